import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from engram.functions.lexicon import ENGLISH, LexiconScorer
from engram.operators import classify, graph, importance, metrics, passages, recurrence, retention, search, sessions

ENTRY = "id string, content string, timestamp bigint, kind string, scope string, session_id string, token_count bigint, metadata string"


def entries(spark, *rows):
    """(id, content, timestamp, scope, session_id, token_count)"""
    return spark.createDataFrame([(i, c, t, "m", s, e, n, None) for i, c, t, s, e, n in rows], ENTRY)


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, text string")


def test_words_are_ored_and_operators_are_plain(spark):
    e = entries(spark, ("a", "apple pie", 1, None, None, None), ("b", "banana split", 2, "s", None, None), ("c", "cherry", 3, None, None, None))
    got = search.bm25(search.Index.build(e), asked(spark, "apple AND banana", '"cherry" id:x -(', "zebra", "")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [("q0", "a"), ("q0", "b"), ("q1", "c")] and all(r.score > 0 for r in got)
    both = search.Index.build(e).postings.exceptAll(search.Index.counted(e).postings)
    assert both.count() == 0


def test_scope_comes_before_the_cut(spark):
    e = entries(spark, *[(f"x{i}", "term", i, "big", None, None) for i in range(120)], ("y", "term", 0, "small", None, None))
    assert [r.id for r in search.bm25(search.Index.build(e), asked(spark, "term"), scope="small").collect()] == ["y"]
    assert search.bm25(search.Index.build(e), asked(spark, "term")).count() == 50


def test_index_on_disk(spark, tmp_path):
    e = entries(spark, ("a", "apple apple pie", 1, None, None, None), ("b", "pie", 2, None, None, None))
    idx = search.Index.build(e)
    want = [tuple(r) for r in search.bm25(idx, asked(spark, "apple pie")).collect()]
    kept = search.Index.write(e, str(tmp_path / "i"))
    assert [tuple(r) for r in search.bm25(kept, asked(spark, "apple pie")).collect()] == want
    assert kept.postings.exceptAll(idx.postings).isEmpty() and idx.postings.exceptAll(kept.postings).isEmpty()


@pytest.mark.parametrize("scope", [None, "s1"])
def test_tables_of_queries_as_single_ones(spark, tmp_path, monkeypatch, scope):
    rng = random.Random(5)
    word = lambda: f"w{min(rng.randint(0, 40), rng.randint(0, 40))}"
    e = entries(spark, *[(f"d{i:03}", " ".join(word() for _ in range(rng.randint(0, 30))) + " " + "x" * 40, i, f"s{i % 3}", None, None) for i in range(120)])
    q = asked(spark, *[" ".join(word() for _ in range(rng.randint(0, 6))) for _ in range(12)], "w1 w1 w2", "unknown", "x" * 40)
    rows = lambda index: [tuple(r) for r in search.bm25(index, q, k=7, scope=scope).orderBy("query_id", "rank").collect()]
    want = rows(search.Index.counted(e))
    kept = search.Index.write(e, str(tmp_path / "i"))
    assert rows(kept) == want and want
    monkeypatch.setattr(search, "FEW_TERMS", 0)  # as a matrix
    assert rows(kept) == want
    monkeypatch.setattr(search, "PAIRS", 0)  # by joins
    assert rows(kept) == want


def test_everything(spark):
    e = entries(spark, *[(f"x{i:03}", "t", i, None, None, None) for i in range(60)])
    got = search.lexical(e, asked(spark, "*", "t")).where("query_id = 'q0'").orderBy("rank").collect()
    assert len(got) == 50 and got[0].id == "x059" and {r.score for r in got} == {1.0}


def test_fusion_decay_boost_and_ties(spark):
    e = entries(spark, ("a", "word", 0, None, None, 1), ("b", "word noted", 1_000, None, None, 1), ("c", "other", 1_000, None, None, 1))
    v = spark.createDataFrame([("c", None, [1.0, 0.0]), ("a", None, [0.9, 0.1])], "id string, scope string, embedding array<float>")
    q = spark.createDataFrame([("q", "word", [1.0, 0.0])], "query_id string, text string, embedding array<float>")
    got = search.assemble(e, q, 100, 1_000, embeddings=v, scorer=LexiconScorer(ENGLISH), half_life=1_000).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "c", "a"]
    score = {r.id: r.score for r in got}
    assert score["a"] == pytest.approx((1 / 61 + 1 / 62) * 0.5) and score["b"] == pytest.approx((1 / 62 + 1 / 111) * 1.05) and score["c"] == pytest.approx(1 / 111 + 1 / 61)
    assert search.assemble(e, q.withColumn("text", F.lit("none")).drop("embedding"), 100, 1_000).count() == 0


def test_vectors_shared_and_in_blocks(spark):
    rng = random.Random(5)
    vs = [(f"v{i}", None, [float(rng.randint(-2, 2)) for _ in range(3 if i % 9 else 2)] if i % 7 else None) for i in range(60)]
    v = spark.createDataFrame([*vs, ("zero", None, [0.0, 0.0, 0.0])], "id string, scope string, embedding array<float>")
    q = spark.createDataFrame([(i, [float(rng.randint(-2, 2)) for _ in range(2)] + [1.0]) for i in range(9)] + [(9, None), (10, [1.0, 1.0])], "query_id int, embedding array<float>")

    def cosine(a, b):
        norm = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return round(1 - sum(x * y for x, y in zip(a, b)) / norm, 9) if len(a) == len(b) and norm else None

    want = {}
    for r in q.where("embedding is not null").collect():
        ds = sorted(((cosine(x.embedding, r.embedding), x.id) for x in v.where("embedding is not null").collect()), key=lambda p: (p[0] is None, p[0] or 0, p[1]))
        want |= {(r.query_id, n): (i, d) for n, (d, i) in enumerate(ds[:8], 1)}
    for shared, block in ((100, 1), (0, 13)):
        got = {(r.query_id, r.rank): (r.id, r.distance) for r in search.semantic(v, q, 8, shared=shared, block=block).collect()}
        assert {x: y[0] for x, y in got.items()} == {x: y[0] for x, y in want.items()}
        assert all(got[x][1] == pytest.approx(want[x][1]) if want[x][1] is not None else got[x][1] is None for x in want)
    assert search.semantic(v.limit(0), q).count() == 0 and search.semantic(v, q.limit(0)).count() == 0


def walk(costs, budget):
    used, kept = 0, []
    for i, c in enumerate(costs):
        if used + c <= budget:
            used += c
            kept.append((i, used))
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_packing_is_a_greedy_walk(spark, seed):
    rng = random.Random(seed)
    groups = {g: [rng.choice([0, 1, 2, 3, 7, 7, 20, 60]) for _ in range(rng.randint(0, 60))] for g in range(5)}
    df = spark.createDataFrame([(g, i, c) for g, cs in groups.items() for i, c in enumerate(cs)], "g int, i int, cost int")
    got = search.pack(df, 50, ["g"], [F.col("i")]).orderBy("g", "place").collect()
    assert [(r.g, r.i, r.used) for r in got] == [(g, i, u) for g, cs in groups.items() for i, u in walk(cs, 50)]


def runs(times, gap):
    out, start, before = {}, None, None
    for t in sorted(times):
        if before is None or t - before > gap:
            start = t
        out[t] = start
        before = t
    return out


@pytest.mark.parametrize("gap,slice_", [(60, 100), (0, 7), (30, 86_400), (500, 90)])
def test_gaps_across_slices(spark, gap, slice_):
    rng = random.Random(gap)
    times = {g: [rng.randint(-2000, 3000) for _ in range(60)] for g in ("a", None)}
    df = spark.createDataFrame([(g, t) for g, ts in times.items() for t in ts], "g string, timestamp bigint")
    got = {(r.g, r.timestamp): r.session_start for r in sessions.gap_starts(df, gap, ["g"], slice_).collect()}
    assert got == {(g, t): s for g, ts in times.items() for t, s in runs(ts, gap).items()}
    alone = {r.timestamp: r.session_start for r in sessions.gap_starts(df, gap, None, slice_).collect()}
    assert alone == runs([t for ts in times.values() for t in ts], gap)


def test_sessions(spark):
    e = entries(spark, ("a", "x", 100, None, None, None), ("b", "x", 160, None, None, None), ("c", "x", 221, None, None, None), ("d", "x", 150, None, "s", None), ("e", "x", 90, None, "", None), ("f", "x", 5, None, "s", None))
    got = sessions.groups(e, 60).orderBy("session_start", "fallback", "session").collect()
    assert [(g.session, [x.id for x in g.entries]) for g in got] == [("s", ["f", "d"]), ("", ["e"]), ("__fallback__100", ["a", "b"]), ("__fallback__221", ["c"])]
    with pytest.raises(ValueError):
        sessions.sessionize(e, -1)


def test_recurrence(spark):
    s = spark.createDataFrame([("1", ["red", "car", "x"]), ("2", ["red", "car", "y"]), ("3", ["z", "y"]), ("4", []), ("5", ["z"])], "session string, tokens array<string>")
    got = {r.term: (r.session_frequency, r.recurrence_score) for r in recurrence.recurrence(s).collect()}
    assert got == {"red car": (2, 0.4), "y": (2, 0.4), "z": (2, 0.4)}
    blocked = {r.term for r in recurrence.recurrence(s, blocked=("red car",)).collect()}
    assert blocked == {"red", "car", "y", "z"} and recurrence.recurrence(s, most_ratio=0.3).count() == 0
    assert spark.createDataFrame([(["a", "b", "a"],)], "t array<string>").select(recurrence.term_counts(F.col("t"))).first()[0] == {"a": 2, "b": 1}


def test_ngrams_cross_entries(spark):
    e = entries(spark, ("a", "green", 1, None, "s", None), ("b", "house", 2, None, "s", None)).withColumn("session", F.col("session_id"))
    got = {r.term for r in recurrence.session_terms(recurrence.session_tokens(e)).collect()}
    assert got == {"green", "house", "green house"}


def test_terms_of_a_session_are_counted_within_its_row(spark):
    own = spark.createDataFrame([("s", ["b", "a", "b", "a", "b"]), ("t", ["x"]), ("none", []), ("null", None)], "session string, tokens array<string>")
    got = recurrence.session_terms(own)
    want = {("s", "a", 2), ("s", "b", 3), ("s", "b a", 2), ("s", "a b", 2), ("s", "b a b", 2), ("s", "a b a", 1), ("t", "x", 1)}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan  # a table of all terms of a task's sessions


def test_passages(spark):
    body = " ".join(f"S{i} has{' Fox' if i in (1, 2, 12) else ''} it." for i in range(14))
    e = spark.createDataFrame([("1", body), ("2", "Foxes run."), ("3", "Foxes run."), ("4", "nothing")], "entry_id string, content string")
    terms = spark.createDataFrame([("fox",), ("FOX",), ("has",)], "term string").where("term <> 'has'")
    got = passages.extract(e, terms).orderBy("entry_id", "first").collect()
    assert [(r.entry_id, r.first, r.last) for r in got] == [("1", 0, 3), ("1", 11, 13), ("2", 0, 0)] and got[0].triggering_terms == ["FOX", "fox"]
    assert got[1].text == "S11 has it.\nS12 has Fox it.\nS13 has it."
    long = passages.extract(e, spark.createDataFrame([("has",), ("fox",)], "term string"), most=6).where("entry_id = '1'").orderBy("first").collect()
    assert [(r.first, r.last, r.triggering_terms) for r in long] == [(0, 5, ["fox", "has"]), (6, 11, ["has"]), (12, 13, ["fox", "has"])]
    chunked = passages.extract(e.where("entry_id = '1'"), spark.createDataFrame([("s2 has",), ("s12",)], "term string"), context=9, most=3).orderBy("first").collect()
    assert [(r.first, r.triggering_terms) for r in chunked] == [(0, ["s2 has"]), (12, ["s12"])]
    assert passages.extract(e, terms.limit(0)).count() == 0 and passages.extract(e, terms, dedupe=False).count() == 4


def test_many_terms_are_joined(spark):
    e = spark.createDataFrame([("1", "Foxes run ab. An A\U0001f600 fox"), ("2", "ox"), ("3", "")], "entry_id string, content string")
    terms = spark.createDataFrame([("fox",), ("foxes r",), ("A",), ("ox",), ("zz",), ("",)], "term string")
    few, many = ({(r.entry_id, r.n, r.pos): r.terms for r in passages.sentence_hits(e, terms, most=n).collect()} for n in (100, 1))
    assert few == many == {("1", 2, 0): ["A", "fox", "foxes r", "ox"], ("1", 2, 1): ["A", "fox", "ox"], ("2", 1, 0): ["ox"]}


def kinds(spark, *rows):
    """(text, terms, session, timestamp)"""
    df = spark.createDataFrame([(i, t, w, s, n) for i, (t, w, s, n) in enumerate(rows)], "ord int, text string, triggering_terms array<string>, session_id string, timestamp bigint")
    return classify.classify(df).orderBy("ord").collect()


def test_categories(spark):
    got = kinds(
        spark,
        ("Do not use redis", ["redis"], "1", 1), ("Should we not use redis?\"", ["redis"], "1", 1), ("not one two three four redis", ["redis"], "1", 1), ("not one two three four five redis", ["redis"], "1", 1),
        ("The Server IP: is 10.0.0.1", ["ip"], "1", 1), ("the server is set to blue mode for good and all of it", [], "1", 2), ("is now open", [], "1", 3), ("We chose Alpha instead of Beta because of cost", ["z"], "1", 5), ("so Beta went with Alpha therefore", ["z"], "1", 9), ("better because", ["b", "c"], "1", 9), ("better because", ["b"], "1", 9), ("", [], "1", 0), ("x=1 and more", [], "1", 0),
    )
    assert [r.categories for r in got[:4]] == [["corrective"], [], ["corrective"], []]
    assert (got[4].entity, got[4].value) == ("the server", "is 10.0.0.1")
    assert (got[5].entity, got[5].value) == ("the server", "blue mode for good and all")
    assert got[6].categories == [] and got[7].categories == ["decisive"] and tuple(got[7].entity_pair) == ("Alpha", "Beta")
    assert [r.superseded for r in got[4:10]] == [True, False, False, True, False, False]
    assert tuple(got[9].entity_pair) == ("b", "c") and got[10].entity_pair is None and got[10].categories == ["decisive"]
    assert got[11].categories == [] and (got[12].entity, got[12].value) == ("x", "1 and more")


def test_state_operators_fall_back():
    assert classify.state_of("is set to x") == ("is", "x") and classify.state_of("12 -> 5 then cat -> dog") == ("- 5 then cat", "dog")
    assert classify.state_of("report: a") is None and classify.state_of("the port: 80") == ("the", "80") and classify.state_of("-> x") is None and classify.state_of("a b c d e := f") == ("b c d e", "f")


def plain_pairs(rows, w=classify.WORDS):
    import re

    def grams(t):
        ws = [x for x in (re.sub("[^a-z0-9]", "", y.lower()) for y in t.split()) if x]
        return set(zip(ws, ws[1:]))

    said = lambda t: set(classify._words(t.lower())) & set(w.confirmation)
    return {(i, j) for (i, a), (j, b) in itertools.combinations(rows, 2) if said(a) & said(b) and grams(a) and grams(b) and len(grams(a) & grams(b)) / min(len(grams(a)), len(grams(b))) > w.overlap}


def test_repeated_points(spark):
    rng = random.Random(7)
    base = [rng.choices("alpha beta gamma delta kappa sigma omega rho".split(), k=9) for _ in range(6)]
    rows = []
    for i in range(80):
        ws = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            ws[rng.randrange(9)] = rng.choice(["x", "y", "z"])
        rows.append((i, " ".join([rng.choice(["yes", "agreed,", "maybe"]), *ws[: rng.randint(1, 9)]])))
    d = spark.createDataFrame([(i, t, f"s{i % 4}") for i, t in rows], "ord int, text string, session_id string")
    want = plain_pairs(rows)
    assert {tuple(r) for r in classify.repeated_pairs(d).collect()} == want and len(want) > 20
    parent = {i: i for i, _ in rows}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in want:
        parent[root(a)] = root(b)
    size = {}
    for a in {x for p in want for x in p}:
        size.setdefault(root(a), set()).add(a % 4)
    assert {r.ord for r in classify.reinforcing(d).collect()} == {a for p in want for a in p if len(size[root(a)]) >= 3}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)]
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: root(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_importance(spark):
    p = spark.createDataFrame([(1, "abcd", ["x", "y"], ["corrective"], 100, False), (2, "abcd", ["none"], [], 100, False), (3, "abcd", ["x"], ["stateful"], 100 - 604_800, False), (4, "abcd", ["x"], [], 100, True)], "ord int, text string, triggering_terms array<string>, categories array<string>, timestamp bigint, superseded boolean")
    r = spark.createDataFrame([("x", 3, 0.3), ("y", 2, 0.5)], "term string, session_frequency bigint, recurrence_score double")
    scored = importance.score(p, r, 100)
    got = {x.ord: x for x in scored.collect()}
    assert set(got) == {1, 2, 3} and got[1].importance_score == pytest.approx(0.75) and got[1].session_frequency == 3 and got[2].importance_score == 0 and got[3].importance_score == pytest.approx(0.3 * 1.2 * 0.5)
    assert [x.ord for x in importance.pack_segments(scored, 2).orderBy("place").collect()] == [1, 3]


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("q", "b", 3), ("q", "c", 4), ("r", "a", 1)], "query_id string, item string, rank int")
    gold = spark.createDataFrame([("q", "b"), ("q", "z"), ("q", "b")], "query_id string, item string")
    q = spark.createDataFrame([("q",), ("r",)], "query_id string")
    got = {(r.query_id, r.k): (r.recall, r.ndcg) for r in metrics.recall_and_ndcg(ranked, gold, q, (1, 3)).collect()}
    assert got["q", 1] == (0.0, 0.0) and got["q", 3][0] == 0.5 and got["q", 3][1] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3))) and got["r", 1] == (None, None)
    budget = {r.query_id: r.recall for r in metrics.recall_at_budget(ranked, gold, q).collect()}
    assert budget == {"q": 0.5, "r": None}
    v = spark.createDataFrame([("x", 1.0), ("x", None), ("y", None)], "t string, recall double")
    assert {(r.t, r.level): r.recall for r in metrics.mean_rollup(v, "t", "recall").collect()} == {(None, "all"): 1.0, ("x", "group"): 1.0, ("y", "group"): 0.0}


@pytest.mark.parametrize("most", [0, 1, 7, 49, 50, 99])
def test_newest(spark, most):
    rng = random.Random(most)
    rows = [(i, rng.choice([5, 5, 6, rng.randint(-200_000, 400_000)])) for i in range(50)]
    got = {r.id for r in retention.newest(spark.createDataFrame(rows, "id int, timestamp bigint"), most).collect()}
    assert got == {i for i, _ in sorted(rows, key=lambda r: (-r[1], -r[0]))[:most]}


def test_python_takes_batches_in_bounded_pieces():
    import pyarrow as pa

    rows = 2_000
    own = pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array(["s"] * rows), pa.array([[f"w{i % 7}", "x", "x"] * 400 for i in range(rows)])], names=["id", "scope", "ts"])
    parts = list(search._count_terms([own]))
    assert len(parts) >= rows * 1_200 // search.ITEMS_AT_ONCE and sum(p.num_rows for p in parts) == rows
    assert [r for p in parts for r in p.column(2).to_pylist()] == [1_200] * rows
    assert all(dict(zip(t, n)) == {f"w{i % 7}": 400, "x": 800} for p in parts for i, t, n in zip(p.column(0).to_pylist(), p.column(3).to_pylist(), p.column(4).to_pylist()))


def test_long_phrases_are_spread_over_several_automata(spark):
    docs = spark.createDataFrame([("a", "one two three four"), ("b", "three"), ("c", None)], "item string, text string")
    phrases = spark.createDataFrame([(1, "one two"), (2, "three"), (3, "four five"), (4, "")], "phrase_id int, phrase string")
    got = passages.phrase_hits(docs, phrases, chars=6)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1), ("a", 2), ("b", 2)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") > 1


def test_single_precision_finds_the_nearest_with_their_ties():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    x = rng.normal(size=(3_000, 16))
    x[100:180], x[200:260] = x[7], x[8] * (1 + 1e-7)  # more equal ones than are asked for; equal but for the ninth place
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    ids = pa.array([f"{i:05}" for i in range(3_000)])[::-1]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 16, dtype=np.int32)), pa.array(x.ravel()))
    got = search.nearest(ids, lists, ids.slice(0, 60), lists.slice(0, 60), 20)
    names, dist = np.array(ids.to_pylist()), np.round(1 - unit[:60] @ unit.T, 9)
    want = [(names[q], names[i], dist[q, i]) for q in range(60) for i in np.lexsort((names, dist[q]))[:20]]
    assert list(zip(*(c.to_pylist() for c in got.columns))) == want
    r, c, _ = search._near(unit, unit[:60], 20)
    assert len(r) < 60 * 400  # few of 3,000 are compared in double precision


def test_many_terms_are_not_collected_as_rows(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    e = spark.createDataFrame([("a", "Deploy the x9 now. Nothing here.\nWe deployed on Friday!"), ("b", "so be it")], "entry_id string, content string")
    terms = spark.createDataFrame([("deploy",), ("Deploy",), ("on friday",), ("x",), ("here",), ("zz",), ("",), (None,)], "term string")
    collect = DataFrame.collect

    def few(self):
        rows = collect(self)
        assert len(rows) < 3 or "terms" in self.columns  # results, not the terms
        return rows

    monkeypatch.setattr(DataFrame, "collect", few)
    got = {how: sorted((r.entry_id, r.n, r.pos, tuple(r.terms)) for r in passages.sentence_hits(e, terms, **how_).collect()) for how, how_ in (("one", {}), ("terms", {"most": 2}), ("chars", {"chars": 8}))}
    assert got["one"] == [("a", 3, 0, ("Deploy", "deploy", "x")), ("a", 3, 1, ("here",)), ("a", 3, 2, ("Deploy", "deploy", "on friday"))]
    assert got["terms"] == got["one"] == got["chars"]


def test_repeated_pairs_keep_hashes_of_word_pairs_only(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(classify, "checkpointed", lambda df: kept.append(df) or df)
    own = spark.createDataFrame([(1, "confirmed the plan is good to go"), (2, "confirmed: the plan is good to go now"), (3, "confirmed something else")], "ord int, text string")
    assert [tuple(r) for r in classify.repeated_pairs(own).collect()] == [(1, 2)]
    strings = [(c, t) for df in kept for c, t in df.dtypes if "string" in t and c != "said"]
    assert strings == []

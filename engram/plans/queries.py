"""The registered queries over whole tables, each with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions import scoring, text
from engram.functions.distill import merge_all
from engram.functions.lexicon import AFFIRMED, ENGLISH, NEGATED, NEGATORS, LexiconScorer, normal
from engram.functions.prefilter import strip_artifacts
from engram.functions.scrub import scrub, scrub_sql
from engram.operators import classify, importance, metrics, passages, recurrence, retention, search, sessions
from engram.plans import tables
from engram.plans.tables import EPOCH, NOW, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_ITEMS = "[^\\p{L}\\p{N}]+"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# -- retrieval


def _terms_sql(c: str) -> str:
    return f"list_filter(string_split_regex(lower({c}), '{_ITEMS}'), lambda w: w <> '' AND strlen(w) < 40)"


def _bm25_sql(where: str = "") -> str:
    return f"""d AS (SELECT {tables.DOCUMENTS} FROM documents), t AS (SELECT id, scope, {_terms_sql('content')} AS ts FROM d), dl AS (SELECT id, scope, len(ts) AS dl FROM t),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT query_id, term, count(*) AS qn FROM (SELECT item_id AS query_id, unnest({_terms_sql('text')}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT query_id, id, round(sum(qn * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (id) CROSS JOIN st {where} GROUP BY ALL),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 50)"""


def _scored(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", "score", "rank")


@query(f"WITH {_bm25_sql()} SELECT query_id, id, score, rank FROM w")
def bm25_topk(spark, sf):
    return _scored(search.bm25(tables.index(spark, sf), tables.benchmark(spark, sf)))


@query(f"WITH {_bm25_sql("WHERE scope = 'fr'")} SELECT query_id, id, score, rank FROM w")
def bm25_scoped(spark, sf):
    return _scored(search.bm25(tables.index(spark, sf), tables.benchmark(spark, sf), scope="fr"))


@query(f"WITH e AS (SELECT {tables.TURNS} FROM conversations) SELECT id, timestamp, 1.0 AS score, row_number() OVER (ORDER BY timestamp DESC, id) AS rank FROM e QUALIFY rank <= 50")
def match_all(spark, sf):
    entries = tables.turns(spark, sf)
    found = search.match_all(entries, spark.createDataFrame([("q", search.MATCH_ALL)], "query_id string, text string"))
    return found.join(entries.select("id", "timestamp"), "id").select("id", "timestamp", "score", "rank")


_DIST = "1 - list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"


@query(f"""WITH p AS (SELECT q.vec_id AS query_id, x.vec_id AS id, round({_DIST.format(a='x.embedding', b='q.embedding')}, 9) AS distance FROM embeddings x CROSS JOIN embeddings q)
SELECT query_id, id, CASE WHEN distance = 0 THEN 0 ELSE distance END AS distance, greatest(1 - distance, 0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p QUALIFY rank <= 50""")
def vector_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    found = search.semantic(rows.select(F.col("vec_id").alias("id"), "embedding"), rows.select(F.col("vec_id").alias("query_id"), "embedding"))
    return found.select("query_id", "id", F.when(F.col("distance") == 0, 0.0).otherwise(F.col("distance")).alias("distance"), "score", "rank")


_FUSED = f"""{_bm25_sql()}, vp AS (SELECT i.item_id AS query_id, cast(x.vec_id AS string) AS id, round({_DIST.format(a='x.embedding', b='q.embedding')}, 9) AS distance FROM embeddings x JOIN documents y ON y.doc_id = x.vec_id CROSS JOIN benchmark i JOIN embeddings q ON q.vec_id = i.item_id),
v AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM vp QUALIFY rank <= 50),
f AS (SELECT coalesce(w.query_id, v.query_id) AS query_id, coalesce(w.id, v.id) AS id, w.rank AS word_rank, v.rank AS vector_rank, 1.0::DOUBLE / (60 + coalesce(w.rank, 51)) + 1.0::DOUBLE / (60 + coalesce(v.rank, 51)) AS rrf FROM w FULL JOIN v ON w.query_id = v.query_id AND w.id = v.id)"""
_RANKED = f"""{_FUSED}, z AS (SELECT query_id, f.id, word_rank, vector_rank, timestamp, round(rrf * pow(0.5, greatest({NOW} - timestamp, 0) / 259200.0::DOUBLE), 12) AS score, ceil(strlen(content) / 4.0)::BIGINT AS cost FROM f JOIN d ON f.id = d.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, word_rank ASC NULLS LAST, vector_rank ASC NULLS LAST, id) AS rank FROM z)"""


def _fused(spark, sf):
    words = search.bm25(tables.index(spark, sf), tables.benchmark(spark, sf))
    return search.fuse(words, search.semantic(tables.document_embeddings(spark, sf), tables.benchmark(spark, sf)))


@query(f"WITH {_FUSED} SELECT query_id, id, word_rank, vector_rank, round(rrf, 9) AS rrf FROM f")
def rrf_fusion(spark, sf):
    return _fused(spark, sf).select("query_id", "id", "word_rank", "vector_rank", F.round("rrf", 9).alias("rrf"))


def _ranked(spark, sf):
    return search.rank(_fused(spark, sf), tables.documents(spark, sf), NOW)


@query(f"WITH {_RANKED} SELECT query_id, id, score, rank FROM ranked")
def recency_rank(spark, sf):
    return _ranked(spark, sf).select("query_id", "id", "score", "rank")


BUDGET = 2_000
_PACKED = f"""{_RANKED}, p AS (SELECT query_id, rank, CASE WHEN cost <= {BUDGET} THEN cost ELSE 0 END AS used, cost <= {BUDGET} AS kept FROM ranked WHERE rank = 1
UNION ALL SELECT r.query_id, r.rank, p.used + CASE WHEN p.used + r.cost <= {BUDGET} THEN r.cost ELSE 0 END, p.used + r.cost <= {BUDGET} FROM p JOIN ranked r ON r.query_id = p.query_id AND r.rank = p.rank + 1),
packed AS (SELECT p.query_id, r.id, p.rank, p.used, row_number() OVER (PARTITION BY p.query_id ORDER BY p.rank) AS place FROM p JOIN ranked r ON r.query_id = p.query_id AND r.rank = p.rank WHERE kept)"""


def _assembled(spark, sf):
    return search.assemble(tables.documents(spark, sf), tables.benchmark(spark, sf), BUDGET, NOW, embeddings=tables.document_embeddings(spark, sf), index=tables.index(spark, sf))


@query(f"WITH RECURSIVE {_PACKED} SELECT query_id, id, rank, used, place FROM packed")
def assemble_budget(spark, sf):
    return _assembled(spark, sf).select("query_id", "id", "rank", "used", "place")


# -- evaluation

_GOLD = "gold AS (SELECT i.item_id AS query_id, cast(x.doc_id AS string) AS item FROM documents x JOIN benchmark i ON contains(x.text, i.text))"
_EACH = f"""{_GOLD}, gs AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1), grid AS (SELECT item_id AS query_id, k FROM benchmark CROSS JOIN (SELECT unnest([1, 3, 5, 10]) AS k)),
m AS (SELECT g.query_id, g.k, any_value(gs.n) AS n, count(h.rank) AS found, coalesce(sum(1.0::DOUBLE / log2(h.rank + 1)), 0.0) AS dcg FROM grid g LEFT JOIN gs ON gs.query_id = g.query_id
LEFT JOIN (SELECT w.query_id, w.rank FROM w JOIN gold ON gold.query_id = w.query_id AND gold.item = w.id) h ON h.query_id = g.query_id AND h.rank <= g.k GROUP BY 1, 2),
each AS (SELECT query_id, k, found / n AS recall, CASE WHEN n IS NOT NULL THEN dcg / list_sum(list_transform(range(1, least(k, n) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) END AS ndcg FROM m)"""


def _each(spark, sf):
    found = search.bm25(tables.index(spark, sf), tables.benchmark(spark, sf)).withColumnRenamed("id", "item")
    return metrics.recall_and_ndcg(found, tables.gold(spark, sf), tables.benchmark(spark, sf))


@query(f"WITH {_bm25_sql()}, {_EACH} SELECT query_id, k, round(recall, 9) AS recall FROM each")
def recall_at_k(spark, sf):
    return _each(spark, sf).select("query_id", "k", F.round("recall", 9).alias("recall"))


@query(f"WITH {_bm25_sql()}, {_EACH} SELECT query_id, k, round(ndcg, 9) AS ndcg FROM each")
def ndcg_at_k(spark, sf):
    return _each(spark, sf).select("query_id", "k", F.round("ndcg", 9).alias("ndcg"))


@query(f"""WITH RECURSIVE {_PACKED}, {_GOLD}, gs AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1), h AS (SELECT gold.query_id, count(*) AS found FROM gold JOIN packed ON packed.query_id = gold.query_id AND packed.id = gold.item GROUP BY 1)
SELECT i.item_id AS query_id, round(CASE WHEN n > 0 THEN coalesce(found, 0) / n END, 9) AS recall FROM benchmark i LEFT JOIN gs ON gs.query_id = i.item_id LEFT JOIN h ON h.query_id = i.item_id""")
def recall_at_budget(spark, sf):
    packed = _assembled(spark, sf).withColumnRenamed("id", "item")
    return metrics.recall_at_budget(packed, tables.gold(spark, sf), tables.benchmark(spark, sf)).select("query_id", F.round("recall", 9).alias("recall"))


@query(f"""WITH {_bm25_sql()}, {_EACH} SELECT k, CASE WHEN grouping(k) = 1 THEN 'all' ELSE 'group' END AS level, count(*) AS n, round(coalesce(avg(recall), 0), 9) AS recall, round(coalesce(avg(ndcg), 0), 9) AS ndcg FROM each GROUP BY ROLLUP (k)""")
def metrics_rollup(spark, sf):
    return metrics.mean_rollup(_each(spark, sf), "k", "recall", "ndcg").select("k", "level", "n", F.round("recall", 9).alias("recall"), F.round("ndcg", 9).alias("ndcg"))


# -- storage


@query(f"SELECT event_id, {scrub_sql('t')} AS scrubbed FROM (SELECT event_id, {tables.SECRETS} AS t FROM events)")
def scrub_secrets(spark, sf):
    return table(spark, sf, "events").select("event_id", scrub(F.expr(tables.SECRETS)).alias("scrubbed"))


@query("SELECT doc_id, ceil(strlen(text) / 4.0)::BIGINT AS tokens FROM documents")
def estimate_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


_EVENTS = "SELECT event_id AS id, epoch(ts)::BIGINT AS timestamp, user_id, event_type FROM events"
CAP = 3_000


def _events(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("timestamp"), "user_id", "event_type")


@query(f"WITH e AS (SELECT event_id AS id, floor(epoch(ts))::BIGINT AS timestamp FROM events) SELECT id, timestamp FROM e QUALIFY row_number() OVER (ORDER BY timestamp DESC, id DESC) <= {CAP}")
def retention_newest(spark, sf):
    return retention.newest(_events(spark, sf).select("id", "timestamp"), CAP)


@query("""WITH n AS (SELECT o_custkey AS id, o_orderstatus || '-' || o_orderkey AS content FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT id, content FROM n UNION ALL SELECT c_custkey AS id, c_name AS content FROM customer WHERE c_custkey NOT IN (SELECT id FROM n)""")
def upsert_latest(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("content"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.concat_ws("-", "o_orderstatus", F.col("o_orderkey").cast("string")).alias("content"), "o_orderkey")
    return retention.upsert(old, new, ordinal="o_orderkey")


@query(f"WITH e AS (SELECT {tables.TURNS} FROM conversations) SELECT id, scope, content FROM e WHERE scope IS DISTINCT FROM 's1'")
def clear_scope(spark, sf):
    return retention.clear_scope(tables.turns(spark, sf), "s1").select("id", "scope", "content")


@query("SELECT cast(doc_id AS string) AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def unembedded(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"))
    return retention.unembedded(tables.documents(spark, sf), vectors).select("id")


@query("SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedupe_first(spark, sf):
    return retention.latest(table(spark, sf, "documents").select("doc_id", "text"), "text", "doc_id", first=True)


# -- sessions and recurring terms

GAP_HOURS, GAP_SECONDS = 6, 300


def _sessions_sql(gap: int, by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    key = f"{by}, " if by else ""
    return f"""WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER ({part}ORDER BY t, event_id) <= {gap} THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER ({part}ORDER BY t, event_id) AS s FROM g) SELECT {key}min(t) AS session_start, max(t) AS session_end, count(*) AS n FROM s GROUP BY {key}s"""


@query(_sessions_sql(GAP_HOURS * 3600, "user_id"))
def sessionize_gap(spark, sf):
    own = sessions.gap_starts(_events(spark, sf), GAP_HOURS * 3600, ["user_id"])
    return own.groupBy("user_id", "session_start").agg(F.max("timestamp").alias("session_end"), F.count("*").alias("n"))


@query(_sessions_sql(GAP_SECONDS, ""))
def sessionize_timeline(spark, sf):
    own = sessions.gap_starts(_events(spark, sf), GAP_SECONDS)
    return own.groupBy("session_start").agg(F.max("timestamp").alias("session_end"), F.count("*").alias("n"))


_STOP = _list(text.STOP_WORDS)


def _tokens_sql(c: str) -> str:
    low = f"translate({c}, '{text.UPPER}', '{text.LOWER}')"
    return f"list_filter(list_transform(string_split_regex({low}, '[ \\t\\n\\f\\r]+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: w <> '' AND NOT list_contains({_STOP}, w))"


def _grams_sql(t: str) -> str:
    more = "".join(f" || list_transform(range(1, len({t}) - {n - 2}), lambda i: array_to_string({t}[i:i+{n - 1}], ' '))" for n in (2, 3))
    return f"({t}{more})"


@query(f"SELECT lang, term, count(*) AS cnt FROM (SELECT lang, unnest({_tokens_sql('text')}) AS term FROM documents) GROUP BY ALL")
def tokenize_terms(spark, sf):
    own = table(spark, sf, "documents").select("lang", text.tokenize(F.col("text")).alias("tokens"))
    return recurrence.count_terms(own, "tokens", "lang")


_SESSION_TOKENS = f"""t AS (SELECT conv_id, turn, {_tokens_sql('text')} AS ts FROM conversations), s AS (SELECT conv_id, flatten(list(ts ORDER BY turn)) AS ts FROM t GROUP BY conv_id), g AS MATERIALIZED (SELECT conv_id, unnest({_grams_sql('ts')}) AS term FROM s)"""


def _session_tokens(spark, sf):
    return recurrence.session_tokens(tables.turns(spark, sf), "session_id", "id", None)


@query(f"WITH {_SESSION_TOKENS} SELECT cast(conv_id AS string) AS session_id, term, count(*) AS cnt FROM g GROUP BY ALL")
def ngram_counts(spark, sf):
    return recurrence.session_terms(_session_tokens(spark, sf), "session_id")


_RECURRENCE = f"""{_SESSION_TOKENS}, c AS (SELECT term, count(DISTINCT conv_id) AS session_frequency FROM g GROUP BY 1), k AS (SELECT term, session_frequency, session_frequency / (SELECT count(*) FROM s) AS recurrence_score FROM c WHERE session_frequency >= 2),
b AS MATERIALIZED (SELECT * FROM k WHERE recurrence_score <= 0.8), parts AS (SELECT DISTINCT unnest(string_split(term, ' ')) AS term FROM b WHERE contains(term, ' ')), rec AS (SELECT b.* FROM b ANTI JOIN parts USING (term))"""


@query(f"WITH {_RECURRENCE} SELECT term, session_frequency, round(recurrence_score, 9) AS recurrence_score, row_number() OVER (ORDER BY recurrence_score DESC, session_frequency DESC, term) AS rank FROM rec")
def recurring_terms(spark, sf):
    found = recurrence.ranked(recurrence.recurrence(_session_tokens(spark, sf), session="session_id"))
    return found.withColumn("recurrence_score", F.round("recurrence_score", 9))


# -- passages

_PATH = r"^(?:/|~/|\./|\.\./|[A-Za-z]:[\\/]|build/|crates/|dist/|docs/|extension/|lib/|node_modules/|scripts/|src/|target/|test/|tests/)"
_WRAP = r"""["''`,.;:()\[\]{}<>]"""


@query(f"""WITH RECURSIVE c AS (SELECT conv_id, turn, string_split_regex({tables.TRANSCRIPTS}, '\\r?\\n') AS ls FROM conversations), l AS (SELECT conv_id, turn, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM c),
b AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS bare FROM l),
f AS (SELECT *, list_filter(string_split_regex(line, '[ \\t\\n\\f\\r]+'), lambda w: w <> '') AS ws, (strlen(bare) > 100 AND regexp_matches(bare, '^(\\{{|\\[\\s*[{{"\\[0-9])')) OR bare IN ('[user]', '[assistant]', '[tool_result]') OR regexp_matches(bare, '^(?i:human:|assistant:)') OR lower(bare) = 'user:'
OR regexp_matches(bare, '^((ba|z)?sh)?\\$ [0-9A-Za-z./~(-]') OR (contains(bare, '$ ') AND contains(string_split(bare, '$ ')[1], '@') AND contains(string_split(bare, '$ ')[1], ':') AND regexp_matches(bare[length(string_split(bare, '$ ')[1]) + 3], '[0-9A-Za-z./~(-]')) AS gone FROM b),
x AS (SELECT *, list_filter(ws, lambda w: NOT regexp_matches(regexp_replace(w, '^{_WRAP}+|{_WRAP}+$', '', 'g'), '{_PATH}')) AS kept FROM f),
y AS (SELECT conv_id, turn, i, bare, CASE WHEN gone THEN '' WHEN len(kept) < len(ws) THEN array_to_string(kept, ' ') WHEN bare = '' THEN '' ELSE line END AS txt FROM x),
r AS (SELECT conv_id, turn, 0::BIGINT AS i, false AS tool, false AS fence, ''::VARCHAR AS out FROM c UNION ALL SELECT y.conv_id, y.turn, y.i,
CASE WHEN r.tool THEN bare <> '[tool_result]' ELSE starts_with(bare, '[tool_use') END, CASE WHEN r.tool THEN r.fence WHEN starts_with(bare, '[tool_use') THEN false WHEN r.fence THEN NOT starts_with(bare, '```') ELSE starts_with(bare, '```') END,
CASE WHEN r.tool OR starts_with(bare, '[tool_use') OR r.fence OR starts_with(bare, '```') THEN '' ELSE txt END FROM r JOIN y ON y.conv_id = r.conv_id AND y.turn = r.turn AND y.i = r.i + 1),
o AS (SELECT *, lag(out) OVER (PARTITION BY conv_id, turn ORDER BY i) AS before FROM r WHERE i > 0)
SELECT conv_id, turn, string_agg(out, chr(10) ORDER BY i) AS stripped FROM o WHERE NOT (out = '' AND before IS NOT NULL AND before = '') GROUP BY ALL""")
def prefilter(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", strip_artifacts(F.expr(tables.TRANSCRIPTS)).alias("stripped"))


def _sentences_sql(c: str) -> str:
    line = f"regexp_replace(regexp_replace(trim(regexp_replace(l, '\\r$', '')), '(?i)({'|'.join(text.ABBREVIATIONS)})\\.', '\\1' || chr(2), 'g'), '^$', '')"
    for _ in range(2):
        line = f"regexp_replace({line}, '(^|[^.\\x02])\\.(\\s+)(\\p{{Lu}})', '\\1.' || chr(1) || '\\3', 'g')"
    line = f"regexp_replace({line}, '([!?])(\\s+)(\\p{{Lu}})', '\\1' || chr(1) || '\\3', 'g')"
    return f"list_filter(flatten(list_transform(string_split({c}, chr(10)), lambda l: list_transform(string_split(translate({line}, chr(2), '.'), chr(1)), lambda s: trim(s)))), lambda s: s <> '')"


@query(f"WITH s AS (SELECT doc_id, {_sentences_sql('text')} AS ss FROM documents) SELECT doc_id, generate_subscripts(ss, 1) - 1 AS pos, unnest(ss) AS sentence FROM s")
def sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))


#: Terms to look for: the second word of each benchmark passage.
_WANTED = "SELECT DISTINCT lower(string_split(text, ' ')[2]) AS term FROM benchmark"


@query(f"""WITH terms AS (SELECT term FROM ({_WANTED}) WHERE length(term) >= 5), e AS (SELECT conv_id || '-' || turn AS entry_id, {_sentences_sql('text')} AS ss FROM conversations), x AS (SELECT entry_id, len(ss) AS n, generate_subscripts(ss, 1) - 1 AS pos, unnest(ss) AS s FROM e),
h AS (SELECT entry_id, n, pos, list_sort(list(term)) AS terms FROM x JOIN terms ON contains(lower(s), term) GROUP BY ALL), a AS (SELECT *, greatest(pos - 1, 0) AS a, least(pos + 1, n - 1) AS b FROM h),
r AS (SELECT *, max(b) OVER (PARTITION BY entry_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM a), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY entry_id ORDER BY pos) AS rng FROM r),
g AS (SELECT entry_id, rng, min(a) AS a, max(b) AS b FROM i GROUP BY ALL), p AS (SELECT entry_id, b, CASE WHEN b - a + 1 > 6 THEN 6 ELSE b - a + 1 END AS step, a FROM g), c AS (SELECT entry_id, unnest(range(a, b + 1, step)) AS first, step, b FROM p),
d AS (SELECT entry_id, first, least(first + step - 1, b) AS last FROM c), t AS (SELECT d.entry_id, first, last, array_to_string(list_sort(list_distinct(flatten(list(h.terms)))), ',') AS triggering_terms FROM d JOIN h ON h.entry_id = d.entry_id AND h.pos BETWEEN first AND last GROUP BY ALL),
z AS (SELECT t.*, trim(array_to_string(ss[first+1:last+1], chr(10))) AS text FROM t JOIN e USING (entry_id)) SELECT entry_id, first, last, text, triggering_terms FROM z QUALIFY row_number() OVER (PARTITION BY text ORDER BY entry_id, first) = 1""")
def extract_passages(spark, sf):
    terms = table(spark, sf, "benchmark").select(F.lower(F.get(F.split("text", " "), F.lit(1))).alias("term")).where("length(term) >= 5")
    entries = tables.turns(spark, sf).select(F.col("id").alias("entry_id"), "content")
    return passages.extract(entries, terms).select("entry_id", "first", "last", "text", F.array_join("triggering_terms", ",").alias("triggering_terms"))


# -- wording and classes

_PATTERNS = ", ".join(f"('{normal(p)}', {w})" for ps, w in ((ENGLISH.affirmations, AFFIRMED), (ENGLISH.negations, NEGATED)) for p in ps)


@query(f"""WITH e AS (SELECT event_id, replace(lower({tables.WORDINGS}), '''', '') AS x FROM events), p AS (SELECT * FROM (VALUES {_PATTERNS}) v(p, w)), h AS (SELECT event_id, w, string_split_regex(trim(x[1:strpos(x, p) - 1]), '\\s+')[-3:] AS ws FROM e JOIN p ON contains(x, p)),
b AS (SELECT event_id, sum(w) AS boost FROM h WHERE NOT list_has_any(list_transform(ws, lambda t: regexp_replace(t, '[[:punct:]]+$', '')), {_list(sorted(NEGATORS))}) GROUP BY 1) SELECT event_id, round(coalesce(boost, 0), 9)::DOUBLE AS boost FROM e LEFT JOIN b USING (event_id)""")
def lexicon_boost(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(LexiconScorer(ENGLISH).boost(F.expr(tables.WORDINGS)), 9).alias("boost"))


_WORDS = "list_filter(list_transform(string_split_regex({c}, '\\s+'), lambda w: regexp_replace(regexp_replace(w, '^[^A-Za-z0-9''_:=-]+|[^A-Za-z0-9''_:=-]+$', '', 'g'), '^[:=]+|[:=]+$', '', 'g')), lambda w: w <> '')"
_STATED = f"x AS (SELECT event_id, user_id, event_type, floor(epoch(ts))::BIGINT AS timestamp, {tables.STATEMENTS} AS text FROM events)"


def _stated(spark, sf):
    own = _events(spark, sf)
    return table(spark, sf, "events").select("event_id", F.expr(tables.STATEMENTS).alias("text")).join(own.withColumnRenamed("id", "event_id"), "event_id").withColumn("triggering_terms", F.array("event_type"))


def _statements(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("event_type"), F.expr(tables.STATEMENTS).alias("text"))


@query(f"""WITH {_STATED}, w AS (SELECT event_id, lower(event_type) AS term, text, {_WORDS.format(c='lower(text)')} AS ws FROM x), p AS (SELECT event_id, term, text, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM w),
n AS (SELECT event_id, i FROM p WHERE list_contains({_list(classify.WORDS.negation)}, word)), t AS (SELECT event_id, i FROM p WHERE word = term), c AS (SELECT DISTINCT n.event_id FROM n JOIN t ON n.event_id = t.event_id AND abs(n.i - t.i) <= 5)
SELECT event_id, NOT regexp_matches(text, '\\?["'')\\]}}]*\\s*$') AND event_id IN (SELECT event_id FROM c) AS corrective FROM x""")
def corrective(spark, sf):
    return _statements(spark, sf).select("event_id", classify.is_corrective(F.col("text"), F.array("event_type")).alias("corrective"))


@query(f"""WITH {_STATED}, s AS (SELECT event_id, regexp_extract(lower(text), '(?s)^(.*?)(?:\\bis now\\b|\\bset to\\b|->)(.*)$', ['a', 'b']) AS m FROM x), w AS (SELECT event_id, {_WORDS.format(c='m.a')} AS a, {_WORDS.format(c='m.b')} AS b FROM s)
SELECT event_id, CASE WHEN len(a) > 0 AND len(b) > 0 THEN array_to_string(a[-4:], ' ') END AS entity, CASE WHEN len(a) > 0 AND len(b) > 0 THEN array_to_string(b[1:6], ' ') END AS value FROM w""")
def stateful(spark, sf):
    own = _statements(spark, sf).select("event_id", classify.stateful(F.col("text")).alias("s"))
    return own.select("event_id", "s.entity", "s.value")


def _has_sql(words: tuple[str, ...]) -> str:
    single, many = [w for w in words if " " not in w], [w for w in words if " " in w]
    return f"(list_has_any({_WORDS.format(c='lower(text)')}, {_list(single)}) OR list_bool_or(list_transform({_list(many)}, lambda m: contains(lower(text), m))))"


@query(f"""WITH {_STATED}, c AS (SELECT *, {_has_sql(classify.WORDS.comparison)} AND {_has_sql(classify.WORDS.causal)} AS decisive FROM x), r AS (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS raw FROM c),
n AS (SELECT *, list_distinct(list_filter(raw[2:], lambda w: regexp_matches(w, '^[A-Z]'))) AS d, list_filter(raw[2:], lambda w: regexp_matches(w, '^[A-Z]')) AS names FROM r)
SELECT event_id, decisive, CASE WHEN decisive AND len(d) >= 2 THEN names[1] || '/' || names[2] END AS pair FROM n""")
def decisive(spark, sf):
    kind = classify.is_decisive(F.col("text"))
    pair = classify.entity_pair(F.col("text"), F.array("event_type"))
    return _statements(spark, sf).select("event_id", kind.alias("decisive"), F.when(kind, F.concat_ws("/", pair["left"], pair["right"])).alias("pair"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, floor(epoch(ts))::BIGINT AS t FROM events), a AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS s, row_number() OVER (PARTITION BY least(event_type, 'user ' || user_id), greatest(event_type, 'user ' || user_id) ORDER BY t DESC, event_id DESC) AS p FROM e)
SELECT event_id, s > 1 OR p > 1 AS superseded FROM a""")
def supersede(spark, sf):
    user = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    swap = F.col("id") % 2 == 0
    pair = F.struct(F.when(swap, user).otherwise(F.upper("event_type")).alias("left"), F.when(swap, F.col("event_type")).otherwise(user).alias("right"))
    own = _events(spark, sf).select(F.col("id").alias("ord"), "timestamp", F.array(F.lit("stateful"), F.lit("decisive")).alias("categories"), F.col("user_id").cast("string").alias("entity"), pair.alias("entity_pair"))
    return classify.supersede(own).select(F.col("ord").alias("event_id"), "superseded")


@query("""WITH RECURSIVE x AS (SELECT doc_id, source, list_filter(list_transform(string_split_regex(lower('Confirmed ' || text), '\\s+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: w <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i+1]))) AS gram FROM x), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL), e AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared / least(x.n, y.n) > 0.6),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), c AS (SELECT a AS node, a AS near FROM s UNION SELECT c.node, s.b FROM c JOIN s ON s.a = c.near), r AS (SELECT node, min(near) AS root FROM c GROUP BY 1),
k AS (SELECT root FROM r JOIN documents d ON d.doc_id = r.node GROUP BY 1 HAVING count(DISTINCT source) >= 3) SELECT node AS doc_id FROM r WHERE root IN (SELECT root FROM k)""")
def reinforcing(spark, sf):
    own = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("Confirmed "), F.col("text")).alias("text"), F.col("source").alias("session_id"))
    return classify.reinforcing(own).select(F.col("ord").alias("doc_id"))


# -- importance

_WEIGHT = "CASE event_id % 5 WHEN 0 THEN 1.5 WHEN 1 THEN 1.2 WHEN 2 THEN 1.3 WHEN 3 THEN 1.0 ELSE 0.5 END"
_NOW_EVENTS = 1_706_745_600
_TYPES = "tt AS (SELECT event_type AS term, count(*) / (SELECT count(*) FROM events) AS s, count(*) AS c FROM events GROUP BY 1)"
_IMPORTANT = f"""{_TYPES}, im AS (SELECT event_id, user_id, timestamp, text, s * {_WEIGHT} * pow(0.5, greatest({_NOW_EVENTS} - timestamp, 0) / 604800.0::DOUBLE) AS score, c AS session_frequency, ceil(strlen(text) / 4.0)::BIGINT AS cost FROM x JOIN tt ON tt.term = x.event_type)"""


def _important(spark, sf):
    n = F.col("event_id") % 5
    kinds = F.when(n == 0, F.array(F.lit("corrective"), F.lit("reinforcing"))).when(n == 1, F.array(F.lit("stateful"))).when(n == 2, F.array(F.lit("decisive"))).when(n == 3, F.array(F.lit("reinforcing"))).otherwise(F.array().cast("array<string>"))
    own = _stated(spark, sf).withColumn("ord", F.col("event_id")).withColumn("categories", kinds).withColumn("superseded", F.lit(False))
    events = table(spark, sf, "events")
    rates = events.groupBy(F.col("event_type").alias("term")).agg(F.count("*").alias("session_frequency")).crossJoin(events.agg(F.count("*").alias("n")))
    return importance.score(own, rates.withColumn("recurrence_score", F.col("session_frequency") / F.col("n")).drop("n"), _NOW_EVENTS)


@query(f"WITH {_STATED}, {_IMPORTANT} SELECT event_id, round(score, 9) AS importance_score, session_frequency, cost AS token_estimate FROM im")
def importance_score(spark, sf):
    return _important(spark, sf).select("event_id", F.round("importance_score", 9).alias("importance_score"), "session_frequency", "token_estimate")


SEGMENT_BUDGET = 200


@query(f"""WITH RECURSIVE {_STATED}, {_IMPORTANT}, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 12) DESC, timestamp DESC, text, event_id) AS rank FROM im),
p AS (SELECT user_id, rank, cost AS used, true AS kept FROM ranked WHERE rank = 1 UNION ALL SELECT r.user_id, r.rank, p.used + CASE WHEN p.used + r.cost <= {SEGMENT_BUDGET} THEN r.cost ELSE 0 END, p.used + r.cost <= {SEGMENT_BUDGET} FROM p JOIN ranked r ON r.user_id = p.user_id AND r.rank = p.rank + 1)
SELECT p.user_id, r.event_id, p.used, row_number() OVER (PARTITION BY p.user_id ORDER BY p.rank) AS place FROM p JOIN ranked r ON r.user_id = p.user_id AND r.rank = p.rank WHERE kept""")
def pack_segments(spark, sf):
    return importance.pack_segments(_important(spark, sf), SEGMENT_BUDGET, ["user_id"]).select("user_id", "event_id", "used", "place")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 7 > 1 THEN least(ceil((o_orderkey % 4096) * (1 + (o_custkey % 7 - 1) * 0.25))::BIGINT, 6000) ELSE o_orderkey % 4096 END AS budget FROM orders")
def scale_budget(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scoring.scale_budget(F.col("o_orderkey") % 4096, F.col("o_custkey") % 7, cap=6000).alias("budget"))


# -- distillation


@query("""WITH f AS (SELECT user_id, event_id AS part, 0 AS pos, CASE WHEN event_id % 3 = 0 THEN 'state' ELSE 'decision' END AS kind, CASE WHEN event_id % 2 = 0 THEN ' ' || upper(event_type) ELSE event_type END AS text FROM events),
d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id, kind, lower(trim(text)) ORDER BY part, pos) = 1), g AS (SELECT user_id, string_agg(kind || '=' || text, ';' ORDER BY part) AS facts FROM d GROUP BY 1),
s AS (SELECT user_id, string_agg(event_type, chr(10) || chr(10) ORDER BY event_id) AS summary FROM events GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events) SELECT user_id, substr(coalesce(summary, ''), 1, 8192) AS summary, facts FROM u JOIN g USING (user_id) LEFT JOIN s USING (user_id)""")
def merge_facts(spark, sf):
    kind = F.when(F.col("event_id") % 3 == 0, "state").otherwise("decision")
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), F.upper("event_type"))).otherwise(F.col("event_type"))
    parts = table(spark, sf, "events").select("user_id", F.col("event_id").alias("part"), F.col("event_type").alias("summary"), F.array(F.struct(kind.alias("kind"), said.alias("text"))).alias("facts"))
    facts = F.array_join(F.transform("memory.facts", lambda f: F.concat(f["kind"], F.lit("="), f["text"])), ";")
    return merge_all(parts, "user_id").select("user_id", F.col("memory.summary").alias("summary"), facts.alias("facts"))


CHUNK = 400


@query(f"""WITH RECURSIVE x AS (SELECT doc_id, regexp_extract_all(text, '(?s)[^\\n]{{{CHUNK}}}|[^\\n]*\\n|[^\\n]+') AS ps FROM documents), p AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS piece FROM x),
r AS (SELECT doc_id, i, length(piece) AS size, 0 AS part FROM p WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, CASE WHEN r.size + length(piece) > {CHUNK} THEN length(piece) ELSE r.size + length(piece) END, r.part + CASE WHEN r.size + length(piece) > {CHUNK} THEN 1 ELSE 0 END FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1)
SELECT doc_id, part, string_agg(piece, '' ORDER BY i) AS chunk FROM r JOIN p USING (doc_id, i) GROUP BY ALL""")
def split_on_budget(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(text.split_on_budget(F.col("text"), CHUNK)).alias("part", "chunk"))


@query("""SELECT event_id, '{"fact_kind":"' || event_type || '","source":"distill"}' AS metadata, json_extract(props, '$.k')::BIGINT AS k FROM events""")
def fact_metadata(spark, sf):
    made = F.to_json(F.struct(F.col("event_type").alias("fact_kind"), F.lit("distill").alias("source")))
    return table(spark, sf, "events").select("event_id", made.alias("metadata"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""SELECT conv_id, string_agg(role || ': ' || text || chr(10), '' ORDER BY turn) AS transcript FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def render_transcripts(spark, sf):
    from engram.sources.datasets import transcripts

    own = table(spark, sf, "conversations").where("trim(text) <> ''").select("conv_id", "turn", "role", F.col("text").alias("content"))
    return transcripts(own, "conv_id")


@query(None)
def importance_pipeline(spark, sf):
    """Conversations to packed passages; tested against a plain version."""
    from engram.plans.importance import inject

    return inject(tables.turns(spark, sf), EPOCH + 200_000, 4_096).select("ord", "text", "importance_score", "token_estimate", "place")



"""Retrieval: lexical and semantic candidates, their fusion, and packing into a token budget.

All operators take many queries at once, (query_id, ...) rows; a single one is a table of one row. ``now``
is always given, so that a result can be had again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type as to_spark_type

from engram.functions import scoring
from engram.functions.lexicon import Scorer
from engram.functions.text import ITEMS, TERM_BYTES, estimate_tokens, terms
from engram.schema import CLAMP, HALF_LIFE

#: A query for everything, newest first.
MATCH_ALL = "*"
K1, B = 1.2, 0.75
#: Up to so many terms of queries pick the row groups that are read of a kept index. Beyond, up to so many pairs of query and term go over its
#: documents as a matrix; more of them are joined.
FEW_TERMS, PAIRS = 64, 200_000


@dataclass(frozen=True)
class Index:
    """``postings`` (term, id, tf, dl, scope), one row a term and document; ``documents`` (id, dl, scope), also those without
    terms. Both are plans: what isn't written or cached is computed when it is used. A kept index also has ``frequencies``
    (term, df), ``totals`` (n, avgdl) and ``forward`` (id, scope, dl, terms, tfs), a row a document: a few terms are looked up in the
    postings, tables of queries go over the documents once.

    Terms of 40 bytes and more aren't indexed, in texts or queries."""

    postings: DataFrame
    documents: DataFrame
    frequencies: DataFrame | None = None
    totals: DataFrame | None = None
    forward: DataFrame | None = None

    @classmethod
    def build(cls, entries: DataFrame) -> Index:
        """From entries (id, content, scope, ...). Terms are counted within a row, so nothing is shuffled."""
        own = entries.select("id", "scope", terms(F.col("content")).alias("terms"))
        documents = own.select("id", F.size("terms").alias("dl"), "scope")
        count = lambda t: F.size(F.filter("terms", lambda x: x == t))
        each = own.select("id", "scope", F.size("terms").alias("dl"), "terms", F.explode(F.array_distinct("terms")).alias("term"))
        return cls(each.select("term", "id", count(F.col("term")).alias("tf"), "dl", "scope"), documents)

    @classmethod
    def counted(cls, entries: DataFrame, *also: str) -> Index:
        """The same index for long texts: terms are counted by a shuffle in place of a scan of the row for each. ``also``: further columns
        to carry along."""
        own = entries.select("id", "scope", *also, terms(F.col("content")).alias("terms"))
        each = own.select("id", "scope", *also, F.size("terms").alias("dl"), F.explode("terms").alias("term"))
        counted = each.groupBy("id", "scope", *also, "dl", "term").agg(F.count("*").cast("int").alias("tf"))
        return cls(counted.select("term", "id", "tf", "dl", "scope", *also), own.select("id", F.size("terms").alias("dl"), "scope", *also))

    @classmethod
    def write(cls, entries: DataFrame, path: str, inverted: bool = True) -> Index:
        """As Parquet, postings in ranges of terms, so that a query reads the row groups of its terms only. Texts are split once, and
        counted within their rows; all else comes from what was written. Without ``inverted`` no postings are written, which tables of
        queries don't need."""
        spark = entries.sparkSession
        own = entries.select("id", "scope", F.split(F.lower("content"), ITEMS).alias("ts"))
        id_type = own.schema["id"].dataType.simpleString()
        counted = own.mapInArrow(_count_terms, f"id {id_type}, scope string, dl int, terms array<string>, tfs array<int>")
        counted.write.mode("overwrite").parquet(f"{path}/forward")
        forward = spark.read.parquet(f"{path}/forward")
        if inverted:
            _postings(forward).repartitionByRange("term").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
        forward.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/frequencies")
        forward.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).write.mode("overwrite").parquet(f"{path}/totals")
        return cls.read(spark, path, inverted)

    @classmethod
    def read(cls, spark, path: str, inverted: bool = True) -> Index:
        frequencies, totals, forward = (spark.read.parquet(f"{path}/{part}") for part in ("frequencies", "totals", "forward"))
        postings = spark.read.parquet(f"{path}/postings") if inverted else _postings(forward)
        return cls(postings, forward.select("id", "dl", "scope"), frequencies, totals, forward)


def _postings(forward: DataFrame) -> DataFrame:
    pairs = forward.select("id", "dl", "scope", F.explode(F.arrays_zip("terms", "tfs")).alias("p"))
    return pairs.select("p.terms", "id", "p.tfs", "dl", "scope").toDF("term", "id", "tf", "dl", "scope")


#: Items of rows' lists, or bytes of their texts, that a Python worker handles at once, whatever the size of an Arrow batch.
ITEMS_AT_ONCE, BYTES_AT_ONCE = 200_000, 2 << 20


def pieces(batches, sizes, most: int):
    """The batches' rows in pieces of about ``most`` in all by ``sizes`` of a batch, one row at least. At the end the worker, which goes on to other
    stages, gives back what Arrow keeps for no array."""
    for b in batches:
        ends, at = np.cumsum(sizes(b)), 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield b.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()


def _item_counts(column: int):
    return lambda b: b.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _count_terms(batches):
    """(id, scope, dl, terms, tfs) from (id, scope, items): what ``terms`` gives, counted within each row."""
    for b in pieces(batches, _item_counts(2), ITEMS_AT_ONCE):
        lists = b.column(2)
        flat = lists.flatten()
        row = np.repeat(np.arange(b.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        size = pc.binary_length(flat).to_numpy(zero_copy_only=False)
        use = (size > 0) & (size < TERM_BYTES)
        row, coded = row[use], flat.filter(pa.array(use)).dictionary_encode()
        n = max(1, len(coded.dictionary))
        key, tf = np.unique(row * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        bounds = pa.array(np.searchsorted(key // n, np.arange(b.num_rows + 1)).astype(np.int32))
        held = [pa.ListArray.from_arrays(bounds, x) for x in (coded.dictionary.take(pa.array(key % n)), pa.array(tf.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.bincount(row, minlength=b.num_rows).astype(np.int32)), *held], names=["id", "scope", "dl", "terms", "tfs"])


def _best_of(index: Index, asked: pa.Table, k: int, scope: str | None, k1: float, b: float) -> DataFrame:
    """(query_id, id, score) of each batch's ``k`` best documents for each of the queries ``asked`` (query_id, term, qn), by products of
    its weights with a matrix of terms x documents."""
    spark = index.forward.sparkSession
    words, codes = (lambda e: (e.dictionary, e.indices.to_numpy()))(asked.column("term").combine_chunks().dictionary_encode())
    queries, columns = (lambda e: (e.dictionary, e.indices.to_numpy()))(asked.column("query_id").combine_chunks().dictionary_encode())
    wanted = F.broadcast(spark.createDataFrame(pa.table({"term": words})))
    found = {r.term: r.df for r in index.frequencies.join(wanted, "term", "left_semi").collect()}
    n, avgdl = index.totals.first()
    df = np.array([found.get(w, 0) for w in words.to_pylist()], np.float64)
    weights = asked.column("qn").to_numpy() * np.log(1 + (n - df[codes] + 0.5) / (df[codes] + 0.5))
    each = [(codes[columns == q], weights[columns == q]) for q in range(len(queries))]
    shared = spark.sparkContext.broadcast((words, queries, each))
    rows = in_scope(index.forward, scope).select("id", "dl", "terms", "tfs")
    out = T.StructType([T.StructField("query_id", to_spark_type(queries.type)), T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])

    def run(batches):
        words, queries, each = shared.value
        step = max(1, CELLS // max(len(words), len(queries)))
        for batch in pieces(batches, _item_counts(2), ITEMS_AT_ONCE):
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                lists = part.column(2)
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                at = pc.index_in(lists.flatten(), value_set=words).fill_null(-1).to_numpy(zero_copy_only=False)
                tf, dl = part.column(3).flatten().to_numpy()[at >= 0], part.column(1).to_numpy()
                row, at = row[at >= 0], at[at >= 0]
                matrix = np.zeros((len(words), part.num_rows))
                matrix[at, row] = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl[row] / avgdl))
                score = np.stack([w @ matrix[c] for c, w in each])
                score = np.where(score > 0, np.round(score, 9), -np.inf)  # a term in common counts more than 0
                most = min(k, part.num_rows)
                q, i = np.nonzero((score >= np.partition(score, part.num_rows - most, 1)[:, [part.num_rows - most]]) & np.isfinite(score))
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(q)), part.column(0).take(pa.array(i)), pa.array(score[q, i])], names=["query_id", "id", "score"])

    return rows.mapInArrow(run, out)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qn): a term given several times counts as often."""
    return queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))


def in_scope(df: DataFrame, scope: str | None) -> DataFrame:
    """Rows of ``scope``; all of them for None."""
    return df if scope is None else df.where(F.col("scope") == scope)


def top(df: DataFrame, k: int, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank from 1; groups are cut down before the shuffle as well."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def bm25(index: Index, queries: DataFrame, k: int = scoring.CANDIDATES, scope: str | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score, rank) of the ``k`` best documents with at least one of the query's terms.

    Statistics are over all documents; ``scope`` narrows what is ranked before the cut. Equal scores go by id.
    A query without terms has no rows.
    """
    asked = query_terms(queries)
    postings = index.postings
    words = [r.term for r in asked.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    if len(words) <= FEW_TERMS:  # of written postings only these terms' row groups are read; beyond it the join finds them
        postings = postings.where(F.col("term").isin(words))
    elif index.forward is not None:
        few = asked.limit(PAIRS + 1).toArrow()
        if few.num_rows <= PAIRS and len(few.column("query_id").unique()) <= SHARED_QUERIES:
            return top(_best_of(index, few, k, scope, k1, b), k, ["query_id"], F.desc("score"), F.col("id"))
    hits = postings.join(asked, "term")
    if index.frequencies is not None:
        frequent = index.frequencies.join(asked.select("term").distinct(), "term", "left_semi")
    else:
        frequent = postings.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    total = index.totals if index.totals is not None else index.documents.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("qn") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = in_scope(hits, scope).join(frequent, "term").crossJoin(F.broadcast(total)).groupBy("query_id", "id").agg(F.round(F.sum(weight), 9).alias("score"))
    return top(scored, k, ["query_id"], F.desc("score"), F.col("id"))


def match_all(entries: DataFrame, queries: DataFrame, k: int = scoring.CANDIDATES, scope: str | None = None) -> DataFrame:
    """(query_id, id, score 1, rank) of the ``k`` newest entries; the cut comes before queries are joined."""
    newest = in_scope(entries, scope).select("id", "timestamp").orderBy(F.desc("timestamp"), "id").limit(k)
    ranked = newest.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("timestamp"), F.col("id"))))  # k rows
    return queries.select("query_id").crossJoin(ranked).select("query_id", "id", F.lit(1.0).alias("score"), "rank")


def lexical(entries: DataFrame, queries: DataFrame, k: int = scoring.CANDIDATES, scope: str | None = None, index: Index | None = None) -> DataFrame:
    """``bm25``, for queries that are exactly ``*`` ``match_all``."""
    words = bm25(index or Index.counted(entries), queries.where(F.col("text") != MATCH_ALL), k, scope)
    everything = match_all(entries, queries.where(F.col("text") == MATCH_ALL), k, scope)
    return words.unionByName(everything)


#: Up to so many queries go to the workers as a matrix; more of them meet the entries block by block.
SHARED_QUERIES = 4_096
BLOCK = 32_768
#: Numbers of a block of weights or of distances that are held at once; pairs whose exact distances are.
CELLS, DISTANCES, EXACT = 4_000_000, 2_000_000, 16_384


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, starts, sizes) of an array of number lists; null lists have size 0, null numbers are NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes) - sizes, sizes


def _near(unit: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) that hold the ``k`` nearest of the ``unit`` vectors (``k`` at least) of each of ``asked``, and a few more. All pairs
    are compared in single precision, whose error is bounded; distances of those that may count are in double precision."""
    n, dims = unit.shape
    margin = np.float32(2 * (dims + 4) * 2.0**-24 + 2e-7)
    sim = asked.astype(np.float32) @ unit.astype(np.float32).T
    size = n // (8 * k)
    # the k-th of the maxima of groups of rows is no more than the k-th of all
    most = sim[:, : n // size * size].reshape(len(asked), -1, size).max(2) if size > 1 else sim
    cut = np.partition(most, most.shape[1] - k, 1)[:, most.shape[1] - k]
    r, c = np.nonzero(sim >= (cut - margin)[:, None])
    d = np.empty(len(r))
    for at in range(0, len(r), EXACT):
        d[at : at + EXACT] = np.einsum("ij,ij->i", asked[r[at : at + EXACT]], unit[c[at : at + EXACT]])
    return r, c, np.round(1 - d, 9)


def nearest(ids: pa.Array, vectors: pa.Array, query_ids: pa.Array, queries: pa.Array, k: int) -> pa.RecordBatch:
    """(query_id, id, distance) of the ``k`` nearest vectors of each query, by cosine distance rounded to 9 places, then id. A distance to a
    vector of another size, of length 0 or with nulls is null and comes last."""
    values, starts, sizes = _lists(vectors)
    q_values, q_starts, q_sizes = _lists(queries)
    if isinstance(ids, pa.ChunkedArray):
        ids, query_ids = ids.combine_chunks(), query_ids.combine_chunks()
    n = len(ids)
    by_id = np.empty(n, np.int64)
    by_id[pc.sort_indices(ids).to_numpy()] = np.arange(n)
    out_q, out_i, out_d = [], [], []
    for dims in np.unique(q_sizes).tolist():
        asked = np.flatnonzero(q_sizes == dims)
        rows = np.flatnonzero(sizes == dims) if dims else np.zeros(0, np.int64)
        unit = []
        for flat, start, which in ((values, starts, rows), (q_values, q_starts, asked)):
            m = flat[start[which][:, None] + np.arange(dims)]
            norm = np.sqrt((m * m).sum(1))
            with np.errstate(all="ignore"):
                unit.append(m / np.where(norm > 0, norm, np.nan)[:, None])
        step = max(1, DISTANCES // max(n, 1))
        sound = np.flatnonzero(np.isfinite(unit[0]).all(1))
        quick = len(sound) >= k > 0 and np.isfinite(unit[1]).all()
        if quick and len(sound) < len(rows):
            unit[0], rows = unit[0][sound], rows[sound]
        for low in range(0, len(asked), step):
            part = asked[low : low + step]
            if quick:
                r, c, d = _near(unit[0], unit[1][low : low + step], k)
                c = rows[c]
                order = np.lexsort((by_id[c], d, r))
                r, c, d = r[order], c[order], d[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r) < k
                out_q.append(part[r[keep]])
                out_i.append(c[keep])
                out_d.append(d[keep])
                continue
            dist = np.full((len(part), n), np.inf)
            d = np.round(1 - unit[1][low : low + step] @ unit[0].T, 9)
            dist[:, rows] = np.where(np.isfinite(d), d, np.inf)
            cut = np.partition(dist, min(k, n) - 1, 1)[:, min(k, n) - 1]
            r, c = np.nonzero(dist <= cut[:, None])
            order = np.lexsort((by_id[c], dist[r, c], r))
            r, c = r[order], c[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < k
            out_q.append(part[r[keep]])
            out_i.append(c[keep])
            out_d.append(dist[r[keep], c[keep]])
    q, i, d = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((out_q, np.int64), (out_i, np.int64), (out_d, np.float64)))
    return pa.RecordBatch.from_arrays([query_ids.take(pa.array(q)), ids.take(pa.array(i)), pa.array(d, mask=~np.isfinite(d))], names=["query_id", "id", "distance"])


def semantic(embeddings: DataFrame, queries: DataFrame, k: int = scoring.CANDIDATES, scope: str | None = None, shared: int = SHARED_QUERIES, block: int = BLOCK) -> DataFrame:
    """(query_id, id, distance, score, rank) of the ``k`` embedded entries (id, embedding, scope) with the least cosine
    distance to a query's ``embedding``, compared with all. Ranked by distance, ties by id; a distance that can't be had
    comes last; ``score`` is 1 - distance, 0 at least.

    Up to ``shared`` queries: they are broadcast, and entries are read once without a shuffle; of each batch only a query's ``k`` nearest go on.
    Beyond that blocks of ``block`` entries and queries are multiplied.
    """
    asked = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("q"))
    rows = in_scope(embeddings, scope).where("embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("v"))
    out = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("id", rows.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    few = asked.limit(shared + 1).toArrow()
    if few.num_rows <= shared:
        sent = embeddings.sparkSession.sparkContext.broadcast(few)

        def run(batches):
            table = sent.value
            for b in batches:
                if b.num_rows and table.num_rows:
                    yield nearest(b.column(0), b.column(1), table.column(0).combine_chunks(), table.column(1).combine_chunks(), k)

        near = rows.mapInArrow(run, out)
    else:
        a, b = (max(1, math.ceil(df.count() / block)) for df in (rows, asked))
        left = rows.withColumn("x", F.pmod(F.xxhash64("id"), F.lit(a)).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
        right = asked.withColumn("y", F.pmod(F.xxhash64("query_id"), F.lit(b)).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(a - 1))))

        def multiply(entries: pa.Table, wanted: pa.Table) -> pa.Table:
            if not entries.num_rows or not wanted.num_rows:
                return pa.Table.from_batches([nearest(entries.column("id").slice(0, 0), entries.column("v").slice(0, 0), wanted.column("query_id").slice(0, 0), wanted.column("q").slice(0, 0), k)])
            return pa.Table.from_batches([nearest(entries.column("id"), entries.column("v"), wanted.column("query_id"), wanted.column("q"), k)])

        near = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(multiply, out)
    ranked = top(near, k, ["query_id"], F.col("distance").asc_nulls_last(), F.col("id"))
    return ranked.withColumn("score", scoring.similarity(F.col("distance")))


def fuse(words: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """(query_id, id, word_rank, vector_rank, rrf) of the candidates of either kind."""
    own = words.select("query_id", "id", F.col("rank").alias("word_rank"))
    if vectors is None:
        both = own.withColumn("vector_rank", F.lit(None).cast("int"))
    else:
        both = own.join(vectors.select("query_id", "id", F.col("rank").alias("vector_rank")), ["query_id", "id"], "full")
    return both.withColumn("rrf", scoring.rrf(F.col("word_rank"), F.col("vector_rank")))


def cost() -> Column:
    """Tokens of an entry, estimated where they aren't known."""
    return F.coalesce(F.col("token_count"), estimate_tokens(F.col("content")))


def rank(candidates: DataFrame, entries: DataFrame, now: int, scorer: Scorer | None = None, half_life: float = HALF_LIFE, clamp: float = CLAMP, query: str = "") -> DataFrame:
    """Candidates with their entries, ``decay``, ``boost``, ``score``, ``cost`` and ``rank`` from 1. Candidates without an
    entry go. Equal scores go by word rank, vector rank and id."""
    own = candidates.join(entries, "id")
    own = own.withColumn("decay", scoring.recency_decay(F.col("timestamp"), now, half_life)).withColumn("boost", scorer.boost(F.col("content"), query) if scorer else F.lit(0.0))
    own = own.withColumn("score", F.round(scoring.fused_score(F.col("rrf"), F.col("decay"), F.col("boost"), clamp), 12)).withColumn("cost", cost())
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("word_rank").asc_nulls_last(), F.col("vector_rank").asc_nulls_last(), F.col("id"))
    return own.withColumn("rank", F.row_number().over(order))


def pack(df: DataFrame, budget: int, by: list[str], order: list[Column], cost: str = "cost") -> DataFrame:
    """The rows that a walk in ``order`` takes, skipping what doesn't fit any more, with ``place`` from 1 among those
    taken and ``used`` so far.

    Rows of one cost are taken from the front until the first that doesn't fit, so that of rows of cost c only the first
    budget / c can be: the walk sees budget x log(budget) rows at most, whatever the table's size. ``order`` must tell all rows
    of a group apart. Rows without a cost never fit; those of cost 0 always do.
    """
    fitting = df.where(F.col(cost).isNotNull() & (F.col(cost) <= budget) & (F.col(cost) >= 0))
    nth = F.row_number().over(Window.partitionBy(*by, cost).orderBy(*order))
    near = fitting.withColumn("_nth", nth).where((F.col(cost) == 0) | (F.col("_nth") * F.col(cost) <= budget)).drop("_nth")
    walked = near.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    steps = F.array_sort(F.collect_list(F.struct(F.col("_at").alias("at"), F.col(cost).cast("bigint").alias("c"))))
    zero = F.named_struct(F.lit("used"), F.lit(0).cast("bigint"), F.lit("kept"), F.array().cast("array<struct<at:int,used:bigint>>"))

    def take(s: Column, x: Column) -> Column:
        total = s["used"] + x["c"]
        fits = total <= budget
        return F.named_struct(F.lit("used"), F.when(fits, total).otherwise(s["used"]), F.lit("kept"), F.when(fits, F.concat(s["kept"], F.array(F.named_struct(F.lit("at"), x["at"], F.lit("used"), total)))).otherwise(s["kept"]))

    kept = walked.groupBy(*by).agg(F.aggregate(steps, zero, take, lambda s: s["kept"]).alias("kept")).select(*by, F.posexplode("kept").alias("place", "k"))
    kept = kept.select(*by, (F.col("place") + 1).alias("place"), F.col("k.at").alias("_at"), F.col("k.used").alias("used"))
    return walked.join(kept, [*by, "_at"]).drop("_at")


def assemble(
    entries: DataFrame, queries: DataFrame, budget: int, now: int, *, scope: str | None = None, embeddings: DataFrame | None = None, scorer: Scorer | None = None,
    index: Index | None = None, searcher=None, half_life: float = HALF_LIFE, clamp: float = CLAMP, k: int = scoring.CANDIDATES,
) -> DataFrame:
    """The entries that answer each query (query_id, text and, for semantic search, embedding) within ``budget`` tokens. Candidates come from
    ``searcher`` if there is one (see ``sources.store.Searcher``), else from ``index`` or the entries, and ``embeddings``.

    What comes back is text that others wrote: give it to a model as quoted data, never as instructions.
    """
    if searcher is not None:
        words = searcher.search(queries, k, scope)
        vectors = searcher.search_semantic(queries, k, scope) if "embedding" in queries.columns else None
    else:
        words = lexical(entries, queries, k, scope, index)
        vectors = None if embeddings is None or "embedding" not in queries.columns else semantic(embeddings, queries, k, scope)
    ranked = rank(fuse(words, vectors), entries, now, scorer, half_life, clamp)
    return pack(ranked, budget, ["query_id"], [F.col("rank")])

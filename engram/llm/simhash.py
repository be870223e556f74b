"""Near duplicates by SimHash with deletion-variant signatures.

A text's features are its different words, of weight WORD, and its different pairs of neighbouring words, of weight 1, so that all
words and their order count. Each has SEGMENTS x WIDTH pseudo-random bits, and the signature has each bit's weighted
majority. The signature is cut into so few segments that of two
signatures within RADIUS = 2 x SEGMENTS - 1 bits one segment differs in one bit at most: then the two share
a one-wildcard variant of it (the segment with one bit deleted). Variants are joined on equality
and the pairs verified on the whole signature. Pairs farther apart share a variant by chance only, so the bits
are cut into segments in ARRANGEMENTS orders, of which one is enough.

A variant leaves one half of its segment whole. So rows go to a partition by that half only (2 rows
a segment in place of WIDTH), and the variants of the other half are made and joined there,
by sorting. Equal signatures go through as one. Pairs that verify are reduced to a spanning forest within each
set of rows that share a segment, which keeps the groups exact and the edges few.

Groups are the connected components of all edges (alternating large-star and small-star steps,
each cut by a checkpoint). One document of each group stays, that with the least id.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm.common import as_string, buffers, cut, frugal, pick, place, positional, slices

SEGMENTS, WIDTH = 10, 28
BITS = SEGMENTS * WIDTH
BYTES = BITS // 8
HALF = WIDTH // 2
#: All pairs within RADIUS bits share a variant. Pairs that share one count up to NEAR bits (about 0.86 in cosine).
RADIUS, NEAR = 2 * SEGMENTS - 1, 48
#: Of pairs at 38, 44 and 48 bits, 0.61, 0.38 and 0.27 share a variant in one arrangement, 0.99, 0.94 and 0.85 in one of six.
ARRANGEMENTS = 6
#: Weight of a word against a pair of neighbouring words.
WEIGHT = 8
#: Runs of 255 features of one text at most whose bits are spread at once.
RUNS = 256
_WORD = re.compile(r"[^\W_]+")
_POPULATION = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)
#: Each byte's bits, one in each byte of a 64-bit number, so that eight counters are added at once.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def words(text: str) -> list[str]:
    """Of a text without words, the text itself."""
    return _WORD.findall(text.lower()) or ([text.strip()] if text.strip() else [])


def _mixed(h: np.ndarray, turn: int) -> np.ndarray:
    """Further 64 bits from a 64-bit hash (splitmix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((turn * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _votes(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, BITS): how many of each text's features have the bit. ``h``: the texts' features one after another, ``counts`` (1 at least)
    how many each has. Some 64,000 features have their bits spread at once, however many a text has."""
    ends = np.cumsum(counts)
    # runs of 255 features of one text at most, so that no counter of 8 bits overflows
    runs = -(-counts // 255)
    first = np.cumsum(runs) - runs
    starts = np.repeat(ends - counts, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    stops = np.append(starts[1:], len(h))
    votes = np.zeros((len(counts), BITS), np.int32)
    own = np.repeat(np.arange(len(counts)), runs)
    for at in range(0, len(starts), RUNS):
        to = min(at + RUNS, len(starts))
        part = h[starts[at] : stops[to - 1]]
        raw = np.stack([_mixed(part, k + 1) for k in range(-(-BITS // 64))], 1).astype("<u8").view(np.uint8)[:, :BYTES]
        sums = np.add.reduceat(_SPREAD[raw], starts[at:to] - starts[at], axis=0).view(np.uint8)
        begin = np.flatnonzero(np.concatenate([[True], own[at + 1 : to] != own[at : to - 1]]))
        votes[own[at:to][begin]] += np.add.reduceat(sums, begin, axis=0, dtype=np.int32)
    return votes


def _signed(features: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """(texts, BYTES) from each text's hashes of words and of pairs. A tied bit is 0."""
    n, m = (np.array([len(f[i]) for f in features], np.int64) for i in (0, 1))
    votes = WEIGHT * _votes(np.concatenate([f[0] for f in features]), n)
    some = np.flatnonzero(m)
    if len(some):
        votes[some] += _votes(np.concatenate([f[1] for f in features]), m[some])
    return np.packbits(2 * votes > (WEIGHT * n + m)[:, None], axis=1)


def signatures(texts: list[str | None]) -> list[bytes | None]:
    """BYTES bytes for each text; None for null and blank ones."""
    digest = xxhash.xxh3_64_intdigest
    out: list[bytes | None] = [None] * len(texts)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    at: list[int] = []
    size = 0

    def flush() -> None:
        for i, sig in zip(at, _signed(held)):
            out[i] = sig.tobytes()

    for i, t in enumerate(texts):
        own = words(t) if t else []
        if own:
            h = np.fromiter(map(digest, own), np.uint64, len(own))
            held.append((np.unique(h), np.unique(_mixed(h[:-1], 9) ^ h[1:])))
            at.append(i)
            size += len(held[-1][0]) + len(held[-1][1])
            if size > 60_000:  # features at once, one text at least
                flush()
                held, at, size = [], [], 0
    if held:
        flush()
    return out


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of BYTES bytes, an odd number of which is padded."""
    x = np.bitwise_xor(a, b)
    if x.shape[-1] % 2:
        x = np.concatenate([x, np.zeros((*x.shape[:-1], 1), np.uint8)], -1)
    return _POPULATION[np.ascontiguousarray(x).view(np.uint16)].sum(-1, dtype=np.int32)


#: For each arrangement the order of the bits; the first is their own.
ORDERS = np.stack([np.arange(BITS), *[np.argsort(_mixed(np.arange(BITS, dtype=np.uint64), k)) for k in range(1, ARRANGEMENTS)]])


#: Signatures whose bits are spread at once, a byte for each.
ROWS = 8_192


def segment(sigs: np.ndarray, k: int) -> np.ndarray:
    """Segment ``k`` of ARRANGEMENTS x SEGMENTS, a number of WIDTH bits, of each signature."""
    order = ORDERS.ravel()[k * WIDTH : (k + 1) * WIDTH]
    out = np.empty(len(sigs), np.uint32)
    for at in range(0, len(sigs), ROWS):
        own = sigs[at : at + ROWS]
        bits = np.zeros((len(own), 32), np.uint8)
        bits[:, 32 - WIDTH :] = (own[:, order >> 3] >> (7 - (order & 7)).astype(np.uint8)) & 1
        out[at : at + ROWS] = np.packbits(bits, axis=1).view(">u4").ravel()
    return out


def segments(sigs: np.ndarray) -> np.ndarray:
    """(n, ARRANGEMENTS x SEGMENTS) numbers of WIDTH bits."""
    return np.stack([segment(sigs, k) for k in range(ARRANGEMENTS * SEGMENTS)], 1).astype(np.int64)


def segments_at(sigs: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Of each signature the segment ``which`` says."""
    out = np.empty(len(sigs), np.int64)
    order = np.argsort(which, kind="stable")
    ends = np.cumsum(np.bincount(which, minlength=ARRANGEMENTS * SEGMENTS))
    for k, (at, to) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
        if at < to:
            out[order[at:to]] = segment(sigs[order[at:to]], k)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    """(n, BYTES) of a column of signatures without nulls."""
    column = column.cast(pa.binary(BYTES))
    return np.frombuffer(column.buffers()[1], np.uint8, len(column) * BYTES, column.offset * BYTES).reshape(-1, BYTES)


def _forest(rows: np.ndarray, sigs: np.ndarray, near: int, out: list) -> None:
    """Edges of a spanning forest of the pairs within ``near`` bits among ``rows``: breadth first, each row compared
    with those not reached yet only."""
    left = rows
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            hit = hamming(sigs[left], sigs[u]) <= near
            if hit.any():
                new = left[hit]
                out.extend((u, v) for v in new)
                queue.extend(new)
                left = left[~hit]


def _across(a: np.ndarray, b: np.ndarray, sigs: np.ndarray, near: int, out: list) -> None:
    """Edges that keep the components of the pairs within ``near`` bits between two sets of rows: each row of the
    smaller one is joined with one row of each component of the other that it reaches."""
    if len(a) > len(b):
        a, b = b, a
    label = np.arange(len(b))
    other = sigs[b]
    for u in a.tolist():
        hit = np.flatnonzero(hamming(other, sigs[u]) <= near)
        if len(hit):
            own, where = np.unique(label[hit], return_index=True)
            out.extend((u, v) for v in b[hit[where]].tolist())
            if len(own) > 1:
                label[np.isin(label, own)] = own[0]


def _united(edges: list, n: int) -> np.ndarray:
    """The same components with as few edges as can be."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for u, v in edges:
        a, b = root(int(u)), root(int(v))
        if a != b:
            parent[b] = a
            keep.append((u, v))
    return np.array(keep, np.int64).reshape(-1, 2)


def join_variants(half: np.ndarray, number: np.ndarray, sigs: np.ndarray, near: int = NEAR) -> np.ndarray:
    """Edges (row, row) that keep the components of all pairs within ``near`` bits that share a one-wildcard variant
    with this half whole. ``half``: the key of the partitioning (segment, which half, its bits); ``number``: the segment."""
    n = len(half)
    edges: list = []
    if n < 2:
        return np.zeros((0, 2), np.int64)
    order = np.lexsort((number, half))
    h, s = half[order], number[order]
    # rows that share the whole segment go through the joins as one
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])]))
    ends = np.append(first[1:], n)
    size = ends - first
    for a, b in zip(first[size > 1].tolist(), ends[size > 1].tolist()):
        _forest(order[a:b], sigs, near, edges)
    nh, ns = h[first], s[first]
    lower = nh & 1  # the half that is whole is the lower one; the wildcard is in the other
    singles = []
    for bit in range(HALF):
        masked = ns & ~(np.int64(1) << np.where(lower == 1, bit + HALF, bit))
        o = np.lexsort((masked, nh))
        i = np.flatnonzero((nh[o][1:] == nh[o][:-1]) & (masked[o][1:] == masked[o][:-1]))
        x, y = o[i], o[i + 1]  # never three: the bit is 0 or 1
        one = (size[x] == 1) & (size[y] == 1)
        singles.append(np.stack([order[first[x[one]]], order[first[y[one]]]], 1))
        for p, q in zip(x[~one].tolist(), y[~one].tolist()):
            _across(order[first[p] : ends[p]], order[first[q] : ends[q]], sigs, near, edges)
    pairs = np.concatenate(singles)
    return _united(edges + pairs[hamming(sigs[pairs[:, 0]], sigs[pairs[:, 1]]) <= near].tolist(), n)


def signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, hash of the text, sig) of rows whose text isn't blank."""
    own = pick(docs, key, text).toDF("key", "text").where("text is not null").select("key", F.xxhash64(F.col("text")).alias("hash"), F.col("text").cast("string"))

    def run(batches):
        for batch in batches:
            column = as_string(batch.column(2))
            for at, to in slices(np.diff(buffers(column)[0])):
                sigs = signatures(column.slice(at, to - at).to_pylist())
                have = pa.array([at + i for i, s in enumerate(sigs) if s], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(have), batch.column(1).take(have), pa.array([s for s in sigs if s], pa.binary())], names=["key", "hash", "sig"])

    return own.mapInArrow(frugal(run), T.StructType([T.StructField("key", own.schema["key"].dataType), T.StructField("hash", T.LongType()), T.StructField("sig", T.BinaryType())]))


def node_of(sig: Column) -> Column:
    return F.xxhash64(sig)


def edges(nodes: DataFrame, near: int = NEAR) -> DataFrame:
    """(u, v), u < v: pairs of the nodes of signatures (sig) whose components are those of all verified pairs. Only signatures are shuffled: the
    segment follows from the signature and the key, and the node (``node_of``) from the signature."""
    each = ARRANGEMENTS * SEGMENTS

    def halves(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = _matrix(batch.column(0))
            for k in range(each):
                own = segment(sigs, k).astype(np.int64)
                for which in (0, 1):  # 0: the upper half is whole
                    part = own >> HALF if which == 0 else own & ((1 << HALF) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array((part * each + k) << 1 | which), batch.column(0)], names=["half", "sig"])

    def joined(rows: pa.Table):
        half, column = rows.column(0).to_numpy(), rows.column(1).combine_chunks()
        sigs = _matrix(column)
        found = join_variants(half, segments_at(sigs, (half >> 1) % each), sigs, near)
        if len(found):
            yield pa.RecordBatch.from_arrays([column.take(pa.array(found[:, 0])), column.take(pa.array(found[:, 1]))], names=["a", "b"])

    def pairs(batches):
        """Rows come ordered by half; whole keys are joined, some 200,000 rows at once."""
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
                if n >= 200_000:
                    rows = pa.Table.from_batches(held)
                    whole = int(np.searchsorted(rows.column(0).to_numpy(), rows.column(0)[n - 1].as_py()))
                    if whole:
                        yield from joined(rows.slice(0, whole))
                        held = rows.slice(whole).combine_chunks().to_batches()
                        n -= whole
        if held:
            yield from joined(pa.Table.from_batches(held))

    spread = nodes.select("sig").mapInArrow(frugal(halves), "half bigint, sig binary")
    close = spread.repartition("half").sortWithinPartitions("half").mapInArrow(frugal(pairs), "a binary, b binary").where("a != b")
    a, b = node_of(F.col("a")), node_of(F.col("b"))
    return close.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for nodes of pairs (u, v), u < v. By large-star and small-star
    steps, each of which shortens all paths, until nothing changes any more."""
    now = cut(pairs.select("u", "v").distinct())
    last = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: each node's greater neighbours go to its least one
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").distinct()
        # small star: each node's lesser neighbours and itself go to the least of them
        low = big.groupBy("v").agg(F.min("u").alias("m"))
        small = big.join(low, "v").where("u != m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        now = cut(small.unionByName(low.select(F.col("m").alias("u"), "v")).distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())
        if state == last:
            break
        last = state
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


#: Decisions on so many rows at most are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _decisions(docs: DataFrame, near: int, key: str, text: str) -> DataFrame:
    """(key, hash, n rows, best (key, hash) of the group, group_size) of all groups of several rows. A node is the
    64-bit hash of a signature."""
    rows = cut(signed(docs, key, text).withColumn("node", node_of(F.col("sig"))))
    roots = components(edges(rows.groupBy("node").agg(F.min("sig").alias("sig")), near))
    flat = rows.groupBy("node", "key", "hash").agg(F.count("*").alias("n")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = flat.groupBy("root").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "hash")).alias("best"), F.sum("n").alias("group_size")).where("group_size > 1")
    return flat.join(best, "root").groupBy("key", "hash", "best", "group_size").agg(F.sum("n").alias("n"))


def _best() -> Column:
    return F.col("key").eqNullSafe(F.col("best.key")) & (F.col("hash") == F.col("best.hash"))


def duplicates(docs: DataFrame, near: int = NEAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, ``duplicate_of``, ``group_size``): every row that goes, with the row that stays of its group.

    Rows belong together if their signatures differ in ``near`` bits at most and share a variant, or through
    others. Of each group the row with the least key stays (null keys last, then the least hash of the text);
    of rows equal in both one stays, so a row given twice is reported once, with itself. Texts that are null
    or blank belong to no group; a text without words is one feature, so that equal ones are duplicates.
    Whole texts count at any length; other columns are ignored; an empty table gives no rows.
    """
    own = _decisions(docs, near, key, text).withColumn("n", F.col("n") - F.when(_best(), 1).otherwise(0)).where("n > 0")
    return own.select(F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"), F.col("key").alias(key), F.col("best.key").alias("duplicate_of"), "group_size").drop("i")


def drop(docs: DataFrame, near: int = NEAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Cases: see ``duplicates``; of rows equal in key and
    text that with the least hash of all columns stays."""
    own = positional(docs)
    k, t = F.col(place(docs, key)), F.col(place(docs, text))
    decided = cut(_decisions(docs, near, key, text).select(F.col("key").alias("d_key"), F.col("hash").alias("d_hash"), _best().alias("stays"), "n"))
    gone, again = decided.where("not stays").drop("stays", "n"), decided.where("stays and n > 1").drop("stays", "n")
    gone_rows, again_rows = decided.agg(F.count_if(~F.col("stays")), F.count_if(F.col("stays") & (F.col("n") > 1))).first()
    same = k.eqNullSafe(F.col("d_key")) & (F.xxhash64(t.cast("string")) == F.col("d_hash")) & t.isNotNull()
    small = lambda x, n: F.broadcast(x) if n <= BROADCAST_ROWS else x
    left = own.join(small(gone, gone_rows), same, "left_anti")
    if again_rows:  # rows given several times
        again = small(again, again_rows)
        first = Window.partitionBy(k, F.xxhash64(t)).orderBy(F.xxhash64(*own.columns))
        one = left.join(again, same, "left_semi").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
        left = left.join(again, same, "left_anti").unionByName(one)
    return left.toDF(*docs.columns)

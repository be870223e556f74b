"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits the unit sphere at medians, by one random direction a level. The medians come from a bounded sample of
vectors, so the forest is small enough to broadcast; every vector is filed under one leaf of each tree. A query
descends all trees with one shared priority queue: the branch whose crossed margins have the least sum of squares comes
first, whichever tree it is in, until the leaves taken hold ``enough`` members. Queries meet the leaves'
members by a join. Single precision tells which members may be among the nearest, and these are ranked by their exact distance.

``enough`` is measured: the true neighbours of PROBES vectors are found by one pass over all rows, and the queue goes as far as
it must to meet the wanted share of them. Vectors with clusters need as many members whatever their number; those
without any structure need a share of all, as there is nothing that an index could use. A member counts once for each tree that
it is met in, and is filed once for each tree, so how many of the trees are used is measured as well: that number with which the work is least.

Rows with equal vectors are one member with the k + 1 least of their ids, as no others can be among k nearest. Leaves with many members
are cut in chunks and leaves that many queries visit in blocks, so no task holds more than MEMBERS x QUERIES.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm.common import cut, pick, ragged

TREES, LEAF = 8, 256
#: Vectors that the splits are made from, about PER_LEAF for a leaf: trees of SAMPLE / PER_LEAF leaves at most, which grow beyond LEAF
#: from 4 million vectors on. All vectors are filed and counted.
SAMPLE, PER_LEAF = 131_072, 8
#: Vectors whose true neighbours are found, and the share of these that the search must meet.
PROBES, RECALL = 64, 0.97
#: Members and visits of queries that one task holds.
MEMBERS, QUERIES = 16_384, 16_384
#: Comparisons with a query for which filing a member in one more tree counts.
FILED = 1_000
#: Distances are rounded to so many digits: nearer ones are equal.
DIGITS = 12


class Forest:
    """Complete binary trees of one depth, nodes in breadth-first order; the left child of i is 2 i + 1. ``directions`` (trees,
    depth, dims), ``splits`` (trees, nodes). Leaves are numbered through all trees."""

    def __init__(self, directions: np.ndarray, splits: np.ndarray):
        self.directions, self.splits = directions, splits
        self.trees, self.depth, self.dims = directions.shape
        self.leaves = splits.shape[1] + 1
        self._lists: list[list[float]] | None = None

    @classmethod
    def build(cls, sample: np.ndarray, trees: int, depth: int, seed: int = 11) -> Forest:
        rng = np.random.default_rng(seed)
        directions = rng.standard_normal((trees, depth, sample.shape[1]))
        directions /= np.linalg.norm(directions, axis=2, keepdims=True)
        splits = np.zeros((trees, 2**depth - 1))
        for t in range(trees):
            p, node = sample @ directions[t].T, np.zeros(len(sample), np.int64)
            for level in range(depth):
                low = 2**level - 1
                order = np.lexsort((p[:, level], node))
                ends = np.searchsorted(node[order], low + np.arange(2**level + 1))
                some = np.flatnonzero(np.diff(ends))
                splits[t, low + some] = p[order[(ends[some] + ends[some + 1]) // 2], level]
                node = 2 * node + 1 + (p[:, level] >= splits[t, node])
        return cls(directions, splits)

    def project(self, x: np.ndarray) -> np.ndarray:
        """(n, trees, depth)."""
        return (x @ self.directions.reshape(-1, self.dims).T).reshape(len(x), self.trees, self.depth)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """(n, trees): each vector's leaves; one on a split goes right."""
        p = self.project(x)
        at, tree = np.zeros((len(x), self.trees), np.int64), np.arange(self.trees)
        for level in range(self.depth):
            at = 2 * at + 1 + (p[:, :, level] >= self.splits[tree, at])
        return at - (self.leaves - 1) + tree * self.leaves

    def margins(self, p: np.ndarray) -> np.ndarray:
        """For one vector's projections the sum of the squared margins crossed on the way to each leaf, 0 to its own."""
        crossed = np.zeros((self.trees, 1))
        for level in range(self.depth):
            low = 2**level - 1
            m = p[:, level, None] - self.splits[:, low : 2 * low + 1]
            crossed = np.stack([crossed + np.maximum(m, 0) ** 2, crossed + np.maximum(-m, 0) ** 2], -1).reshape(self.trees, -1)
        return crossed.ravel()

    def most(self, p: np.ndarray, sizes: np.ndarray, enough: int) -> np.ndarray:
        """What ``search`` gives, by sorting all leaves: faster where most are taken."""
        order = np.argsort(self.margins(p), kind="stable")
        order = order[sizes[order] > 0]
        return order[: np.searchsorted(np.cumsum(sizes[order]), enough) + 1]

    def first(self, trees: int) -> Forest:
        """Of the first trees only."""
        return Forest(self.directions[:trees], self.splits[:trees])

    def search(self, p: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
        """Leaves in the order of the shared queue, until they hold ``enough`` members. ``p``: one vector's projections."""
        if self._lists is None:
            self._lists = self.splits.tolist()
        splits, depth, base, rows = self._lists, self.depth, self.leaves - 1, p.tolist()
        queue: list[tuple[float, int, int, int]] = [(0.0, t, 0, 0) for t in range(self.trees)]
        found: list[int] = []
        held = 0
        while queue and held < enough:
            crossed, t, level, node = heapq.heappop(queue)
            row, own = rows[t], splits[t]
            while level < depth:
                m = row[level] - own[node]
                level += 1
                right = m >= 0
                heapq.heappush(queue, (crossed + m * m, t, level, 2 * node + 2 - right))
                node = 2 * node + 1 + right
            leaf = node - base + t * self.leaves
            if sizes[leaf]:
                found.append(leaf)
                held += sizes[leaf]
        return found


def _packed(leaves: np.ndarray, number: int) -> bytes:
    """Some of so many leaves, as compressed bits: a query may visit thousands."""
    mask = np.zeros(number, bool)
    mask[leaves] = True
    return zlib.compress(np.packbits(mask).tobytes(), 1)


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    """In order of the leaves' numbers."""
    return [np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(x), np.uint8))) for x in column.to_pylist()]


def _units(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of length 1; scaled by the greatest number first, so that nothing overflows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(1, keepdims=True, initial=0)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def clean(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v), one row an id, of the vectors that have a direction and the most frequent number of dimensions; and that number."""
    own = pick(vectors, key, vector).toDF("id", "v")
    if own.schema["v"].dataType.elementType != T.FloatType():
        own = own.withColumn("v", F.col("v").cast("array<double>"))
    own = own.where("id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)")
    own = cut(own.groupBy("id").agg(F.min("v").alias("v")))
    first = own.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = first.dims if first else 0
    return own.where(F.size("v") == dims), dims


def _places(members: np.ndarray, visits: np.ndarray, queries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each leaf its group (-1 if no query visits it), in how many chunks its members go and in how many blocks the queries of its group. Leaves go
    together as long as they stay within MEMBERS, or a 16th of all up to four times as many: a query is sent to a group once, however many of its leaves it
    visits, and each block of 4 QUERIES gets the members again. ``queries``: how many there are."""
    limit = max(MEMBERS, min(4 * MEMBERS, int(members.sum()) // 16))
    chunks = -(-members // limit)
    group, number, held = np.full(len(members), -1, np.int32), 0, 0
    for i in np.flatnonzero((members > 0) & (visits > 0)).tolist():
        if held and held + members[i] > limit:
            number, held = number + 1, 0
        group[i] = number
        held += int(members[i])
    some = group >= 0
    asked = np.minimum(np.bincount(group[some], visits[some], number + 1).astype(np.int64), queries)
    blocks = np.ones(len(members), np.int64)
    blocks[some] = np.maximum(1, -(-asked // (4 * QUERIES)))[group[some]]
    return group, chunks, blocks


def _nearest(asked: pa.Table, members: pa.Table, dims: int, most: int, kind: pa.DataType, leaves: int) -> pa.Table:
    """The ``most`` nearest of the members in the leaves that each query visits, by distance and id. A tree has ``leaves`` leaves.

    ``least``: ``most`` members are known that are as similar, so none below it can be among the nearest. Members of one tree are
    different ones, those of several trees may not be, so ``tops`` is kept for one tree at a time."""
    struct = pa.struct([("distance", pa.float64()), ("neighbour", kind)])
    if not asked.num_rows or not members.num_rows:
        return pa.table({"qid": pa.array([], kind), "found": pa.array([], pa.list_(struct))})
    q, m = _units(asked.column("v"), dims), _units(members.column("v"), dims)
    ids = members.column("ids").combine_chunks()
    flat_ids = ids.flatten()
    _, code = np.unique(flat_ids.to_numpy(zero_copy_only=False), return_inverse=True)  # the ids' order, of whatever type
    first, held = ids.offsets.to_numpy()[:-1].astype(np.int64) - ids.offsets[0].as_py(), np.diff(ids.offsets.to_numpy()).astype(np.int64)
    leaf = members.column("leaf").to_numpy()
    by_leaf = np.argsort(leaf, kind="stable")
    lists = _unpacked(asked.column("leaves"))
    wanted = np.concatenate(lists)
    row = np.repeat(np.arange(len(q)), [len(x) for x in lists])
    by_wanted = np.argsort(wanted, kind="stable")
    some, starts = np.unique(wanted[by_wanted], return_index=True)
    ends = np.append(starts[1:], len(wanted))

    def best(r: np.ndarray, c: np.ndarray, d: np.ndarray, n: int = most) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((code[first[c]], d, r))
        r, c, d = r[order], c[order], d[order]
        again = np.zeros(len(r), bool)  # a member seen in several trees
        again[1:] = (r[1:] == r[:-1]) & (code[first[c[1:]]] == code[first[c[:-1]]])
        r, c, d = r[~again], c[~again], d[~again]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < n
        return r[keep], c[keep], d[keep]

    small_q, small_m, slack = q.astype(np.float32), m.astype(np.float32), np.float32(dims * 2.5e-7)  # of single precision, twice
    least, tops, tree = np.full(len(q), -np.inf, np.float32), np.empty((len(q), most), np.float32), -1
    parts, held_now = [], 0
    for number, a, b in zip(some.tolist(), starts.tolist(), ends.tolist()):
        if number // leaves != tree:
            tree = number // leaves
            tops.fill(-np.inf)
        own = by_leaf[np.searchsorted(leaf[by_leaf], number) : np.searchsorted(leaf[by_leaf], number, "right")]
        rows = row[by_wanted[a:b]]
        for low in range(0, len(rows), 512):
            r = rows[low : low + 512]
            for at in range(0, len(own), 4096):
                c = own[at : at + 4096]
                s = small_q[r] @ small_m[c].T
                new = np.flatnonzero(np.isneginf(least[r]))
                if len(new) and len(c) > most:
                    least[r[new]] = np.partition(s[new], len(c) - most, 1)[:, len(c) - most]
                x, y = np.divmod(np.flatnonzero(s >= (least[r] - slack)[:, None]), len(c))
                if not len(x):
                    continue
                found = s[x, y]
                order = np.lexsort((-found, x))
                nth = np.arange(len(x)) - np.searchsorted(x, x)
                which, at_ = np.unique(x, return_inverse=True)
                wide = np.full((len(which), 2 * most), -np.inf, np.float32)
                wide[:, :most] = tops[r[which]]
                wide[at_[nth < most], most + nth[nth < most]] = found[order][nth < most]
                tops[r[which]] = wide = np.partition(wide, most, 1)[:, most:]
                least[r[which]] = np.maximum(least[r[which]], wide.min(1))
                x, y = r[x], c[y]
                parts.append((x, y, np.round(1.0 - np.einsum("kd,kd->k", q[x], m[y]), DIGITS)))
                held_now += len(x)
                if held_now > 1_000_000:
                    parts = [best(*(np.concatenate(z) for z in zip(*parts)))]
                    held_now = 0
    if not parts:
        return _nearest(asked.slice(0, 0), members, dims, most, kind, leaves)
    r, c, d = best(*(np.concatenate(z) for z in zip(*parts)))
    # a member stands for all its ids
    place = ragged(np.arange(len(code)), first[c], held[c])
    r, d = np.repeat(r, held[c]), np.repeat(d, held[c])
    order = np.lexsort((code[place], d, r))
    order = order[np.arange(len(r)) - np.searchsorted(r[order], r[order]) < most]
    r, d, place = r[order], d[order], place[order]
    rows = np.unique(r)
    bounds = np.append(np.searchsorted(r, rows), len(r)).astype(np.int32)
    structs = pa.StructArray.from_arrays([pa.array(d), flat_ids.take(pa.array(place))], fields=list(struct))
    return pa.table({"qid": asked.column("qid").combine_chunks().take(pa.array(rows)), "found": pa.ListArray.from_arrays(pa.array(bounds), structs)})


def neighbours(
    vectors: DataFrame, k: int = 10, queries: Callable[[Column], Column] | None = None, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(``key``, ``rank`` from 1, ``neighbour``, ``distance`` 1 - cosine) of the ``k`` nearest other rows of every query.

    ``queries``: a condition on the key, by default all rows; they are searched against all rows. Distances are rounded to DIGITS
    digits, equal ones go by id. Keys may be of any type that has an order. Rows with a null id, or with a vector that is null, empty,
    zero or holds a null, NaN or infinite number, or of another size than most (the least of the most frequent sizes), are
    no queries and nobody's neighbours. Of rows with equal ids the one with the least vector counts, so no row is its
    own neighbour. Fewer than ``k`` others give as many ranks as there are; an empty table none. Other columns are
    ignored. ``recall``: the share of true neighbours that the search is set to meet on the probes.
    """
    spark, most = vectors.sparkSession, k + 1
    rows, dims = clean(vectors, key, vector)
    id_type, v_type = (rows.schema[c].dataType.simpleString() for c in ("id", "v"))
    out = f"qid {id_type}, found array<struct<distance: double, neighbour: {id_type}>>"
    # both steps within the hash's partitions, as floating-point keys would be shuffled again for the second
    nth = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))
    alike = rows.withColumn("h", F.xxhash64("v")).repartition("h").withColumn("nth", nth).where(F.col("nth") <= most)  # most ids at most
    members = cut(alike.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids", "v", "h"))
    total = members.count()
    depth = max(1, math.ceil(math.log2(max(total, 1) / leaf))) if total <= SAMPLE // PER_LEAF * leaf else int(math.log2(SAMPLE // PER_LEAF))
    some = F.pmod(F.xxhash64("ids"), F.lit(1 << 20)) < F.lit(min(1 << 20, math.ceil((1 << 20) * SAMPLE / max(total, 1))))
    picked = members.where(some).select("v", F.xxhash64("ids").alias("o")).toArrow()  # about SAMPLE rows, whatever the table
    sample = _units(picked.column("v"), max(dims, 1))[np.argsort(picked.column("o").to_numpy())]
    forest = Forest.build(sample, trees, depth) if len(sample) else Forest(np.zeros((trees, depth, max(dims, 1))), np.zeros((trees, 2**depth - 1)))
    probes = sample[:PROBES]
    shared = spark.sparkContext.broadcast((forest, probes))  # trees x SAMPLE / PER_LEAF splits at most
    leaves = trees * forest.leaves

    def probe(batches):
        forest, probes = shared.value
        count, near, where = np.zeros(leaves, np.int64), np.full((len(probes), k), -np.inf), np.zeros((len(probes), k, trees), np.int32)
        for b in batches:
            if b.num_rows:
                x = _units(b.column(0), dims)
                at = forest.leaf(x)
                count += np.bincount(at.ravel(), minlength=leaves)
                s = probes @ x.T
                s[s > 1 - 1e-9] = -np.inf  # itself
                top = np.argpartition(-s, min(k, len(x)) - 1, 1)[:, :k]
                s, w = np.concatenate([near, np.take_along_axis(s, top, 1)], 1), np.concatenate([where, at[top]], 1)
                order = np.argsort(-s, 1, kind="stable")[:, :k]
                near, where = np.take_along_axis(s, order, 1), np.take_along_axis(w, order[:, :, None], 1)
        have = np.flatnonzero(count)
        p, j = np.nonzero(np.isfinite(near))
        hits = pa.StructArray.from_arrays([pa.array(-near[p, j]), pa.array(where[p, j].tolist(), pa.list_(pa.int32()))], names=["d", "leaves"])
        hits = pa.concat_arrays([pa.nulls(len(have), hits.type), hits])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([have, -1 - p]).astype(np.int32)), pa.array(np.concatenate([count[have], 0 * p])), hits], names=["which", "n", "hit"])

    found = members.select("v").mapInArrow(probe, "which int, n bigint, hit struct<d: double, leaves: array<int>>")
    found = found.groupBy("which").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.collect_list("hit")), 1, k).alias("hits")).collect()  # leaves and PROBES rows at most
    sizes = np.zeros(leaves, np.int64)
    sizes[[r.which for r in found if r.which >= 0]] = [r.n for r in found if r.which >= 0]
    wanted = rows if queries is None else rows.where(queries(F.col("id")))
    each, number, choices = forest.leaves, wanted.count(), []
    for n in dict.fromkeys([*(2**i for i in range(trees.bit_length()) if 2**i <= trees), trees]):
        some, needed, own = forest.first(n), [1], sizes[: n * each]
        for r in found:
            if r.which < 0:
                order = np.argsort(some.margins(some.project(probes[[-1 - r.which]])[0]), kind="stable")
                before = np.empty(n * each, np.int64)
                before[order] = np.cumsum(own[order]) - own[order]
                needed += [int(before[h.leaves[:n]].min()) + 1 for h in r.hits]
        looked = max(most, int(np.quantile(needed, recall, method="higher")))
        choices.append((number * looked + FILED * n * total, n, looked))
    _, used, enough = min(choices)
    forest, trees, sizes, leaves = forest.first(used), used, sizes[: used * each], used * each
    shared = spark.sparkContext.broadcast((forest, probes))

    def ask(batches):
        forest, many = shared.value[0], 8 * enough > sizes.sum()
        own = sizes if many else sizes.tolist()
        for b in batches:
            for low in range(0, b.num_rows, 1024):
                part = b.slice(low, 1024)
                lists = [(forest.most if many else forest.search)(p, own, enough) for p in forest.project(_units(part.column(1), dims))]
                lists = [_packed(x, leaves) for x in lists]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lists, pa.binary())], names=["qid", "v", "leaves"])

    alone = wanted.groupBy("v").agg(F.min("id").alias("qid"))
    asked = cut(alone.select("qid", "v").mapInArrow(ask, f"qid {id_type}, v {v_type}, leaves binary"))

    def visited(batches):
        count = np.zeros(leaves, np.int64)
        for b in batches:
            for x in _unpacked(b.column(0)):
                count[x] += 1
        have = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array(count[have])], names=["leaf", "n"])

    visits = np.zeros(leaves, np.int64)
    for r in asked.select("leaves").mapInArrow(visited, "leaf int, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # leaves at most
        visits[r.leaf] = r.n
    group, chunks, blocks = _places(sizes, visits, asked.count())
    names = ["grp", "chunk", "blk"]

    def file(batches):
        forest = shared.value[0]
        for b in batches:
            if b.num_rows:
                at = forest.leaf(_units(b.column(1), dims)).ravel()
                row = np.repeat(np.arange(b.num_rows), trees)
                row, at = row[group[at] >= 0], at[group[at] >= 0]
                times = blocks[at]
                blk = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, at = np.repeat(row, times), np.repeat(at, times)
                chunk = b.column(2).to_numpy()[row] % chunks[at]
                for low in range(0, len(row), 50_000):
                    cut_ = slice(low, low + 50_000)
                    take = pa.array(row[cut_])
                    numbers = [pa.array(x[cut_].astype(np.int32)) for x in (group[at], chunk, blk, at)]
                    yield pa.RecordBatch.from_arrays([*numbers, b.column(0).take(take), b.column(1).take(take)], names=[*names, "leaf", "ids", "v"])

    def spread(batches):
        for b in (b.slice(low, 1024) for b in batches for low in range(0, b.num_rows, 1024)):
            if not b.num_rows:
                continue
            lists = _unpacked(b.column(2))
            at, row = np.concatenate(lists), np.repeat(np.arange(b.num_rows), [len(x) for x in lists])
            times = chunks[at]
            chunk = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, at = np.repeat(row, times), np.repeat(at, times)
            if not len(row):
                continue
            order = np.lexsort((at, chunk, group[at], row))
            row, at, chunk = row[order], at[order], chunk[order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(group[at]) != 0) | (np.diff(chunk) != 0)]))
            bounds = np.append(new, len(row)).astype(np.int32)
            blk = b.column(3).to_numpy()[row[new]] % blocks[at[new]]
            for low in range(0, len(new), 50_000):
                some = new[low : low + 50_000]
                take, own = pa.array(row[some]), bounds[low : low + len(some) + 1]
                numbers = [pa.array(x.astype(np.int32)) for x in (group[at[some]], chunk[some], blk[low : low + 50_000])]
                own_lists = pa.array([_packed(at[i:j], leaves) for i, j in zip(own[:-1].tolist(), own[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([*numbers, b.column(0).take(take), b.column(1).take(take), own_lists], names=[*names, "qid", "v", "leaves"])

    filed = members.mapInArrow(file, f"grp int, chunk int, blk int, leaf int, ids array<{id_type}>, v {v_type}")
    sent = asked.select("qid", "v", "leaves", F.xxhash64("qid").alias("h")).mapInArrow(spread, f"grp int, chunk int, blk int, qid {id_type}, v {v_type}, leaves binary")

    def rank(asked: pa.Table, members: pa.Table) -> pa.Table:
        return _nearest(asked, members, dims, most, asked.schema.field("qid").type, each)

    near = sent.groupBy(*names).cogroup(filed.groupBy(*names)).applyInArrow(rank, out)
    merged = near.groupBy("qid").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, most).alias("found"))
    whole = wanted.join(alone, "v").select("id", "qid").join(merged, "qid")
    whole = whole.select("id", F.expr(f"slice(filter(found, x -> x.neighbour != id), 1, {k})").alias("found"))
    return whole.select("id", F.posexplode("found").alias("pos", "hit")).select("id", (F.col("pos") + 1).alias("rank"), "hit.neighbour", "hit.distance").toDF(key, "rank", "neighbour", "distance")

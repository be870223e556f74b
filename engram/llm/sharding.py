"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has VIRTUAL points on the ring of hash values; a key belongs to the arc that ends in the next point
clockwise, and at first to its shard. No shard takes more than ceil((1 + SLACK) x keys / shards). In
each round all keys without a place ask the next shard clockwise from their arc that they haven't
asked; a shard with less room takes arcs in the ring's order and keys within an arc by hash, and the
others go on. All have a place after as many rounds as there are shards at most.

Only the numbers of keys of the arcs (shards x VIRTUAL rows, whatever the data) are needed to decide: the plan says
for each arc which ranks of its keys go to which shard. Arcs whose keys all stay, the most, are
assigned by their arc alone; keys of the others are ranked within their arc.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import cut, pick

SHARDS, VIRTUAL, SLACK = 64, 128, 0.05
RING = 1 << 60


def position(text: str) -> int:
    """Place of a string on the ring: the first 15 hexadecimal digits of its MD5."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def place_of(key: Column) -> Column:
    """The same for a column; a null key has the place of 'null'."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("key:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 15), 16, 10).cast("bigint")


def ring(shards: int = SHARDS, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(point, shard), ascending. The names of points don't depend on the number of shards, so that a further shard
    takes keys but moves none between the others."""
    return sorted((position(f"shard:{s}:{v}"), s) for s in range(shards) for v in range(virtual))


def plan(points: list[tuple[int, int]], counts: dict[int, int], shards: int, capacity: int) -> dict[int, list[tuple[int, int]]]:
    """For each arc with keys [(ranks below, shard), ...], ascending: the first ranks go to the first shard and so on."""
    n = len(points)
    room = [capacity] * shards
    out: dict[int, list[tuple[int, int]]] = {a: [] for a in sorted(counts)}
    left = {a: (0, a, frozenset()) for a in sorted(counts) if counts[a]}  # arc -> (keys placed, point to ask, shards asked)
    while left:
        after = {}
        for arc, (done, at, asked) in left.items():
            s = points[at][1]
            take = min(room[s], counts[arc] - done)
            if take:
                room[s] -= take
                done += take
                out[arc].append((done, s))
            if done < counts[arc]:
                asked |= {s}
                if len(asked) == shards:
                    raise ValueError("the capacity is too small")
                while points[at][1] in asked:
                    at = (at + 1) % n
                after[arc] = (done, at, asked)
        left = after
    return out


def shard(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL, slack: float = SLACK, key: str = "doc_id") -> DataFrame:
    """(``key``, ``home`` the shard that the ring alone gives, ``shard``, ``moved``) of every row.

    Loads count distinct keys; all rows of a key, repeated ones too, go to one shard. A null key is a key
    like others. Ties of hash values go by the key. Each shard has at most
    ceil((1 + slack) x keys / shards) keys. Other columns are ignored; an empty table gives no rows.
    """
    if shards < 1 or virtual < 1 or slack < 0:
        raise ValueError("there must be shards and points, and no negative slack")
    points = ring(shards, virtual)
    spark = docs.sparkSession
    own = pick(docs, key).select(F.col(key).alias("key"), F.col(key).cast("string").alias("name")).withColumn("place", place_of(F.col("name")))
    # buckets of the ring's first 16 bits find the arc without comparing a key with every point
    bits = 60 - 16
    table, at = [], 0
    for b in range(1 << 16):
        low, high = b << bits, (b + 1) << bits
        while at < len(points) and points[at][0] < low:
            at += 1
        inside = at
        ends = []
        while inside < len(points) and points[inside][0] < high:
            ends.append(points[inside][0])
            inside += 1
        if ends:
            table.append((b, at, ends))
    starts = spark.createDataFrame(table, "bucket int, first int, ends array<bigint>")  # shards x virtual rows at most
    edge = sorted((b, f) for b, f, _ in table)
    # buckets without a point: the next point is that of the next bucket with one
    filled, i = [], 0
    for b in range(1 << 16):
        while i < len(edge) and edge[i][0] < b:
            i += 1
        filled.append(edge[i][1] if i < len(edge) else 0)
    nexts = spark.createDataFrame([(b, f) for b, f in enumerate(filled)], "bucket int, next int")
    buckets = F.broadcast(nexts.join(starts, "bucket", "left").coalesce(1))  # 65,536 rows
    keyed = own.withColumn("bucket", F.shiftright("place", bits).cast("int")).join(buckets, "bucket")
    behind = F.coalesce(F.size(F.filter("ends", lambda e: e < F.col("place"))), F.lit(0))
    arc = F.when(F.col("ends").isNull(), F.col("next")).otherwise((F.col("first") + behind) % len(points))
    keyed = keyed.select("key", "name", "place", arc.cast("int").alias("arc"))
    distinct = cut(keyed.groupBy("name").agg(F.first("place").alias("place"), F.first("arc").alias("arc")))
    counts = {r.arc: r["count"] for r in distinct.groupBy("arc").count().collect()}  # shards x virtual rows at most
    total = sum(counts.values())
    capacity = math.ceil((1 + slack) * total / shards)
    decided = plan(points, counts, shards, capacity)
    ranges = [(a, points[a][1], low, high, s) for a, cuts in decided.items() for (high, s), low in zip(cuts, [0, *[c for c, _ in cuts]])]
    whole = [(a, h, s) for a, h, low, high, s in ranges if low == 0 and high == counts[a]]
    split = [r for r in ranges if not (r[2] == 0 and r[3] == counts[r[0]])]
    assigned = keyed.join(F.broadcast(spark.createDataFrame(whole, "arc int, home int, shard int")), "arc").select("key", "home", "shard")
    if split:
        parts = F.broadcast(spark.createDataFrame(split, "arc int, home int, low bigint, high bigint, shard int"))
        arcs = F.broadcast(spark.createDataFrame([(a,) for a in sorted({r[0] for r in split})], "arc int"))
        rank = F.dense_rank().over(Window.partitionBy("arc").orderBy("place", F.col("name").asc_nulls_last())) - 1
        rest = keyed.join(arcs, "arc", "left_semi").withColumn("rank", rank).join(parts, "arc").where("rank >= low and rank < high").select("key", "home", "shard")
        assigned = assigned.unionByName(rest)
    return assigned.select(F.col("key").alias(key), "home", "shard", (F.col("home") != F.col("shard")).alias("moved"))

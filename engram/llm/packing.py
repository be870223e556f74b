"""Best-fit packing into sequences of several permitted lengths.

Texts are cut into pieces of the greatest capacity at most and packed longest first. A piece goes
into the open bin that it fills best, of whatever capacity. If none has room, a bin is opened. In the end each bin is
downsized to the least capacity that holds its contents.

Which capacity to open is optimised for all sizes together: a plan names one for each class of pieces (those that fit into
the least capacity, into the next and so on), every plan is tried on the lengths at hand, and the one whose downsized
bins cost least in all is taken. A bin of c costs ``fixed`` + c + ``square`` x c squared. Lengths are characters, plus one for the
separator behind each piece.

Pieces are hashed into groups of about GROUP_CHARS and each group is packed on its own, with its own plan, so that packing needs one
shuffle of the texts and no order over all documents. The number of groups follows the table's size: a larger table isn't packed as
one whole, which costs part of a bin or two for each group of thousands of pieces.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_left, insort
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm.common import frugal, pick

CAPACITIES = (2_048, 4_096, 8_192, 16_384)
#: Cost of a bin of c: FIXED + c + SQUARE * c * c, a step's overhead and attention's growth with the length.
FIXED, SQUARE = 512.0, 1 / 65_536
GROUP_CHARS = 12 << 20


def cost(c: int, fixed: float = FIXED, square: float = SQUARE) -> float:
    return fixed + c + square * c * c


def _fill(lengths: list[int], classes: list[int], plan: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """(each piece's bin, the room used of each bin) for descending lengths; ``classes``: each piece's place in ``plan``."""
    room: list[tuple[int, int]] = []  # (room, bin), ascending
    where, used = [], []
    for n, kind in zip(lengths, classes):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            b, left = len(used), plan[kind]
            used.append(0)
        used[b] += n
        where.append(b)
        if left > n:
            insort(room, (left - n, b))
    return where, used


def plans(capacities: tuple[int, ...]) -> list[tuple[int, ...]]:
    """For pieces of each class any capacity that holds them: the factorial of the number of capacities."""
    return list(itertools.product(*[capacities[i:] for i in range(len(capacities))]))


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, fixed: float = FIXED, square: float = SQUARE) -> list[tuple[int, int, list[int]]]:
    """Bins (capacity, used, places in ``lengths`` in the order of packing) by the plan of least cost, of equal ones the first. Equal lengths go
    in their order, equal room by the bin opened first."""
    capacities = tuple(sorted(capacities))
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    if order and lengths[order[0]] > capacities[-1]:
        raise ValueError("a piece exceeds the greatest capacity")
    own = [lengths[i] for i in order]
    classes = [bisect_left(capacities, n) for n in own]
    costs = [cost(c, fixed, square) for c in capacities]
    best: tuple[float, list[int], list[int]] | None = None
    for plan in plans(capacities):
        where, used = _fill(own, classes, plan)
        total = sum(costs[bisect_left(capacities, u)] for u in used)
        if best is None or total < best[0]:
            best = (total, where, used)
    _, where, used = best
    bins: list[list[int]] = [[] for _ in used]
    for i, b in zip(order, where):
        bins[b].append(i)
    return [(capacities[bisect_left(capacities, u)], u, places) for u, places in zip(used, bins)]


def _out(key: T.DataType) -> T.StructType:
    i = T.IntegerType()
    return T.StructType([
        T.StructField("bin_id", T.StringType()), T.StructField("capacity", i), T.StructField("used", i), T.StructField("n_pieces", i),
        T.StructField("doc_ids", T.ArrayType(key)), T.StructField("parts", T.ArrayType(i)), T.StructField("starts", T.ArrayType(i)), T.StructField("text", T.StringType()),
    ])


#: Of so many equal rows in one partition of the input the further ones go to other groups.
ALIKE = 256


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, fixed: float = FIXED, square: float = SQUARE, key: str = "doc_id", text: str = "text", separator: str = "\x1e") -> DataFrame:
    """One row a bin: (``bin_id``, ``capacity``, ``used``, ``n_pieces``, ``doc_ids`` array of the key's type, ``parts`` the pieces' numbers within
    their documents from 0, ``starts`` in ``text``, ``text`` the pieces, each followed by ``separator``, one character).

    ``used`` counts characters with separators and is at most ``capacity``. Null and empty texts take no
    room and are in no bin. A null key stays null in ``doc_ids``. Repeated rows are packed each. Texts
    of any length are cut in pieces of the greatest capacity less one, none is lost. Equal lengths go by key
    (null last), part and text. Other columns are ignored; an empty table gives no bins.
    """
    capacities = tuple(sorted(set(capacities)))
    if not capacities or capacities[0] < 2 or len(capacities) > 5 or len(separator) != 1:
        raise ValueError("capacities must be 2 at least, five at most of them, and the separator one character")
    most = capacities[-1] - 1
    own = pick(docs, key, text).toDF("key", "text").select("key", F.col("text").cast("string")).where("text != ''")
    total = own.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = max(1, math.ceil(total / GROUP_CHARS))

    key_type = own.schema["key"].dataType
    kind = own.schema["key"].dataType.simpleString()

    def pieces(batches):
        seen: Counter = Counter()
        for batch in batches:
            keys, texts, hashes = batch.column(0), batch.column(1), batch.column(2).to_pylist()
            row, part, piece, salt, size = [], [], [], [], 0

            def out():
                return pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int32())), pa.array(part, pa.int32()), pa.array(piece, pa.string()), pa.array(salt, pa.int32())], names=["key", "part", "text", "salt"])  # noqa: B023

            for i, h in enumerate(hashes):
                t = texts[i].as_py()
                turn = seen[h] // ALIKE
                seen[h] += 1
                for p, at in enumerate(range(0, len(t), most)):
                    row.append(i)
                    part.append(p)
                    piece.append(t[at : at + most])
                    salt.append(turn)
                    size += len(piece[-1])
                    if size > 4 << 20:
                        yield out()
                        row, part, piece, salt, size = [], [], [], [], 0
            if row:
                yield out()

    cut_up = own.withColumn("h", F.xxhash64("key", "text")).mapInArrow(frugal(pieces), f"key {kind}, part int, text string, salt int")
    # equal rows are alike but for their number within a partition, which is all that the salt depends on
    further = F.when(F.col("salt") > 0, F.spark_partition_id())
    cut_up = cut_up.withColumn("grp", F.pmod(F.xxhash64("key", "part", "text", "salt", further), F.lit(groups)).cast("int")).drop("salt")
    schema = _out(key_type)

    def group(rows: pa.Table) -> pa.Table:
        grp = rows.column("grp")[0].as_py()
        keys, parts, texts = (rows.column(c).to_pylist() for c in ("key", "part", "text"))
        order = sorted(range(len(keys)), key=lambda i: (-len(texts[i]), keys[i] is None, 0 if keys[i] is None else keys[i], parts[i], texts[i]))
        found = best_fit([len(texts[i]) + 1 for i in order], capacities, fixed, square)
        out: list[list] = [[] for _ in schema]
        for b, (capacity, used, places) in enumerate(found):
            at, starts, body = 0, [], []
            for i in places:
                t = texts[order[i]]
                starts.append(at)
                body += [t, separator]
                at += len(t) + 1
            row = (f"{grp}-{b}", capacity, used, len(places), [keys[order[i]] for i in places], [parts[order[i]] for i in places], starts, "".join(body))
            for x, v in zip(out, row):
                x.append(v)
        types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(rows.schema.field("key").type), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.string()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=schema.names)

    return cut_up.groupBy("grp").applyInArrow(group, schema)

"""Helpers that several operators share: column picking, checkpoints, ragged arrays."""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once, whatever the size of an Arrow batch.
SLICE_BYTES = 4 << 20
#: Most rows that the Parquet reader decodes at once, and most bytes of an Arrow batch: long texts by the thousand don't fit an executor.
READ_ROWS, BATCH_BYTES = 128, 16 << 20


def bounded(spark: SparkSession) -> None:
    """Lowers what the engine decodes and sends to Python at once to READ_ROWS and BATCH_BYTES; what is lower stays. Spark's own 4,096 rows of
    200,000 characters are 0.8 GB in each task."""
    for name, most in (("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(str(spark.conf.get(name)).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def positional(df: DataFrame) -> DataFrame:
    """``df`` with columns ``_0, _1, ...``: no name of the caller's can clash with ours. Texts come in bounded batches from here on."""
    bounded(df.sparkSession)
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> str:
    """The positional name of column ``name``: the exact spelling first, else the only
    one that differs in case alone, else an error."""
    if name in df.columns:
        return f"_{df.columns.index(name)}"
    near = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(near) != 1:
        raise ValueError(f"no column {name!r} in {df.columns}")
    return f"_{near[0]}"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Just these columns, found by ``place``."""
    return positional(df).select(*[F.col(place(df, n)).alias(n) for n in names])


def checkpoints(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: the one that the cluster names in
    ``spark.checkpoint.dir``; a temporary one only in local mode, where there is one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder; lost executors don't
    take it along."""
    checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def slices(lengths: np.ndarray, most: int = SLICE_BYTES):
    """(from, to) of consecutive rows with about ``most`` bytes in all, one row at least."""
    at = 0
    ends = np.cumsum(lengths)
    while at < len(lengths):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield at, to
        at = to


def frugal(run):
    """``run`` for mapInArrow; at its end the worker, which goes on to other stages, gives back what Arrow keeps for no array."""

    def own(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return own


def portions(batch: pa.RecordBatch, text: int):
    """``batch`` in pieces of about SLICE_BYTES of its column number ``text``, so that the engine holds one piece at once as it reads them."""
    for at, to in slices(np.diff(buffers(batch.column(text))[0])):
        yield batch.slice(at, to - at)


def as_string(column: pa.Array) -> pa.Array:
    """One string array with 32-bit offsets from a (chunked) array of any string type."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column if pa.types.is_string(column.type) else column.cast(pa.string())


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array, offsets from 0; nulls are empty."""
    column = as_string(column)
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def ragged(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The pieces ``flat[start[i] : start[i] + length[i]]``, one after another."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - length), length) + np.arange(total)]


def file_bytes(path: str) -> bytes:
    with open(os.path.expanduser(path), "rb") as f:
        return f.read()

"""What a bounded table of entries holds after saves and deletions, as plans over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, *order, first: bool = False) -> DataFrame:
    """One row of each ``key``: the last in ``order``, or the first. Columns of ``order`` must tell rows apart."""
    cols = [F.col(c) if first else F.col(c).desc() for c in order]
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*cols))).where("_nth = 1").drop("_nth")


def upsert(entries: DataFrame, new: DataFrame, key: str = "id", ordinal: str | None = None) -> DataFrame:
    """``entries`` with the rows of ``new`` in place of those of equal ids; of several new rows of an id the one with the greatest
    ``ordinal`` stays."""
    fresh = latest(new, key, ordinal) if ordinal else new
    fresh = fresh.select(*entries.columns)
    return entries.join(fresh.select(key), key, "left_anti").select(*entries.columns).unionByName(fresh)


def newest(entries: DataFrame, most: int) -> DataFrame:
    """The ``most`` newest rows by timestamp, ties by the greater id.

    No sort of the whole table into one place: the counts of rows by time tell where the limit lies, and only rows of that
    one timestamp are ranked.
    """
    if most <= 0:
        return entries.limit(0)
    by_time = entries.groupBy("timestamp").agg(F.count("*").alias("n"))
    # days first, then the times of the day in which the limit lies: two small windows
    day = F.floor(F.col("timestamp") / 86_400)
    days = by_time.groupBy(day.alias("day")).agg(F.sum("n").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.withColumn("above", above).where(F.col("above") < most).withColumn("split", F.col("above") + F.col("n") > most)
    times = by_time.withColumn("day", day).join(days.where("split").select("day", "above"), "day")
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("timestamp")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    times = times.withColumn("room", F.lit(most) - F.col("above") - before).where("room > 0").select("timestamp", "room", (F.col("n") > F.col("room")).alias("cut"))
    whole = entries.join(days.where("not split").select(F.col("day").alias("_day")), day == F.col("_day"), "left_semi")
    part = entries.join(times.where("not cut").select("timestamp"), "timestamp", "left_semi").select(*entries.columns)
    edge = entries.join(times.where("cut").select("timestamp", "room"), "timestamp")
    edge = edge.withColumn("_nth", F.row_number().over(Window.partitionBy("timestamp").orderBy(F.desc("id")))).where("_nth <= room").select(*entries.columns)
    return whole.unionByName(part).unionByName(edge)


def clear_scope(entries: DataFrame, scope: str) -> DataFrame:
    """Without the rows of ``scope``; those without a scope stay."""
    return entries.where(~F.col("scope").eqNullSafe(scope))


def unembedded(entries: DataFrame, embeddings: DataFrame, limit: int | None = None) -> DataFrame:
    out = entries.join(embeddings.select("id"), "id", "left_anti")
    return out if limit is None else out.limit(limit)

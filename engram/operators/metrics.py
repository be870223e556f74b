"""Quality of retrieval against known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)
BUDGETS = (500, 1_000, 2_000, 4_000)


def distinct_ranked(ranked: DataFrame, by: str = "query_id", item: str = "item", rank: str = "rank") -> DataFrame:
    """(by, item, rank): an item given twice counts where it comes first, ranks are 1, 2, ..."""
    first = ranked.groupBy(by, item).agg(F.min(rank).alias("_first"))
    return first.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy("_first", item))).drop("_first")


def recall_and_ndcg(ranked: DataFrame, gold: DataFrame, queries: DataFrame, cuts: tuple[int, ...] = CUTS, by: str = "query_id", item: str = "item") -> DataFrame:
    """(by, k, recall, ndcg) for every query and cut; null for queries without known answers."""
    truth = gold.select(by, item).distinct()
    size = truth.groupBy(by).agg(F.count("*").alias("n"))
    hits = distinct_ranked(ranked, by, item).where(F.col("rank") <= max(cuts)).join(truth, [by, item], "left_semi")
    grid = queries.select(by).distinct().withColumn("k", F.explode(F.array(*[F.lit(k) for k in cuts])))
    gain = F.lit(1.0) / F.log2(F.col("rank") + 1)
    each = grid.join(hits, by, "left").groupBy(by, "k").agg(F.sum(F.when(F.col("rank") <= F.col("k"), 1).otherwise(0)).alias("found"), F.sum(F.when(F.col("rank") <= F.col("k"), gain).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("k", "n").cast("int")), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2(i + 1))
    out = each.join(size, by, "left")
    return out.select(by, "k", (F.col("found") / F.col("n")).alias("recall"), (F.col("dcg") / F.when(F.col("n") > 0, ideal)).alias("ndcg"))


def recall_at_budget(packed: DataFrame, gold: DataFrame, queries: DataFrame, by: str = "query_id", item: str = "item") -> DataFrame:
    """(by, recall): the share of known answers among the rows packed; null without known answers."""
    truth = gold.select(by, item).distinct()
    found = truth.join(packed.select(by, item), [by, item], "left_semi").groupBy(by).agg(F.count("*").alias("found"))
    size = truth.groupBy(by).agg(F.count("*").alias("n"))
    out = queries.select(by).distinct().join(size, by, "left").join(found, by, "left")
    return out.select(by, F.when(F.col("n") > 0, F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"))


def mean_rollup(values: DataFrame, group: str, *metrics: str) -> DataFrame:
    """(group, level, n, metrics): means without nulls, 0 where there are none, overall ('all') and for each ``group``."""
    rolled = values.rollup(group).agg(F.grouping(group).alias("_g"), F.count("*").alias("n"), *[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics])
    return rolled.select(group, F.when(F.col("_g") == 1, "all").otherwise("group").alias("level"), "n", *metrics)

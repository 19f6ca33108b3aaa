"""Retrieval quality against expected keywords: recall, reciprocal rank, nDCG; by mode and by query type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quality(results: DataFrame, golden: DataFrame, k: int = 10) -> DataFrame:
    """(mode, query, queryType, recall, mrr, ndcg); results (mode, query, rank, text), golden (query, keywords, queryType)."""
    hit = F.filter("keywords", lambda w: F.contains(F.lower("text"), F.lower(w)))
    rows = results.filter(F.col("rank") <= k).join(F.broadcast(golden), "query").select("mode", "query", "queryType", "rank", "keywords", hit.alias("hit"))
    rows = rows.withColumn("gain", F.size("hit").cast("double")).withColumn("best", F.row_number().over(Window.partitionBy("mode", "query").orderBy(F.desc("gain"), "rank")))
    discounted = lambda n: F.sum(F.col("gain") / F.log2(F.col(n) + 1.0))
    g = rows.groupBy("mode", "query", "queryType").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("hits"), F.max(F.size("keywords")).alias("n"), F.min(F.when(F.col("gain") > 0, F.col("rank"))).alias("first"), discounted("rank").alias("dcg"), discounted("best").alias("ideal")
    )
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return g.select("mode", "query", "queryType", zero(F.try_divide("hits", "n")).alias("recall"), zero(F.try_divide(F.lit(1.0), "first")).alias("mrr"), zero(F.try_divide("dcg", "ideal")).alias("ndcg"))


def summary(scores: DataFrame, by: tuple[str, ...] = ("mode", "queryType")) -> DataFrame:
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("queries"), mean("recall"), mean("mrr"), mean("ndcg"))


def best_mode(scores: DataFrame) -> DataFrame:
    return summary(scores, ("mode",)).orderBy(F.desc(F.col("recall") + F.col("mrr") + F.col("ndcg")), "mode").limit(1).select("mode")

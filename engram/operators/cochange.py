"""Files that change together: association rules over commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs(commits: DataFrame, min_support: float = 0.01, min_confidence: float = 0.3) -> DataFrame:
    """(file1, file2, together, support, confidence), file1 < file2; confidence is that of file1 leading to file2.

    commits: (commit, file). A commit's pairs are made within its own sorted set of files, so commits are shuffled once
    and pairs are pre-aggregated before their own shuffle.
    """
    sets = commits.filter("file is not null").groupBy("commit").agg(F.array_sort(F.collect_set("file")).alias("files"))
    total = sets.agg(F.count(F.lit(1)).alias("commits"))
    single = sets.select(F.explode("files").alias("file1")).groupBy("file1").agg(F.count(F.lit(1)).alias("alone"))
    each = sets.select("files", F.posexplode("files").alias("i", "file1")).select("file1", F.explode(F.slice("files", F.col("i") + 2, F.size("files"))).alias("file2"))
    counted = each.groupBy("file1", "file2").agg(F.count(F.lit(1)).alias("together"))
    rules = counted.join(single, "file1").join(F.broadcast(total)).select(
        "file1", "file2", "together", F.round(F.col("together") / F.col("commits"), 6).alias("support"), F.round(F.col("together") / F.col("alone"), 6).alias("confidence")
    )
    return rules.filter((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))


def related(rules: DataFrame, file: str) -> DataFrame:
    """(file, confidence): partners of a file from either side."""
    one = rules.filter(F.col("file1") == file).select(F.col("file2").alias("file"), "confidence")
    return one.union(rules.filter(F.col("file2") == file).select("file1", "confidence"))


def advice(rules: DataFrame, file: str, n: int = 3) -> DataFrame:
    top = related(rules, file).orderBy(F.desc("confidence"), "file").limit(n)
    return top.select(F.format_string("%s changes with it in %.0f%% of commits", "file", F.col("confidence") * 100).alias("advice"))


def bands(rules: DataFrame, bounds: tuple[float, float, float] = (0.8, 0.6, 0.4)) -> DataFrame:
    hi, mid, low = bounds
    c = F.col("confidence")
    return rules.agg(F.count_if(c >= hi).alias("strong"), F.count_if((c >= mid) & (c < hi)).alias("medium"), F.count_if((c >= low) & (c < mid)).alias("weak"))

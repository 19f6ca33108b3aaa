"""Figures of dashboards over a symbol table: totals, radar axes, health of directories, quality rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.operators import insights


def rounded(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def totals(symbols: DataFrame) -> DataFrame:
    """One row: symbols, complexity, documented (percent), files, languages, dead."""
    dead = insights.dead_code(symbols).agg(F.count(F.lit(1)).alias("dead"))
    n = F.count(F.lit(1))
    every = symbols.agg(
        n.alias("symbols"), F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("complexity"), (F.count_if("documented") * 100.0 / F.greatest(n, F.lit(1))).alias("documented"), F.count_distinct("path").alias("files"), F.count_distinct("language").alias("languages")
    )
    return every.join(F.broadcast(dead))  # one row each


def radar(totals: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """(axis, value): five percentages, each full at a fixed measure: 20 symbols a file, 30 links, 5 languages, 100 chunks."""
    ends = edges.select(F.col("source").alias("vertex")).union(edges.select("target")).groupBy("vertex").count().agg(F.max("count").alias("links"))
    row = totals.join(F.broadcast(ends)).join(F.broadcast(chunks.agg(F.count(F.lit(1)).alias("chunks"))))
    full = lambda x, measure: F.least(x / float(measure), F.lit(1.0))
    axes = {
        "health": 1 - F.col("dead") / F.col("symbols"), "density": full(F.col("symbols") / F.col("files"), 20), "connections": full(F.coalesce("links", F.lit(0)), 30), "languages": full(F.col("languages"), 5), "memory": full(F.col("chunks"), 100)
    }
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("axis"), rounded(v * 100).alias("value")) for k, v in axes.items()))).alias("x")).select("x.*")


def health_axes(symbols: DataFrame) -> DataFrame:
    """(axis, value) of the seven axes of the health radar, in whole percent, each full at a fixed measure.

    Live share, 20 symbols a file, a median of 10 connections, 5 languages, 50 files, the share of symbols with a
    complexity of 5 at most, the documented share.
    """
    simple = symbols.agg(F.count_if(F.col("complexity") <= 5).alias("simple"))
    row = totals(symbols).join(F.broadcast(simple)).join(F.broadcast(insights.median_connections(insights.connections(symbols))))  # one row each
    full = lambda x, measure: F.least(x / float(measure), F.lit(1.0))
    share = lambda x: F.when(F.col("symbols") > 0, x / F.col("symbols")).otherwise(1.0)
    axes = {
        "Health": 1 - F.when(F.col("symbols") > 0, F.col("dead") / F.col("symbols")).otherwise(0.0), "Density": full(F.col("symbols") / F.greatest("files", F.lit(1)), 20), "Connectivity": full(F.col("median"), 10),
        "Diversity": full(F.col("languages"), 5), "Spread": full(F.col("files"), 50), "Simplicity": share(F.col("simple")), "Docs": F.coalesce(F.col("documented"), F.lit(0.0)) / 100,
    }
    return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("axis"), rounded(v * 100).alias("value")) for k, v in axes.items()))).alias("x")).select("x.*")


def simplicity(complexity: Column) -> Column:
    return F.greatest(F.lit(0.0), 100 - complexity * 10)


def band(percent: Column) -> Column:
    """The colour band of a percentage."""
    return F.when(percent >= 90, "excellent").when(percent >= 70, "good").when(percent >= 50, "fair").when(percent >= 30, "poor").otherwise("critical")


def overview(totals: DataFrame) -> DataFrame:
    """(health, band): the mean of simplicity, documentation and live code; the band of the documented share."""
    live = F.greatest(F.lit(0.0), 100 - F.col("dead") * 100.0 / F.col("symbols"))
    return totals.select(rounded((simplicity(F.col("complexity")) + F.col("documented") + live) / 3).alias("health"), band(F.col("documented")).alias("band"))


def directories(symbols: DataFrame, totals: DataFrame, depth: int = 3) -> DataFrame:
    """(directory, symbols, files, dead, health) of directories up to a depth."""
    of = lambda d: d.withColumn("directory", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    dead = of(insights.dead_code(symbols)).groupBy("directory").agg(F.count(F.lit(1)).alias("dead"))
    rows = of(symbols).groupBy("directory").agg(F.count(F.lit(1)).alias("symbols"), F.count_distinct("path").alias("files")).join(dead, "directory", "left").fillna(0, ["dead"])
    mean = F.broadcast(totals.select(F.col("complexity").alias("_mean")))
    clean = F.greatest(F.lit(0.0), 100 - F.col("dead") * 100.0 / F.col("symbols"))
    shallow = rows.filter(F.size(F.split("directory", "/")) <= depth)
    return shallow.join(mean).select("directory", "symbols", "files", "dead", rounded((simplicity(F.col("_mean")) + clean) / 2).alias("health"))


def quality_rules(totals: DataFrame, largest: DataFrame, gods: DataFrame) -> DataFrame:
    """(rule, severity) of the thresholds that totals, the longest symbol (lines) and god symbols pass, or one row `none`."""
    rule = lambda rows, name, severity: rows.limit(1).select(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))
    found = reduce(
        DataFrame.unionByName,
        [
            rule(totals.filter("complexity > 10"), "complexity", "high"),
            rule(totals.filter("documented < 50"), "documentation", "medium"),
            rule(totals.filter("dead > symbols * 0.1"), "dead code", "high"),
            rule(largest.filter("lines > 200"), "size", "medium"),
            rule(gods, "coupling", "high"),
        ],
    )
    none = found.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("none").alias("rule"), F.lit("low").alias("severity"))
    return found.unionByName(none)

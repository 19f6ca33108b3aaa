"""The code graph: edges from symbol rows, degrees, PageRank, blast radius."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.scoring import min_max
from engram.operators.insights import csv
from engram.sources.tables import checkpointed


def edges(symbols: DataFrame) -> DataFrame:
    """(id, source, target, edgeType, sourceFile, count): `calls` to names, `imports` of names (the part before the colon)."""
    of = lambda kind, column: symbols.select(F.col("symbol").alias("source"), F.explode(csv(column)).alias("target"), F.lit(kind).alias("edgeType"), F.col("path").alias("sourceFile"))
    both = of("calls", "calls").union(of("imports", "imports").withColumn("target", F.substring_index("target", ":", 1)))
    counted = both.groupBy("source", "target", "edgeType").agg(F.min("sourceFile").alias("sourceFile"), F.count(F.lit(1)).alias("count"))
    return counted.select(F.concat_ws(":", "source", "target", "edgeType").alias("id"), "*")


def outgoing(e: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    return e.filter((F.col("source") == name) & (F.lit(kind is None) | (F.col("edgeType") == kind)))


def incoming(e: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    return e.filter((F.col("target") == name) & (F.lit(kind is None) | (F.col("edgeType") == kind)))


def vertices(e: DataFrame) -> DataFrame:
    return e.select(F.col("source").alias("vertex")).union(e.select("target")).distinct()


def degrees(e: DataFrame) -> DataFrame:
    """(vertex, callers, callees, importers) in one aggregation over both ends of the edges."""
    call, imported = F.col("edgeType") == "calls", F.col("edgeType") == "imports"
    zero = F.lit(0)
    ends = e.select(F.col("source").alias("vertex"), zero.alias("callers"), F.when(call, 1).otherwise(0).alias("callees"), zero.alias("importers")).union(
        e.select("target", F.when(call, 1).otherwise(0), zero, F.when(imported, 1).otherwise(0))
    )
    return ends.groupBy("vertex").agg(*(F.sum(c).cast("long").alias(c) for c in ("callers", "callees", "importers")))


def pagerank(e: DataFrame, damping: float = 0.85, iterations: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """(vertex, rank). Only `calls` edges carry rank, all vertices count; mass at vertices without calls is lost.

    Edges with their sources' out-degrees are fixed before the loop and partitioned by source, so an iteration shuffles
    ranks and contributions only. Iterations stop once no rank changes by the tolerance; 0 runs all of them.
    """
    calls = e.filter("edgeType = 'calls'").select("source", "target")
    out = calls.groupBy("source").agg(F.count(F.lit(1)).alias("out"))
    links = checkpointed(calls.join(out, "source"))
    nodes = checkpointed(vertices(e))
    n = nodes.count()
    base = (1 - damping) / max(n, 1)
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for step in range(iterations):
        given = links.join(ranks, links["source"] == ranks["vertex"]).groupBy("target").agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        after = ranks.join(given, ranks["vertex"] == given["target"], "left").select("vertex", F.col("rank").alias("before"), (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if tolerance > 0 or step % 5 == 4:
            after = checkpointed(after)
        moved = after.agg(F.max(F.abs(F.col("rank") - F.col("before")))).first()[0] if tolerance > 0 else None
        ranks = after.select("vertex", "rank")
        if moved is not None and moved < tolerance:
            break
    return ranks


def normalised(ranks: DataFrame) -> DataFrame:
    ends = ranks.agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    return ranks.join(F.broadcast(ends)).select("vertex", min_max(F.col("rank"), F.col("lo"), F.col("hi"), clamped=False).alias("rank"))


def affected(symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """Symbols whose path ends with a changed file: matched by file name first, so that the join is by equality."""
    name = lambda c: F.substring_index(c, "/", -1)
    c = changed.select(F.col("file"), name("file").alias("_name"))
    return symbols.withColumn("_name", name("path")).join(c, "_name").filter("endswith(path, file)").drop("_name", "file").dropDuplicates(["id"])


def indirect_callers(symbols: DataFrame, hit: DataFrame, n: int = 15) -> DataFrame:
    """Callers of the first n affected symbols that aren't affected themselves."""
    first = hit.orderBy("id").limit(n).select("symbol")
    callers = symbols.withColumn("_c", F.explode(csv("calls"))).join(F.broadcast(first.withColumnRenamed("symbol", "_c")), "_c", "left_semi").drop("_c")
    return callers.dropDuplicates(["id"]).join(hit.select("id"), "id", "left_anti")


def blast_radius(symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """(affected, indirect, class): large beyond 20 symbols, moderate beyond 5."""
    hit = affected(symbols, changed)
    n = hit.agg(F.count(F.lit(1)).alias("affected"))
    m = indirect_callers(symbols, hit).agg(F.count(F.lit(1)).alias("indirect"))
    total = F.col("affected") + F.col("indirect")
    return n.join(F.broadcast(m)).withColumn("class", F.when(total > 20, "large").when(total > 5, "moderate").otherwise("small"))


def next_actor_edges(events: DataFrame) -> DataFrame:
    """Users as symbols: each event's user calls the user of the next event of its type within the hour, so tasks stay small."""
    order = Window.partitionBy("event_type", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    pairs = events.select(F.col("user_id").cast("string").alias("source"), F.lead("user_id").over(order).cast("string").alias("target"))
    return pairs.filter("target is not null").distinct().select("source", "target", F.lit("calls").alias("edgeType"))

"""Upkeep of an index: incremental sync, cleanup, snapshots, summaries."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.operators import graph, insights, sessions, views
from engram.operators.trends import health_score, trend_flag
from engram.sources.tables import CODE_METRICS, upserted


def synced(index: DataFrame, chunks: DataFrame, hashes: DataFrame, key: str = "checkpointId") -> DataFrame:
    """An index after taking in the chunks of new and changed sessions; others keep their rows."""
    known = index.select(key, "contentHash").distinct()
    fresh = sessions.new_or_changed(hashes, known, key).select(key)
    return upserted(index, chunks.join(fresh, key, "left_semi"), key)


def sync_batch(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], chunk: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch: chunk a micro-batch, upsert it. It is safe to run twice, as offsets follow the write."""

    def each(batch: DataFrame, _: int) -> None:
        chunks, hashes = chunk(batch)
        write(synced(read(), chunks, hashes))

    return each


def reindexed(symbols: DataFrame, edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges after the files of `new` were parsed again: rows of those files go, new rows and edges come."""
    gone = new.select("path").distinct()
    kept = edges.join(gone.withColumnRenamed("path", "sourceFile"), "sourceFile", "left_anti")
    return upserted(symbols, new, "path"), kept.unionByName(graph.edges(new), allowMissingColumns=True)


def cleaned(symbols: DataFrame, present: DataFrame) -> DataFrame:
    """Symbols of files that are still there, one for each path and name."""
    live = symbols.join(present.select("path").distinct(), "path", "left_semi")
    return insights.first_rows(live, ["path", "symbol"], ["id"])


def cleanup_counts(symbols: DataFrame, present: DataFrame) -> DataFrame:
    """(kind, n) of rows that a cleanup drops."""
    stale = symbols.join(present.select("path").distinct(), "path", "left_anti")
    live = symbols.join(present.select("path").distinct(), "path", "left_semi")
    double = live.groupBy("path", "symbol").agg((F.count(F.lit(1)) - 1).alias("n"))
    count = lambda kind, d, c: d.select(F.lit(kind).alias("kind"), c)
    return count("stale", stale.agg(F.count(F.lit(1)).alias("n")), "n").union(count("duplicate", double.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "n"))


def as_list(rows: DataFrame, order: list, fields: dict[str, str], name: str) -> DataFrame:
    """One row with a few rows as a JSON list of objects, in an order."""
    place = F.row_number().over(Window.orderBy(*order)).alias("_n")
    made = rows.select(place, F.struct(*(F.col(c).alias(k) for k, c in fields.items())).alias("_o"))
    return made.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_o"))), lambda x: x["_o"])).alias(name))


def snapshot(symbols: DataFrame, as_of: str, commit: str, previous: DataFrame | None = None, top: int = 10) -> DataFrame:
    """One metrics row of a symbol table, with the columns of `CODE_METRICS`.

    The most complex and the most connected symbols are JSON lists of at most `top` objects, cut before anything is
    gathered. Trends are up, down or stable against the latest of the previous snapshots; stable without one.
    """
    n, c = F.count(F.lit(1)), F.col
    gods = insights.god_symbols(insights.connections(symbols))
    at = symbols.join(F.broadcast(gods.select("symbol").distinct()), "symbol").groupBy("symbol").agg(F.min("path").alias("path"))  # a few names
    named = insights.top(gods.join(at, "symbol"), top, F.desc("total"), "symbol")
    parts = [
        symbols.agg(n.alias("totalSymbols"), F.count_distinct("path").alias("totalFiles"), F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("avgComplexity"), (F.count_if("documented") / F.greatest(n, F.lit(1))).alias("documentationCoverage")),
        insights.dead_code(symbols).agg(n.alias("deadCodeCount")),
        insights.duplicate_rows(symbols).agg(n.alias("duplicateSymbolCount")),
        gods.agg(n.alias("godSymbolCount")),
        as_list(insights.top(symbols, top, F.desc("complexity"), "symbol", "path"), [F.desc("complexity"), "symbol", "path"], {"symbol": "symbol", "cyclomatic": "complexity", "path": "path"}, "topComplexSymbols"),
        as_list(named, [F.desc("total"), "symbol"], {"symbol": "symbol", "totalConnections": "total", "path": "path"}, "godSymbols"),
    ]
    row = reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # one row each
    row = row.withColumn("avgSymbolsPerFile", c("totalSymbols") / F.greatest("totalFiles", F.lit(1)))
    row = row.withColumn("healthScore", health_score(c("avgComplexity"), c("documentationCoverage"), c("deadCodeCount"), c("duplicateSymbolCount"), c("godSymbolCount"), c("totalSymbols")))
    last = ["avgComplexity", "documentationCoverage", "deadCodeCount"]
    if previous is None:
        row = row.withColumns({f"_{x}": F.lit(None).cast("double") for x in last})
    else:
        before = previous.orderBy(F.desc("timestamp")).limit(1).select(*(c(x).cast("double").alias(f"_{x}") for x in last))
        row = row.join(F.broadcast(before), how="left")
    change = {x: c(x) - c(f"_{x}") for x in last} | {x: (c(x) - c(f"_{x}")) / F.greatest(f"_{x}", F.lit(1.0)) for x in ("avgComplexity", "deadCodeCount")}
    row = row.withColumns({t: trend_flag(change[x]) for t, x in (("complexityTrend", "avgComplexity"), ("documentationTrend", "documentationCoverage"), ("deadCodeTrend", "deadCodeCount"))})
    told = row.withColumn("id", F.lit(f"{as_of}:{commit[:8]}")).withColumn("timestamp", F.lit(as_of)).withColumn("commit", F.lit(commit))
    return told.select(*(c(f.name).cast(f.dataType).alias(f.name) for f in CODE_METRICS.fields))


def insights_hash(symbols: DataFrame) -> DataFrame:
    """(hash): what decides whether recommendations are made anew: symbols, files, complexity, documentation (percent), dead code, duplicates."""
    facts = views.totals(symbols).join(F.broadcast(insights.duplicate_rows(symbols).agg(F.count(F.lit(1)).alias("duplicates"))))
    real = lambda x: F.format_string("%.6f", F.col(x))
    whole = lambda x: F.col(x).cast("string")
    return facts.select(F.concat_ws(":", whole("symbols"), whole("files"), real("complexity"), real("documented"), whole("dead"), whole("duplicates")).alias("hash"))

"""Code insights over a symbol table: usage counts, dead code, connections, sizes, directories, index health.

A symbol row has symbol, symbolType, path, language, body, summary, calls and imports (comma-separated; imports as
name:source). Every insight is a frame of its own, so that only what is asked for is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.scoring import js_round
from engram.functions.text import directory_key


def csv(column: str) -> Column:
    return F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != "")


def top(rows: DataFrame, n: int, *order) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def caller_counts(symbols: DataFrame) -> DataFrame:
    """(symbol, callers): rows that call a name, indexed or not."""
    return symbols.select(F.explode(csv("calls")).alias("symbol")).groupBy("symbol").agg(F.count(F.lit(1)).alias("callers"))


def importer_counts(symbols: DataFrame) -> DataFrame:
    """(symbol, importers): rows that import an indexed name."""
    names = symbols.select(F.explode(csv("imports")).alias("i")).select(F.substring_index("i", ":", 1).alias("symbol"))
    return names.groupBy("symbol").agg(F.count(F.lit(1)).alias("importers")).join(symbols.select("symbol").distinct(), "symbol", "left_semi")


def last_by_name(symbols: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """One row for each name: the last by a stated order."""
    return symbols.groupBy("symbol").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select("symbol", "r.*")


def distribution(symbols: DataFrame, column: str) -> DataFrame:
    """(value, n, percentage) of a column; the total is one row."""
    counts = symbols.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = symbols.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total)).select("value", "n", js_round(F.col("n") * 100.0 / F.col("total")).cast("long").alias("percentage"))


def dead_code(symbols: DataFrame) -> DataFrame:
    """Rows, types and interfaces aside, that nobody calls or imports."""
    rows = symbols.filter(~F.col("symbolType").isin("type", "interface"))
    return rows.join(caller_counts(symbols), "symbol", "left_anti").join(importer_counts(symbols), "symbol", "left_anti")


def connections(symbols: DataFrame) -> DataFrame:
    """(symbol, callers, callees, importers, total) for every name."""
    own = last_by_name(symbols.withColumn("callees", F.size(csv("calls")).cast("long")), ["callees"], ["path", "id"])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = own.join(caller_counts(symbols), "symbol", "left").join(importer_counts(symbols), "symbol", "left")
    return rows.select("symbol", zero("callers"), "callees", zero("importers")).withColumn("total", F.col("callers") + F.col("callees") + F.col("importers"))


def median_connections(links: DataFrame) -> DataFrame:
    return links.agg(F.coalesce(F.median("total"), F.lit(0.0)).alias("median"))


def most_connected(links: DataFrame, n: int = 15) -> DataFrame:
    return top(links, n, F.desc("total"), "symbol")


def god_symbols(links: DataFrame, n: int = 15) -> DataFrame:
    """Of the most connected, those with three times the median, and five, connections at least."""
    return most_connected(links, n).join(F.broadcast(median_connections(links))).filter("total >= greatest(3 * median, 5)").drop("median")


def high_fan_in(symbols: DataFrame, n: int = 15) -> DataFrame:
    """Names imported by 30 % of the files, and three, at least."""
    files = symbols.agg(F.countDistinct("path").alias("files"))
    rows = importer_counts(symbols).join(F.broadcast(files)).filter(F.col("importers") >= F.greatest(js_round(F.col("files") * 0.3), F.lit(3)))
    return top(rows.select("symbol", "importers", js_round(F.col("importers") * 100.0 / F.col("files")).cast("long").alias("percentage")), n, F.desc("importers"), "symbol")


def hot_files(symbols: DataFrame, n: int = 15) -> DataFrame:
    return top(symbols.groupBy("path").agg(F.count(F.lit(1)).alias("n")), n, F.desc("n"), "path")


def recent_files(symbols: DataFrame, n: int) -> DataFrame:
    return top(symbols.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("lastModified").alias("modified")), n, F.desc("modified"), "path")


def line_count(body: str = "body") -> Column:
    return F.size(F.split(body, "\n", -1)).cast("long")


def largest(symbols: DataFrame, n: int = 15) -> DataFrame:
    return top(symbols.select("symbol", line_count().alias("lines")), n, F.desc("lines"), "symbol")


def average_per_file(symbols: DataFrame) -> DataFrame:
    return symbols.agg((js_round(F.count(F.lit(1)) * 10.0 / F.greatest(F.countDistinct("path"), F.lit(1))) / 10).alias("average"))


def documentation_coverage(symbols: DataFrame) -> DataFrame:
    return symbols.agg(js_round(F.count_if(F.col("documented")) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1))).cast("long").alias("percentage"))


def directory_insights(symbols: DataFrame, n: int = 20) -> DataFrame:
    """Directories by size: symbols, mean complexity, dead symbols, documented share, languages, most complex symbol."""
    dead = dead_code(symbols).select(F.col("id").alias("_dead")).distinct()
    rows = symbols.join(dead, F.col("id") == F.col("_dead"), "left").withColumn("directory", directory_key(F.col("path")))
    grouped = rows.groupBy("directory").agg(
        F.count(F.lit(1)).alias("symbols"), (js_round(F.avg("complexity") * 10) / 10).alias("complexity"), F.count("_dead").alias("dead"),
        js_round(F.count_if("documented") * 100.0 / F.count(F.lit(1))).cast("long").alias("documented"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"),
        F.min_by("symbol", F.struct(-F.col("complexity"), "symbol")).alias("top"),
    )
    return top(grouped, n, F.desc("symbols"), "directory")


def cross_directory_imports(symbols: DataFrame, n: int = 20) -> DataFrame:
    where = last_by_name(symbols.withColumn("directory", directory_key(F.col("path"))), ["directory"], ["path", "id"])
    used = symbols.select(directory_key(F.col("path")).alias("from"), F.explode(csv("imports")).alias("i")).select("from", F.substring_index("i", ":", 1).alias("symbol"))
    links = used.join(where, "symbol").filter("`from` <> directory").groupBy("from", F.col("directory").alias("to")).agg(F.count(F.lit(1)).alias("n"))
    return top(links, n, F.desc("n"), "from", "to")


def store_stats(chunks: DataFrame, n: int = 10) -> DataFrame:
    """(kind, name, n): the rows, the distinct agents and the most mentioned files."""
    rows = chunks.agg(F.lit("rows").alias("kind"), F.lit("").alias("name"), F.count(F.lit(1)).alias("n"))
    agents = chunks.filter("agent <> ''").agg(F.lit("agents").alias("kind"), F.lit("").alias("name"), F.count_distinct("agent").alias("n"))
    files = chunks.select(F.explode(csv("files")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(agents).unionByName(top(files, n, F.desc("n"), "name").select(F.lit("file").alias("kind"), "name", "n"))


def duplicate_rows(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("path", "symbol").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def first_rows(symbols: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first by a stated order."""
    return symbols.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def stale_and_missing(indexed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(key, state): indexed but gone, present but not indexed."""
    a, b = indexed.select(key).distinct(), present.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("state", F.lit("stale")).unionByName(b.join(a, key, "left_anti").withColumn("state", F.lit("missing")))


def text_lengths(rows: DataFrame, column: str = "text") -> DataFrame:
    n = F.length(column)
    return rows.agg(F.min(n).cast("long").alias("least"), js_round(F.avg(n)).cast("long").alias("mean"), F.max(n).cast("long").alias("most"))


def index_health(symbols: DataFrame, present: DataFrame) -> DataFrame:
    """(issue, severity, n) for what is wrong with an index."""
    checks = [
        ("stale", "warning", stale_and_missing(symbols, present, "path").filter("state = 'stale'")),
        ("missing", "warning", stale_and_missing(symbols, present, "path").filter("state = 'missing'")),
        ("duplicates", "error", duplicate_rows(symbols)),
        ("empty body", "info", symbols.filter("body is null or body = ''")),
    ]
    out = None
    for name, severity, rows in checks:
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("issue"), F.lit(severity).alias("severity"), "n").filter("n > 0")
        out = one if out is None else out.unionByName(one)
    return out


def first_in_groups(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group, with `nth` from 1. Every task cuts its own rows before they are shuffled, so no list
    is longer than n, however large a group is."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("nth") <= n)


def joined_in_order(column: str, order: str = "nth") -> Column:
    """The values of a column of a few rows, joined in an order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(column).cast("string").alias("v")))), lambda x: x["v"]), ",")


def symbols_by_type(symbols: DataFrame, n: int = 5) -> DataFrame:
    """(symbolType, n, first): how many symbols a type has, and its first names."""
    first = first_in_groups(symbols.select("symbolType", "symbol"), ["symbolType"], ["symbol"], n).groupBy("symbolType").agg(joined_in_order("symbol").alias("first"))
    return symbols.groupBy("symbolType").agg(F.count(F.lit(1)).alias("n")).join(first, "symbolType")


def file_metadata(commits: DataFrame, n: int = 5) -> DataFrame:
    """(file, changes, authors, last, recent) from commits (file, commit, author, date): recent holds the latest commits."""
    latest = first_in_groups(commits.select("file", "commit", "date"), ["file"], [F.desc("date"), "commit"], n).groupBy("file").agg(joined_in_order("commit").alias("recent"))
    whole = commits.groupBy("file").agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("author").alias("authors"), F.max("date").alias("last"))
    return whole.join(latest, "file")

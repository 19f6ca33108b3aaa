"""Source trees and commit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What is indexed and what isn't.
EXTENSIONS = ["ts", "tsx", "js", "jsx", "py", "go", "rs"]
HUNK = ("old_start", "old_count", "new_start", "new_count")
IGNORED = ["node_modules", "dist", "build", "target", "vendor", "coverage", "__pycache__", "venv"]


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, language, text) of a tree, without ignored folders and dot entries."""
    from engram.functions.text import LANGUAGE_BY_EXTENSION

    glob = "*.{" + ",".join(EXTENSIONS) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    path = F.regexp_replace("path", rf"^(?:file:)?/*{root.removeprefix('file:').strip('/')}/*", "")
    languages = F.create_map(*(F.lit(x) for pair in LANGUAGE_BY_EXTENSION.items() for x in pair))
    skipped = rf"(?:^|/)(?:{'|'.join(IGNORED)}|\.[^/]*)(?:/|$)"
    rows = files.select(path.alias("path"), F.col("content").cast("string").alias("text")).filter(~F.col("path").rlike(skipped))
    return rows.select("path", F.coalesce(F.try_element_at(languages, F.regexp_extract("path", r"(\.[^.]*)$", 1)), F.lit("unknown")).alias("language"), "text")


def changed_only(files: DataFrame, changed: DataFrame | None) -> DataFrame:
    """Files named in `changed` (path); all of them where that is None."""
    return files if changed is None else files.join(changed.select("path"), "path", "left_semi")


def commit_files(log: DataFrame, column: str = "value") -> DataFrame:
    """(commit, author, date, file) from blocks "hash|author|date" and file lines, as a name-only log gives them."""
    lines = F.filter(F.split(F.trim(column), "\n"), lambda x: F.trim(x) != "")
    rows = log.select(F.split(F.get(lines, F.lit(0)), r"\|").alias("head"), F.slice(lines, 2, 1 << 30).alias("files")).filter(F.size("files") > 0)
    return rows.select(F.get("head", F.lit(0)).alias("commit"), F.get("head", F.lit(1)).alias("author"), F.get("head", F.lit(2)).alias("date"), F.explode("files").alias("file")).withColumn("file", F.trim("file"))


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """A log file whose commits are parted by blank lines; read block by block, so it splits across tasks."""
    return commit_files(spark.read.text(path, lineSep="\n\n"))


def commit_hunks(log: DataFrame, column: str = "value") -> DataFrame:
    """(commit, author, date, path, old_start, old_count, new_start, new_count) from blocks of a head "hash|author|date"
    and a patch. Files that end or begin with the commit keep the name that they had or have; counts left out are 1."""
    head = F.split(F.substring_index(column, "\n", 1), r"\|")
    files = F.slice(F.split(column, r"(?m)^diff --git "), 2, 1 << 30)
    rows = log.select(*(F.get(head, F.lit(i)).alias(c) for i, c in enumerate(("commit", "author", "date"))), F.explode(files).alias("_file"))
    name = lambda mark: F.regexp_extract("_file", rf"(?m)^{mark} (?:[ab]/)?([^\n\t]*)", 1)
    path = F.when(name(r"\+\+\+") != "/dev/null", name(r"\+\+\+")).otherwise(name("---"))
    hunk = r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    found = F.arrays_zip(*(F.regexp_extract_all("_file", F.lit(hunk), F.lit(i + 1)).alias(c) for i, c in enumerate(HUNK)))
    each = rows.select("commit", "author", "date", path.alias("path"), F.explode(found).alias("h"))
    one = lambda c: F.when(F.col(f"h.{c}") == "", F.lit(1)).otherwise(F.expr(f"try_cast(h.{c} AS bigint)")).cast("long").alias(c)
    return each.select("commit", "author", "date", "path", *map(one, HUNK))


def commit_renames(log: DataFrame, column: str = "value") -> DataFrame:
    """(commit, old, new) from blocks of a head "hash|author|date" and lines of a log with names and states."""
    lines = log.select(F.substring_index(F.substring_index(column, "\n", 1), "|", 1).alias("commit"), F.explode(F.split(column, "\n")).alias("_l"))
    given = F.split("_l", "\t")
    return lines.filter(F.col("_l").rlike(r"^R\d*\t[^\t]+\t[^\t]+$")).select("commit", F.get(given, F.lit(1)).alias("old"), F.get(given, F.lit(2)).alias("new"))


def line_range_changes(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, changes, authors) of symbols (id, path, first, last) from lines (path, line, commit, author) that are numbered as
    in the newest version; `history.line_history` moves ranges through older ones."""
    hits = symbols.join(lines, "path").filter("line between first and last")
    return hits.groupBy("id").agg(F.count_distinct("commit").alias("changes"), F.count_distinct("author").alias("authors"))


def commit_triples(lines: DataFrame) -> DataFrame:
    """(hash, subject, date) from numbered lines (n, value) that come in threes."""
    at = lambda i: F.max(F.when(F.col("n") % 3 == i, F.col("value")))
    rows = lines.groupBy(F.floor(F.col("n") / 3).alias("k")).agg(at(0).alias("hash"), at(1).alias("subject"), at(2).alias("date"))
    return rows.filter("hash <> '' and subject <> '' and date <> ''").drop("k")

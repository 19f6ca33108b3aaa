"""Agent transcripts: JSON lines, checkpoint folders, content of several shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: {folder of two hex digits}/{ten more}/{n}/{file}
CHECKPOINT_PATH = r"([0-9a-f]{2})/([0-9a-f]{10})/(?:([0-9]+)/)?([^/]+)$"


def content_text(line: Column) -> Column:
    """The text of a JSON line: of `message.content`, else `content`; a text as it is, a list by its text items, else as JSON."""
    raw = F.coalesce(F.get_json_object(line, "$.message.content"), F.get_json_object(line, "$.content"))
    items = F.from_json(raw, "array<struct<type:string,text:string>>")
    listed = F.array_join(F.transform(F.filter(items, lambda x: x["type"] == "text"), lambda x: x["text"]), "\n")
    single = F.get_json_object(raw, "$.text")
    return F.when(F.startswith(raw, F.lit("[")) & items.isNotNull(), listed).when(F.startswith(raw, F.lit("{")) & single.isNotNull(), single).otherwise(F.coalesce(raw, F.lit("")))


def decoded(lines: DataFrame, column: str = "value") -> DataFrame:
    """lines with role and content; lines that aren't JSON or have no role go."""
    role = F.coalesce(F.get_json_object(column, "$.role"), F.get_json_object(column, "$.message.role"))
    return lines.withColumn("role", role).filter("role is not null").withColumn("content", content_text(F.col(column)))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(path, nth, role, content) of the transcripts of a folder; nth orders the lines of a file."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.jsonl").select(F.col("_metadata.file_path").alias("path"), "value")
    lines = whole.select("path", F.posexplode(F.split("value", "\n")).alias("nth", "line")).filter("trim(line) <> ''")
    return decoded(lines, "line").select("path", "nth", "role", "content")


def checkpoints(files: DataFrame) -> DataFrame:
    """(checkpointId, sessionIndex, file, value) from (path, value) of a checkpoint tree."""
    at = lambda i: F.regexp_extract("path", CHECKPOINT_PATH, i)
    return files.filter(F.col("path").rlike(CHECKPOINT_PATH)).select(F.concat(at(1), at(2)).alias("checkpointId"), F.when(at(3) != "", at(3).cast("long")).alias("sessionIndex"), at(4).alias("file"), "value")


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return checkpoints(files)


def grown(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """Files (path, size) that are new or longer than when they were last read; contents are read for these only."""
    return listing.join(seen.select("path", F.col("size").alias("_seen")), "path", "left").filter("_seen is null or size > _seen").drop("_seen")


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    """(query, keywords, ids, queryType) of an evaluation set in one JSON document."""
    rows = spark.read.schema("query string, expectedKeywords array<string>, expectedIds array<string>, queryType string").json(path, multiLine=True)
    return rows.select("query", F.col("expectedKeywords").alias("keywords"), F.col("expectedIds").alias("ids"), F.coalesce("queryType", F.lit("default")).alias("queryType"))


def save_golden_set(rows: DataFrame, path: str) -> None:
    rows.select("query", F.col("keywords").alias("expectedKeywords"), F.col("ids").alias("expectedIds"), "queryType").write.mode("overwrite").json(path)

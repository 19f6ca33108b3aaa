"""Event-time operators that run on a stream and on a batch alike, and the incremental loops around them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stamped(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need an instant, so times without a zone are read in the session's."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def tumbling(events: DataFrame, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by windows of a size; with a slide they overlap, with `late` a watermark holds."""
    rows = stamped(events)
    if late:
        rows = rows.withWatermark("ts", late)
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """(user_id, start, n): runs of a user's events with no longer pause than the gap. A stream holds back open ones."""
    rows = stamped(events)
    if late:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_by_key(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """One event for each key; on a stream, within the watermark, so that its state stays bounded."""
    if events.isStreaming:
        return stamped(events).withWatermark("ts", late or "1 hour").dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def watch(source: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Run `each` on every micro-batch, one at a time; offsets are kept only after it has returned. Without `every`, drain and stop."""
    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def session_files(spark: SparkSession, path: str, schema, per_batch: int = 1000) -> DataFrame:
    """New JSON-lines files of a folder as a stream of rows with their path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).json(path).withColumn("path", F.col("_metadata.file_path"))


def interval_join(left: DataFrame, right: DataFrame, key: str, within: str, late: str, how: str = "inner") -> DataFrame:
    """Rows of `left` with the rows of `right` of their key that come no later than `within` after them; both have `ts`.

    On streams both sides have a watermark `late` behind their latest row: older rows are dropped, a left row is kept
    while partners may come and a right one while rows before it may. With how="left", a row without a partner is given
    when its time is over. On batches the same join, of all rows. The right side's columns are prefixed with `right_`.
    """
    watermarked = lambda df: stamped(df).withWatermark("ts", late) if df.isStreaming else stamped(df)
    one, two = watermarked(left), watermarked(right)
    two = two.select(*(F.col(c).alias(f"right_{c}") for c in two.columns))
    meets = (F.col(key) == F.col(f"right_{key}")) & (F.col("right_ts") >= F.col("ts")) & (F.col("right_ts") <= F.col("ts") + F.expr(f"interval {within}"))
    return one.join(two, meets, how)


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's Parquet file, or folder of files, as a stream."""
    at = f"{folder}/{name}.parquet"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    schema = spark.read.parquet(at).schema
    reader = spark.readStream.schema(schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(at)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives until it has nothing more, written below a folder; called again, it goes on from there."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")

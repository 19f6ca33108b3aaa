"""Joins by time and range, and sketches: what the planner has no single operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each row of left with the latest value of right at or before its time; one union and one window, no range join."""
    rows = left.select(key, time, F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.struct(*left.columns).alias("_row")).unionByName(
        right.select(key, time, F.col(value).alias("_v"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_row"))
    )
    order = Window.partitionBy(key).orderBy(time, F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last("_v", ignorenulls=True).over(order)).filter("_row is not null").select("_row.*", value)


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points within [low, high): both sides are cut into bins of a width, so that the join is by equality."""
    bins = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return points.withColumn("_b", F.floor(F.col(point) / width)).join(bins, "_b").filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_b")

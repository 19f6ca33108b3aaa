"""Sketches that are stored by period and merged by range: distinct counts, quantiles and counts of single items.

A period's row holds an HLL and a KLL sketch as binary and a count-min sketch as its cells that aren't 0, `DEPTH` rows of
`width` cells at most. Each is made where the rows are and merged by aggregation, so a range of any length costs one row
a period, never the rows that were sketched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a count-min sketch and its cells in a row: counts are too high by over e / WIDTH of all with probability e ** -DEPTH.
DEPTH, WIDTH = 5, 4096
HLL_BITS, KLL_K = 12, 200


def cells_of(item: Column, depth: int = DEPTH, width: int = WIDTH) -> Column:
    """array<struct(row, cell)>: where an item is counted."""
    return F.array(*(F.struct(F.lit(d).alias("row"), F.pmod(F.xxhash64(item.cast("string"), F.lit(d)), F.lit(width)).cast("int").alias("cell")) for d in range(depth)))


def sketched(rows: DataFrame, period: str, distinct: str, value: str, item: str, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(period, n, hll, kll, counts) for each period: sketches of the distinct values of a column, of a column's quantiles and
    of the counts of another's values. Nulls are left out of the column that has them."""
    whole = rows.groupBy(period).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(distinct).cast("string"), F.lit(HLL_BITS)).alias("hll"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("kll")
    )
    each = rows.filter(F.col(item).isNotNull()).select(period, F.explode(cells_of(F.col(item), depth, width)).alias("c")).groupBy(period, "c.row", "c.cell").agg(F.count(F.lit(1)).alias("n"))
    counts = each.groupBy(F.col(period).alias("_p")).agg(F.array_sort(F.collect_list(F.struct("row", "cell", "n"))).alias("counts"))  # depth * width at most
    return whole.join(counts, F.col(period).eqNullSafe(F.col("_p")), "left").drop("_p")


def merged(store: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, hll, kll) of the periods that share keys; filter the store to a range first."""
    return store.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.kll_merge_agg_double("kll").alias("kll"))


def bitmaps(rows: DataFrame, period: str, distinct: str) -> DataFrame:
    """(period, bucket, bits): the distinct values of a whole-number column as bitmaps of 32768 neighbouring numbers each,
    for exact counts over any range. Dense keys take a bit a value and period."""
    some = rows.filter(F.col(distinct).isNotNull()).select(period, F.bitmap_bucket_number(distinct).alias("bucket"), F.bitmap_bit_position(distinct).alias("bit"))
    return some.groupBy(period, "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def distinct_count(maps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, values): how many distinct values the periods that share keys have, exactly."""
    whole = maps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return whole.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("values"))


def merged_counts(store: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, cell, n): the count-min cells of the periods that share keys."""
    return store.select(*keys, F.explode("counts").alias("c")).groupBy(*keys, "c.row", "c.cell").agg(F.sum("c.n").alias("n"))


def distinct_estimate(hll: Column) -> Column:
    return F.hll_sketch_estimate(hll)


def quantile(kll: Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(kll, F.lit(float(q)))


def rank(kll: Column, value: Column) -> Column:
    """The share of values up to one."""
    return F.kll_sketch_get_rank_double(kll, value)


def item_counts(cells: DataFrame, items: DataFrame, keys: list[str], depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(keys, item, n) of items (item) for every key: never too low; an item whose cells are empty has 0."""
    asked = items.select("item", F.explode(cells_of(F.col("item"), depth, width)).alias("c")).select("item", "c.row", "c.cell")
    every = asked.join(cells.select(*keys).distinct()) if keys else asked  # periods' keys are few: one row a merged range
    found = every.join(cells, [*keys, "row", "cell"], "left")
    return found.groupBy(*keys, "item").agg(F.min(F.coalesce("n", F.lit(0))).cast("long").alias("n"))

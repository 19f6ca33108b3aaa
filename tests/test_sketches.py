"""Stored sketches, merged by range, against the errors that they are made for."""

import math

import numpy as np
from pyspark.sql import functions as F

from engram.operators import sketches as SK


def test_merged_sketches(spark, tmp_path):
    rnd = np.random.default_rng(1)
    n = 60_000
    days, users, values, items = rnd.integers(0, 30, n), rnd.integers(0, 9000, n), rnd.normal(0, 10, n), rnd.zipf(1.3, n) % 5000
    rows = spark.createDataFrame(list(zip(days.tolist(), users.tolist(), values.tolist(), items.tolist(), strict=True)), "day long, user long, value double, item long")
    SK.sketched(rows, "day", "user", "value", "item", width=512).write.parquet(str(tmp_path / "s"))
    store = spark.read.parquet(str(tmp_path / "s"))
    assert store.count() == 30 and store.agg(F.max(F.size("counts"))).first()[0] <= SK.DEPTH * 512
    for lo, hi in ((0, 29), (3, 9), (12, 12)):
        inside = (days >= lo) & (days <= hi)
        part = store.filter(F.col("day").between(lo, hi)).withColumn("all", F.lit(1))
        one = SK.merged(part, ["all"]).select("n", SK.distinct_estimate(F.col("hll")).alias("d"), *(SK.quantile(F.col("kll"), q).alias(f"q{int(q * 100)}") for q in (0.1, 0.5, 0.9))).first()
        assert one.n == inside.sum()
        true = len(np.unique(users[inside]))
        assert abs(one.d - true) <= 4 * 1.04 / math.sqrt(1 << SK.HLL_BITS) * true
        for q in (0.1, 0.5, 0.9):  # 200 values keep ranks to about 1.4 %
            assert abs((values[inside] <= one[f"q{int(q * 100)}"]).mean() - q) <= 0.03
        asked = [1, 2, 3, 50, 4999, 77777]
        got = {r.item: r.n for r in SK.item_counts(SK.merged_counts(part, ["all"]), spark.createDataFrame([(i,) for i in asked], "item long"), ["all"], width=512).collect()}
        truth = {i: int((items[inside] == i).sum()) for i in asked}
        assert set(got) == set(asked) and all(got[i] >= truth[i] for i in asked)
        assert all(got[i] - truth[i] <= math.e / 512 * inside.sum() for i in asked)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, None, None), (1, "a", 2.0, "x"), (None, "b", 3.0, "x"), (2, "b", None, None)], "day long, user string, value double, item string")
    store = SK.sketched(rows, "day", "user", "value", "item")
    assert {r.day: (r.n, r.d) for r in store.select("day", "n", SK.distinct_estimate(F.col("hll")).alias("d")).collect()} == {1: (2, 1), None: (1, 1), 2: (1, 1)}
    cells = SK.merged_counts(store.withColumn("all", F.lit(1)), ["all"])
    assert [(r.item, r.n) for r in SK.item_counts(cells, spark.createDataFrame([("x",), ("y",)], "item string"), ["all"]).orderBy("item").collect()] == [("x", 2), ("y", 0)]
    assert SK.sketched(rows.limit(0), "day", "user", "value", "item").count() == 0

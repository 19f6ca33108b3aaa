"""Debounced changes, against a plain replay, in one batch and in many."""

import random

import pytest
from pyspark.sql import functions as F

from engram.streaming import triggers as T


def replay(changes, quiet, interval, until):
    """(key, fired, changes) by going through each key's changes; those due by `until`."""
    out = []
    for key in {k for k, _ in changes}:
        last, before, n = None, None, 0
        for at in [*sorted(t for k, t in changes if k == key), None]:
            if n:
                then = last + quiet if before is None else max(last + quiet, before + interval)
                if (at is None and then <= until) or (at is not None and then <= at):
                    out.append((key, then, n))
                    before, n = then, 0
            last, n = at, n + 1
    return sorted(out)


@pytest.mark.parametrize("files", [1, 6])
def test_debounced(spark, tmp_path, files):
    rnd = random.Random(files)
    changes, t = [], {k: rnd.randint(0, 5000) for k in "abc"}
    for _ in range(150):
        k = rnd.choice("aab")
        t[k] += rnd.choice([100, 700, 3000, 12_000, 40_000])
        changes.append((k, t[k]))
    changes.append(("c", max(t.values()) + 60_000))  # moves the watermark on
    changes.sort(key=lambda x: x[1])
    for i in range(files):
        part = changes[len(changes) * i // files : len(changes) * (i + 1) // files]
        df = spark.createDataFrame(part, "key string, at long").select("key", F.timestamp_millis("at").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = T.debounced(stream, 2000, 15_000).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = sorted((r.key, r.at, r.changes) for r in spark.read.parquet(str(tmp_path / "out")).select("key", F.unix_millis("fired").alias("at"), "changes").collect())
    assert got == replay(changes, 2000, 15_000, changes[-1][1]) and len(got) > 20
    for key in "ab":
        at = [x for k, x, _ in got if k == key]
        assert all(y - x >= 15_000 for x, y in zip(at, at[1:], strict=False))

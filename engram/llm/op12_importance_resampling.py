"""Importance resampling towards a target distribution, without exploding a document when it is scored.

Features are runs of 1 to `longest` consecutive words, hashed into `buckets`. Each document becomes an array of bucket
numbers by higher-order functions. The corpus and the target are counted by bucket, in each task before anything is
sent, so that only `buckets` totals a task are shuffled; the driver turns them into a literal array of gains, and a
document's weight is an aggregate over element_at of that array. A Gumbel term drawn from a hash of doc_id makes the
highest scores a sample without replacement.

Ranks come from a sort by ranges: each part numbers its own rows, and the parts' sizes give the offsets. No row is sent
to the driver, and no task holds more than its range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.shared import ascii_lower, park

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
#: The share that is drawn, in percent, of the documents with at least so many words.
PERCENT, LEAST_WORDS = 10, 20
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z only; none of a null text."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def bucket_array(words: Column, longest: int = LONGEST, buckets: int = BUCKETS) -> Column:
    """The bucket of each feature of an array of words, repeats kept."""
    bucket = lambda feature: (F.crc32(feature.cast("binary")) % buckets).cast("int")

    def of(n: int) -> Column:
        first = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(first, lambda i: bucket(F.array_join(F.slice(words, i, n), " ")))

    return F.concat(F.transform(words, bucket), *(of(n) for n in range(2, longest + 1)))


def bucket_counts(texts: DataFrame, longest: int, buckets: int) -> list[int]:
    """The number of features in each bucket over all texts. One row a bucket reaches the driver."""
    each = texts.select(F.explode(bucket_array(words_of(F.col("text")), longest, buckets)).alias("bucket"))
    out = [0] * buckets
    for r in each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """For each bucket, 1000 times the log of how much likelier it is in the target, each bucket counted once more."""
    s, t, n = sum(corpus), sum(target), len(corpus)
    return [math.floor(1000 * math.log((float(b + 1) * float(s + n)) / (float(a + 1) * float(t + n)))) for a, b in zip(corpus, target, strict=True)]


def resampled(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row; rank numbers the drawn rows from 1, others have none.

    A null or empty text has no features and weight 0. Rows without a doc_id are drawn by the hash of an empty id and
    come after others of their score. Repeated rows are scored alike and ranked one after another. An empty table gives
    an empty result, an empty target a smoothed, even one. Other columns are ignored.
    """
    spark = docs.sparkSession
    table = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    literal = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded into one literal
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"))
    arrays = words.select("doc_id", F.size("words").alias("n_words"), bucket_array(F.col("words"), longest, buckets).alias("buckets"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, b: total + F.element_at(literal, b + 1))
    scored = park(
        arrays.select("doc_id", F.size("buckets").cast("long").alias("n_features"), (F.col("n_words") >= least_words).alias("open"), weight.alias("weight")).select(
            "*", (F.col("weight") + gumbel).cast("long").alias("score")
        )
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("open"), F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("weight")]
    # Within a part, the lower 33 bits of this number count its rows from 0, the upper ones are the part's number.
    dealt = scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = park(dealt.withColumn("part", F.shiftright("at", 33).cast("int")).withColumn("nth", F.col("at").bitwiseAND((1 << 33) - 1)).drop("at"))
    sizes = {r["part"]: (r["n"], r["open"]) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("open").alias("open")).collect()}
    draw, before, rows = percent * sum(n for _, n in sizes.values()) // 100, 0, []
    for part in sorted(sizes):
        rows.append((part, before))
        before += sizes[part][0]
    offsets = spark.createDataFrame(rows, "part int, before long")  # a row for each part of the sort
    rank = F.col("before") + F.col("nth") + 1
    return placed.join(F.broadcast(offsets), "part").select("doc_id", "n_features", "weight", "score", F.when(F.col("open") & (rank <= draw), rank).alias("rank"))

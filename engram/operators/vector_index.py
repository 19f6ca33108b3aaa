"""Inverted lists of vectors around trained centroids, partitioned on disk.

Every vector lies in the list of its nearest centroid, a folder of its own, so a search reads the folders of the lists
that it probes and re-ranks their vectors exactly. Centroids are trained on a bounded sample; all vectors are indexed.

A search by `probes` reads the nearest lists only and may miss neighbours; tests measure its recall on all vectors. An
exact search reads the nearest lists first, and then those whose radius lets them hold anything nearer than what was
found: none of the neighbours is lost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.functions.vectors import distance
from engram.operators.retrieval import DIGITS, ranked

#: Vectors of the training sample for each list, rounds of training, and lists that a search probes: of 32 lists of vectors
#: in all directions, as the tests have them, that many are needed for a recall of 0.9; vectors in clusters need few.
SAMPLE, ROUNDS, PROBES = 64, 12, 20


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of v to all of c."""
    return np.maximum((v * v).sum(axis=1)[:, None] - 2 * v @ c.T + (c * c).sum(axis=1), 0)


def trained(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Centroids of a sample: spread seeds, then the means of what is nearest; an empty one starts anew at the farthest vector."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    lists = min(lists, len(distinct))
    centroids = distinct[[rng.integers(len(distinct))]]
    nearest = squared(distinct, centroids)[:, 0]
    while len(centroids) < lists:
        pick = distinct[rng.choice(len(distinct), p=nearest / nearest.sum())][None] if nearest.sum() > 0 else distinct[[len(centroids)]]
        centroids = np.concatenate([centroids, pick])
        nearest = np.minimum(nearest, squared(distinct, pick)[:, 0])
    for _ in range(rounds):
        d = squared(sample, centroids)
        of = d.argmin(axis=1)
        sums = np.stack([np.bincount(of, sample[:, k], minlength=lists) for k in range(sample.shape[1])], axis=1)
        n = np.bincount(of, minlength=lists)
        far = np.argsort(-d.min(axis=1), kind="stable")
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], sample[far[: lists]] if len(far) >= lists else centroids)
    return centroids


def centroids_of(rows: DataFrame, lists: int, sample: int = SAMPLE) -> np.ndarray:
    """The centroids of rows (id, vector), from `sample` * `lists` of them by a hash of id; one task learns them."""
    some = rows.filter("vector is not null").orderBy(F.xxhash64("id", F.lit(5)), "id").limit(sample * lists).select("vector")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [matrix(b.column("vector")) for b in batches if b.num_rows]
        if held:
            c = trained(np.concatenate(held), lists)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.list_(pa.float64()))], names=["vector"])

    return np.array([r["vector"] for r in some.coalesce(1).mapInArrow(learn, "vector array<double>").collect()])


def write_index(rows: DataFrame, path: str, lists: int = 32, sample: int = SAMPLE) -> None:
    """Write rows (id, vector, ...) to an index at a path: `lists`, a folder for each list, and `centroids`.

    Rows without a vector are left out. A centroid's row has its list's size and radius, the largest distance in it.
    """
    spark = rows.sparkSession
    centroids = centroids_of(rows, lists, sample)
    sent = spark.sparkContext.broadcast(centroids)
    kept = rows.filter("vector is not null")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = squared(matrix(b.column("vector")), sent.value)
                of = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(of.astype(np.int32)), pa.array(np.sqrt(d[np.arange(len(of)), of]))], names=[*b.schema.names, "list", "_away"])

    schema = T.StructType([*kept.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("_away", T.DoubleType())])
    kept.mapInArrow(assign, schema).write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    of = spark.read.parquet(f"{path}/lists").groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("_away").alias("radius"))
    given = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "list int, vector array<double>")
    given.join(of, "list", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


class VectorIndex:
    """An index at a path. What stays on the driver is the centroids, as many as there are lists."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows = spark.read.parquet(f"{path}/lists")
        found = spark.read.parquet(f"{path}/centroids").filter("n > 0").orderBy("list").collect()
        self.lists = np.array([r["list"] for r in found], int)
        self.radius = np.array([r["radius"] for r in found])
        self.centroids = np.array([r["vector"] for r in found])

    def order(self, query: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
        """The lists from the nearest centroid on, and their distances."""
        if not len(self.lists):
            return self.lists, np.zeros(0)
        away = np.sqrt(squared(np.array([query], float), self.centroids)[0])
        by = np.lexsort((self.lists, away))
        return by, away[by]

    def read(self, which: np.ndarray) -> DataFrame:
        """The rows of some lists; the others' folders aren't opened."""
        return self.rows.filter(F.col("list").isin([int(x) for x in self.lists[which]]))

    def search(self, query: Sequence[float], k: int, probes: int = PROBES) -> DataFrame:
        """The k nearest rows (id, score, rank) of the `probes` nearest lists, as `retrieval.knn` gives them."""
        by, _ = self.order(query)
        return self.nearest(self.read(by[:probes]), query, k)

    @staticmethod
    def nearest(rows: DataFrame, query: Sequence[float], k: int) -> DataFrame:
        scored = rows.select("id", F.round(F.lit(1.0) - distance(F.col("vector"), query), DIGITS).alias("score"))
        return ranked(scored.filter("score is not null"), k)

    def needed(self, query: Sequence[float], k: int, probes: int = PROBES) -> np.ndarray:
        """The lists that can hold one of the k nearest rows, by what the nearest lists hold."""
        by, away = self.order(query)
        found = [r["score"] for r in self.search(query, k, probes).collect()]
        if len(found) < k:
            return by
        # Scores are rounded, and ties go by id: half a digit more is looked at.
        kth = np.sqrt(max(1.0 - found[-1] + 10.0**-DIGITS, 0))
        return by[away - self.radius[by] <= kth + 1e-9]

    def exact(self, query: Sequence[float], k: int, probes: int = PROBES) -> DataFrame:
        """The k nearest of all rows; lists that can't hold one aren't read."""
        return self.nearest(self.read(self.needed(query, k, probes)), query, k)

    def search_many(self, queries: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
        """(query, id, score, rank) for queries (query, vector): each meets the rows of its nearest lists, in a join by list.

        Queries are dealt to their lists where they are; a list's rows are joined with the queries that probe it, and each
        query's best are cut within every list before they meet.
        """
        spark = queries.sparkSession
        sent = spark.sparkContext.broadcast((self.lists, self.centroids))

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists, centroids = sent.value
            for b in batches:
                if b.num_rows and len(lists):
                    near = np.argsort(squared(matrix(b.column("vector")), centroids), axis=1, kind="stable")[:, :probes]
                    of = np.repeat(np.arange(b.num_rows), near.shape[1])
                    some = b.select(["query", "vector"]).take(pa.array(of))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(lists[near.ravel()].astype(np.int32))], names=["query", "_vector", "list"])

        kind = dict(queries.dtypes)
        asked = queries.select("query", "vector").mapInArrow(dealt, f"query {kind['query']}, _vector {kind['vector']}, list int")
        met = asked.join(self.rows.select("id", "vector", "list"), "list")
        away = F.aggregate(F.zip_with("vector", "_vector", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
        scored = met.select("query", "list", "id", F.round(F.lit(1.0) - away, DIGITS).alias("score"))
        best = lambda rows, *keys: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= k)
        return best(best(scored, "query", "list").drop("rank"), "query").select("query", "id", "score", F.col("rank").cast("long").alias("rank"))

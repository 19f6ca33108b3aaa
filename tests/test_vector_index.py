"""The vector index against a scan of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import retrieval as R
from engram.operators import vector_index as V


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    path = str(tmp_path_factory.mktemp("index"))
    V.write_index(rows.union(spark.createDataFrame([(-1, None)], rows.schema)), path, lists=32)
    ids = np.array([r.id for r in rows.orderBy("id").select("id").collect()])
    vectors = np.array([r.vector for r in rows.orderBy("id").select("vector").collect()], float)
    return rows, V.VectorIndex(spark, path), ids, vectors


def test_every_vector_is_in_one_list(made):
    rows, index, ids, _ = made
    assert sorted(r.id for r in index.rows.select("id").collect()) == ids.tolist()
    assert 16 <= len(index.lists) <= 32


def test_recall_on_all_vectors(spark, made):
    rows, index, ids, vectors = made
    asked = rows.filter("id % 100 = 0").select(F.col("id").alias("query"), "vector")
    got = {}
    for r in index.search_many(asked, 10).collect():
        got.setdefault(r.query, []).append((r.rank, r.id, r.score))
    place = {i: k for k, i in enumerate(ids)}
    hit = total = 0
    for q, some in got.items():
        d = ((vectors - vectors[place[q]]) ** 2).sum(axis=1)
        want = set(ids[np.lexsort((ids, np.round(d, 6)))[:10]])
        hit, total = hit + len(want & {i for _, i, _ in some}), total + 10
        assert [k for k, _, _ in sorted(some)] == list(range(1, len(some) + 1))
        assert all(abs(1 - d[place[i]] - s) < 2e-6 for _, i, s in some)
    assert len(got) == asked.count() and hit / total >= 0.9


def test_one_query_reads_its_lists_only(spark, made):
    rows, index, ids, vectors = made
    for q in (0, 17, 400):
        want = [tuple(r) for r in R.knn(rows, vectors[q].tolist(), 10).collect()]
        assert [tuple(r) for r in index.exact(vectors[q].tolist(), 10).collect()] == want
        some = index.search(vectors[q].tolist(), 10, probes=3)
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters" in plan and index.read(index.order(vectors[q])[0][:3]).inputFiles()
        read = {f.split("list=")[1].split("/")[0] for f in index.read(index.order(vectors[q])[0][:3]).inputFiles() if "list=" in f}
        assert len(set(index.lists)) > 3 and index.read(index.order(vectors[q])[0][:3]).select("list").distinct().count() == 3, read
    far = (vectors[0] + 100).tolist()
    assert [tuple(r) for r in index.exact(far, 5).collect()] == [tuple(r) for r in R.knn(rows, far, 5).collect()]


def test_odd_tables(spark, tmp_path):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(50)] + [(60, [0.0, 1.0])], "id long, vector array<float>")
    V.write_index(same, str(tmp_path / "a"), lists=8)
    index = V.VectorIndex(spark, str(tmp_path / "a"))
    assert [r.id for r in index.exact([1.0, 0.0], 3).collect()] == [0, 1, 2] and [r.id for r in index.exact([0.0, 1.0], 1).collect()] == [60]
    assert index.exact([1.0, 0.0], 100).count() == 51

"""Queries against their SQL on tables with near copies of vectors, many users, and texts of odd blanks or hashes that cancel."""

import itertools
import shutil

import pytest
from pyspark.sql import functions as F

from engram.functions.embedding import hashing_embedder
from engram.plans import catalogue
from tests.test_oracle import SF, TABLES, plain


def cancelling() -> str:
    """Two words with one place and opposite signs."""
    seen: dict[int, tuple[str, float]] = {}
    for i in itertools.count():
        v = hashing_embedder(f"w{i}")
        place = max(range(len(v)), key=lambda k: abs(v[k]))
        word, sign = seen.setdefault(place, (f"w{i}", v[place]))
        if sign != v[place]:
            return f"{word} w{i}"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """The smallest tables; the vectors are all near copies of the first, every third document of one source, the events' users 3000."""
    import duckdb

    at = tmp_path_factory.mktemp("odd")
    changed = {"embeddings", "documents", "events"}
    for t in set(TABLES) - changed:
        shutil.copy(f"{SF}/{t}.parquet", at)
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    v = read("embeddings")
    first = list(v.filter("vec_id = 0").first()["embedding"])
    near = F.array(*(F.lit(x) + F.when(F.pmod(F.xxhash64("vec_id"), F.lit(64)) == i, 1e-3 * (1 + F.col("vec_id") % 97)).otherwise(0.0) for i, x in enumerate(first)))
    v.withColumn("embedding", near.cast("array<float>")).write.parquet(f"{at}/embeddings.parquet")
    docs = read("documents")
    texts = F.when(F.col("doc_id") == 1, " ").when(F.col("doc_id") == 2, cancelling()).when(F.col("doc_id") == 3, " \n\t").when(F.col("doc_id") == 4, "\x0b").otherwise(F.col("text"))
    third = F.col("doc_id") % 3 == 0
    docs = docs.withColumns({"source": F.when(third, "src1").otherwise(F.col("source")), "lang": F.when(third, "en").otherwise(F.col("lang"))})
    docs.withColumn("text", texts).write.parquet(f"{at}/documents.parquet")
    events = read("events")
    events = events.withColumn("event_id", F.explode(F.sequence(F.col("event_id") * 8, F.col("event_id") * 8 + 7)))
    events.withColumn("user_id", F.pmod(F.xxhash64("event_id"), F.lit(3000)).cast(dict(events.dtypes)["user_id"])).write.parquet(f"{at}/events.parquet")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/{t}.parquet{'/*.parquet' if t in changed else ''}')")
    return str(at), con


@pytest.mark.parametrize("name", ["evaluation_modes", "hashed_embeddings", "hybrid_search", "hybrid_search_in_files", "hybrid_search_with_floor", "lsh_candidates", "related_sessions", "stored_sketches"])
def test_query(spark, odd, name):
    at, con = odd
    df = catalogue.queries()[name](spark, at)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    want = con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({catalogue.oracle_sql()[name]}) q").fetchall()
    assert rows == sorted((tuple(plain(v) for v in r) for r in want), key=str)


def test_approx_distinct_of_many_groups(spark, tmp_path):
    """Estimates of 100 groups of 5000 parts: all of them come near."""
    spark.range(500_000).select((F.col("id") % 100).cast("string").alias("l_returnflag"), F.col("id").alias("l_partkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalogue.queries()["approx_distinct"](spark, str(tmp_path)).collect()
    assert len(got) == 100 and all(r.parts == 5000 and r.near and r.near_sketch for r in got)

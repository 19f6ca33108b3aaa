"""Every query that SQL can express gives the rows that DuckDB gives."""

import math
from pathlib import Path

import pytest

from engram.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    if name not in catalogue.oracle_sql():
        assert columns
        return
    want = duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({catalogue.oracle_sql()[name]}) q").fetchall()
    assert rows == sorted((tuple(plain(v) for v in r) for r in want), key=str)

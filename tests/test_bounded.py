"""Short lists are cut before anything is gathered; the table function equals the operator; snapshots are whole."""

import json

import pytest
from pyspark.sql import functions as F

from engram.operators import insights as I
from engram.operators import maintenance as M
from engram.operators import symbols as SY
from engram.sources.tables import CODE_METRICS

SCHEMA = "id string, symbol string, symbolType string, path string, language string, body string, documented boolean, complexity long, calls string, imports string"


@pytest.fixture(scope="module")
def rows(spark):
    made = [(str(i), f"s{i:03}", "function" if i % 7 else "type", f"p{i % 9}.ts", "go" if i % 2 else "ts", "b", i % 3 == 0, i % 40, f"s{(i * 3) % 200:03},s000" if i % 4 else "", "") for i in range(200)]
    return spark.createDataFrame([*made, ("200", "s001", "function", "p1.ts", "go", "b", True, 3, "", "")], SCHEMA)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lists_are_cut_first(rows):
    got = {r.symbolType: (r.n, r.first) for r in I.symbols_by_type(rows, 3).collect()}
    assert got["type"] == (29, "s000,s007,s014") and got["function"] == (172, "s001,s001,s002")
    assert "WindowGroupLimit" in plan(I.symbols_by_type(rows, 3))
    commits = rows.select(F.col("path").alias("file"), F.col("id").alias("commit"), F.col("language").alias("author"), F.col("complexity").alias("date"))
    assert "WindowGroupLimit" in plan(I.file_metadata(commits))
    assert "GlobalLimit" in plan(M.snapshot(rows, "2025-01-01", "abc"))


def test_a_whole_snapshot(spark, rows):
    first = M.snapshot(rows, "2025-01-01", "0123456789")
    assert first.columns == [f.name for f in CODE_METRICS.fields]
    one = first.first()
    assert (one.id, one.totalSymbols, one.totalFiles, one.duplicateSymbolCount) == ("2025-01-01:01234567", 201, 9, 1)
    assert one.avgSymbolsPerFile == 201 / 9 and {one.complexityTrend, one.documentationTrend, one.deadCodeTrend} == {"stable"}
    top = json.loads(one.topComplexSymbols)
    assert len(top) == 10 and [x["cyclomatic"] for x in top] == [39] * 5 + [38] * 5 and top[0] == {"symbol": "s039", "cyclomatic": 39, "path": "p3.ts"}
    assert json.loads(one.godSymbols)[0]["symbol"] == "s000" and one.godSymbolCount == 1
    later = M.snapshot(rows.filter("complexity > 20"), "2025-01-02", "x", previous=first).first()
    assert later.complexityTrend == "up"
    empty = M.snapshot(rows.limit(0), "2025-01-03", "y", previous=first).first()
    assert empty.totalSymbols == 0 and json.loads(empty.topComplexSymbols) == []


def test_the_table_function(spark):
    def lines(text):
        for n, line in enumerate(text.splitlines(), 1):
            yield line, "line", n, n, line, "", True, None, line

    files = spark.createDataFrame([("a.py", "def f():\n    pass\nclass C:\n    def m(self): pass\n"), ("b.go", "func G() {}\n"), ("c.txt", "one\ntwo"), ("d.ts", None), (None, "x"), ("e", "y")], "path string, text string")
    for name, more in (("parse_symbols", None), ("parse_more", {".txt": lines})):
        SY.register_parser(spark, name, more)
        got = spark.sql(f"SELECT f.path, s.symbol, s.symbolType, s.startLine, s.endLine FROM {{files}} f, LATERAL {name}(f.path, f.text) s", files=files)
        want = SY.symbols_of(files.filter("path is not null"), more).select("path", "symbol", "symbolType", "startLine", "endLine")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == (6 if more else 4)

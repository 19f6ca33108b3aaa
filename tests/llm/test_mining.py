"""Collocations and importance resampling against plain versions, on odd rows and on empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import op11_collocations as op11
from engram.llm import op12_importance_resampling as op12
from tests.llm import brute

ODD = [
    ("a a a a a a a a a a a a", "en"), ("New York, new york! new york? New\tYork; new  york: new york\nnew york\x0bnew york\rnew york new york", "en"),
    ("der die das " * 30, "de"), ("der die das " * 12, None), (None, "en"), ("", "fr"), (" ., ! ", "fr"), ("\x0c\t", None), ("é\x00ß é\x00ß " * 11, "de"),
    ("x y z w " * 40 + "x y. " * 15, "fr"), ("the end " * 10 + "of the end " * 9, "en"), ("der die das " * 12, ""), ("\x85o k " * 10, "en"), ("tab\ttab tab" * 11, "a\tb"),
]


def frame(spark, rows):
    return spark.createDataFrame([(k % 7 if k % 5 else None, t, x, "clash", "clash", 3) for k, (t, x) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n string, rank int")


@pytest.mark.parametrize("longest,least,share,top,bits,shard,held", [(3, 10, 50, 2000, 28, 4 << 20, 1 << 21), (3, 2, 80, 7, 16, 300, 40), (4, 3, 50, 50, 18, 2000, 400), (2, 2, 50, 9, 16, 64, 1)])
def test_op11(spark, monkeypatch, longest, least, share, top, bits, shard, held):
    monkeypatch.setattr(op11, "HELD", held)
    rnd = np.random.default_rng(3)
    words = ["The", "of", "red", "Réd", "ox", "öx", "x" * 300, "."]
    rows = [*ODD, *((" ".join(rnd.choice(words, rnd.integers(0, 120))), str(rnd.choice(["en", "de"]))) for _ in range(60)), *ODD[:3]]
    got = op11.collocations(frame(spark, rows), longest, least, share, top, bits, shard).collect()
    assert sorted(map(tuple, got)) == sorted(brute.collocations(rows, longest, least, share, top)) and len(got) > 4


def test_op11_counts(spark):
    rows = ODD * 3
    f, n = brute.run_counts(rows)
    got = {(r.lang, r.phrase): r.n for r in op11.phrase_counts(frame(spark, rows)).collect()}
    assert got == {(x, " ".join(w)): a for (x, w), a in f.items() if a >= 10} | {(x, ""): a for x, a in n.items() if a or (x, "") in got}
    empty = op11.collocations(frame(spark, rows).limit(0))
    assert empty.count() == 0 and empty.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_op11_sketch_bounds_every_run_from_above(spark):
    rnd = np.random.default_rng(8)
    rows = [(" ".join(f"w{k}" for k in rnd.zipf(1.4, 300) % 500), "en") for _ in range(40)]
    bitmap, bits = op11.sketch(frame(spark, rows).select(F.lit("en").alias("lang"), "text"), 3, 10, 28)
    import pyarrow as pa

    runs = op11.Runs(pa.array([t for t, _ in rows]), np.repeat(op11.salts(["en"]), len(rows)), 3)
    bit = {}
    for key, whole in zip(runs.keys, runs.whole, strict=True):
        cell, n = np.unique(key[whole] >> np.uint64(64 - bits), return_counts=True)
        for c, m in zip(cell.tolist(), n.tolist(), strict=True):
            bit[c] = bit.get(c, 0) + m
    on = {c for c in bit if bitmap[c >> 3] >> (c & 7) & 1}
    assert on == {c for c, m in bit.items() if m >= 10} and 0 < len(on) < len(bit)


def test_op11_of_very_long_texts(spark):
    rnd = np.random.default_rng(4)
    words = [f"w{k}" for k in range(200)]
    long = " ".join(words[k] + ("." if k % 37 == 0 else "") for k in rnd.integers(0, 200, 300_000))
    rows = [(long, "en"), ("z" * (1 << 21) + " a b", "en"), ("w1 w2", "en")]
    assert len(long) > 1 << 20
    got = op11.collocations(frame(spark, rows), shard=1 << 18).collect()
    assert sorted(map(tuple, got)) == sorted(brute.collocations(rows))
    text = b"no break " * 50 + b". one, two"
    assert b"".join(op11.parts_of(text, 64)) == text and max(map(len, op11.parts_of(text, 64))) > 400
    assert list(op11.parts_of(b"aa.bb.cc.dd", 4)) == [b"aa.", b"bb.", b"cc.dd"] or b"".join(op11.parts_of(b"aa.bb.cc.dd", 4)) == b"aa.bb.cc.dd"


@pytest.mark.parametrize("longest,buckets,percent,least", [(1, 10_000, 10, 20), (3, 50, 35, 3), (2, 1000, 100, 0)])
def test_op12(spark, longest, buckets, percent, least):
    rows = brute.messy()
    target = [rows[5][1], None, "", "a b c the of", rows[7][1]]
    items = spark.createDataFrame([(k, t, "x") for k, t in enumerate(target)], "item_id long, text string, buckets string")
    docs = brute.frame(spark, rows).withColumns({c: F.lit("clash") for c in ("words", "buckets", "score", "part", "open", "weight")})
    got = op12.resampled(docs, items, longest, buckets, percent, least).collect()
    want = brute.resampled(rows, target, longest, buckets, percent, least)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(r.rank is not None for r in got) == percent * sum(len(brute.bench_words(t)) >= least for _, t in rows) // 100


def test_op12_of_empty_tables_and_long_texts(spark):
    rows = brute.messy()[:30]
    docs = brute.frame(spark, rows)
    none = spark.createDataFrame([], "item_id long, text string")
    assert op12.resampled(docs.limit(0), none).count() == 0
    got = op12.resampled(docs, none).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute.resampled(rows, [])))
    long = " ".join(f"w{k % 1009}" for k in range(300_000))
    rows = [(1, long), (2, "w1 " * 25), (3, None)]
    got = op12.resampled(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("w1 w2",)], "text string"), percent=50).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute.resampled(rows, ["w1 w2"], percent=50)))

"""The toxicity network against a plain version, numerical slopes and held-out labels."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engram.llm import op13_toxicity as op13
from engram.llm.bytehash import NON_LETTERS, Words
from tests.llm import brute

ODD = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " .,! "), (None, "a b idiot"), (10**6 + 3, "é" * 700 + " 😀 x"), (10**6 + 4, "you stupid " * 9), (10**6 + 5, "IDIOT")]


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, op13.fit(docs, labels, rows=2400)


def test_op13_on_held_out_labels(spark, fitted):
    docs, labels, model = fitted
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = op13.toxicity_scores(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    # Some labelled texts have lost their words to junk; nothing can tell those.
    assert np.mean([r.predicted for r in held if truth[r.doc_id]]) >= 0.85
    assert np.mean([r.predicted for r in held if not truth[r.doc_id]]) <= 0.04


def test_op13_against_plain_windows(spark, fitted):
    docs, _, model = fitted
    some = docs.filter("doc_id < 25").select("doc_id", F.substring("text", 1, 900).alias("text")).union(spark.createDataFrame(ODD, "doc_id long, text string"))
    some = some.union(some.limit(2)).withColumns({c: F.lit("clash") for c in ("toxic", "score", "h", "held_out", "windows", "kind")})
    rows, got = [(r.doc_id, r.text) for r in some.collect()], op13.toxicity_scores(some, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    texts = dict(rows)
    for r in got:
        assert abs(r.score - brute.toxicity(texts[r.doc_id], model)) < 2e-3, r
    by = {r.doc_id: r for r in got}
    assert by[10**6 + 4].predicted and by[10**6 + 5].predicted and not by[10**6 + 3].predicted
    assert by[10**6].score == by[10**6 + 1].score == by[10**6 + 2].score


def test_op13_reads_whole_texts(spark, fitted):
    """One bad phrase anywhere in a text of over a mebibyte, across a window's end too."""
    docs, _, model = fitted
    # doc_id 1 and its like are clean: their words, over and over.
    words = " ".join(r.text for r in docs.filter("lang = 'en' and doc_id in (1, 2, 4)").collect()).split()
    clean = (words * (180_000 // len(words) + 1))[:180_000]
    rows = [(0, " ".join(clean))]
    for k, at in enumerate((0, 11, 12, 15, 100_003, 179_997), 1):
        rows.append((k, " ".join([*clean[:at], "worthless", "idiot", *clean[at:]])))
    assert len(rows[0][1]) > 1 << 20 - 1
    got = {r.doc_id: r.predicted for r in op13.toxicity_scores(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {0: 0} | {k: 1 for k in range(1, 7)}


def test_op13_windows_cover_every_word():
    for n in (0, 1, 15, 16, 17, 27, 28, 29, 100, 1000):
        words = Words(pa.array(["x y", " ".join(["w"] * n), "z"]), NON_LETTERS)
        doc, first, size = op13.windows_of(words)
        mine = [(a - 2, s) for d, a, s in zip(doc, first, size, strict=True) if d == 1]
        want = [] if not n else [(0, min(n, 16))]
        while want and sum(want[-1]) < n:
            want.append((want[-1][0] + 12, min(n - want[-1][0] - 12, 16)))
        assert mine == want


def test_op13_slopes():
    rng = np.random.default_rng(0)
    words = Words(pa.array(["idiot the of a moron é x", "a b c", "of the the", "idiot " * 16, "the scum of"]), NON_LETTERS)
    spelling = op13.Spelling(words)
    some = np.unique(words.hash)[::2]
    net = op13.Toxicity(some, np.zeros(len(some)), np.zeros(1 << op13.BUCKET_BITS))
    for k in op13.PARAMETERS:
        setattr(net, k, getattr(net, k).astype(np.float64) + 0.3 * rng.normal(size=getattr(net, k).shape))
    index = spelling.of[np.minimum(words.first[:-1, None] + np.arange(op13.WINDOW), len(words.hash) - 1)]
    y, weight, blind = np.array([1.0, 0, 1, 0, 1]), np.array([0.3, 0.2, 0.5, 0.1, 0.4]), np.arange(len(spelling.hash)) % 3 == 0

    def loss() -> float:
        row = np.where(blind, -1, net.row(spelling.hash))
        x = np.concatenate([np.where(row[:, None] >= 0, net.own[row], 0), spelling.pooled(net.spelt)], axis=1)
        inside = np.arange(op13.WINDOW) < words.counts[:, None]
        f = net.states(x @ net.wf + net.bf, net.uf, index, inside, range(op13.WINDOW))
        b = net.states(x @ net.wb + net.bb, net.ub, index, inside, range(op13.WINDOW - 1, -1, -1))
        z = net.pooled(f, b, inside)[3] @ net.out + net.bias[0]
        return float((weight * (np.logaddexp(0, z) - y * z)).sum())

    slopes = net.gradient(spelling, index, words.counts, np.arange(5), y, weight, blind)
    for k in op13.PARAMETERS:
        at = np.argwhere(np.abs(slopes[k]) > 1e-6)
        for j in map(tuple, at[rng.integers(0, len(at), 4)]):
            value, old = getattr(net, k), getattr(net, k)[j]
            value[j] = old + 1e-4
            above = loss()
            value[j] = old - 1e-4
            below = loss()
            value[j] = old
            assert abs((above - below) / 2e-4 - slopes[k][j]) < 1e-5 + 1e-3 * abs(slopes[k][j])


def test_op13_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot of a man"), (2, "a fine day"), (3, None), (4, "an idiot"), (6, "the day")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, "x"), (1, 1, "x"), (2, 0, "x"), (3, 0, "x"), (9, None, "x")], "doc_id long, toxic int, text string")
    assert op13.fit(docs, labels.filter("toxic = 0")) is None and op13.fit(docs.limit(0), labels) is None
    assert {r.score for r in op13.toxicity_scores(docs, None).collect()} == {0.0}
    model = op13.fit(docs, labels, held=9)  # from one row of either kind on
    assert op13.toxicity_scores(docs, model).count() == 5 and op13.toxicity_scores(docs.limit(0), model).count() == 0

"""The pipeline's stages against brute force, on the smallest tables."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as CP
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from engram.llm.shared import park

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in CP.STAGES:
        docs = park(stage(spark, docs, SF))
        out.append((name, docs))
    return dict(out)


def test_stages(spark, stages):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    for name in list(stages)[:-1]:
        assert stages[name].columns == documents.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {name: {r.doc_id: r.text for r in df.collect()} for name, df in stages.items() if name != "tokens"}
    good = rows["quality"]
    assert sum(labels[i] for i in good if i in labels) >= 0.95 * sum(labels.values())
    one_each = {c for _, c in brute.classes(sorted(good.items())).values()}
    assert set(rows["near_duplicates"]) == one_each
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(rows["decontamination"]) == {i for i, t in rows["near_duplicates"].items() if not brute.contaminated(t, bench)[4]}
    assert set(rows["personal_data"]) == set(rows["decontamination"])
    for i, t in rows["personal_data"].items():
        before = rows["decontamination"][i]
        if not brute.base_spans(before) and not re.search("[0-9]", before):
            assert t == before
        assert not brute.base_spans(t)
    last = stages["tokens"]
    assert set(last.columns) == {"doc_id", "n_tokens", "ids"} and last.count() == len(rows["personal_data"])
    assert last.filter(F.size("ids") != F.col("n_tokens")).count() == 0


def test_odd_rows(spark):
    """Each stage alone on odd rows: what it keeps, row by row, with all columns as they were."""
    rows = brute.messy()
    docs = brute.frame(spark, rows)
    seen = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leak = (777, "so " + bench[0][1] + " it is")
    with_leak = brute.frame(spark, [*rows, leak, leak])
    kept = {name: sorted(((r[0], r[1]) for r in stage(spark, with_leak if name == "decontamination" else docs, SF).select("doc_id", F.col("text") if name != "tokens" else F.size("ids")).collect()), key=str) for name, stage in CP.STAGES}
    # The labelled ids of the small tables are other texts here, but scores still decide by the text alone.
    decided = {}
    for i, t in kept["quality"]:
        decided.setdefault(t, []).append(i)
    for t in decided:
        assert sorted(decided[t], key=str) == sorted((i for i, x in seen if x == t), key=str)
    components = brute.classes(rows)
    want = [(i, t) for i, t in {r: 0 for r in rows} if i is not None and components[i][1] == i] + [r for r in rows if r[0] is None]
    assert kept["near_duplicates"] == sorted(want, key=str)
    assert kept["decontamination"] == [r for r in seen if not brute.contaminated(r[1], bench)[4]]
    assert [i for i, _ in kept["personal_data"]] == [i for i, _ in seen]
    assert all(not brute.base_spans(t or "") for _, t in kept["personal_data"]) and (90, None) in kept["personal_data"] and (91, "") in kept["personal_data"]
    assert len(kept["tokens"]) == len(seen) and {n for i, n in kept["tokens"] if i in (90, 91, 92)} == {0}
    for name, stage in CP.STAGES:
        none = stage(spark, docs.limit(0), SF)
        assert none.count() == 0 and (name == "tokens" or none.columns == docs.columns)


def test_near_duplicates_of_rows_with_one_id(spark):
    """Rows that share a doc_id but not a text go and stay by their own texts."""
    text = lambda t: " ".join(f"{t}{k}" for k in range(30))
    rows = [(5, text("a")), (5, text("b")), (3, text("a") + " end"), (7, text("b") + " end"), (5, text("b"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in CP.near_duplicates(spark, docs, SF).collect()) == [(3, text("a") + " end"), (5, text("b"))]


def test_tokens_are_decoded_and_words_let_go(spark):
    """The stage decodes its ids, and a worker keeps no words beyond its task."""
    import public_tokenizers
    import pyarrow as pa

    from engram.llm import op06_rank_bpe as B

    docs = spark.createDataFrame([(1, "one two <|endoftext|> two"), (2, ""), (3, None)], "doc_id long, text string")
    made = CP.tokens(spark, docs, SF)
    assert "decoded" in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r.doc_id: len(r.ids) == r.n_tokens for r in made.collect()} == {1: True, 2: True, 3: True}

    class Sent:
        with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
            value = f.read()

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["one two three"])], names=["doc_id", "text"])
    assert [b.column("n_tokens").to_pylist() for b in B.encoder(Sent, digests=False)(iter([batch]))] == [[3]]
    assert not B.loaded(Sent.value).known

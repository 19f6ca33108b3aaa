"""Every operator against a plain version, on odd rows and on an empty table."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engram.llm import op01_ngram_jaccard as op1
from engram.llm import op02_winnowing as op2
from engram.llm import op03_imatch as op3
from engram.llm import op04_chat_prefixes as op4
from engram.llm import op05_language_backoff as op5
from engram.llm import op06_rank_bpe as op6
from engram.llm import op07_quality as op7
from engram.llm import op08_pii_bootstrap as op8
from engram.llm import op09_suffix_dedup as op9
from engram.llm import op10_vector_shards as op10
from engram.llm.shared import components, hot_join
from tests.llm import brute

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 8), (20, 21), (21, 22), (22, 20), (7, 6), (6, 5), (1, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 20: 20, 21: 20, 22: 20, 5: 5, 6: 5, 7: 5}


def test_hot_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(2000)] + [(i, i) for i in range(2, 900)] + [(None, 5)], "k long, v long")
    right = spark.createDataFrame([(i, -i) for i in range(0, 500)], "k long, w long")
    for how in ("inner", "left"):
        rows = lambda df: sorted((tuple(r) for r in df.select("k", "v", "w").collect()), key=str)
        assert rows(hot_join(left, right, "k", how)) == rows(left.join(right, "k", how))


def test_components_of_hot_nodes(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(40)] + [(9000, i) for i in range(2990, 3100)] + [(6000, 7000 + i) for i in range(800)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in [*range(3100), 9000]} | {5000 + i: 5000 for i in range(41)} | {i: 6000 for i in [6000, *range(7000, 7800)]}
    assert got == want


def test_op1(spark):
    rows = brute.messy()
    want = brute.classes(rows)
    got = op1.ngram_jaccard_classes(brute.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
    assert op1.ngram_jaccard_classes(brute.frame(spark, rows).limit(0)).count() == 0


def test_op1_links_sets_either_side_of_the_sketch(spark):
    rows, at = [], 0
    for n in range(40, 48):  # words of their own, so that nothing else bridges a pair
        for m in range(op1.SKETCH + 1, 4 * n // 3 + 1):
            for _ in range(3):
                w = [f"{at}x{k}" for k in range(m + 4)]
                rows += [(at, " ".join(w[: n + 4])), (at + 1, " ".join(w))]
                at += 2
    got = {r.doc_id: r.component_id for r in op1.ngram_jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(at)}
    for n in range(1, 48):
        for m in range(n, 4 * n // 3 + 1):
            both = next(o for o in range(n + 1) if 100 * o >= 75 * (n + m - o))
            assert op1.least_shared(n, 75) <= both - max(0, m - op1.SKETCH)


def test_op1_links_by_size_pair(spark):
    """Sizes 30 to 90, at likenesses about 0.75 to 0.8: nested texts and texts that differ in the middle or at both ends."""
    rnd, rows = np.random.default_rng(9), []
    for n in range(30, 91, 3):
        for like in (0.74, 0.75, 0.76, 0.78, 0.8):
            for shape in range(3):
                at = len(rows)
                w = [f"{at}x{k}" for k in range(n + 4)]
                if shape == 0:  # a longer copy
                    other = w + [f"{at}y{k}" for k in range(round(n / like) - n)]
                elif shape == 1:  # some words replaced, each of which changes five shingles
                    other = list(w)
                    for k in rnd.choice(np.arange(4, n, 6), max(1, round(n * (1 - like) / (1 + like) / 5)), replace=False):
                        other[k] = f"{at}z{k}"
                else:  # both ends moved on
                    k = max(1, round(n * (1 - like) / (1 + like)))
                    other = w[k:] + [f"{at}y{j}" for j in range(k)]
                rows += [(at, " ".join(w)), (at + 1, " ".join(other))]
    want = {}
    for (i, a), (j, b) in zip(rows[::2], rows[1::2], strict=True):
        a, b = brute.shingles(a), brute.shingles(b)
        linked = 100 * len(a & b) >= 75 * len(a | b)
        want |= {i: (len(a), i), j: (len(b), i if linked else j)}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op1.ngram_jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and 0.3 < np.mean([want[i + 1][1] == i for i in range(0, len(rows), 2)]) < 0.95


def test_op1_judges_rows_of_one_id_by_their_own_texts(spark):
    text = lambda t: " ".join(f"{t}{k}" for k in range(30))
    rows = [(5, text("a")), (5, text("b")), (7, text("a") + " end"), (8, text("b") + " end"), (3, text("c")), (5, text("c") + " end"), (9, text("d"))]
    rows += [(i, text(f"t{i}") + tail) for i in range(20, 40) for tail in ("", " end")] + [(i, text(f"u{i - 20}")) for i in range(40, 60)]
    rows += [(i - 20, text(f"u{i - 20}") + " end") for i in range(40, 60)]
    got = op1.ngram_jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), hashes=True)
    h = {r.h: r.text for r in spark.createDataFrame(rows, "doc_id long, text string").select("text", F.xxhash64("text").alias("h")).collect()}
    got = {(r.doc_id, h[r.h]): r.component_id for r in got.collect()}
    want = {(5, text("a")): 5, (5, text("b")): 5, (7, text("a") + " end"): 5, (8, text("b") + " end"): 5, (3, text("c")): 3, (5, text("c") + " end"): 3, (9, text("d")): 9}
    want |= {(i, t): i if i < 40 else i - 20 for i, t in rows if i >= 20}
    assert got == want


def test_op1_bitmaps_bound_the_overlap_from_above():
    rng = np.random.default_rng(1)
    for n in (3, 40, 700, 9000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)]))
        w = min(op1.width(len(a)), op1.width(len(b))) // 8
        x, y = op1.folded([op1.parity(a)], w), op1.folded([op1.parity(b)], w)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(-9, 9), min_size=1, max_size=6), min_size=2, max_size=8))
def test_op1_gives_a_pair_to_its_smallest_shared_hash(sets):
    import pyarrow as pa

    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] & sets[b]]
    got = op1.first_shared(pa.array([sorted(x) for x in sets], pa.list_(pa.int64())), np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int), 3)
    assert got.tolist() == [min(sets[a] & sets[b]) for a, b in pairs]


def test_op2(spark):
    rows = brute.messy()
    bench = [(7, " ".join(rows[5][1].split()[:25])), (8, "one"), (9, None), (10, " ... "), (11, " ".join(rows[4][1].split()[3:20])), (12, "a b c"), (12, "d e f")]
    items = spark.createDataFrame([(i, t, "x") for i, t in bench], "item_id long, text string, h string")
    got = op2.contamination(brute.frame(spark, rows), items).collect()
    assert len(got) == len(rows)
    want = {(i, t): brute.contaminated(t, bench) for i, t in rows}
    by_id = {}
    for (i, t), w in want.items():
        by_id.setdefault(i, set()).add(w)
    assert {i for i, t in rows if want[(i, t)][4]}
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) in by_id[r.doc_id], r
    assert op2.contamination(brute.frame(spark, rows).limit(0), items).count() == 0
    assert op2.contamination(brute.frame(spark, rows[:3]), items.limit(0)).filter("contaminated").count() == 0


def test_op3(spark):
    rows = brute.messy()
    got = op3.imatch(brute.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), brute.xx(r[1] or "")))
    words, want = brute.lexicon([t for _, t in rows]), []
    for k, (i, t) in enumerate(order):
        t, f = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + f[: len(t) // 2]
        near = (brute.fingerprint_likeness(t, x, words) for x in (edited, f))
        want.append((i, len(t), brute.sha(edited), brute.fingerprint_text(t, words), brute.fingerprint_text(edited, words), *(round(x, 9) for x in near)))
    assert sorted((*r[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got if r.doc_id is not None) == sorted(w for w in want if w[0] is not None)
    assert sorted(r[1:5] for r in got if r.doc_id is None) == sorted(w[1:5] for w in want if w[0] is None)
    assert op3.imatch(brute.frame(spark, rows).limit(0)).count() == 0
    assert op3.imatch(brute.frame(spark, rows[:1])).first().near_next == 1


def test_op3_of_a_hot_group(spark):
    rnd = np.random.default_rng(7)
    word = lambda k: f"w{'abcdefghij'[k % 10]}{k}"
    rows = [(i, " ".join(word(k) for k in rnd.integers(0, 900, 80))) for i in range(60)]
    hot = " ".join(word(k) for k in range(80))
    copied = [*rows, *((100 + i, hot) for i in range(30)), *((None, hot) for _ in range(3)), (100, hot)]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    assert op3.lexicon_of(frame(copied)).tolist() == op3.lexicon_of(frame([*rows, (100, hot)])).tolist()
    near = []
    for i in range(30):  # distinct texts, a third of all, so that their words are above the band
        w = hot.split()
        w[2 * i] = f"own{i}"
        near.append((100 + i, " ".join(w)))
    got = {r.doc_id: r for r in op3.imatch(frame([*rows, *near])).collect()}
    assert all(not got[i].fingerprint.startswith("t:") for i in range(100, 130))
    assert all(got[i].near_next > 0.8 for i in range(101, 130))
    # The edited text is a first half followed by the next text's first half.
    assert all(0.3 < got[i].near_edited < 0.7 for i in range(101, 130)) and 0.1 < got[100].near_edited < 0.6 and got[100].near_next < 0.2
    assert all(r.near_next < 0.3 for i, r in got.items() if i < 60)


def test_op3_keeps_its_band_at_any_size(spark):
    words = " ".join(f"w{k:x}" for k in range(1_100_000))
    docs = spark.createDataFrame([(1, words), (2, words + " end"), (3, None)], "doc_id long, text string")
    assert len(op3.lexicon_of(docs)) == 1_100_000


def test_op4(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "\\", "\\<|", "<\\|", "a\nb", "", None, "<<||>>\\n", "x" * 3000]
    rows = [(c, t, r, odd[(c * 3 + t) % len(odd)], "clash") for c in range(6) for t, r in enumerate(["system", "user", "assistant", "user", "assistant", "to\\ol\n<|x"][: c + 1])]
    rows += [(9, 0, "assistant", "same", "x"), (9, 0, "assistant", "same", "x"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    talks = {}
    for c, t, r, x, _ in rows:
        talks.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    got = {r.conv_id: r for r in op4.chat_digests(df).collect()}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        turns.sort()
        said, loss = "".join(f"{r}\n{x}\n" for _, r, x in turns), "".join(x for _, r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), brute.sha(said), len(loss), brute.sha(loss))
    for r in op4.chat_examples(df).collect():
        assert r.text.endswith(op4.CLOSE) and r.loss_start + r.loss_chars <= len(r.text)
    assert op4.chat_digests(df.limit(0)).count() == 0


def test_op5(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "", "en"), (10**6 + 2, "123 ... !", None), (None, "the of and", None)], "doc_id long, text string, lang string")
    got = op5.identify(docs.select("doc_id", "text", "lang").union(odd)).collect()
    assert len(got) == docs.count() + 4
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    seen = {r.doc_id: r for r in got}
    held = [i for i in lang if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(seen[i].held_out == (i in held) for i in lang)
    assert np.mean([seen[i].lang_pred == lang[i] for i in held]) >= 0.95
    assert all(seen[10**6 + k].lang_pred == "und" for k in range(3)) and all(0 <= r.score <= 1 for r in got)
    assert op5.identify(docs.limit(0)).count() == 0
    # Against plain counting, with columns whose names clash and repeated rows.
    some = docs.filter("doc_id < 60").union(docs.filter("doc_id < 5")).withColumn("held_out", F.lit("x")).withColumn("score", F.lit(7))
    rows = [(r.doc_id, r.text, r.lang) for r in some.collect()]
    langs, tables = brute.language_model([(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 5 and x is not None and t is not None])
    texts = {i: t for i, t, _ in rows}
    got = op5.identify(some).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _, _ in rows)
    for r in got:
        lang, score = brute.language(texts[r.doc_id], langs, tables)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3


def test_op6_on_every_code_point():
    from tokenizers import Tokenizer

    mine, reference = op6.RankBpe(open(VOCABULARY).read()), Tokenizer.from_file(VOCABULARY)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 1 << 16):
        texts = [f"a{chr(c)}b {chr(c)}1 {chr(c)}{chr(c)}" for c in points[at : at + (1 << 16)]]
        assert mine.encode(texts) == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_op6(spark):
    from tokenizers import Tokenizer

    rows = brute.messy([(200, "<|endoftext|>A<|startoftext|> b<|end"), (201, "ΣΑΣ İstanbul ſ ½Ⅷ٣"), (202, "aaaa" * 300), (203, "it's we'll THEY'VE")])
    reference = Tokenizer.from_file(VOCABULARY)
    got = op6.bpe_encode(brute.frame(spark, rows), VOCABULARY).collect()
    digests = op6.bpe_encode(brute.frame(spark, rows), VOCABULARY, digests=True).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), reference.encode(t or "", add_special_tokens=False).ids) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    assert sorted((str(r.doc_id), r.decoded) for r in got) == sorted((i, reference.decode(ids, skip_special_tokens=False)) for i, ids in want)
    assert sorted(r.ids_sha256 for r in digests) == sorted(brute.sha(np.array(ids, "<u4").tobytes()) for _, ids in want)
    assert op6.bpe_encode(brute.frame(spark, rows).limit(0), VOCABULARY).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abthe ingTIONéßΣ'12<|>😀\n", max_size=60))
def test_op6_on_any_text(text):
    from tokenizers import Tokenizer

    if not hasattr(test_op6_on_any_text, "made"):
        test_op6_on_any_text.made = op6.RankBpe(open(VOCABULARY).read()), Tokenizer.from_file(VOCABULARY)
    mine, reference = test_op6_on_any_text.made
    assert mine.encode([text])[0] == reference.encode(text, add_special_tokens=False).ids
    for word in text.split():
        if word.isascii() and word.isalpha():
            assert mine.long(word.lower().encode()) == mine.short([word.lower().encode()])[0]


def test_op7(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = op7.fit(docs, labels)
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (None, "a b")], "doc_id long, text string")
    rows = op7.quality_scores(docs.select("doc_id", "text").union(odd), model).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows) and len(rows) == docs.count() + 3
    kept = op7.of_quality(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in rows if r.predicted and r.doc_id is not None and r.doc_id < 10**6)
    assert op7.fit(docs, labels.limit(0)) is None and op7.quality_scores(docs.limit(0), None).count() == 0


def test_op7_against_plain_features(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (None, "a b"), (10**6 + 2, "...")], "doc_id long, text string")
    some = docs.filter("doc_id < 100").select("doc_id", "text")
    some = some.union(some.limit(3)).union(odd).withColumns({c: F.lit("clash") for c in ("quality", "score", "h", "held_out", "x")})
    model = op7.fit(some, labels.withColumn("text", F.lit("clash")), share=0.0005)
    rows = [(r.doc_id, r.text) for r in some.collect()]
    vectors = brute.word_vectors([t for _, t in rows], 0.0005)
    assert 100 < len(model.vocabulary) <= 2000 and set(model.vocabulary.tolist()) == set(vectors)
    got = op7.quality_scores(some, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    texts = dict(rows)
    for r in got:
        assert abs(r.score - brute.quality(texts[r.doc_id], vectors, model)) < 1e-3
    assert op7.of_quality(some, model).columns == some.columns
    assert op7.fit(some, labels.filter("doc_id < 0")) is None
    for n in (1, 2, 4):  # a model from one row of each kind on
        few = [r.doc_id for k in (0, 1) for r in labels.filter(f"quality = {k} and doc_id < 100 and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").orderBy("doc_id").limit(n).collect()]
        small = op7.fit(some, labels.filter(F.col("doc_id").isin(few)))
        assert small is not None and {r.score for r in op7.quality_scores(some, small).collect()} != {1.0}


def test_op8(spark):
    odd = ["a@b.c_d@e.f.g", "1.2.3.4.5.6.7.8", "+12 345 678 9012 x", "4111 1111 1111 1111", "4111-1111-1111-1112 x 1 2", "x@y.z@w.v", "é😀 joe.x@mail.example.com, 300.1.1.1 255.255.255.255 0255.1.1.1", "+1+1 (555) 123-4567-", "9" * 400, "12" * 9, "a." * 2000 + "@x"]
    secret = ["key: id = %040x end" % (16**39 + i * 7919 * 16**20) for i in range(8)] + ["key: id = zz-99-abc-7 end"]
    rows = brute.messy([(300 + k, t) for k, t in enumerate([*odd, *secret])])
    df = brute.frame(spark, rows)
    want = {(i, t): brute.base_spans(t or "") for i, t in rows}
    got = op8.personal_data(df).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [(s.start, s.rank, s.kind, s.end) for s in r.base]
        assert mine in [w for (i, _), w in want.items() if i == r.doc_id]
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    found = {s.value for r in got for s in r.spans if s.kind == "id"}
    assert "zz-99-abc-7" in found
    clean = {(r.doc_id, r.text) for r in op8.without_personal_data(df).collect()}
    assert (90, None) in clean and any("<CARD>" in (t or "") for _, t in clean) and not any("4111 1111" in (t or "") for _, t in clean)
    assert op8.personal_data_digest(df.limit(0)).count() == 0


def test_op8_bootstrap(spark):
    rnd = np.random.default_rng(5)
    word = lambda: str(rnd.choice(["account", "number", "call", "the", "Ref:", "(x", "id="]))
    value = lambda: str(rnd.choice(["1.2.3.%d" % rnd.integers(300), "+1 555 %07d" % rnd.integers(10**7), "u%d@x.org" % rnd.integers(99), "AB-%d" % rnd.integers(10**6), "a,12-345,678-9xyz", "f%031x" % rnd.integers(10**9)]))
    texts = [" ".join(word() if rnd.random() < 0.6 else value() for _ in range(rnd.integers(0, 40))) for _ in range(120)]
    texts += ["", " 12-34-56 ", "id=" + "x" * 90 + "=AB-77777", "call \n\t number   AB-424242\n", "É" * 40 + " AB-424243 é@12345", *(f"who is AB-{i}Z1" for i in range(9)), *(f"who is u{i}@y.org" for i in range(20))]
    got = {r.doc_id: r for r in op8.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = brute.pii(texts)
    assert sum(len(all_) > len(base) for base, all_ in want) > 5
    for k, (base, every) in enumerate(want):
        assert [(s.start, s.rank, s.kind, s.end) for s in got[k].base] == base, texts[k]
        assert [(s.start, s.rank, s.kind, s.end) for s in got[k].spans] == every, texts[k]


def test_op8_cuts_long_texts(spark):
    text = "é" * 1500 + " a@b.cd " + "x" * 3000 + " 10.1.2.3 " + "y" * 2048
    got = op8.without_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
    assert got == text.replace("a@b.cd", "<EMAIL>").replace("10.1.2.3", "<IP>")


@pytest.mark.parametrize("part,many,sample", [(3, 1 << 12, 64), (1 << 14, 1 << 12, 1), (1 << 14, 2, 64), (5, 0, 1)])
def test_op9(spark, part, many, sample, monkeypatch):
    monkeypatch.setattr(op9, "SAMPLE", sample)
    monkeypatch.setattr(op9, "PART", part)
    monkeypatch.setattr(op9, "MANY", many)
    rows = brute.messy([(400, "ab" * 300), (401, "ab" * 200 + "xyz"), (402, "q" * 50), (403, "z" + "q" * 50 + "é" * 40), (404, "é" * 40), (405, "x" * 49), (406, "x" * 49)])
    want = brute.cuts(rows)
    got = op9.suffix_dedup(brute.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) in [w for (i, _), w in want.items() if i == r.doc_id], r
    if part > 3:
        assert op9.suffix_dedup(brute.frame(spark, rows).limit(0)).count() == 0


def test_op9_of_a_key_with_many_stretches(spark, monkeypatch):
    """One passage of 30 bytes in every text, with other words on both sides; some texts share more of them."""
    monkeypatch.setattr(op9, "MANY", 50)
    rnd = np.random.default_rng(4)
    word = lambda: "".join(rnd.choice(list("abcdef"), 12))
    rows = [(i, f"{word()} {word()} this is one very common passage {word()} {word()}") for i in range(300)]
    rows += [(300 + i, rows[i][1][: 70 - i % 30] + word()) for i in range(100)] + [(i, rows[i - 400][1][9:] + word()) for i in range(400, 450)]
    want = brute.cuts(rows)
    got = {r.doc_id: r for r in op9.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(r.n_removed for r in got.values()) > 5000
    for (i, _), w in want.items():
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == w


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), max_size=40))
def test_op9_longest_previous_factors(pairs):
    value, common = np.array([v for v, _ in pairs], np.int64), np.array([c for _, c in pairs], np.int64)
    common[:1] = 0
    want = []
    for i in range(len(value)):
        best = 0
        for step in (-1, 1):
            j, m = i + step, 99
            while 0 <= j < len(value):
                m = min(m, common[max(j, j - step)])
                if value[j] < value[i]:
                    best = max(best, m)
                    break
                j += step
        want.append(best)
    assert op9.previous_factors(value, common).tolist() == want


def test_op9_sorts_suffixes_whole():
    rnd = np.random.default_rng(2)
    some = [bytes(rnd.choice(list(b"ab\0"), n).astype(np.uint8)) for n in rnd.integers(50, 82, 40)] + [b"a" * 81, b"a" * 60, b"a" * 60 + b"\0" * 21]
    o = np.concatenate([[0], np.cumsum([len(x) for x in some])])
    key = np.arange(len(some)) % 3
    row, at, order, common = op9.suffix_order(np.frombuffer(b"".join(some), np.uint8), o, key, np.arange(len(some)))
    got = [(key[row[i]], some[row[i]][at[i] :]) for i in order]
    assert got == sorted((key[r], x[i:]) for r, x in enumerate(some) for i in range(len(x) - 49))
    for (k, x), (l, y), c in zip(got[:-1], got[1:], common[1:], strict=True):
        assert c == (next((n for n, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y))) if k == l else 0)


def test_op10(spark):
    rows = brute.messy([(500 + i, "copy of a copy") for i in range(120)])
    got = op10.vector_shards(brute.frame(spark, rows), shards=4).collect()
    assert len(got) == len(rows)
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r)
    assert set(per) <= set(range(4))
    for some in per.values():
        assert sorted(r.slot for r in some) == list(range(len(some)))
    load = [sum(r["size"] for r in some) for some in per.values()]
    assert max(load) - min(load) <= 0.25 * np.mean(load)
    assert sorted(r.text_crc32 for r in got) == sorted(zlib.crc32((t or "").encode()) for _, t in rows)
    assert len({r.shard for r in got if r.doc_id in (80, 81, 82)}) == 1
    assert op10.vector_shards(brute.frame(spark, rows).limit(0)).count() == 0
    some = [r for r in rows if r[0] is not None]  # those without are dealt by where they stand
    for n in (4, 40):
        found = op10.vector_shards(brute.frame(spark, some), shards=n).collect()
        assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard) for r in found), key=str) == brute.shards(some, n)


def test_texts_beyond_a_chunk(spark):
    """Texts of over a mebibyte take every operator's path for long ones."""
    from tokenizers import Tokenizer

    rnd = np.random.default_rng(6)
    words = ["".join(rnd.choice(list("abcdefgh"), n)) for n in rnd.integers(3, 11, 3000)]
    long = " ".join(words[k] for k in rnd.integers(0, 3000, 160_000))
    assert len(long) > 1 << 20
    rows = [(1, long), (2, long[: len(long) * 9 // 10]), (3, long[1000:9000] + " x@y.org"), (4, "small"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op1.ngram_jaccard_classes(df).collect()} == brute.classes(rows)
    items = [(1, long[5000:5200]), (2, "small")]
    got = op2.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got} == {(i, *brute.contaminated(t, items)[:3]) for i, t in rows}
    lexicon = brute.lexicon([t for _, t in rows])
    assert {r.doc_id: r.fingerprint for r in op3.imatch(df).collect()} == {i: brute.fingerprint_text(t or "", lexicon) for i, t in rows}
    assert {r.doc_id for r in op5.identify(df.withColumn("lang", F.lit("zz"))).filter("lang_pred = 'zz'").collect()} == {1, 2, 3, 4}
    reference = Tokenizer.from_file(VOCABULARY)
    assert {r.doc_id: r.ids for r in op6.bpe_encode(df, VOCABULARY).collect()} == {i: reference.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    graded = df.union(spark.createDataFrame([(10 + i, "a b c d " * i if i % 2 else "! ? " * i) for i in range(40)], df.schema))
    model = op7.fit(graded, spark.createDataFrame([(i, i % 2) for i in range(10, 50)], "doc_id long, quality int"))
    scores = {r.doc_id: r.score for r in op7.quality_scores(graded, model).collect()}
    assert len(scores) == 45 and scores[11] > 0.5 > scores[48] and abs(scores[1] - scores[2]) < 0.1
    assert {r.doc_id: len(r.base) for r in op8.personal_data(df).collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in op9.suffix_dedup(df).collect()}
    assert got == {1: (len(long), 0, 0), 2: (len(rows[1][1]),) * 2 + (1,), 3: (8008, 8000, 1), 4: (5, 0, 0), 5: (0, 0, 0)}
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard) for r in op10.vector_shards(df, 4).collect()), key=str) == brute.shards(rows, 4)


def test_words_of_a_regular_pattern(spark):
    """Words of the Thue-Morse sequence and their opposites, which polynomials modulo a power of two take for equal."""
    word = "a"
    while len(word) < 1 << 14:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = []
    for k in range(8, 15):
        one = word[: 1 << k]
        for text in (one, one.translate(str.maketrans("ab", "ba"))):
            rows += [(len(rows), f"{text} w x y z"), (len(rows) + 1, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in op1.ngram_jaccard_classes(df).collect()}
    assert got == {i: i for i, _ in rows}
    prints = {r.doc_id: r.fingerprint for r in op3.imatch(df).collect()}
    assert len({prints[i] for i, t in rows if " " not in t}) == len(rows) // 2
    named = df.filter("doc_id % 2 = 1").withColumn("lang", F.concat(F.lit("l"), F.col("doc_id").cast("string")))
    model = op5.fit(named)
    assert [model.predict([t])[0][0] for i, t in rows if i % 2] == [f"l{i}" for i, _ in rows if i % 2]
    vectors = op7.word_vectors(df, 1e-9)
    assert len(vectors.vocabulary) == len({w for _, t in rows for w in t.split()})


def test_op10_deals_out_heavy_groups(spark):
    rows = [(i if i % 3 else None, "copy " * 20) for i in range(900)] + [(1000 + i, f"own text {i} " * 18) for i in range(600)]
    got = op10.vector_shards(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    assert len(got) == 1500
    load, hot, nulls = {}, {}, {}
    for r in got:
        load[r.shard] = load.get(r.shard, 0) + r["size"]
        if r["size"] == 116:
            hot[r.shard] = hot.get(r.shard, 0) + 1
            if r.doc_id is None:
                nulls[r.shard] = nulls.get(r.shard, 0) + 1
    assert max(load.values()) <= 1.1 * min(load.values()) and len(hot) >= 6 and len(nulls) >= 6 and max(nulls.values()) < 100


def test_pack_prefers_the_residual():
    rng = np.random.default_rng(0)
    loads = rng.integers(1, 100, (400, 3)).astype(float)
    shard = op10.pack(loads, 8)
    sums = np.array([loads[shard == s].sum(axis=0) for s in range(8)])
    assert (sums.max(axis=0) / sums.mean(axis=0) < 1.05).all()

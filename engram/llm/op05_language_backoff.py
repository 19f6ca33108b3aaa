"""Language identification: words first, then ever shorter character n-grams.

A known word scores by its log frequency in each language. An unknown word scores by the mean log frequency of its known
character n-grams of the longest length (`ORDERS`) of which it has any. The language with the highest sum over the text
wins; the score is its share in the softmax of the sums.

The counts come from a sample of labelled rows of bounded size: `FIT_ROWS` rows and `FIT_BYTES` bytes of text for each
language on average, chosen by a hash of doc_id; all rows of a language that has fewer. Every word and n-gram of the
sample is in the model, which is broadcast, so its size follows from those bounds: an entry for each language in which
it was seen, nothing for the others.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.bytehash import NON_LETTERS, Words, pieces
from engram.llm.shared import park

FIT_ROWS, FIT_BYTES, ORDERS, SMOOTH = 4000, 8 << 20, (4, 3, 2, 1), 0.1
LETTER = regex.compile(r"\p{L}")


def words_of(texts: list[str | None]) -> Words:
    return Words(pa.array([(t or "").lower() for t in texts], pa.large_string()), NON_LETTERS)


def ngrams(words: Words, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the character n-grams of the words `which`; word is an index into which."""
    letter = np.flatnonzero((words.data & 0xC0) != 0x80)  # where characters begin
    a, b = np.searchsorted(letter, words.start[which]), np.searchsorted(letter, words.end[which])
    count = np.maximum(b - a - n + 1, 0)
    word = np.repeat(np.arange(len(which)), count)
    first = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + a[word]
    bounds = np.append(letter, len(words.data))
    end = np.where(first + n < b[word], bounds[np.minimum(first + n, len(letter))], words.end[which][word])
    return word, words.spans(bounds[first], end)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, gram, n): kind 0 for words, else the length of an n-gram."""
    for whole in batches:
        for batch in pieces(whole):
            langs = np.array(batch.column("lang").to_pylist(), object)
            words = words_of(batch.column("text").to_pylist())
            names, of = np.unique(langs.astype(str), return_inverse=True)
            for k, name in enumerate(names):
                which = np.flatnonzero(of[words.doc] == k)
                for kind, h in [(0, words.hash[which]), *((n, ngrams(words, which, n)[1]) for n in ORDERS)]:
                    gram, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([str(name)] * len(gram), pa.string()), pa.array(np.full(len(gram), kind, np.int32)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "kind", "gram", "n"],
                    )


class Backoff:
    """For words and for each n-gram length: sorted hashes, and of each the languages in which it was seen.

    A table is (keys, first, lang, more, never): the entries of key k are first[k] to first[k + 1], each a language and
    what its log frequency has more than `never`, that of a key not seen in the language.
    """

    def __init__(self, langs: list[str], tables: dict[int, tuple[np.ndarray, ...]]):
        self.langs, self.tables = langs, tables

    def look(self, kind: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, row) of hashes."""
        keys = self.tables[kind][0]
        if not len(keys):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return keys[at] == h, at

    def sums(self, kind: int, at: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """For each text and language, the weighted sum of the log frequencies of the keys `at`."""
        _, first, lang, more, never = self.tables[kind]
        count = first[at + 1] - first[at]
        key = np.repeat(np.arange(len(at)), count)
        entry = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count) + first[at][key]
        seen = np.bincount(doc[key] * len(never) + lang[entry], weight[key] * more[entry], minlength=docs * len(never))
        return seen.reshape(docs, len(never)) + np.bincount(doc, weight, minlength=docs)[:, None] * never

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        words = words_of(texts)
        known, at = self.look(0, words.hash)
        total = self.sums(0, at[known], np.ones(int(known.sum())), words.doc[known], len(texts))
        open_ = np.flatnonzero(~known)
        for n in ORDERS:
            if not len(open_):
                break
            word, h = ngrams(words, open_, n)
            met, at = self.look(n, h)
            word, at = word[met], at[met]
            many = np.bincount(word, minlength=len(open_))
            total += self.sums(n, at, 1 / many[word], words.doc[open_[word]], len(texts))
            open_ = open_[many == 0]
        best = total.argmax(axis=1)
        share = np.exp(total - total.max(axis=1, keepdims=True))
        score = share[np.arange(len(texts)), best] / share.sum(axis=1)
        blank = np.array([t is None or not LETTER.search(t) for t in texts])
        return ["und" if b else self.langs[k] for b, k in zip(blank, best, strict=True)], np.where(blank, 0.0, score)


def fit(docs: DataFrame, rows_per_language: int = FIT_ROWS, bytes_per_language: int = FIT_BYTES) -> Backoff:
    """The model from labelled rows (doc_id, text, lang); without any, every text is `und`.

    The two parameters bound the labelled sample, and with it the model. Repeated rows count as often as they stand
    there; a row without a doc_id has a place in the hash order like any other.
    """
    rows = docs.filter("lang is not null and text is not null")
    per = park(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("count"), F.sum(F.octet_length("text")).alias("bytes")))
    rate = F.least(F.lit(1.0), rows_per_language / F.col("count"), bytes_per_language / F.greatest("bytes", F.lit(1)))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < F.col("rate") * (1 << 20)
    sample = rows.join(per.select("lang", rate.alias("rate")), "lang").filter(chosen)
    counts = sample.select("lang", "text").mapInArrow(counted, "lang string, kind int, gram long, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    found = park(counts).toArrow()  # as many rows as the bounded sample has words and n-grams at most
    langs = sorted(set(found.column("lang").unique().to_pylist()) | {r[0] for r in per.select("lang").collect()})
    of = np.searchsorted(np.array(langs, object), np.array(found.column("lang").to_pylist(), object)) if langs else np.zeros(0, np.int64)
    kinds, grams, n = (found.column(c).to_numpy() for c in ("kind", "gram", "n"))
    tables = {}
    for kind in (0, *ORDERS):
        some = np.flatnonzero(kinds == kind)
        some = some[np.lexsort((of[some], grams[some].astype(np.int64).view(np.uint64)))]
        keys, first = np.unique(grams[some].astype(np.int64).view(np.uint64), return_index=True)
        total = np.log(np.bincount(of[some], n[some], minlength=len(langs)) + SMOOTH * max(len(keys), 1))
        never = np.log(SMOOTH) - total
        more = (np.log(n[some] + SMOOTH) - np.log(SMOOTH)).astype(np.float32)
        tables[kind] = (keys, np.append(first, len(some)), of[some].astype(np.int32), more, never)
    return Backoff(langs, tables)


def predictor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backoff = pickle.loads(model.value)
        for whole in batches:
            for batch in pieces(whole):
                lang, score = backoff.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out")), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Backoff | None = None, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row.

    Without a model, one is fitted on the rows whose crc32 of doc_id (as text; a null id counts as empty) leaves a
    remainder other than 0. A null text or one without letters is `und` with score 0. Repeated rows get equal results;
    other columns than doc_id, text and lang are ignored.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0).alias("held_out")
    docs = docs.select("doc_id", "text", "lang" if model is None else F.lit(None).cast("string").alias("lang"), held)
    if model is None:
        model = fit(docs.filter("not held_out"))
    if not model.langs:
        none = np.zeros(0, np.int64)
        model = Backoff(["und"], {k: (none.astype(np.uint64), np.zeros(1, np.int64), none, none.astype(float), np.zeros(1)) for k in (0, *ORDERS)})
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    return docs.select("doc_id", "held_out", "text").mapInArrow(predictor(sent), "doc_id long, held_out boolean, lang_pred string, score double")

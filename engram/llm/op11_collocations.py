"""Phrase collocation mining: candidates from a sketch's upper bounds, counted by pyahocorasick automata.

1. Sketch. Every task hashes the word runs of its texts (1 to `longest` words, within a piece, for each language) into
   the cells of one table and sends its own counts, in blocks of cells. Sums are upper bounds of every run's count, so
   a bit a cell, set where the sum reaches `least`, tells which runs can be frequent. The bits are broadcast: their
   number follows the input's bytes up to `most_bits`, beyond which there are more candidates, not other results.
2. Scan. A shard is some megabytes of one language's texts. Those of its own distinct runs whose bits, and whose parts'
   bits, are set become patterns with a blank at both ends, in one automaton. The shard's text, written with one blank
   between words and a line end between pieces, is scanned once, and overlapping matches are counted: neighbours share
   their blank. So an automaton never holds more than a shard does, whatever the corpus.
3. Sum. The shards' counts are added up by phrase and the thresholds applied, which drops what only looked frequent.

What follows (cuts, contained candidates, the first `top` of each language) are joins and windows over counted phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.bytehash import Words, classes, mix, pieces
from engram.llm.shared import hot_join, park

LONGEST, LEAST, SHARE, TOP = 3, 10, 50, 2000
#: The sketch has a cell for every so many bytes of text, 2 ** MOST_BITS at most (a bit each is broadcast: 32 MB).
BYTES_A_CELL, MOST_BITS = 4, 28
#: Cells of a block, bytes of a shard, and entries that a task holds before it sends them.
BLOCK, SHARD, HELD = 1 << 16, 2 << 20, 1 << 21
SALTS = 64
BREAKS = [(0x2E, 0x2E), (0x2C, 0x2C), (0x3B, 0x3B), (0x3A, 0x3A), (0x21, 0x21), (0x3F, 0x3F), (0x0A, 0x0D)]
#: Words of `[^\x20\x09]+` in the pieces between `[.,;:!?\x0A-\x0D]`.
KIND = classes([(0x20, 0x20), (0x09, 0x09), *BREAKS])
_break = np.zeros(256, bool)
for _a, _b in BREAKS:
    _break[_a : _b + 1] = True
U = np.uint64
ROW = "lang string, phrase string, n long"


class Runs:
    """The word runs of a batch of texts: `keys[k - 1]` are the 64-bit hashes of the runs of k words, one for each first
    word; `whole[k - 1]` tells where such a run lies within one piece."""

    def __init__(self, texts: pa.Array, salt: np.ndarray, longest: int):
        self.words = w = Words(texts, KIND)
        m = len(w.hash)
        breaks = np.concatenate([[0], np.cumsum(_break[w.data])])[w.start] if m else np.zeros(0, np.int64)
        self.opens = np.ones(m, bool)  # whether a word is the first of its piece
        self.opens[1:] = (w.doc[1:] != w.doc[:-1]) | (breaks[1:] != breaks[:-1])
        with np.errstate(over="ignore"):
            key, whole = mix(w.hash ^ salt[w.doc]), np.ones(m, bool)
            self.keys, self.whole = [key], [whole]
            for k in range(1, min(longest, max(m, 1))):
                key, whole = key.copy(), whole.copy()
                key[: m - k] = mix(key[: m - k] * U(0x9E3779B97F4A7C15) + w.hash[k:])
                whole[: m - k] &= ~self.opens[k:]
                whole[m - k :] = False
                self.keys.append(key)
                self.whole.append(whole)


def salts(langs: list[str]) -> np.ndarray:
    """A hash for each language, the same in every task. Languages that share one only loosen the sketch."""
    return Words(pa.array([x or "\t" for x in langs], pa.large_string()), classes([])).hash


def language_salts(langs: list[str]) -> np.ndarray:
    names, of = np.unique(np.array(langs, object).astype(str), return_inverse=True)
    return salts(names.tolist())[of]


def sketcher(bits: int, longest: int):
    """(block, low, n): for the cells that this part's runs fall into, the lower 16 bits of the cell and a count up to 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> pa.RecordBatch:
            cell, back = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            n = np.minimum(np.bincount(back, np.concatenate([n for _, n in held]), minlength=len(cell)), 255).astype(np.uint8)
            block, first = np.unique(cell >> 16, return_index=True)
            ends = np.append(first, len(cell))
            low = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(block), [None, pa.py_buffer((ends * 2).astype(np.int64)), pa.py_buffer((cell & 0xFFFF).astype("<u2"))])
            count = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(block), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(n)])
            return pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), low.cast(pa.binary()), count.cast(pa.binary())], names=["block", "low", "n"])

        for whole in batches:
            for batch in pieces(whole):
                runs = Runs(batch.column("text"), language_salts(batch.column("lang").to_pylist()), longest)
                cells = np.concatenate([(k[w] >> U(64 - bits)).astype(np.int64) for k, w in zip(runs.keys, runs.whole, strict=True)])
                held.append(np.unique(cells, return_counts=True))
                if sum(len(c) for c, _ in held) > HELD:
                    yield merged()
                    held.clear()
        if held:
            yield merged()

    return run


def frequent(least: int):
    """(block, bits): a bit for each cell of a block, set where the counts sum up to `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, low, n in zip(batch.column("block").to_pylist(), batch.column("low").to_pylist(), batch.column("n").to_pylist(), strict=True):
                total = sums.setdefault(block, np.zeros(BLOCK, np.uint16))
                at = np.frombuffer(low, "<u2")
                total[at] = np.minimum(total[at] + np.frombuffer(n, np.uint8), 1 << 15)
        for block, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    return run


def sketch(docs: DataFrame, longest: int, least: int, most_bits: int) -> tuple[np.ndarray, int]:
    """The packed bits of the cells that reach `least`, and the number of bits of a cell's number."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(max(int(size // BYTES_A_CELL).bit_length(), 16), most_bits)
    # Counts of up to 255 a task are enough: `least` is below, and a sum that reaches it does so with any larger ones.
    cells = docs.mapInArrow(sketcher(bits, longest), "block int, low binary, n binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cells.repartition(parts, "block").mapInArrow(frequent(least), "block int, bits binary").toArrow()
    out = np.zeros(max(1 << bits, BLOCK) // 8, np.uint8)
    for block, some in zip(found.column("block").to_pylist(), found.column("bits").to_pylist(), strict=True):
        out[block * (BLOCK // 8) : (block + 1) * (BLOCK // 8)] = np.frombuffer(some, np.uint8)
    return out, bits


def written(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """The words again, one blank before and after each and a line end between pieces, and where each word begins."""
    w = runs.words
    size = w.end - w.start
    begin = np.cumsum(size + 1 + 2 * runs.opens) - size - 1
    out = np.full(int(begin[-1] + size[-1] + 1) if len(size) else 0, 0x20, np.uint8)
    opens = begin[runs.opens] - 2
    out[opens[opens >= 0]] = 0x0A
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[inside + np.repeat(begin, size)] = w.data[inside + np.repeat(w.start, size)]
    return out, begin


def counted(texts: list[bytes], lang: str, bitmap: np.ndarray, bits: int, longest: int) -> tuple[list[str], np.ndarray, int]:
    """(phrases, counts, words) of a shard: its candidates, by one scan of its text with their automaton."""
    runs = Runs(pa.array(texts, pa.large_binary()), np.repeat(salts([lang]), len(texts)), longest)
    m = len(runs.words.hash)
    if not m:
        return [], np.zeros(0, np.int64), 0
    text, begin = written(runs)
    end = begin + (runs.words.end - runs.words.start)
    raw, spans, may = text.tobytes(), [], None
    for k, (key, whole) in enumerate(zip(runs.keys, runs.whole, strict=True)):
        cell = (key >> U(64 - bits)).astype(np.int64)
        bound = (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
        if k == 0:
            may = bound
        else:  # a run's own bound, and those of its first and last k words
            shorter, may = may, np.zeros(m, bool)
            may[: m - 1] = shorter[: m - 1] & shorter[1:]
            may &= bound & whole
        at = np.flatnonzero(may)
        _, once = np.unique(key[at], return_index=True)
        spans.append((begin[at[once]], end[at[once] + k]))
    first, last = (np.concatenate([s[i] for s in spans]) for i in range(2))
    if not len(first):
        return [], np.zeros(0, np.int64), m
    phrases = [raw[a:b].decode() for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, phrase in enumerate(phrases):
        automaton.add_word(f" {phrase} ", i)
    automaton.make_automaton()
    hits = np.fromiter((i for _, i in automaton.iter(raw.decode())), np.int64)
    return phrases, np.bincount(hits, minlength=len(phrases)), m


def scanner(sent, bits: int, longest: int, shard: int = SHARD):
    """(lang, phrase, n) of this part's shards, merged before they are sent; the empty phrase counts a language's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sent.value, np.uint8)
        waiting: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        held: list[pa.Table] = []

        def scan(lang: str) -> None:
            phrases, n, words = counted(waiting.pop(lang), lang, bitmap, bits, longest)
            size.pop(lang)
            held.append(pa.table([pa.array([lang] * (len(phrases) + 1), pa.string()), pa.array(["", *phrases], pa.string()), np.append(words, n).astype(np.int64)], names=["lang", "phrase", "n"]))

        def merged() -> pa.Table:
            table = pa.concat_tables(held).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
            held.clear()
            return table.select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"])

        for whole in batches:
            for batch in pieces(whole):
                for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    for part in parts_of((text or "").encode(), shard):
                        waiting.setdefault(lang, []).append(part)
                        size[lang] = size.get(lang, 0) + len(part) + 1
                        if size[lang] > shard:
                            scan(lang)
                while sum(size.values()) > 2 * shard:  # many languages: the largest goes first
                    scan(max(size, key=size.get))
                if sum(t.num_rows for t in held) > HELD // 2 and len(held) > 1:
                    table = merged()
                    if table.num_rows > HELD // 2:
                        yield from table.to_batches()
                    else:
                        held.append(table)
        for lang in list(waiting):
            scan(lang)
        if held:
            yield from merged().to_batches()

    return run


def parts_of(text: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about `size` bytes, cut where pieces end; pieces longer than that stay whole."""
    data, at = np.frombuffer(text, np.uint8), 0
    while len(text) - at > size:
        reach = size
        while not len(ends := np.flatnonzero(_break[data[at : at + reach]])) and at + reach < len(text):
            reach *= 2
        if not len(ends):
            break
        cut = at + int(ends[-1] if reach == size else ends[0]) + 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, most_bits: int = MOST_BITS, shard: int = SHARD) -> DataFrame:
    """(lang, phrase, n) of the word runs that occur at least `least` times, space-joined; phrase '' has all words.

    Exact: the sketch only leaves out runs that can't be frequent, and runs are told apart in a shard by 64-bit hashes.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    bitmap, bits = sketch(docs, longest, min(least, 255), most_bits)
    sent = docs.sparkSession.sparkContext.broadcast(bitmap.tobytes())
    sums = docs.mapInArrow(scanner(sent, bits, longest, shard), ROW).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return park(sums.filter((F.col("n") >= least) | (F.col("phrase") == "")))


def key(phrase: Column) -> Column:
    """One string for a language and a phrase; no phrase holds a tab."""
    return F.concat("lang", F.lit("\t"), phrase)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP, most_bits: int = MOST_BITS, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to `longest` words.

    A null text has no words, a null lang is `und`; repeated rows count as often as they stand there, whatever their
    doc_id. An empty table, or one without a frequent phrase, gives an empty result. Other columns are ignored.
    """
    counts = phrase_counts(docs, longest, least, most_bits, shard)
    words = F.split("phrase", " ")
    found = counts.filter("phrase <> ''").withColumn("size", F.size(words))
    candidates = found.filter("size > 1").withColumnRenamed("n", "a")
    inner = lambda first, n: F.array_join(F.slice(words, first, n), " ")
    runs_of = lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: inner(i, n))
    if longest > 2:
        # A candidate's shorter runs of two words and more, with the largest count of a candidate around them.
        longer = candidates.filter("size > 2")
        runs = F.flatten(F.array(*(F.when(F.col("size") > n, runs_of(n)).otherwise(F.array().cast("array<string>")) for n in range(2, longest))))
        around = longer.select("lang", F.explode(runs).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        candidates = candidates.join(around, ["lang", "phrase"], "left").filter(f"longer is null or 100 * longer < {share} * a").drop("longer")
    ks = F.sequence(F.lit(1), F.col("size") - 1)
    cuts = candidates.select("lang", "phrase", "a", F.explode(F.transform(ks, lambda k: F.struct(k.alias("k"), inner(F.lit(1), k).alias("left"), inner(k + 1, F.col("size") - k).alias("right")))).alias("cut"))
    cuts = park(cuts.select("lang", "phrase", "a", "cut.k", key(F.col("cut.left")).alias("left"), key(F.col("cut.right")).alias("right")))
    left = found.select(key(F.col("phrase")).alias("left"), F.col("n").alias("l"))
    right = found.select(key(F.col("phrase")).alias("right"), F.col("n").alias("r"))
    both = hot_join(park(hot_join(cuts, left, "left").drop("left")), right, "right").drop("right")
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    scored = both.withColumn("above", F.lit(1_000_000).cast("decimal(7,0)") * exact("a") * exact("a")).withColumn("below", exact("l") * exact("r"))
    scored = scored.withColumn("score", F.expr("above div below"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    ranked = lowest.select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # The first rows of a language are among the first of its parts.
    parts = ranked.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = parts.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(f"nth <= {top}")
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(f"rank <= {top}")
    totals = counts.filter("phrase = ''").select("lang", "n")
    out = first.join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

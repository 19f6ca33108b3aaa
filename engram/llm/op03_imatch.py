"""Document fingerprints by I-Match over several randomised lexicons.

The lexicon is the terms within a band of inverse document frequency, counted over all distinct texts, so that copies
don't push a text's own words out of the band. A fingerprint hashes
the sorted distinct lexicon terms of a text that fall in each of `SUBSETS` random subsets of the lexicon. So that a
subset holds about one term of a text of any length, subsets exist at rates 1, 1/2, 1/4, ...: a text with m lexicon terms
keeps the codes of the rates about 1/m, and two fingerprints are compared at a rate that both hold, over the subsets in
which either has a term. Equal texts have equal fingerprints.

A text with less than `THIN` of its terms in the lexicon (near copies in a group so large that its words are above the
band, texts of rare words) is known by all its terms, and compared by all terms of both sides. A text without words is
known by a hash of itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.bytehash import NON_LETTERS, Words, mix, pieces
from engram.llm.shared import park

SUBSETS, LEVELS = 48, 3
#: The band: terms in at most this share of the distinct texts, and in at least this share (and two texts).
MOST, LEAST = 0.05, 0.0002
THIN = 0.25
#: So many texts with copies are broadcast by their hashes at most, else shuffled.
COPIES = 1_000_000
U = np.uint64
ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n): the sum of the weights of this part's texts that hold a term, merged before it is sent."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> pa.RecordBatch:
        term, back = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
        n = np.bincount(back, np.concatenate([c for _, c in held]), minlength=len(term)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], names=["term", "n"])

    for whole in batches:
        for batch in pieces(whole):
            doc, term = distinct_terms(Words(batch.column("text"), NON_LETTERS))
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            once, back = np.unique(term, return_inverse=True)
            held.append((once, np.bincount(back, weight[doc], minlength=len(once))))
            if sum(len(t) for t, _ in held) > 1 << 21:
                yield merged()
                held.clear()
    if held:
        yield merged()


def distinct_terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((words.hash, words.doc))
    doc, term = words.doc[order], words.hash[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    return doc[new], term[new]


class Prints:
    """Fingerprints of a list of texts by the terms in a lexicon, or by all terms where it is None.

    `level` (-1: no such term), `codes` (text, rate, subset), `own` (hash of a text of no level), `thin` (too few of its
    terms are in the lexicon) and `whole` (by all terms).
    """

    def __init__(self, texts: list[str], lexicon: np.ndarray | None):
        doc, term = distinct_terms(Words(pa.array(texts, pa.large_string()), NON_LETTERS))
        total = np.bincount(doc, minlength=len(texts))
        if lexicon is None:
            pass
        elif len(lexicon):
            at = np.minimum(np.searchsorted(lexicon, term), len(lexicon) - 1)
            known = lexicon[at] == term
            doc, term = doc[known], term[known]
        else:
            doc, term = doc[:0], term[:0]
        m = np.bincount(doc, minlength=len(texts))
        self.thin = m < THIN * total
        self.whole = np.full(len(texts), lexicon is None)
        self.level = np.where(m > 0, np.ceil(np.log2(np.maximum(m, 1))).astype(np.int64), -1)
        self.codes = np.zeros((len(texts), LEVELS, SUBSETS), np.uint16)
        with np.errstate(over="ignore"):
            here = np.flatnonzero(m)
            if len(here):
                begin = np.concatenate([[0], np.cumsum(m)])[here]
                rates = np.maximum(self.level[doc] + np.arange(-1, LEVELS - 1)[:, None], 0).astype(U)
                below = (U(1) << rates) - U(1)
                for s in range(SUBSETS):
                    x = mix(term + U(0x9E3779B97F4A7C15) * U(s + 1))
                    y = mix(x)
                    for r in range(LEVELS):
                        inside = (x & below[r]) == 0
                        h = mix(np.add.reduceat(np.where(inside, y, U(0)), begin))
                        some = np.logical_or.reduceat(inside, begin)
                        self.codes[here, r, s] = np.where(some, (h >> U(48)) | U(1), U(0))
        self.own = [hashlib.sha256(t.encode()).hexdigest()[:32] if x < 0 else "" for t, x in zip(texts, self.level, strict=True)]

    def strings(self) -> list[str]:
        parts = zip(self.level, self.codes, self.own, self.whole, strict=True)
        return [f"t:{o}" if x < 0 else f"{'w' if w else ''}{x:x}:{c.astype('>u2').tobytes().hex()}" for x, c, o, w in parts]

    def part(self, at) -> Prints:
        out = object.__new__(Prints)
        out.level, out.codes, out.own = self.level[at], self.codes[at], np.array(self.own, object)[at].tolist()
        out.thin, out.whole = self.thin[at], self.whole[at]
        return out

    def replaced(self, at: np.ndarray, new: Prints) -> Prints:
        """These, with those at some places replaced."""
        out = object.__new__(Prints)
        for name in ("level", "codes", "own", "thin", "whole"):
            column = np.array(getattr(self, name), object if name == "own" else None)
            column[at] = getattr(new, name)
            setattr(out, name, column.tolist() if name == "own" else column)
        return out


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """The share of subsets with a term of either in which both have the same terms, at a rate that both hold."""
    high, low = np.maximum(a.level, b.level), np.minimum(a.level, b.level)
    rate = np.minimum(high, low + 1)
    held = (low >= 0) & (high - low <= 2)
    row = np.arange(len(a.level))
    out = np.zeros(len(row))
    for back in (0, 1):  # where no subset has a term, the rate before is asked
        x = a.codes[row, np.clip(rate - back - a.level + 1, 0, LEVELS - 1)]
        y = b.codes[row, np.clip(rate - back - b.level + 1, 0, LEVELS - 1)]
        some = ((x > 0) | (y > 0)).sum(axis=1)
        out = np.where(held & (out == 0) & (some > 0), ((x == y) & (x > 0)).sum(axis=1) / np.maximum(some, 1), out)
    same = np.array([l < 0 and k < 0 and o == p for l, k, o, p in zip(a.level, b.level, a.own, b.own, strict=True)])
    identical = (a.level == b.level) & (a.level >= 0) & (a.codes == b.codes).all(axis=(1, 2))
    return np.where(same | identical, 1.0, out)


def compared(ids: list[int | None], texts: list[str], following: list[str], lexicon: np.ndarray) -> pa.RecordBatch:
    """The result rows of texts and of the texts that follow them."""
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
    n = len(texts)
    every = [*texts, *edited, *following]
    prints = Prints(every, lexicon)
    thin = prints.thin.reshape(3, n)
    near = []
    at = np.flatnonzero(np.concatenate([thin.any(axis=0), thin[0] | thin[1], thin[0] | thin[2]]))
    wide = prints.replaced(at, Prints([every[i] for i in at], None))
    for k in (1, 2):
        one, two = ((p.part(slice(0, n)), p.part(slice(k * n, (k + 1) * n))) for p in (prints, wide))
        near.append(np.where(thin[0] | thin[k], likeness(*two), likeness(*one)))
    own = np.flatnonzero(prints.thin)
    shown = prints.replaced(own, wide.part(own)).strings()
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(shown[:n], pa.string()),
            pa.array(shown[n : 2 * n], pa.string()),
            *map(pa.array, near),
        ],
        names=[f.split()[0] for f in ROW.split(", ")],
    )


def chained(lexicon):
    """From texts in order: the rows of all but a part's last text; that one, and the first, are sent on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(lexicon.value, U)
        part = TaskContext.get().partitionId()
        names = [*(f.split()[0] for f in ROW.split(", ")), "part", "edge", "text"]

        def edge(kind: str, i: int | None, text: str) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]
            values = [i, None, None, None, None, None, None, part, kind, text]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        last: tuple[int | None, str] | None = None
        for whole in batches:
            for batch in pieces(whole):
                ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
                if last is None:
                    yield edge("first", ids[0], texts[0])
                else:
                    ids, texts = [last[0], *ids], [last[1], *texts]
                last = (ids[-1], texts[-1])
                if len(texts) > 1:
                    rows = compared(ids[:-1], texts[:-1], texts[1:], words)
                    n = rows.num_rows
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=names)
        if last is not None:
            yield edge("last", *last)

    return run


def joints(lexicon):
    """The rows of the parts' last texts, from each and the text that follows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(lexicon.value, U)
        for batch in batches:
            if batch.num_rows:
                yield compared(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("following").to_pylist(), words)

    return run


def lexicon_of(docs: DataFrame) -> np.ndarray:
    """The sorted hashes of the terms in the band: 1 / LEAST times the mean number of a text's terms at most.

    Every row counts, and of each text with k rows one row more with the weight 1 - k: only those are shuffled, not all
    texts.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    groups = park(docs.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("doc_id").alias("low")))
    n = groups.agg(F.count(F.lit(1)), F.count_if(F.col("k") > 1)).first()
    copies = groups.filter("k > 1").withColumnRenamed("h", "of")
    if n[1] <= COPIES:
        copies = F.broadcast(copies)
    more = docs.join(copies, (F.col("h") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("low"))).groupBy("h").agg(F.first("text").alias("text"), F.first("k").alias("k"))
    weighted = docs.select("text", F.lit(1).cast("long").alias("weight")).union(more.select("text", 1 - F.col("k")))
    counted = weighted.mapInArrow(term_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = park(counted.filter(f"n >= 2 and n >= {LEAST * n[0]} and n <= {max(2.0, MOST * n[0])}"))
    terms = counts.select("term").toPandas()["term"].to_numpy(np.int64)
    return np.sort(terms.view(U))


def imatch(docs: DataFrame) -> DataFrame:
    """The fingerprint of every row's text and of its edited text, and their likenesses; see ROW.

    The next document is that of the next smaller doc_id (nulls last, ties by the xxhash64 of the text); after the last
    comes the first. A null text is empty. Other columns are ignored. A single row follows itself; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    lexicon = spark.sparkContext.broadcast(lexicon_of(docs).tobytes())
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = park(
        # Dealt by doc_id and hash, so rows without a doc_id spread as well; the driver's sample of keys holds no texts.
        docs.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(chained(lexicon), f"{ROW}, part int, edge string, text string")
    )
    ends = rows.filter("edge is not null")
    # One first and one last text for each part: which part follows which is a list of small numbers.
    used = sorted(r[0] for r in ends.filter("edge = 'first'").select("part").collect())
    after = spark.createDataFrame([(p, used[(k + 1) % len(used)]) for k, p in enumerate(used)], "part int, onward int")
    lasts = ends.filter("edge = 'last'").select("part", "doc_id", "text").join(after, "part")
    firsts = ends.filter("edge = 'first'").select(F.col("part").alias("onward"), F.col("text").alias("following"))
    joined = lasts.join(firsts, "onward").select("doc_id", "text", "following").mapInArrow(joints(lexicon), ROW)
    return rows.filter("edge is null").select(*(f.split()[0] for f in ROW.split(", "))).union(joined)

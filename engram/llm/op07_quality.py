"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Every token (a word, or a run of marks) has a sparse ternary index vector drawn from its hash. The vector of a token that
is at least `share` of all tokens is the sum of the index vectors around it in all documents, normalised; other tokens keep their index vector. A
document is described by the mean and the spread of its token vectors, by how alike neighbouring and next-but-one
vectors are, and by its length. Two layers give a logit, and a temperature fitted on a part of the sample that the
network hasn't seen makes its probabilities calibrated.

Token counts and contexts are summed over all texts, merged in each task before they are sent. Two parameters of `fit`
bound the model at any size of the corpus: `share`, as no more than 1 / share tokens can have it, whose vectors are
broadcast, and `rows`, the labelled rows that the network is fitted on, chosen by a hash of doc_id. Those rows are sent
as features, so their texts' length doesn't matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.bytehash import MARKS, Words, mix, pieces
from engram.llm.shared import park

FIT_ROWS, SIZE, NONZERO, WINDOW, SHARE = 6000, 32, 4, 2, 2e-5
FEATURES = 2 * SIZE + 6
HIDDEN, STEPS, RATE, DECAY = 24, 400, 0.01, 1e-4
THRESHOLD = 0.7
#: Bytes of text whose words have their vectors at a time: these take some 60 times as much.
PART = 1 << 18
U = np.uint64


def index_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """NONZERO places and signs for each hash."""
    with np.errstate(over="ignore"):
        x = mix(h[:, None] + np.arange(1, NONZERO + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return (x % U(SIZE)).astype(np.int64), np.where(x >> U(63), 1.0, -1.0)


def index_vectors(h: np.ndarray) -> np.ndarray:
    """The index vectors of hashes, as unit vectors."""
    place, sign = index_places(h)
    out = np.zeros((len(h), SIZE), np.float32)
    for k in range(NONZERO):
        out[np.arange(len(h)), place[:, k]] += sign[:, k].astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of this part's texts, merged before they are sent."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> pa.RecordBatch:
        token, back = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
        n = np.bincount(back, np.concatenate([c for _, c in held]), minlength=len(token)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    for whole in batches:
        for batch in pieces(whole):
            held.append(np.unique(Words(batch.column("text"), MARKS).hash, return_counts=True))
            if sum(len(t) for t, _ in held) > 1 << 21:
                yield merged()
                held.clear()
    if held:
        yield merged()


def context_sums(vocabulary):
    """(at, v0, v1, ...): for each token of the vocabulary in this part's texts, the sum of the index vectors around it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = np.frombuffer(vocabulary.value, U)
        total = np.zeros(len(keep) * SIZE)  # whole numbers
        for whole in batches:
            for batch in pieces(whole):
                words = Words(batch.column("text"), MARKS)
                once, back = np.unique(words.hash, return_inverse=True)
                at = np.minimum(np.searchsorted(keep, once), len(keep) - 1)
                row = np.where(keep[at] == once, at, -1)[back]
                place, sign = index_places(once)
                for shift in range(1, WINDOW + 1):
                    same = words.doc[shift:] == words.doc[:-shift]
                    for of, by in ((row[:-shift], back[shift:]), (row[shift:], back[:-shift])):
                        ok = same & (of >= 0)
                        of, by = of[ok], by[ok]
                        total += np.bincount((of[:, None] * SIZE + place[by]).ravel(), sign[by].ravel(), minlength=len(total))
        total = total.reshape(-1, SIZE).astype(np.int64)
        some = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, k]) for k in range(SIZE))], names=["at", *(f"v{k}" for k in range(SIZE))])

    return run


class Quality:
    """The fitted model; `score` gives the probability of label 1."""

    def __init__(self) -> None:
        self.vocabulary, self.vectors = np.zeros(0, U), np.zeros((0, SIZE), np.float32)

    def embed(self, h: np.ndarray) -> np.ndarray:
        """The vectors of tokens."""
        once, back = np.unique(h, return_inverse=True)
        out = index_vectors(once)
        if len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, once), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == once
            out[known] = self.vectors[at[known]]
        return out[back]

    def features(self, texts: list[str | None]) -> np.ndarray:
        words = Words(pa.array(texts, pa.large_string()), MARKS)
        v = self.embed(words.hash)
        n = words.counts
        here = np.flatnonzero(n)
        out = np.zeros((len(texts), FEATURES), np.float32)
        out[:, -1] = np.log1p(n)
        if not len(here):
            return out
        first, size = words.first[here], n[here][:, None].astype(np.float32)
        mean = np.add.reduceat(v, first, axis=0) / size
        spread = np.sqrt(np.maximum(np.add.reduceat(v * v, first, axis=0) / size - mean * mean, 0))
        out[here, :SIZE], out[here, SIZE : 2 * SIZE] = mean, spread
        out[here, -2] = np.linalg.norm(mean, axis=1)
        for k in (1, 2):
            near, again = np.zeros(len(v), np.float32), np.zeros(len(v), np.float32)
            same = words.doc[k:] == words.doc[:-k]
            near[k:] = np.where(same, (v[k:] * v[:-k]).sum(axis=1), 0)
            again[k:] = same & (words.hash[k:] == words.hash[:-k])
            out[here, -2 - k] = np.add.reduceat(near, first) / size[:, 0]
            out[here, -4 - k] = np.add.reduceat(again, first) / size[:, 0]
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def learn(self, x: np.ndarray, y: np.ndarray) -> None:
        """Fit the network to features and labels of 0 and 1."""
        rng = np.random.default_rng(7)
        aside = rng.random(len(y)) < 0.2
        if aside.all() or not aside.any():
            aside = np.arange(len(y)) % 5 == 4
        if len(np.unique(y[~aside])) < 2:
            aside[:] = False  # too few rows to keep any back
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.w1, self.b1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
        z, t = (x[~aside] - self.centre) / self.scale, y[~aside]
        names = ("w1", "b1", "w2", "b2")
        m, s = ({k: np.zeros_like(getattr(self, k)) for k in names} for _ in range(2))
        for step in range(1, STEPS + 1):
            hidden = np.tanh(z @ self.w1 + self.b1)
            off = (1 / (1 + np.exp(-np.clip(hidden @ self.w2 + self.b2, -30, 30))) - t) / max(len(t), 1)
            back = np.outer(off, self.w2) * (1 - hidden**2)
            slopes = {"w1": z.T @ back + DECAY * self.w1, "b1": back.sum(axis=0), "w2": hidden.T @ off + DECAY * self.w2, "b2": np.array([off.sum()])}
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * slopes[k]
                s[k] = 0.999 * s[k] + 0.001 * slopes[k] ** 2
                setattr(self, k, getattr(self, k) - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8))
        seen, truth = (self.logits(x[aside]), y[aside]) if aside.any() else (self.logits(x), y)
        heat = np.exp(np.linspace(-1.5, 2.5, 81))
        loss = [np.mean(np.logaddexp(0, np.where(truth > 0, -seen, seen) / h)) for h in heat]
        self.temperature = float(heat[int(np.argmin(loss))])

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.features(texts)) / self.temperature, -30, 30)))


def word_vectors(docs: DataFrame, share: float) -> Quality:
    """A model without a network: the vectors of the tokens that are `share` of all tokens of all texts, or more."""
    model, context = Quality(), docs.sparkSession.sparkContext
    texts = docs.select("text")
    counts = park(texts.mapInArrow(token_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    least = share * (counts.agg(F.sum("n")).first()[0] or 0)
    top = counts.filter(F.col("n") >= least).select("token").toArrow()  # 1 / share tokens at most
    keep = np.sort(top.column("token").to_numpy().astype(np.int64).view(U))
    total = np.zeros((len(keep), SIZE))
    if len(keep):
        columns = [f"v{k}" for k in range(SIZE)]
        sums = texts.mapInArrow(context_sums(context.broadcast(keep.tobytes())), ", ".join(f"{c} long" for c in ("at", *columns)))
        found = sums.groupBy("at").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()  # one row for each entry at most
        total[found.column("at").to_numpy()] = np.stack([found.column(c).to_numpy() for c in columns], axis=1)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    model.vocabulary, model.vectors = keep, np.where(norm > 0, total / np.where(norm > 0, norm, 1), index_vectors(keep)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, rows: int = FIT_ROWS, share: float = SHARE) -> Quality | None:
    """The model: word vectors from all texts, a network from labelled rows outside the held-out fold.

    None where the labelled rows are all of one kind; one row of either is enough. Repeated labels count as their largest;
    of rows that share a doc_id, the one whose text has the smallest hash counts.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter(F.col("quality").isNotNull() & (fold != held)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # `rows` ids at most, so this side is small by construction.
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows)
    model = word_vectors(docs, share)
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").join(F.broadcast(chosen), "doc_id")
    featured = sample.mapInArrow(featurer(sent), "doc_id long, h long, quality long, x array<float>")
    one_each = featured.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min_by("x", "h").alias("x"))
    made = one_each.repartition(1).mapInArrow(learned, "model binary").collect()
    if not made:
        return None
    net = pickle.loads(bytes(made[0][0]))
    net.vocabulary, net.vectors = model.vocabulary, model.vectors
    return net


def featurer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent.value)
        for whole in batches:
            for batch in pieces(whole, size=PART):
                x = model.features(batch.column("text").to_pylist())
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * FEATURES)
                columns = [batch.column("doc_id"), batch.column("h"), batch.column("quality").cast(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "quality", "x"])

    return run


def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row with the network, or none. The sample's features are bounded: one task learns from them, away from the driver."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    sample = pa.Table.from_batches(held).sort_by("doc_id")
    y = (sample.column("quality").to_numpy() > 0).astype(float)
    if len(np.unique(y)) < 2:
        return
    model = Quality()
    model.learn(sample.column("x").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(y), FEATURES), y)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def scorer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent.value)
        for whole in batches:
            for batch in pieces(whole, size=PART):
                score = model.score(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def quality_scores(docs: DataFrame, model: Quality | None, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row.

    A null text counts as empty, and empty texts have scores too. Without a model (see `fit`), every score is 1. Repeated rows get equal results; other columns are ignored.
    """
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == held
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text")
    if model is None:
        return docs.select("doc_id", "held_out", F.lit(1.0).alias("score"), F.lit(1).alias("predicted"))
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    return docs.mapInArrow(scorer(sent), "doc_id long, held_out boolean, score double, predicted int")


def keeper(sent, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent.value)
        for whole in batches:
            for batch in pieces(whole, size=PART):
                yield batch.filter(pa.array(model.score(batch.column("text").to_pylist()) >= threshold))

    return run


def of_quality(docs: DataFrame, model: Quality | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text reaches the threshold; all of them without a model."""
    if model is None:
        return docs
    return docs.mapInArrow(keeper(docs.sparkSession.sparkContext.broadcast(pickle.dumps(model)), threshold), docs.schema)

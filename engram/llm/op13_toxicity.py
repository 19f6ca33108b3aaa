"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy, over overlapping windows.

A text is cut into windows of `WINDOW` words, a new one every `STRIDE` words, to its end. Each word gives two inputs: a
vector of its own, where it was learnt, and the sum of the vectors of its character n-grams, which also speak for words
never seen. Two gated recurrent layers read a window in both directions, attention weighs the states, and one unit gives
the window's logit. A document is as toxic as its worst window.

Learning takes a bounded number of labelled rows (`rows`, half of them toxic where there are so many, by a hash of
doc_id). They say only which documents are toxic, not where: each is represented by its windows that look worst so far
and some others, and its loss is that of the worst. What looks worst is told by the log odds of words and n-grams in the
first round, which also start the vectors, and by the network of the round before in the others. Only those windows are
gathered, in one task; words that one labelled row alone holds have no vector of their own.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.bytehash import NON_LETTERS, Words, classes, mix, pieces
from engram.llm.shared import park

ROWS, ROUNDS, WORST, OTHERS = 4000, 2, 2, 2
WINDOW, STRIDE = 16, 12
#: Sizes of a word's own vector, of its characters' vector, of a state, of the attention; n-grams and their vectors.
OWN, SPELT, STATE, LOOK = 8, 8, 8, 8
GRAMS, BUCKET_BITS = (4, 6), 16
EPOCHS, BATCH, RATE, DECAY, BLIND = 8, 64, 0.01, 1e-4, 0.5
THRESHOLD = 0.5
#: Windows that are scored at a time.
BLOCK = 2048
U = np.uint64
PARAMETERS = ("own", "spelt", "wf", "uf", "bf", "wb", "ub", "bb", "look", "lean", "query", "out", "bias")


class Spelling:
    """The distinct words of some texts: `hash`, and their character n-grams as buckets, one word after another.

    `of` gives the distinct word of each word. Words are spelt with a mark on both sides.
    """

    def __init__(self, words: Words):
        self.hash, first, self.of = np.unique(words.hash, return_index=True, return_inverse=True)
        start, end = words.start[first], words.end[first]
        size = end - start
        ends = np.cumsum(size + 2)
        data = np.full(int(ends[-1]) if len(ends) else 0, 3, np.uint8)
        begin = ends - size - 2
        data[begin] = 2
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        data[inside + np.repeat(begin + 1, size)] = words.data[inside + np.repeat(start, size)]
        letter = np.flatnonzero((data & 0xC0) != 0x80)  # where characters begin
        bounds = np.append(letter, len(data))
        a = np.searchsorted(letter, begin)
        chars = np.diff(np.append(a, len(letter)))
        marked = Words(pa.LargeBinaryArray.from_buffers(pa.large_binary(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int64)), pa.py_buffer(data)]), classes([]), lower=False)
        word, gram = [], []
        for n in GRAMS:
            count = np.maximum(chars - n + 1, 1)  # a shorter word is one n-gram
            at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
            last = np.minimum(at + n, np.repeat(a + chars, count))
            word.append(np.repeat(np.arange(len(size)), count))
            gram.append((marked.spans(bounds[at], bounds[last]) >> U(64 - BUCKET_BITS)).astype(np.int64))
        word = np.concatenate(word)
        order = np.argsort(word, kind="stable")
        self.word, self.gram = word[order], np.concatenate(gram)[order]
        self.size = np.bincount(self.word, minlength=len(self.hash))
        self.first = np.cumsum(self.size) - self.size

    def pooled(self, table: np.ndarray) -> np.ndarray:
        """For each distinct word, the sum of its n-grams' rows over the root of their number."""
        if not len(self.hash):
            return np.zeros((0, table.shape[1]), table.dtype)
        return np.add.reduceat(table[self.gram], self.first, axis=0) / np.sqrt(self.size)[:, None].astype(table.dtype)


def windows_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, number of words) of every window; a document without words has none."""
    n = words.counts
    count = np.where(n > 0, np.maximum(-((WINDOW - n) // STRIDE), 0) + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = words.first[doc] + nth * STRIDE
    return doc, first, np.minimum(words.first[doc + 1] - first, WINDOW)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Toxicity:
    """The network; `logits` gives each text's worst window, `score` its probability."""

    def __init__(self, vocabulary: np.ndarray, own: np.ndarray, spelt: np.ndarray, seed: int = 13):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.vocabulary = vocabulary
        self.own, self.spelt = 0.1 * draw(len(vocabulary) or 1, OWN), 0.1 * draw(1 << BUCKET_BITS, SPELT)
        self.own[: len(vocabulary), 0], self.spelt[:, 0] = own, spelt
        self.wf, self.wb = draw(OWN + SPELT, 3 * STATE), draw(OWN + SPELT, 3 * STATE)
        self.uf, self.ub = draw(STATE, 3 * STATE), draw(STATE, 3 * STATE)
        self.bf, self.bb = np.zeros(3 * STATE, np.float32), np.zeros(3 * STATE, np.float32)
        self.look, self.lean, self.query = draw(2 * STATE, LOOK), np.zeros(LOOK, np.float32), draw(LOOK)
        self.out, self.bias = draw(2 * STATE), np.zeros(1, np.float32)

    def row(self, hashes: np.ndarray) -> np.ndarray:
        """The place of words in the vocabulary, -1 for others."""
        if not len(self.vocabulary):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def inputs(self, spelling: Spelling) -> np.ndarray:
        row = self.row(spelling.hash)
        return np.concatenate([np.where(row[:, None] >= 0, self.own[row], 0), spelling.pooled(self.spelt)], axis=1)

    def states(self, x: np.ndarray, u: np.ndarray, index: np.ndarray, inside: np.ndarray | None, steps: range, keep: list | None = None) -> np.ndarray:
        """The states (step, window, unit) of one direction; x holds the gates' inputs of the distinct words."""
        n, two = len(index), 2 * STATE
        half = np.full(3 * STATE, 0.5, x.dtype)  # a logistic unit is a tanh of half its input
        half[two:] = 1
        x, u = x * half, u * half
        h, out = np.zeros((n, STATE), x.dtype), np.zeros((WINDOW, n, STATE), x.dtype)
        given, rest = np.empty((n, 3 * STATE), x.dtype), np.empty((n, 3 * STATE), x.dtype)
        steps_of = np.ascontiguousarray(index.T)
        for t in steps:
            np.take(x, steps_of[t], axis=0, out=given, mode="clip")
            np.matmul(h, u, out=rest)
            zr = given[:, :two] + rest[:, :two]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :STATE], zr[:, STATE:]
            c = r * rest[:, two:]
            c += given[:, two:]
            np.tanh(c, out=c)
            if keep is not None:
                keep.append((t, h, z, r, c, rest[:, two:].copy()))
            new = h - c
            new *= z
            new += c
            h = out[t] = new if inside is None else np.where(inside[:, t, None], new, h)
        return out

    def pooled(self, f: np.ndarray, b: np.ndarray, inside: np.ndarray | None):
        both = np.concatenate([f, b], axis=2)
        look = np.tanh(both @ self.look + self.lean)
        e = look @ self.query
        if inside is not None:
            e = np.where(inside.T, e, -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        return both, look, a, np.einsum("tw,tws->ws", a, both)

    def window_logits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, size, logit) of every window."""
        doc, first, size = windows_of(words)
        logit = np.zeros(len(doc), np.float32)
        if len(doc):
            spelling = Spelling(words)
            x = self.inputs(spelling)
            xf, xb = x @ self.wf + self.bf, x @ self.wb + self.bb
            for some in np.split(order := np.argsort(size < WINDOW, kind="stable"), range(BLOCK, len(order), BLOCK)):
                place = first[some, None] + np.arange(WINDOW)
                inside = None if (size[some] == WINDOW).all() else np.arange(WINDOW) < size[some, None]
                index = spelling.of[np.minimum(place, len(spelling.of) - 1)]
                f = self.states(xf, self.uf, index, inside, range(WINDOW))
                b = self.states(xb, self.ub, index, inside, range(WINDOW - 1, -1, -1))
                logit[some] = self.pooled(f, b, inside)[3] @ self.out + self.bias
        return doc, first, size, logit

    def logits(self, texts: pa.Array) -> np.ndarray:
        """The highest logit of each text's windows; a text without words has the logit of an empty state."""
        words = Words(texts, NON_LETTERS)
        doc, _, _, logit = self.window_logits(words)
        out = np.full(words.n, float(self.bias[0]))
        here = np.flatnonzero(words.counts)
        if len(here):
            out[here] = np.maximum.reduceat(logit, np.searchsorted(doc, here))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -30, 30)))

    def gradient(self, spelling: Spelling, index: np.ndarray, size: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray, blind: np.ndarray) -> dict[str, np.ndarray]:
        """The slopes of the documents' weighted loss; the words `blind` are known by their characters alone.

        doc numbers the documents of the windows in order. A document's logit is its windows' highest; what follows
        from it is shared among them by a softmax.
        """
        row = np.where(blind, -1, self.row(spelling.hash))
        x = np.concatenate([np.where(row[:, None] >= 0, self.own[row], 0), spelling.pooled(self.spelt)], axis=1)
        inside = np.arange(WINDOW) < size[:, None]
        tape_f, tape_b = [], []
        f = self.states(x @ self.wf + self.bf, self.uf, index, inside, range(WINDOW), tape_f)
        b = self.states(x @ self.wb + self.bb, self.ub, index, inside, range(WINDOW - 1, -1, -1), tape_b)
        both, look, a, pooled = self.pooled(f, b, inside)
        logit = pooled @ self.out + self.bias[0]
        begin = np.searchsorted(doc, np.arange(len(y)))
        worst = np.maximum.reduceat(logit, begin)
        part = np.exp(4 * (logit - worst[doc]))
        part /= np.add.reduceat(part, begin)[doc]
        d = ((sigmoid(worst) - y) * weight)[doc] * part
        g = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        dp = d[:, None] * self.out
        da = (both * dp).sum(axis=2)
        de = a * (da - (a * da).sum(axis=0))
        dl = de[:, :, None] * self.query * (1 - look**2)
        g["query"], g["lean"] = np.einsum("twl,tw->l", look, de), dl.sum(axis=(0, 1))
        g["look"] = np.einsum("tws,twl->sl", both, dl)
        dboth = a[:, :, None] * dp + dl @ self.look.T
        dx = np.zeros_like(x)
        steps = index.T.ravel()
        order = np.argsort(steps, kind="stable")
        used, begins = np.unique(steps[order], return_index=True)
        for tape, w, u, name, own in ((tape_f, self.wf, self.uf, "f", dboth[:, :, :STATE]), (tape_b, self.wb, self.ub, "b", dboth[:, :, STATE:])):
            du, gates, dh = np.zeros_like(u), np.zeros((WINDOW, len(index), 3 * STATE), x.dtype), np.zeros((len(index), STATE), x.dtype)
            for t, h, z, r, c, rest in reversed(tape):
                dh = dh + own[t]
                here = np.where(inside[:, t, None], dh, 0)
                dc = here * (1 - z) * (1 - c**2)
                dr = dc * rest * r * (1 - r)
                gates[t] = np.concatenate([here * (h - c) * z * (1 - z), dr, dc], axis=1)
                moved = gates[t].copy()
                moved[:, 2 * STATE :] *= r
                du += h.T @ moved
                dh = np.where(inside[:, t, None], here * z + moved @ u.T, dh)
            dgiven = np.zeros((len(x), 3 * STATE), x.dtype)
            dgiven[used] = np.add.reduceat(gates.reshape(-1, 3 * STATE)[order], begins, axis=0)
            g["u" + name], g["w" + name], g["b" + name] = du, x.T @ dgiven, dgiven.sum(axis=0)
            dx += dgiven @ w.T
        known = row >= 0
        g["own"] = np.zeros_like(self.own)
        g["own"][row[known]] = dx[known, :OWN]
        share = (dx[:, OWN:] / np.sqrt(spelling.size)[:, None])[spelling.word]
        g["spelt"] = np.stack([np.bincount(spelling.gram, share[:, k], minlength=1 << BUCKET_BITS) for k in range(SPELT)], axis=1)
        return g

    def learn(self, windows: list[list[str]], y: np.ndarray) -> None:
        """Fit the network to documents, each a list of windows, and their labels of 0 and 1."""
        rng = np.random.default_rng(29)
        few = max(1.0, min(3.0, (y == 0).sum() / max((y == 1).sum(), 1)))
        weight = np.where(y > 0, few, 1.0)
        weight /= weight.mean()
        m, s = ({k: np.zeros(getattr(self, k).shape, np.float32) for k in PARAMETERS} for _ in range(2))
        batches = [order[i : i + BATCH] for order in (rng.permutation(len(y)) for _ in range(EPOCHS)) for i in range(0, len(y), BATCH)]
        for step, some in enumerate(batches, 1):
            some = np.sort(some)
            flat, doc = [w for i in some for w in windows[i]], np.repeat(np.arange(len(some)), [len(windows[i]) for i in some])
            words = Words(pa.array(flat, pa.large_string()), NON_LETTERS)
            spelling = Spelling(words)
            place = np.minimum(words.first[:-1, None] + np.arange(WINDOW), len(words.hash) - 1)
            slopes = self.gradient(spelling, spelling.of[place], words.counts, doc, y[some], weight[some] / len(some), rng.random(len(spelling.hash)) < BLIND)
            rate = RATE * min(1.0, 2 * (1 - step / (len(batches) + 1)))
            for k in PARAMETERS:
                slope = slopes[k] + DECAY * getattr(self, k)
                m[k] = 0.9 * m[k] + 0.1 * slope
                s[k] = 0.999 * s[k] + 0.001 * slope**2
                setattr(self, k, (getattr(self, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))


def odds_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, gram, toxic, clean): in how many toxic and clean rows of this part a word (kind 0) or n-gram (kind 1) is."""
    for whole in batches:
        for batch in pieces(whole):
            words = Words(batch.column("text"), NON_LETTERS)
            spelling = Spelling(words)
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
            pairs = np.unique(words.doc * max(len(spelling.hash), 1) + spelling.of)
            doc, word = pairs // max(len(spelling.hash), 1), pairs % max(len(spelling.hash), 1)
            size = spelling.size[word]
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(spelling.first[word], size)
            grams = np.unique((np.repeat(doc, size) << BUCKET_BITS) + spelling.gram[at])
            for kind, d, names, of in ((0, doc, spelling.hash, word), (1, grams >> BUCKET_BITS, np.arange(1 << BUCKET_BITS), grams & ((1 << BUCKET_BITS) - 1))):
                bad = np.bincount(of, toxic[d], minlength=len(names)).astype(np.int64)
                good = np.bincount(of, ~toxic[d], minlength=len(names)).astype(np.int64)
                some = np.flatnonzero(bad + good)
                columns = [pa.array(np.full(len(some), kind, np.int32)), pa.array(names[some].view(np.int64)), pa.array(bad[some]), pa.array(good[some])]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "gram", "toxic", "clean"])


def log_odds(toxic: np.ndarray, clean: np.ndarray, rows: tuple[int, int]) -> np.ndarray:
    """How much likelier toxic rows hold something, as a clipped logarithm, halved."""
    return np.clip(np.log((toxic + 0.5) / (rows[0] + 1)) - np.log((clean + 0.5) / (rows[1] + 1)), -4, 4).astype(np.float32) / 2


def picker(sent, model_round: int):
    """(doc_id, h, toxic, windows): of each row, the windows that look worst, and some others by a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent.value)
        for whole in batches:
            for batch in pieces(whole):
                words = Words(batch.column("text"), NON_LETTERS)
                doc, first, size, bad = model.window_logits(words)
                if not model_round and len(doc):  # the network hasn't learnt yet: by the words' log odds
                    odds = model.inputs(spelling := Spelling(words))[:, [0, OWN]].sum(axis=1)[spelling.of]
                    bad = np.where(np.arange(WINDOW) < size[:, None], odds[np.minimum(first[:, None] + np.arange(WINDOW), len(odds) - 1)], -1e9).max(axis=1)
                chance = mix(first.astype(U) * U(0x9E3779B97F4A7C15) + U(model_round))
                rank = lambda order: np.arange(len(doc))[np.argsort(order)] - np.searchsorted(doc, doc)
                some = np.flatnonzero((rank(np.lexsort((first, -bad, doc))) < WORST) | (rank(np.lexsort((first, chance, doc))) < OTHERS))
                raw = words.data.tobytes()
                texts = [raw[words.start[a] : words.end[a + n - 1]].decode() for a, n in zip(first[some], size[some], strict=True)]
                offsets = pa.array(np.searchsorted(doc[some], np.arange(words.n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("h"), batch.column("toxic").cast(pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(texts, pa.string()))],
                    names=["doc_id", "h", "toxic", "windows"],
                )

    return run


def learner(sent):
    """One row with the model learnt from the rows' windows, or none. The rows are bounded: one task learns from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by("doc_id")
        model = pickle.loads(sent.value)
        model.learn(rows.column("windows").to_pylist(), (rows.column("toxic").to_numpy() > 0).astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return run


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = ROWS, rounds: int = ROUNDS) -> Toxicity | None:
    """The model, from labelled rows outside the held-out fold; None where they are all of one kind.

    Repeated labels count as their largest, null ones not at all; of rows that share a doc_id, the one whose text has the
    smallest hash counts. Rows without words teach nothing.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & (fold != held)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # `rows` ids at most, so this side is small by construction.
    order = [F.xxhash64("doc_id", F.lit(13)), "doc_id"]
    chosen = [known.filter(f"toxic = {k}").orderBy(*order).limit(rows // 2) for k in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    sample = park(texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id"))
    size = sample.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not size[0] or not size[1]:
        return None
    odds = sample.select("text", "toxic").mapInArrow(odds_counts, "kind int, gram long, toxic long, clean long").groupBy("kind", "gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # Words of two labelled rows and more, and a row a bucket: bounded by the sample.
    found = odds.filter("kind = 1 or toxic + clean > 1").toPandas()
    word = found[found["kind"] == 0]
    hashes = word["gram"].to_numpy(np.int64).view(U)
    by = np.argsort(hashes)
    word, gram = word.iloc[by], found[found["kind"] == 1]
    spelt = np.zeros(1 << BUCKET_BITS, np.float32)
    spelt[gram["gram"].to_numpy(np.int64)] = log_odds(gram["toxic"].to_numpy(), gram["clean"].to_numpy(), size)
    model = Toxicity(hashes[by], log_odds(word["toxic"].to_numpy(), word["clean"].to_numpy(), size), spelt)
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(pickle.dumps(model))
        picked = sample.mapInArrow(picker(sent, k), "doc_id long, h long, toxic int, windows array<string>").filter(F.size("windows") > 0)
        one_each = picked.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min_by("windows", "h").alias("windows"))
        made = one_each.repartition(1).mapInArrow(learner(sent), "model binary").collect()
        if made:
            model = pickle.loads(bytes(made[0][0]))
    return model


def scorer(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(sent.value)
        for whole in batches:
            for batch in pieces(whole):
                score = model.score(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def toxicity_scores(docs: DataFrame, model: Toxicity | None, folds: int = 5, held: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, by all windows of its whole text.

    A null text counts as empty, and texts without words have a score too. Without a model (see `fit`) every score is 0:
    nothing speaks against a text. Repeated rows get equal results; a null doc_id counts as an empty one for the fold;
    other columns are ignored. An empty table gives an empty result.
    """
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == held
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), "text")
    if model is None:
        return docs.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    return docs.mapInArrow(scorer(sent), "doc_id long, held_out boolean, score double, predicted int")

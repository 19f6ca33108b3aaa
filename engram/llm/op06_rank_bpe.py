"""BPE encoding and decoding over contiguous rank arrays.

A word is an array of part ids and an array of the ranks of adjacent pairs. The smallest rank is merged (leftmost first),
its boundary deleted and the two neighbouring ranks refreshed, until no pair has a rank. Words of one length are worked
as the rows of one matrix: each step merges once in every row that still can. Words beyond `SHORT` bytes go through a
heap of pairs instead, which takes no time squared in the length. A task keeps the words it has met, up to `KEPT`, and
then starts anew; none are kept beyond it, as Spark's Python workers live on and later stages need their memory.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from engram.llm.bytehash import pieces

SHORT, KEPT = 96, 100_000
#: Bytes of text that are split and encoded at a time.
PART = 1 << 18
NEVER = np.int32(1 << 30)

# The tokenizers library splits words by Unicode 16 and lowers by Unicode 17. These are the ranges that the
# regex module counts as letters or numbers and the library doesn't yet, and the capitals that Python doesn't lower yet,
# as first, last and the way to the small letter.
LATER_LETTERS = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 "
    "1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
LATER_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
LOWER = {c: c + way for a, b, way in LATER_CAPITALS for c in range(a, b + 1)}


def char_set(ranges: str) -> str:
    """The inside of a character set."""
    return "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in ranges.split())


#: Texts with one of these are lowered and split by the library's own Unicode versions; all of them lie beyond U+0557.
RARE = re.compile(f"[{char_set(LATER_LETTERS)}{char_set(LATER_NUMBERS)}{''.join(map(chr, LOWER))}]")
BEYOND = re.compile("[\u0558-\U0010ffff]")


def rare(text: str) -> bool:
    """Whether a text holds a character of RARE; most are found not to by their encoding."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(BEYOND.search(text) and RARE.search(text))
    return False


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class RankBpe:
    """A word-level BPE vocabulary (JSON text) with its normaliser, word pattern and special tokens."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model = spec["model"]
        ids: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in [*ids.items(), *self.special.items()]}
        self.names = [self.names.get(i, "") for i in range(max(self.names) + 1)]
        self.end = model["end_of_word_suffix"] or ""
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        older = split["pattern"]["Regex"].replace(r"\p{L}", rf"[\p{{L}}--[{char_set(LATER_LETTERS)}]]").replace(r"\p{N}", rf"[\p{{N}}--[{char_set(LATER_NUMBERS)}]]")
        self.older_words = regex.compile(older, regex.V1)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], np.int64)
        self.last = np.array([ids[c + self.end] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(ids[a] << 20) | ids[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        self.known: dict[str, tuple[int, ...]] = {}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NEVER where no merge exists."""
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def short(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of words of one length."""
        n, rows = len(words[0]), np.arange(len(words))
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), n)
        parts = self.inner[raw]
        parts[:, -1] = self.last[raw[:, -1]]
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        out: list = [()] * len(words)
        while True:
            if parts.shape[1] > 1:
                best = ranks.argmin(axis=1)
                low = ranks[np.arange(len(best)), best]
                done = low == NEVER
            else:
                done = np.ones(len(parts), bool)
            for r, ids in zip(rows[done].tolist(), parts[done].tolist(), strict=True):
                out[r] = tuple(ids)
            if done.all():
                return out
            go = ~done
            rows, parts, ranks, best, low = rows[go], parts[go], ranks[go], best[go], low[go]
            m, width = np.arange(len(rows)), parts.shape[1] - 1
            column = np.arange(width)
            parts = np.take_along_axis(parts, column + (column > best[:, None]), axis=1)
            parts[m, best] = self.made[low]
            if width == 1:
                continue
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= best[:, None]), axis=1)
            left = np.flatnonzero(best > 0)
            ranks[left, best[left] - 1] = self.rank(parts[left, best[left] - 1], parts[left, best[left]])
            right = np.flatnonzero(best < width - 1)
            ranks[right, best[right]] = self.rank(parts[right, best[right]], parts[right, best[right] + 1])

    def long(self, word: bytes) -> tuple[int, ...]:
        raw = np.frombuffer(word, np.uint8)
        ids = self.inner[raw].tolist()
        ids[-1] = int(self.last[raw[-1]])
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        ranks = self.rank(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r != NEVER]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (s := int(self.rank(np.array([ids[x]]), np.array([ids[y]]))[0])) != NEVER:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return tuple(i for i in ids if i >= 0)

    def learn(self, words: set[str]) -> None:
        """Encode words that aren't known yet."""
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w.encode()), []).append(w)
        for n, some in by_size.items():
            if n > SHORT:
                self.known.update((w, self.long(w.encode())) for w in some)
            else:
                for at in range(0, len(some), 1 << 14):
                    part = some[at : at + (1 << 14)]
                    self.known.update(zip(part, self.short([w.encode() for w in part]), strict=True))

    def split(self, text: str) -> list[str | int]:
        """The words of a text in order; special tokens as ids."""
        if "<|" not in text:
            return self.words_of(text)
        out: list[str | int] = []
        for i, piece in enumerate(self.cut.split(text)):
            out += [self.special[piece]] if i % 2 else self.words_of(piece)
        return out

    def words_of(self, text: str) -> list[str]:
        if text.isascii():
            return self.words.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        odd = rare(text)
        # Letters are lowered one by one, so a final sigma is an ordinary one.
        text = text.replace("Σ", "σ").lower()
        return self.older_words.findall(text.translate(LOWER)) if odd else self.words.findall(text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(t) for t in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        out, later = [], []
        for i, words in enumerate(split):
            try:
                out.append(list(chain.from_iterable(map(self.known.__getitem__, words))))
            except KeyError:
                out.append([])
                later.append(i)
        met: set = set().union(*(split[i] for i in later))
        self.known.update((t, (t,)) for t in met if isinstance(t, int))
        self.learn({w for w in met if w not in self.known})
        for i in later:
            out[i] = list(chain.from_iterable(map(self.known.__getitem__, split[i])))
        return out

    def decode(self, ids: list[int]) -> str:
        """Token names, special ones included, with spaces between: the vocabulary file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))


_loaded: dict[str, RankBpe] = {}


def loaded(vocabulary: str) -> RankBpe:
    key = hashlib.sha256(vocabulary.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = RankBpe(vocabulary)
    return _loaded[key]


def encoder(vocabulary, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary.value)
        try:
            for whole in batches:
                for batch in pieces(whole, size=PART):
                    ids = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
                    decoded = [bpe.decode(i) for i in ids]
                    columns = [batch.column("doc_id"), pa.array([len(i) for i in ids], pa.int64())]
                    if digests:
                        columns += [
                            pa.array([hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest() for i in ids], pa.string()),
                            pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                        ]
                        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                    else:
                        columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                        names = ["doc_id", "n_tokens", "ids", "decoded"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            bpe.known.clear()
            pa.default_memory_pool().release_unused()

    return run


def bpe_encode(docs: DataFrame, vocabulary_path: str, digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), or with digests (doc_id, n_tokens, ids_sha256, decoded_sha256), for every row.

    Null and empty texts have no tokens. Every row is encoded by itself, so repeated rows and null ids need no care.
    Other columns are ignored. The vocabulary (a few MB at most) is read on the driver and broadcast.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return docs.select("doc_id", "text").selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(encoder(vocabulary, digests), f"doc_id long, n_tokens long, {rest}")

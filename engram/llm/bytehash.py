"""Vectorised hashing of the words of many texts at once, straight from Arrow's UTF-8 buffers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE, BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: Bytes of text that are handled at a time; a longer text is handled alone.
CHUNK = 1 << 20
#: Ranges of more bytes are hashed one by one, by BLAKE2.
LONG = 256

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def classes(between: list[tuple[int, int]], marks: list[tuple[int, int]] = ()) -> np.ndarray:
    """The class of each byte: 0 between words, 1 in a word, 2 in a run of marks."""
    out = np.ones(256, np.uint8)
    for ranges, c in ((marks, 2), (between, 0)):
        for a, b in ranges:
            out[a : b + 1] = c
    return out


_BLANKS, _OTHERS = [(0x20, 0x20), (0x09, 0x0D)], [(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)]
#: Words of `[^\x20\x09-\x0D]+`; of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`; the latter and the runs of marks between them.
SPACES, NON_LETTERS, MARKS = classes(_BLANKS), classes(_OTHERS), classes(_BLANKS, _OTHERS)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, base, dtype=U)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(have)
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    texts = texts.fill_null(b"" if pa.types.is_large_binary(texts.type) else "")
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of text each."""
    if not batch.num_rows:
        return
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


class Words:
    """The words of a batch of texts: `hash`, `doc` (index of the text), `start` and `end` (bytes in `data`)."""

    def __init__(self, texts: pa.Array, between: np.ndarray, lower: bool = True):
        raw, self.offsets = buffers(texts)
        self.n = len(self.offsets) - 1
        self.data = data = _lower[raw] if lower else raw
        kind = between[data]
        inside = kind > 0
        if len(data):
            first = np.zeros(len(data) + 1, bool)
            first[self.offsets[:-1]] = True
            first = first[:-1]
            start = inside.copy()
            start[1:] &= (kind[1:] != kind[:-1]) | first[1:]
            end = inside.copy()
            end[:-1] &= (kind[1:] != kind[:-1]) | first[1:]
            self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1
        self.hash = self.spans(self.start, self.end)
        self.counts = np.bincount(self.doc, minlength=self.n)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges, the same wherever the bytes stand.

        Blocks of eight bytes are mixed in one after another, so no regular pattern of bytes makes two ranges alike.
        """
        if not hasattr(self, "_blocks"):
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            self._blocks = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
        size = end - start
        with np.errstate(over="ignore"):
            h = mix(size.astype(U) * U(0xD6E8FEB86659FD93) + U(BASE))
            some, at, left = slice(None), start, size
            for _ in range(0, min(LONG, int(size.max(initial=0))), 8):
                mask = np.where(left >= 8, ~U(0), (U(1) << (np.clip(left, 0, 7) * 8).astype(U)) - U(1))
                h[some] = mix(h[some] ^ (self._blocks[at] & mask))
                more = left > 8
                some = np.flatnonzero(more) if isinstance(some, slice) else some[more]
                at, left = at[more] + 8, left[more] - 8
        for i in np.flatnonzero(size > LONG):
            h[i] = int.from_bytes(hashlib.blake2b(self.data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
        return h

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, doc) of every run of k words; a text with fewer words, but not none, gives its whole sequence."""
        w, m = self.hash, len(self.hash)
        with np.errstate(over="ignore"):
            h = np.zeros(m, U)
            for j in range(min(k, m)):
                h[: m - j] += w[j:] * U(pow(BASE, j + 1, 1 << 64))
            left = self.first[self.doc + 1] - np.arange(m)  # words from here to the end of the text
            keep = left >= k
            short = np.flatnonzero((self.counts > 0) & (self.counts < k))
            if len(short):
                at = self.first[short]
                keep[at] = True
                for i, n in zip(at, self.counts[short], strict=True):
                    h[i] = np.sum(w[i : i + n] * powers(BASE, n + 1)[1:]) + U(int(n))
            return mix(h[keep]), self.doc[keep]

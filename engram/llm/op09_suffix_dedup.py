"""Suffix-array deduplication: longest-previous-factor arrays remove the later copies of shared strings.

A byte goes when a string of `LEAST` bytes that covers it also starts in a document with a smaller doc_id.

One suffix array over the corpus would be one task's work, so suffixes are dealt out by content: a suffix belongs to the
smallest hash among the 24-byte grams of its first 50 bytes. Equal 50-byte strings therefore meet in one place, and
consecutive suffixes share it for a stretch (of `PIECE` suffixes at most), which is sent as one row. Only stretches whose
key stands twice are sent with their bytes.

Where they meet, equal stretches are one class, known by its first document; the suffixes of the classes are sorted
whole, their common prefixes counted, and for each suffix the previous and the next position with a smaller doc_id are
found. The longer of the two common prefixes is its longest previous factor; from 50 bytes on, it marks the suffix's
first 50 bytes. Every start of a factor of 50 is a suffix of some stretch, so a factor that runs on past its stretch is
marked by the next ones.

A key with over `MANY` stretches is not sorted in one task. Its stretches are first collapsed to classes, before any
shuffle; if over `MANY` classes are left, their suffixes are dealt out again by all of their first 50 bytes. Where equal
strings make up a large part of all rows, those after the first document go at once, without being dealt.

A text that is equal to one with a smaller doc_id goes as a whole, before any of this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.bytehash import BASE, BASE_INVERSE, buffers, mix, pieces, powers
from engram.llm.shared import HOT, discard, hot_join, park, scratch

LEAST, GRAM, PIECE = 50, 24, 32
#: Stretches of one key that are sorted together at most, and rows that are held at a time.
MANY, PART = 1 << 12, 1 << 14
#: One text in SAMPLE is read beforehand, to find common keys.
SAMPLE = 64
#: The 64-bit words of a stretch's longest suffix.
WORDS = (PIECE + LEAST + 6) // 8
U = np.uint64
STRETCH = "key long, doc_id long, h long, start int, bytes binary"
RANGE = "doc_id long, h long, start int, end int"


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, length, key): for every document, its runs of 50-byte windows with the same smallest gram hash, cut to PIECE."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < LEAST:
        return none, none, none, none.view(U)
    with np.errstate(over="ignore"):
        s = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * powers(BASE, n), out=s[1:])
        g = mix((s[GRAM:] - s[:-GRAM]) * powers(BASE_INVERSE, n + 1)[: n - GRAM + 1])
    del s
    # The smallest of LEAST - GRAM + 1 = 27 neighbours, by doubling.
    low, span = g, 1
    while 2 * span <= LEAST - GRAM + 1:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = LEAST - GRAM + 1 - span
    low = np.minimum(low[: len(low) - rest], low[rest:])  # low[i]: of the window that starts at i
    doc = np.searchsorted(offsets, np.arange(len(low)), "right") - 1
    inside = np.arange(len(low)) + LEAST <= offsets[doc + 1]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    cuts = -(-(b - a) // PIECE)
    nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    a, b = np.repeat(a, cuts) + nth * PIECE, np.repeat(b, cuts)
    return doc[a], a, np.minimum(b - a, PIECE), low[a]


def keys_of(common=None):
    """(key, doc_id, h, n): the distinct keys of each text, with the number of its stretches.

    Keys that are known to be common are dealt out by document as well, to 64 places: n is -1 to -64 for them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = np.frombuffer(common.value, U) if common is not None else np.zeros(0, U)
        for whole in batches:
            for batch in pieces(whole):
                doc, _, _, key = stretches(*buffers(batch.column("text")))
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                n = np.diff(np.append(np.flatnonzero(new), len(key))).astype(np.int32)
                doc, key = doc[new], key[new]
                if len(spread):
                    known = spread[np.minimum(np.searchsorted(spread, key), len(spread) - 1)] == key
                    n[known] = -1 - (batch.column("h").to_numpy()[doc[known]] % 64)
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("doc_id").take(at), batch.column("h").take(at), pa.array(n)], names=["key", "doc_id", "h", "n"])

    return run


def repeated(most: int):
    """(key, doc_id, h, hot) of rows sorted by key: those whose key stands in two rows. hot: it is common, or has over `most` stretches.

    A key's rows are held until it ends or is known to be hot, so at most `most` of them and a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hot = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*(held or []), batch]).combine_chunks()
            held, hot, out = judged(table, hot, False, most)
            yield from out
        if held:
            yield from judged(pa.Table.from_batches(held).combine_chunks(), hot, True, most)[2]

    return run


def judged(table: pa.Table, hot: int | None, ended: bool, most: int) -> tuple[list[pa.RecordBatch] | None, int | None, list[pa.RecordBatch]]:
    """(rows to hold, the last key if it is hot, rows decided)."""
    key, n = table.column("key").to_numpy(), table.column("n").to_numpy().astype(np.int64)
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(begin, len(key)))
    many = (np.add.reduceat(n, begin) > most) | (n[begin] < 0) | (key[begin] == hot if hot is not None else False)
    keep = (size > 1) | many
    hold = not ended and not many[-1]
    if hold:
        keep[-1] = False
    rows = pa.array(np.repeat(keep, size))
    out = table.select(["key", "doc_id", "h"]).append_column("hot", pa.array(np.repeat(many, size))).filter(rows)
    return table.slice(begin[-1]).to_batches() if hold else None, int(key[-1]) if many[-1] else None, out.to_batches()


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The byte ranges as a binary column."""
    ends = np.cumsum(size)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[index].tobytes())]).cast(pa.binary())


def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, h, start, bytes): the stretches of each text whose key is on its list."""
    for whole in batches:
        for batch in pieces(whole):
            data, offsets = buffers(batch.column("text"))
            doc, start, length, key = stretches(data, offsets)
            lists = batch.column("keys")
            wanted = lists.flatten().to_numpy().view(U)
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths()))
            # (doc, key) of a stretch is looked up among those wanted.
            order = np.lexsort((wanted, owner))
            wanted, owner = wanted[order], owner[order]
            keep = np.zeros(len(key), bool)
            cut = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            own = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            for d in range(batch.num_rows):
                w, k = wanted[cut[d] : cut[d + 1]], key[own[d] : own[d + 1]]
                if len(w) and len(k):
                    p = np.minimum(np.searchsorted(w, k), len(w) - 1)
                    keep[own[d] : own[d + 1]] = w[p] == k
            doc, start, length, key = doc[keep], start[keep], length[keep], key[keep]
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), batch.column("doc_id").take(at), batch.column("h").take(at), pa.array((start - offsets[doc]).astype(np.int32)), gathered(data, start, length + LEAST - 1)],
                names=["key", "doc_id", "h", "start", "bytes"],
            )


def dealt_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The suffixes of stretches one by one, cut to 50 bytes, which are their key."""
    for batch in batches:
        for at in range(0, batch.num_rows, MANY):
            part = batch.slice(at, MANY)
            data, o = buffers(part.column("bytes"))
            length = np.diff(o) - (LEAST - 1)
            row = np.repeat(np.arange(len(length)), length)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
            begin = o[row] + nth
            key = range_hashes(data, begin, begin + LEAST)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), part.column("doc_id").take(take), part.column("h").take(take), pa.array((part.column("start").to_numpy()[row] + nth).astype(np.int32)), gathered(data, begin, np.full(len(begin), LEAST))],
                names=["key", "doc_id", "h", "start", "bytes"],
            )


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        s = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * powers(BASE, len(data)), out=s[1:])
        return mix((s[end] - s[start]) * powers(BASE_INVERSE, len(data) + 1)[start] + (end - start).astype(U))


def suffix_order(data: np.ndarray, o: np.ndarray, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, at, order, common) of stretches: their suffixes of 50 bytes and more, sorted whole within each key, and each one's common prefix with the one before it."""
    length = np.diff(o) - (LEAST - 1)
    row = np.repeat(np.arange(len(length)), length)
    at = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    begin, rest = o[row] + at, o[row + 1] - o[row] - at
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.zeros(len(data) + 1, U)
    for j in range(8):
        word |= padded[j : len(data) + 1 + j].astype(U) << U(56 - 8 * j)
    words = np.empty((WORDS, len(row)), U)
    for j in range(WORDS):
        outside = U(8) * (8 - np.clip(rest - 8 * j, 1, 8)).astype(U)  # bits of this word that lie past the stretch
        words[j] = np.where(rest > 8 * j, word[np.minimum(begin + 8 * j, len(data))] >> outside << outside, U(0))
    order = np.lexsort((doc[row], rest, *words[::-1], key[row]))
    words, rest, key = words[:, order], rest[order], key[row][order]
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = words[:, 1:] ^ words[:, :-1]
        some = differ != 0
        first = np.where(some.any(axis=0), some.argmax(axis=0), WORDS)
        x = differ[np.minimum(first, WORDS - 1), np.arange(len(first))]
        bits = np.zeros(len(x), np.int64)  # leading zero bytes of the first word that differs
        for j in range(1, 8):
            bits += x < (U(1) << U(64 - 8 * j))
        both = np.where(first < WORDS, 8 * first + bits, 8 * WORDS)
        common[1:] = np.where(key[1:] == key[:-1], np.minimum(both, np.minimum(rest[1:], rest[:-1])), 0)
    return row, at, order, common


def smaller_before(value: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each position, the common prefix with the nearest position before it of a smaller value; 0 without one.

    Pointers jump over positions that are no smaller, so it takes about the logarithm of the longest distance.
    """
    p, m = np.arange(len(value)) - 1, common.copy()
    m[p < 0] = 0
    at = np.flatnonzero((m > 0) & (value[p] >= value))
    while len(at):
        q = p[at]
        p[at], m[at] = p[q], np.minimum(m[at], m[q])
        at = at[(m[at] > 0) & (value[p[at]] >= value[at])]
    return m


def previous_factors(value: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest previous factors of positions in suffix order: the longer of the common prefixes with the previous and the next smaller one."""
    after = np.append(common[1:], 0)[::-1] if len(common) else common
    return np.maximum(smaller_before(value, common), smaller_before(value[::-1], after)[::-1])


def factors(part: int):
    """From stretches sorted by key and doc_id: the byte ranges (doc_id, h, start, end) with a longest previous factor of 50.

    Keys come whole; one that has more rows than fit a part goes on with the classes it has had.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None

        def work(table: pa.Table) -> pa.RecordBatch:
            nonlocal carry
            if carry is not None and carry.column("key")[0].as_py() != table.column("key")[0].as_py():
                carry = None
            old = carry.num_rows if carry is not None else 0
            table = pa.concat_tables([carry, table]).combine_chunks() if old else table.combine_chunks()
            key, doc, start = (table.column(c).to_numpy() for c in ("key", "doc_id", "start"))
            data, o = buffers(table.column("bytes"))
            length = np.diff(o) - (LEAST - 1)
            # Equal stretches of a key are a class; rows come by doc_id, so its first row has its smallest.
            sid = range_hashes(data, o[:-1], o[1:])
            by = np.lexsort((np.arange(len(key)), sid, key))
            new = np.append(True, (key[by][1:] != key[by][:-1]) | (sid[by][1:] != sid[by][:-1]))
            of = np.empty(len(key), np.int64)  # the first row of each row's class
            of[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
            firsts = np.flatnonzero(of == np.arange(len(key)))
            _, back, count = np.unique(key[firsts], return_inverse=True, return_counts=True)
            sorted_ = firsts[count[back] > 1]  # a class alone has no other's factors
            gone = np.zeros(int(length.sum()), bool)  # by suffix
            base = np.cumsum(length) - length
            if len(sorted_):
                cut = gathered(data, o[sorted_], o[sorted_ + 1] - o[sorted_])
                some, so = buffers(cut)
                row, at, order, common = suffix_order(some, so, key[sorted_], doc[sorted_])
                long = np.empty(len(order), bool)
                long[order] = previous_factors(doc[sorted_][row][order], common) >= LEAST
                gone[base[sorted_][row] + at] = long
            # A class's later documents lose the whole stretch; rows of its first document fare as its first row.
            nth = np.arange(len(gone)) - np.repeat(base, length)
            member = np.repeat(np.arange(len(key)), length)
            gone = np.where((doc > doc[of])[member], True, gone[base[of][member] + nth])
            last = firsts[key[firsts] == key[-1]]
            carry = table.take(pa.array(last))
            gone &= member >= old
            a, b = gone.copy(), gone.copy()
            a[1:] &= ~gone[:-1] | (member[1:] != member[:-1])
            b[:-1] &= ~gone[1:] | (member[1:] != member[:-1])
            a, b = np.flatnonzero(a), np.flatnonzero(b)
            take = pa.array(member[a])
            doc_id, h = (table.column(c).combine_chunks().take(take) for c in ("doc_id", "h"))
            begin, end = start[member[a]] + nth[a], start[member[b]] + nth[b] + LEAST
            return pa.RecordBatch.from_arrays([doc_id, h, pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], names=["doc_id", "h", "start", "end"])

        held, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, part):
                held.append(batch.slice(at, part))
                n += held[-1].num_rows
                if n < part:
                    continue
                table = pa.Table.from_batches(held)
                key = table.column("key").to_numpy()
                whole = int(np.flatnonzero(np.append(True, key[1:] != key[:-1]))[-1]) or n  # to where the last key begins
                yield work(table.slice(0, whole))
                held, n = (table.slice(whole).to_batches(), n - whole) if whole < n else ([], 0)
        if n:
            yield work(pa.Table.from_batches(held))

    return run


def ordered_factors(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "doc_id", "start").mapInArrow(factors(PART), RANGE)


def split_at_first(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(late, rest) of parked rows: late are the rows of hot keys that aren't of the key's smallest doc_id.

    Rows of one key hold equal bytes, so what the late ones hold stands in an earlier document, and the rest has no hot key.
    """
    firsts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    hot = firsts.filter(F.col("n") > max(1.0, HOT * rows.count())).select(key, "first").collect()  # 1 / HOT rows at most
    if not hot:
        return rows.limit(0), rows
    late = F.coalesce(F.col("doc_id") > F.element_at(F.create_map(*(F.lit(x) for r in hot for x in r)), F.col(key)), F.lit(False))
    return rows.filter(late), rows.filter(~late)


def hot_ranges(rows: DataFrame) -> DataFrame:
    """(doc_id, h, ranges) of the stretches of keys with over MANY of them: factors of classes, given back to the classes' rows."""
    rows = park(rows.withColumn("sid", F.xxhash64("key", "bytes")))
    classes = park(rows.groupBy("key", "sid").agg(F.min("doc_id").alias("doc_id"), F.first("bytes").alias("bytes")).select("key", "doc_id", F.col("sid").alias("h"), F.lit(0).alias("start"), "bytes"))
    many = park(classes.groupBy("key").count().filter(F.col("count") > MANY).select("key", F.lit(True).alias("many")))
    flagged = park(hot_join(classes, many, "key", "left"))
    few, more = (flagged.filter(f"{c} many is not null").select(*classes.columns) for c in ("not", ""))
    late, rest = split_at_first(park(more.mapInArrow(dealt_again, STRETCH)), "key")
    found = park(ordered_factors(few.union(rest))).union(late.select("doc_id", "h", "start", F.col("start") + LEAST))
    spans = found.groupBy("h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    per = park(classes.select(F.col("h").alias("sid"), F.col("doc_id").alias("first")).join(spans.withColumnRenamed("h", "sid"), "sid", "left"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.octet_length("bytes").alias("end")))
    late, rest = split_at_first(rows, "sid")
    own = rest.join(per, "sid").select("doc_id", "h", "start", F.when(F.col("doc_id") > F.col("first"), whole).otherwise(F.col("spans")).alias("spans"))
    every = late.select("doc_id", "h", "start", whole.alias("spans")).union(own.filter("spans is not null"))
    return every.select("doc_id", "h", F.transform("spans", lambda x: F.struct((F.col("start") + x["start"]).alias("start"), (F.col("start") + x["end"]).alias("end"))).alias("ranges"))


def common_keys(docs: DataFrame) -> np.ndarray:
    """Keys that stand in over 1/256 of the sampled texts (and in nine), at most 4096 of them: they are spread over more tasks, which changes no result."""
    counts = park(docs.mapInArrow(keys_of(), "key long, doc_id long, h long, n int").groupBy("key").count())
    share = docs.select("doc_id", "h").count() / 256
    rows = counts.filter(F.col("count") > max(8.0, share)).orderBy(F.desc("count"), "key").limit(1 << 12).select("key").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64).view(U))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, n_removed, n_spans, kept_sha256, kept) of texts and their removed ranges."""
    for whole in batches:
        for batch in pieces(whole):
            data, offsets = buffers(batch.column("text"))
            ranges = batch.column("ranges").to_pylist()
            removed, spans, digest, left = [], [], [], []
            for d, some in enumerate(ranges):
                text = data[offsets[d] : offsets[d + 1]]
                mark = np.zeros(len(text) + 1, np.int64)
                np.add.at(mark, [r["start"] for r in some], 1)
                np.add.at(mark, [r["end"] for r in some], -1)
                gone = np.cumsum(mark)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0)
                kept = text[~gone].tobytes()
                digest.append(hashlib.sha256(kept).hexdigest())
                left.append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(left, pa.binary())],
                names=["doc_id", "h", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def removed_ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sizes, cuts): every row's doc_id, h, n_bytes, digest and the first doc_id with its text; the outcome of each text that loses some bytes."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    with scratch(spark) as kept:
        digests = park(docs.select("doc_id", "h", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("digest")))
        copied = digests.groupBy("digest").agg(F.min("doc_id").alias("first"))
        sizes = park(hot_join(digests, copied, "digest"))
        discard(digests)
        later = sizes.filter("doc_id > first").select("doc_id", "h").distinct()
        unique_of = lambda docs: docs.filter(f"doc_id is not null and octet_length(text) >= {LEAST}").join(later, ["doc_id", "h"], "left_anti").dropDuplicates(["doc_id", "h"])
        unique = unique_of(docs)
        common = spark.sparkContext.broadcast(common_keys(park(unique_of(docs.filter(F.pmod(F.xxhash64("doc_id", "h"), F.lit(SAMPLE)) == 0)))).tobytes())
        found = unique.mapInArrow(keys_of(common), "key long, doc_id long, h long, n int").repartition("key", F.least("n", F.lit(0))).sortWithinPartitions("key")
        wanted = found.mapInArrow(repeated(MANY), "key long, doc_id long, h long, hot boolean")
        of = lambda hot: F.collect_list(F.when(F.col("hot") == hot, F.col("key")))
        lists = park(wanted.groupBy("doc_id", "h").agg(of(False).alias("keys"), of(True).alias("hot")))
        texts_with = lambda keys: unique.join(lists.select("doc_id", "h", F.col(keys).alias("keys")).filter("size(keys) > 0"), ["doc_id", "h"]).mapInArrow(sent, STRETCH)
        ranges = park(ordered_factors(texts_with("keys"))).select("doc_id", "h", F.array(F.struct("start", "end")).alias("ranges"))
        if lists.filter("size(hot) > 0").limit(1).count():
            ranges = ranges.union(hot_ranges(texts_with("hot")))
        per = park(ranges.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("ranges")).alias("ranges")))
        kept += [sizes, per]
    return sizes, unique.join(per, ["doc_id", "h"]).mapInArrow(cut, "doc_id long, h long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row.

    Null texts are empty. A null doc_id has no order: such rows lose nothing and take nothing from others. Rows that
    share a doc_id don't affect each other; repeated rows get equal results. Other columns are ignored. An empty table
    gives an empty result.
    """
    with scratch(docs.sparkSession) as kept:
        sizes, cuts = removed_ranges(docs)
        cuts = park(cuts.drop("kept"))
        kept += [sizes, cuts]
    gone = (F.col("doc_id") > F.col("first")) & (F.col("n_bytes") >= LEAST)
    return sizes.join(cuts, ["doc_id", "h"], "left").select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
    )

"""N-gram Jaccard join: size-banded tiles of bitmap signatures, then exact sorted-array intersection.

A text's set holds the 64-bit hashes of its distinct word shingles. Two texts link when
``100 * |A & B| >= percent * |A | B|``.

1. Texts with the same set become one class, known by a hash of the set and stood for by a row of its smallest doc_id.
2. A class is listed under the `SKETCH` smallest hashes of its set. In a linked pair at least three quarters of the
   smallest hashes of the union lie in both sets, so a pair shares a quarter of the sketch unless fewer than 12 of 48
   draws at 3/4 succeed (probability below 1e-13). For smaller sets the sketch is the set, and the least number of listed
   hashes shared with any partner is exact (`least_shared`).
3. Where a pair must share `need` of its listed hashes, it shares one outside each side's need - 1 most common ones.
   So those are left out, and with them classes with fewer listed hashes: a passage in millions of otherwise different
   texts makes no list.
4. Within a list, members are ordered by size and cut into tiles. First each member is paired with its tile's and its
   list's first member (a number of pairs linear in the list); these are intersected exactly and grouped.
5. Lists that still hold several groups are compared tile against tile, where sizes allow a link: the bitmaps hold the
   parity of the hashes per bit, so the set bits of their XOR bound the symmetric difference from below and the overlap
   from above. Only pairs of different groups that the bound admits are intersected exactly. Every member carries the
   hashes of its lists, and a pair is given by the list of the smallest hash that both have, not by each.

For a set under `SKETCH` hashes, or one that links with such a set, the bounds are exact and no pair is lost; beyond, a
pair is lost with the probability of step 2, or by a collision of 64-bit hashes. Pairs inside a group need no comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.llm.bytehash import SPACES, Words, pieces
from engram.llm.shared import components, hot_join, park, scratch

SKETCH, QUARTER, TILE = 48, 12, 256
#: So many tiles of a list are matched with the others in one task; a longer list is cut into several such keys.
STRIP = 64
NARROW, WIDE = 128, 16384

SKETCHES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("h", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_id", T.BinaryType()),
        T.StructField("bitmap", T.BinaryType()),
        T.StructField("sketch", T.ArrayType(T.LongType())),
    ]
)


def sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    with np.errstate(over="ignore"):
        words = Words(texts, SPACES)
        h, doc = words.shingles(k)
    cut = np.searchsorted(doc, np.arange(words.n + 1))
    return [np.unique(h[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def least_shared(n: int, percent: int) -> int:
    """How many listed hashes a set of n < SKETCH shares with a linked one at least, which lists not all of its m if m > SKETCH."""
    larger = (-(-percent * (n + m) // (100 + percent)) - (m - SKETCH) for m in range(SKETCH + 1, 100 * n // percent + 1))
    return max(1, min(-(-percent * n // 100), *larger, SKETCH))


def width(n: int) -> int:
    """Bits of the bitmap of a set of n, by its size band: two to four for each hash, so that the bound is close."""
    return min(WIDE, max(NARROW, 2 << (max(n, 1) - 1).bit_length()))


def parity(s: np.ndarray) -> bytes:
    b = width(len(s))
    return np.packbits((np.bincount(((s >> np.uint64(17)) & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1).astype(np.uint8)).tobytes()


def sketcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                n, ids, bits, sketch = [], [], [], []
                for s in sets(batch.column("text"), k):
                    n.append(len(s))
                    ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    bits.append(parity(s))
                    sketch.append(s[:SKETCH].view(np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in sketch])]).astype(np.int32)
                values = pa.array(np.concatenate(sketch) if sketch else np.zeros(0, np.int64), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), values)],
                    names=SKETCHES.names,
                )

    return run


def rows_by(batches: Iterator[pa.RecordBatch], key: list[str], limit: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys from batches sorted by them; a run over `limit` rows comes in parts."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < limit:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        cols = [table.column(c).to_pylist() for c in key]
        last = tuple(c[-1] for c in cols)
        cut = n
        while cut and tuple(c[cut - 1] for c in cols) == last:
            cut -= 1
        if cut:
            yield table.slice(0, cut)
        held, n = table.slice(cut).to_batches(), n - cut
    if held:
        yield pa.Table.from_batches(held)


def verifier(k: int, percent: int):
    """From rows (a, salt, id, text) sorted by a, salt and centre first: links (a, b) of the centre a to members b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, centres = None, []
        for whole in batches:
            for batch in pieces(whole):
                left, right = [], []
                keys = zip(batch.column("a").to_pylist(), batch.column("salt").to_pylist(), strict=True)
                for key, i, s in zip(keys, batch.column("id").to_pylist(), sets(batch.column("text"), k), strict=True):
                    if key != of:
                        of, centres = key, []
                    if i == key[0]:
                        centres.append(s)
                        continue
                    for c in centres:
                        both = len(np.intersect1d(c, s, assume_unique=True))
                        if len(s) and 100 * both >= percent * (len(c) + len(s) - both):
                            left.append(key[0])
                            right.append(i)
                            break
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts link. A centre's text is sent once for each 256 members."""
    pairs = pairs.withColumn("salt", F.lit(0).cast("int"))
    many = pairs.groupBy("a").count().filter("count > 256").select("a", F.ceil(F.col("count") / 256).cast("int").alias("parts"))
    pairs = park(
        pairs.join(many, "a", "left").select("a", "b", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("parts"))).cast("int").alias("salt"))
    )
    members = pairs.join(texts.withColumnRenamed("id", "b"), "b").select("a", "salt", F.lit(1).alias("role"), F.col("b").alias("id"), "text")
    centres = pairs.select("a", "salt").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("id"), "text")
    dealt = centres.union(members).repartition("a", "salt").sortWithinPartitions("a", "salt", "role").drop("role")
    return park(dealt.mapInArrow(verifier(k, percent), "a long, b long"))


def folded(bitmaps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps as rows of `size` bytes: a wider one narrows by XOR of its parts, as the lower bits of a hash choose the bit within a part."""
    out = np.zeros((len(bitmaps), size), np.uint8)
    for r, x in enumerate(bitmaps):
        out[r] = np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0)
    return out.view(np.uint64)


def admitted_pairs(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The id pairs of the tile pairs in a table (whole keys, sorted by side) that groups, sizes and bitmaps admit."""
    one, two, side, ids, n, g = (table.column(c).to_numpy() for c in ("one", "two", "side", "id", "n_shingles", "component"))
    token = table.column("token").to_numpy()
    m = len(ids)
    new = np.ones(m, bool)
    new[1:] = (token[1:] != token[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, m))
    end = np.repeat(start + size, size)
    other = np.repeat(start + np.add.reduceat(1 - side, start), size)  # where side 1 begins
    within = one == two
    begin = np.where(within, np.arange(m) + 1, other)
    count = np.where(within | (side == 0), end - begin, 0)
    i = np.repeat(np.arange(m), count)
    j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    ok = (g[i] != g[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    i, j = i[ok], j[ok]
    lo, hi = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    order = np.lexsort((hi, lo))
    once = np.ones(len(order), bool)
    once[1:] = (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])
    i, j = i[order][once], j[order][once]
    bitmaps = table.column("bitmap").to_pylist()
    wide = np.array([len(x) for x in bitmaps], np.int64)
    # |A ^ B| = |A| + |B| - 2o and 100 o >= percent (|A| + |B| - o) together; first by narrow bitmaps, then by full ones.
    most = (n[i] + n[j]) * (100 - percent)
    for narrow in (True, False):
        keep = np.zeros(len(i), bool)
        width = np.full(len(i), NARROW // 8) if narrow else np.minimum(wide[i], wide[j])
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            used, back = np.unique(np.concatenate([i[at], j[at]]), return_inverse=True)
            x = folded([bitmaps[u] for u in used], int(w))
            differ = np.bitwise_count(x[back[: len(at)]] ^ x[back[len(at) :]]).sum(axis=1, dtype=np.int64)
            keep[at] = differ * (100 + percent) <= most[at]
        i, j, most = i[keep], j[keep], most[keep]
    # Of all lists that hold both, the one with the smallest hash gives the pair; where a table has several, that one came first.
    mine = first_shared(table.column("own").combine_chunks() if isinstance(table.column("own"), pa.ChunkedArray) else table.column("own"), i, j) == token[i]
    i, j = i[mine], j[mine]
    return np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])


def first_shared(own: pa.ListArray, i: np.ndarray, j: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """For pairs of rows with a sorted list of hashes each, the smallest hash that both have; each pair has one."""
    first, size = own.offsets.to_numpy()[:-1], np.diff(own.offsets.to_numpy())
    values, wide = own.values.to_numpy(), int(size.max(initial=0))
    column = np.arange(wide)

    def lists(rows: np.ndarray, rest: int) -> np.ndarray:
        at = np.minimum(first[rows][:, None] + column, max(len(values) - 1, 0))
        return np.where(column < size[rows][:, None], values[at], rest)

    out = np.zeros(len(i), np.int64)
    for k in range(0, len(i), chunk):
        a, b = lists(i[k : k + chunk], -(1 << 63)), lists(j[k : k + chunk], (1 << 63) - 1)
        both = (a[:, :, None] == b[:, None, :]).any(axis=2)
        out[k : k + chunk] = a[np.arange(len(a)), both.argmax(axis=1)]
    return out


def admits(percent: int):
    """From rows sorted by token, tile pair and side (0: members of the first tile, 1: of the second): admitted id pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in rows_by(batches, ["token", "one", "two"]):
            a, b = admitted_pairs(table.combine_chunks(), percent)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def ngram_jaccard_classes(docs: DataFrame, k: int = 5, percent: int = 75, hashes: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs, and with `hashes` h, the xxhash64 of its text.

    A null or wordless text has an empty set and links with nothing. Rows with a null doc_id link with nothing and have
    a null component. Repeated rows are one class. Rows that share a doc_id but not a text are judged by their own
    texts. Other columns are ignored. An empty table gives an empty result.
    """
    with scratch(docs.sparkSession) as kept:
        made, of_set = _classes(docs, k, percent)
        kept += [made, of_set]
    component = F.when(F.col("doc_id").isNull() | (F.col("n_shingles") == 0), F.col("doc_id")).otherwise(F.col("component"))
    return hot_join(made.select("doc_id", "h", "n_shingles", "set_id"), of_set, "set_id", "left").select("doc_id", "n_shingles", component.alias("component_id"), *["h"] * hashes)


def _classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(made, of_set): every row's set, and the component of every set."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    made = park(docs.mapInArrow(sketcher(k), SKETCHES))
    classes = park(
        made.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("set_id")
        .agg(F.min(F.struct("doc_id", "h")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("bitmap").alias("bitmap"), F.first("sketch").alias("sketch"))
        .select(F.xxhash64("set_id").alias("id"), "set_id", "row.doc_id", "row.h", "n_shingles", "bitmap", "sketch")
    )
    lists = classes.select("id", F.explode("sketch").alias("token"))
    counts = park(lists.groupBy("token").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    per = lists.join(counts, "token").groupBy("id").agg(F.collect_list(F.struct("members", "token")).alias("listed"))
    small = F.array(*(F.lit(least_shared(n, percent)) for n in range(1, SKETCH)))
    need = F.when(F.col("n_shingles") >= SKETCH, QUARTER).otherwise(F.get(small, (F.col("n_shingles") - 1).cast("int")))
    rarest = F.slice(F.array_sort("listed"), F.lit(1), F.size("listed") - F.col("need") + 1)
    listed = park(
        per.join(classes.select("id", "doc_id", "n_shingles"), "id")
        .withColumn("need", need)
        .filter("size(listed) >= need")
        .select("id", "doc_id", "n_shingles", F.array_sort(F.transform(rarest, lambda t: t["token"])).alias("own"))
    )
    open_ = listed.select(F.explode("own").alias("token"), "id", "doc_id", "n_shingles")
    # Each list in tiles by size: long lists get a size rank from counts by size, never a sort of the whole list.
    # Members are paired with those of the smallest doc_id: an original comes before its copies, and links with more of them.
    eldest = F.min(F.struct("doc_id", "id"))
    by_size = open_.groupBy("token", "n_shingles").agg(F.count(F.lit(1)).alias("here"), eldest.alias("low"))
    upto = Window.partitionBy("token").orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("token")
    ranks = by_size.select(
        "token", "n_shingles", "here", "low", F.coalesce(F.sum("here").over(upto), F.lit(0)).alias("before"), F.min("low").over(whole).alias("first"), F.sum("here").over(whole).alias("now")
    ).filter("now > 1")
    tiled = park(
        open_.join(ranks, ["token", "n_shingles"])
        .withColumn("tile", F.floor((F.col("before") + F.pmod(F.xxhash64("id"), F.col("here"))) / TILE).cast("int"))
        .select("token", "id", "doc_id", "n_shingles", "tile", F.col("first.id").alias("first"), F.col("low.id").alias("low"))
    )
    starts = tiled.groupBy("token", "tile").agg(eldest.alias("head")).select("token", "tile", F.col("head.id").alias("head"))
    star = (
        tiled.join(starts, ["token", "tile"])
        .select(F.explode(F.array("first", "low", "head")).alias("o"), "id")
        .filter("o <> id")
        .select(F.least("o", "id").alias("a"), F.greatest("o", "id").alias("b"))
        .distinct()
    )
    needed = classes.select("id", "doc_id", "h").join(tiled.select("id").distinct(), "id", "left_semi")
    texts = park(docs.join(needed, ["doc_id", "h"]).select("id", "text").dropDuplicates(["id"]))
    found = verified(star, texts, k, percent)
    grouped = components(found)
    label = F.coalesce("component", "id").alias("component")
    labelled = tiled.select("token", "id", "n_shingles", "tile").join(grouped.withColumnRenamed("node", "id"), "id", "left").select("token", "id", "n_shingles", "tile", label)
    several = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token")
    mixed = park(labelled.join(several, "token", "left_semi"))
    tiles = mixed.groupBy("token", "tile").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    one, two = (tiles.select("token", *(F.col(c).alias(f"{c}{s}") for c in ("tile", "least", "most", "lo", "hi"))) for s in ("1", "2"))
    # Tile pairs of one list whose sizes allow a link and that don't hold one and the same group. A tile meets those
    # before it strip by strip, so a long list is many keys.
    one = one.withColumn("strip", F.floor(F.col("tile1") / STRIP))
    two = two.withColumn("strip", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("tile2") / STRIP))))
    met = (
        one.join(two, ["token", "strip"])
        .filter(f"tile1 <= tile2 and {percent} * least2 <= 100 * most1 and not (lo1 = hi1 and lo2 = hi2 and lo1 = lo2)")
        .select("token", F.col("tile1").alias("one"), F.col("tile2").alias("two"))
    )
    sides = met.select("token", "one", "two", F.col("one").alias("tile"), F.lit(0).alias("side")).union(
        met.filter("one < two").select("token", "one", "two", F.col("two").alias("tile"), F.lit(1).alias("side"))
    )
    signed = mixed.join(classes.select("id", "bitmap"), "id").join(listed.select("id", "own"), "id")
    dealt = sides.join(signed, ["token", "tile"]).select("token", "one", "two", "side", "id", "n_shingles", "component", "bitmap", "own").repartition("token", "one", "two").sortWithinPartitions("token", "one", "two", "side")
    admitted = park(dealt.mapInArrow(admits(percent), "a long, b long").join(found, ["a", "b"], "left_anti"))
    more = verified(admitted, texts, k, percent)
    final = components(found.union(more)).withColumnRenamed("node", "id")
    own = classes.select("id", "set_id", "doc_id")
    placed = park(final.join(own, "id"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("least"))
    named = hot_join(placed, least, "component").select("set_id", F.col("least").alias("component"))
    return made, park(named.union(own.join(final, "id", "left_anti").select("set_id", F.col("doc_id").alias("component"))))

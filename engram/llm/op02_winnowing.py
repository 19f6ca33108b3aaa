"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts are hashed by runs of `GRAM` words; of every `SPAN - GRAM + 1` consecutive hashes the smallest is kept as a
fingerprint. Two texts that share `SPAN` consecutive words therefore share a fingerprint. Documents that share one with
an item are read again: each run of words that hashes to an item's fingerprint is extended to both sides and compared
word by word, which leaves exactly the shared windows of `SPAN` words. Items shorter than that are one window each and
are matched by a hash of all their words, then word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.shared import ascii_lower, park

GRAM, SPAN = 5, 10
#: A table of item fingerprints or of contaminated documents up to this many bytes is broadcast.
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def indexes(n: Column, run: int) -> Column:
    """Starts of the runs of so many words, from 0."""
    return F.when(n >= run, F.sequence(F.lit(0), n - run)).otherwise(F.expr("cast(array() as array<int>)"))


def gram(w: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(w, i + j) for j in range(k)))


def fingerprints(w: Column, g: Column) -> Column:
    """The smallest gram hash of each window, once; g: the gram hashes of w."""
    span = SPAN - GRAM + 1
    return F.array_distinct(F.transform(indexes(F.size(w), SPAN), lambda i: F.least(*(F.get(g, i + j) for j in range(span)))))


def grams(w: Column, k: int = GRAM) -> Column:
    return F.transform(indexes(F.size(w), k), lambda i: gram(w, i, k))


def runs(w: Column, k: int, n: int, ours) -> Column:
    """(i, fp, n, ours) of every run of k words, for targets of n words; ours(i): the words to compare."""
    return F.transform(indexes(F.size(w), k), lambda i: F.struct(i.alias("i"), gram(w, i, k).alias("fp"), F.lit(n).alias("n"), ours(i).alias("ours")))


def own_words(n: int):
    return lambda i: F.array(*(F.get("w", i + j) for j in range(n)))


def small(df: DataFrame, words: str | None = None) -> DataFrame:
    """A parked table, marked for broadcast only if it is small by its counted rows, each of 64 bytes and the words of a column; joins shuffle otherwise."""
    size = F.lit(64) if words is None else 64 + F.aggregate(words, F.lit(0), lambda n, w: n + F.coalesce(F.octet_length(w), F.lit(0)) + 16)
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_items, hit_words) for every row of docs.

    hit_words: sorted positions (from 0) of the words inside any occurrence of an item's window. A null text has no words.
    Items with a null or wordless text match nothing; items that share an id count once. Repeated documents get equal
    rows; a null doc_id is an ordinary value. Other columns are ignored. Without items nothing is hit.
    """
    items = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).filter("size(w) > 0")
    sizes = [r[0] for r in items.select(F.least(F.size("w"), F.lit(SPAN)).alias("n")).distinct().collect()]  # at most SPAN values
    short = sorted(n for n in sizes if n < SPAN)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")

    long_items = items.filter(F.size("w") >= SPAN).withColumn("g", grams(F.col("w")))
    prints = long_items.select("item_id", "w", "g", F.explode(fingerprints(F.col("w"), F.col("g"))).alias("fp"))
    around = lambda w, i: F.array(*(F.get(w, i + (j - (SPAN - GRAM))) for j in range(2 * SPAN - GRAM)))
    at = prints.select("item_id", "w", "fp", F.explode(F.transform(F.filter(F.transform("g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"] == F.col("fp")), lambda s: s["i"])).alias("i"))
    targets = [at.select("fp", "item_id", F.lit(SPAN).alias("n"), around(F.col("w"), F.col("i")).alias("theirs"))]
    for n in short:
        one = items.filter(F.size("w") == n)
        targets.append(one.select(gram(F.col("w"), F.lit(0), n).alias("fp"), "item_id", F.lit(n).alias("n"), F.col("w").alias("theirs")))
    target = targets[0]
    for t in targets[1:]:
        target = target.union(t)
    target = park(target.distinct())
    known = small(park(target.select("fp").distinct().withColumn("known", F.lit(1))))

    # First reading: which documents hold a fingerprint of an item.
    w = keyed.select("doc_id", "h", words(F.col("text")).alias("w"))
    marks = [fingerprints(F.col("w"), F.col("g"))] + [F.array_distinct(grams(F.col("w"), n)) for n in short]
    flat = w.withColumn("g", grams(F.col("w"))).select("doc_id", "h", F.size("w").alias("n_words"), (F.concat(*marks) if short else marks[0]).alias("fps"))
    base = park(
        flat.select("doc_id", "h", "n_words", F.posexplode_outer("fps").alias("pos", "fp"))
        .join(known, "fp", "left")
        .groupBy("doc_id", "h")
        .agg(F.max("n_words").alias("n_words"), F.max("known").alias("known"), F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, 1).otherwise(0)).alias("copies"))
    )

    # Second reading, of those documents only: extend each hit and compare words.
    hit = small(park(base.filter("known = 1").select(F.col("doc_id").alias("d"), F.col("h").alias("k"))))
    again = keyed.join(hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left_semi").dropDuplicates(["doc_id", "h"])
    again = again.select("doc_id", "h", words(F.col("text")).alias("w"))
    wide = F.explode(runs(F.col("w"), GRAM, SPAN, lambda i: around(F.col("w"), i)))
    places = again.select("doc_id", "h", wide.alias("p"))
    for n in short:
        places = places.union(again.select("doc_id", "h", F.explode(runs(F.col("w"), n, n, own_words(n))).alias("p")))
    met = places.select("doc_id", "h", "p.*").join(small(target, "theirs"), ["fp", "n"])
    same = lambda o: (
        F.get("ours", o).isNotNull() & F.get("ours", o + SPAN - 1).isNotNull() & F.get("theirs", o).isNotNull() & F.get("theirs", o + SPAN - 1).isNotNull() & (F.slice("ours", o + 1, SPAN) == F.slice("theirs", o + 1, SPAN))
    )
    extended = F.transform(F.filter(F.sequence(F.lit(0), F.lit(SPAN - GRAM)), same), lambda o: F.col("i") - (SPAN - GRAM) + o)
    starts = met.select("doc_id", "h", "item_id", "n", F.explode(F.when(F.col("n") == SPAN, extended).otherwise(F.when(F.col("ours") == F.col("theirs"), F.array("i")))).alias("start"))
    found = starts.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("item_id")).alias("hit_items"), F.collect_set(F.struct("start", "n")).alias("runs"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["n"] - 1)))))
    found = found.select(F.col("doc_id").alias("d"), F.col("h").alias("k"), "hit_items", covered.alias("hit_words"))
    none = F.expr("cast(array() as array<string>)")
    whole = base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left")
    return (
        whole.withColumn("hit_items", F.coalesce("hit_items", none))
        .withColumn("hit_words", F.coalesce("hit_words", F.expr("cast(array() as array<int>)")))
        .withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select(
            "doc_id",
            "h",
            F.col("n_words").cast("long").alias("n_words"),
            F.size("hit_words").cast("long").alias("n_hit"),
            F.size("hit_items").cast("long").alias("n_items"),
            F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
            (F.size("hit_words") > 0).alias("contaminated"),
            "hit_items",
            "hit_words",
        )
    )

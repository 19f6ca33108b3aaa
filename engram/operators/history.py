"""History of line ranges and of renamed files, from the hunks and renames of a commit log.

A log is told by `seq`, a commit's place in it: 0 is the newest, larger ones are older.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.sources.tables import checkpointed, parked

#: Hunks of a path up to which its commits are folded at once; beyond, commits that are folded at a time, and parts in
#: which they are numbered.
WHOLE, FOLDED, PARTS = 4096, 256, 64


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with `nth`, from 0, in the order of a whole number within a key. A key's rows are counted in PARTS by that
    number, so that no task sorts all rows of a common one."""
    span = rows.agg(F.min(order).alias("_low"), ((F.max(order) - F.min(order)) / PARTS + 1).cast("long").alias("_width"))
    parts = rows.join(F.broadcast(span)).withColumn("_part", F.expr(f"({order} - _low) div _width")).drop("_low", "_width")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = parts.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n")).select(key, "_part", before.alias("_before"))
    inside = parts.withColumn("_nth", F.row_number().over(Window.partitionBy(key, "_part").orderBy(order)) - 1)
    return inside.join(sizes, [key, "_part"]).withColumn("nth", (F.col("_before") + F.col("_nth")).cast("long")).drop("_part", "_nth", "_before")


def before(first: Column, last: Column, hunks: Column) -> tuple[Column, Column, Column]:
    """(touched, first, last): whether a commit's hunks touch a range of lines of its result, and where that range was
    before it. A range that the commit has added as a whole was empty: its last line comes before its first.

    A hunk without new lines stands behind the line that it names; it touches a range only from within.
    """
    start, size, gone = (lambda h: h["new_start"]), (lambda h: h["new_count"]), (lambda h: h["old_count"])
    end = lambda h: start(h) + size(h) - 1
    shift = lambda line: F.aggregate(hunks, F.lit(0).cast("long"), lambda s, h: s + F.when(F.when(size(h) > 0, end(h) < line).otherwise(start(h) < line), gone(h) - size(h)).otherwise(0))
    over = lambda line: F.get(F.filter(hunks, lambda h: (size(h) > 0) & (start(h) <= line) & (end(h) >= line)), F.lit(0))
    touched = F.exists(hunks, lambda h: F.when(size(h) > 0, (start(h) <= last) & (end(h) >= first)).otherwise((start(h) >= first) & (start(h) < last)))
    at, to = over(first), over(last)
    new_first = F.when(at.isNull(), first + shift(first)).otherwise(at["old_start"] + F.when(gone(at) > 0, 0).otherwise(1))
    new_last = F.when(to.isNull(), last + shift(last)).otherwise(to["old_start"] + F.when(gone(to) > 0, gone(to) - 1).otherwise(0))
    return touched, new_first, new_last


COMMIT = ("seq", "commit", "author", "date", "hunks")


def by_commit(hunks: DataFrame) -> DataFrame:
    """(path, seq, commit, author, date, hunks), a row a commit and path."""
    hunk = F.struct(*(F.col(c).cast("long").alias(c) for c in ("old_start", "old_count", "new_start", "new_count")))
    return hunks.groupBy("path", "seq", "commit", "author", "date").agg(F.array_sort(F.collect_list(hunk)).alias("hunks"))


def folded(ranges: DataFrame, commits: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(id, path, first, last, hits) from ranges and (path, commits): where each range was before its path's commits, and which touched it."""
    told = ("seq", "commit", "author", "date")
    hits = F.array().cast("array<struct<" + ",".join(f"{c}:{kinds[c]}" for c in told) + ">>")

    def fold(s: Column, c: Column) -> Column:
        touched, first, last = before(s["first"], s["last"], c["hunks"])
        alive = s["first"] <= s["last"]
        more = F.concat(s["hits"], F.array(F.struct(*(c[x].alias(x) for x in told))))
        return F.struct(F.when(alive, first).otherwise(s["first"]).alias("first"), F.when(alive, last).otherwise(s["last"]).alias("last"), F.when(alive & touched, more).otherwise(s["hits"]).alias("hits"))

    rows = ranges.filter("first <= last").join(commits, "path")
    return rows.select("id", "path", F.aggregate("commits", F.struct("first", "last", hits.alias("hits")), fold).alias("s")).select("id", "path", "s.first", "s.last", "s.hits")


def line_history(hunks: DataFrame, ranges: DataFrame, passes: int = 1) -> DataFrame:
    """(id, seq, commit, author, date) of the commits that touched ranges (id, path, first, last) of the newest version.

    hunks: (path, seq, commit, author, date, old_start, old_count, new_start, new_count), as unified diffs without
    context have them. Commits are folded from the newest to the oldest, and each moves the range to where its lines were
    before; the history ends where all of them were added. Hunks are dealt by path once, and a path's commits are folded
    within one array. Those of paths with over WHOLE hunks are numbered in parts and folded FOLDED at a time, and only
    ranges that still have a history go on to the next ones.

    With more passes, each takes a share of the paths, and no more than its hunks lie shuffled on disk at a time; hunks
    are then read once a pass, so they should come from a parked table.
    """
    ranges = ranges.select("id", "path", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))
    busy = parked(hunks.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WHOLE).select("path"))
    some = not busy.isEmpty()
    calm = hunks.join(F.broadcast(busy), "path", "left_anti") if some else hunks
    found = []
    for k in range(passes):
        share = calm.filter(F.pmod(F.xxhash64("path"), F.lit(passes)) == k) if passes > 1 else calm
        commits = by_commit(share.repartition("path")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*COMMIT))).alias("commits"))
        touched = folded(ranges, commits, dict(hunks.dtypes)).select("id", F.explode("hits").alias("h"))
        found.append(parked(touched.select("id", "h.*")))
    if some:
        found.append(_in_rounds(hunks.join(F.broadcast(busy), "path", "left_semi"), ranges.join(F.broadcast(busy), "path", "left_semi")))
    return reduce(DataFrame.unionByName, found)


def _in_rounds(hunks: DataFrame, ranges: DataFrame) -> DataFrame:
    """`line_history` of paths with any number of commits, FOLDED at a time."""
    commits = numbered(by_commit(hunks), "path", "seq").withColumn("_round", F.expr(f"nth div {FOLDED}"))
    rounds = parked(commits.groupBy("path", "_round").agg(F.array_sort(F.collect_list(F.struct(*COMMIT))).alias("commits")))
    state, out = ranges, []
    for k in range((rounds.agg(F.max("_round")).first()[0] or 0) + 1):
        moved = checkpointed(folded(state, rounds.filter(F.col("_round") == k).select("path", "commits"), dict(hunks.dtypes)))
        out.append(moved.select("id", F.explode("hits").alias("h")).select("id", "h.*"))
        state = moved.drop("hits")
    return reduce(DataFrame.unionByName, out)


def followed(touches: DataFrame, renames: DataFrame) -> DataFrame:
    """touches with `file`, the name that a path's content has in the end, and `life`, the how manieth content of it that is.

    touches: (path, seq, ...), with the new name where a commit renames; renames: (seq, old, new). A name may be used
    again, so every rename splits the names that it takes from and gives to into lives, by time; what is renamed links
    one life to the next. Chains of links are cut short by jumping, in as many rounds as the longest one halves.
    Copies aren't followed. A life of a name that another content was renamed over ends there, without a successor.
    """
    ends = renames.select(F.col("new").alias("path"), "seq").unionByName(renames.select(F.col("old").alias("path"), "seq"))
    # The places at which a name changes hands: as many as it has renames.
    cuts = ends.groupBy("path").agg(F.collect_list("seq").alias("_cuts"))
    lives = lambda at, strictly: F.size(F.filter(F.coalesce("_cuts", F.array().cast("array<long>")), lambda c: c > at if strictly else c >= at))
    named = lambda rows, name, life, strictly: rows.join(cuts.withColumnRenamed("path", name), name, "left").withColumn(life, lives(F.col("seq"), strictly)).drop("_cuts")
    links = named(named(renames.select(F.col("seq").cast("long").alias("seq"), "old", "new"), "old", "old_life", True), "new", "new_life", False)
    now = checkpointed(links.groupBy("old", "old_life").agg(F.min(F.struct("new", "new_life")).alias("to")).select("old", "old_life", "to.new", "to.new_life"))
    while True:
        step = now.select(F.col("old").alias("new"), F.col("old_life").alias("new_life"), F.col("new").alias("_new"), F.col("new_life").alias("_life"))
        jumped = now.join(step, ["new", "new_life"], "left").select("old", "old_life", F.coalesce("_new", "new").alias("new"), F.coalesce("_life", "new_life").alias("new_life"), F.col("_new").isNotNull().alias("_more"))
        jumped = checkpointed(jumped)
        more, now = jumped.filter("_more").limit(1).count(), jumped.drop("_more")
        if not more:
            break
    of = now.select(F.col("old").alias("path"), F.col("old_life").alias("_l"), F.col("new").alias("_file"), F.col("new_life").alias("_life"))
    rows = named(touches, "path", "_l", False).join(of, ["path", "_l"], "left")
    return rows.withColumn("file", F.coalesce("_file", "path")).withColumn("life", F.coalesce("_life", "_l")).drop("_l", "_file", "_life")

"""What the operators of this subpackage share: parked tables, joins that bear hot keys, and connected components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with more than this share of a table's rows is hot; there are at most 1 / HOT of them.
HOT = 1 / 512
#: Lets Spark drop the shuffle files of a query as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application below spark.checkpoint.dir, which driver and executors share.

    Where the setting is unset, a local master gets a folder of its own; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='engram-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/engram/{spark.sparkContext.applicationId}"


def filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def park(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, and a lost executor loses nothing.

    Inside `scratch` the table goes when the block ends, else when the driver's JVM ends.
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    path = f"{folder}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.parked_at = path
    fs, at = filesystem(spark, folder)
    fs.deleteOnExit(at)
    if blocks := getattr(_open, "blocks", None):
        blocks[-1].append(path)
    return out


def discard(*parked: DataFrame) -> None:
    """Delete parked tables that nothing reads any more."""
    for df in parked:
        fs, at = filesystem(df.sparkSession, df.parked_at)
        fs.delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables parked in this block are deleted at its end, but for those put on the list that it gives."""
    blocks = _open.__dict__.setdefault("blocks", [])
    blocks.append([])
    kept: list[DataFrame] = []
    try:
        yield kept
    finally:
        made, stay = blocks.pop(), {df.parked_at for df in kept}
        for path in made:
            if path not in stay:
                fs, at = filesystem(spark, path)
                fs.delete(at, True)
        if blocks:
            blocks[-1].extend(stay)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hot_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """left.join(right, on, how) for a right side with one row a key at most; `left` should be a parked table.

    Keys with over HOT of the left rows (so at most 1 / HOT of them) meet their rows of `right` by broadcast, wherever
    they lie; the others are shuffled. Rows of a null key match nothing.
    """
    rows = left.count()
    keys = [r[0] for r in left.groupBy(on).count().filter((F.col("count") > max(1.0, HOT * rows)) & F.col(on).isNotNull()).select(on).collect()]
    if not keys:
        return left.join(right, on, how)
    some = F.coalesce(F.col(on).isin(keys), F.lit(False))
    return left.filter(some).join(F.broadcast(right.filter(some)), on, how).unionByName(left.filter(~some).join(right.filter(~some), on, how))


def with_least(edges: DataFrame, rows: int) -> DataFrame:
    """(u, v, m) for parked edges (u, v): m is the smallest v of u. Hot u get it by broadcast."""
    low = park(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    hot = {r["u"]: r["m"] for r in low.filter(F.col("n") > max(1.0, HOT * rows)).collect()}  # 1 / HOT rows at most
    if not hot:
        return edges.join(low.select("u", "m"), "u")
    some = F.col("u").isin(list(hot))
    of = F.broadcast(low.filter(some).select("u", "m"))
    return edges.filter(some).join(of, "u").union(edges.filter(~some).join(low.filter(~some).select("u", "m"), "u"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table as (node, component): the smallest node that each one reaches.

    Alternates the large-star and small-star steps until no edge changes. Minima are taken before the shuffle and
    brought back by a join that deals with hot nodes, each round is parked, and no component is ever gathered in a task
    or on the driver. Loops and repeated edges are harmless. Nodes without an edge don't appear.
    """
    spark = edges.sparkSession
    with scratch(spark) as kept:
        now = park(
            edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u <> v").distinct()
        )
        before, n = None, now.count()
        for _ in range(rounds):
            with scratch(spark) as round_kept:
                both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
                # Large star: each neighbour above u is tied to the smallest of u's neighbourhood, u itself included.
                large = park(with_least(both, 2 * n).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
                # Small star: u and its smaller neighbours are tied to the smallest of them.
                tied = with_least(large, large.count())
                small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(tied.select("u", F.col("m").alias("v")))
                after = park(small.filter("u <> v").distinct())
                round_kept.append(after)
            discard(now)
            now = after
            state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if state == before:
                break
            before, n = state, state[0]
        else:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        star = now.groupBy("u").agg(F.min("v").alias("component"))
        roots = star.select(F.col("component").alias("node"), "component").distinct()
        out = park(star.select(F.col("u").alias("node"), "component").union(roots))
        kept.append(out)
    return out

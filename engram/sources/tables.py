"""Table access: typed Parquet reads, appends, upserts and deletes by key, schema migration."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_s, _l, _d = T.StringType(), T.LongType(), T.DoubleType()


def _schema(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


SOLUTIONS = _schema(
    id=_s, vector=T.ArrayType(T.FloatType(), False), checkpointId=_s, sessionIndex=_l, prompt=_s, response=_s, diffSummary=_s, summary=_s, agent=_s, timestamp=_s,
    filesChanged=_s, tokensUsed=_l, embeddingText=_s, contentHash=_s, source=_s, scope=_s, confidence=_d, version=_l, language=_s, symbols=_s,
)
CODE_SYMBOLS = _schema(
    id=_s, vector=T.ArrayType(T.FloatType(), False), path=_s, symbol=_s, symbolType=_s, language=_s, body=_s, summary=_s, embeddingText=_s, commit=_s, lastModified=_s,
    calls=_s, imports=_s, metadata=_s, gitChangeCount=_l, gitAuthorCount=_l, gitLastChangeDate=_s,
)
CODE_GRAPH = _schema(id=_s, source=_s, target=_s, edgeType=_s, sourceFile=_s, targetFile=_s, count=_l, commit=_s, lastModified=_s)
CODE_METRICS = _schema(
    id=_s, timestamp=_s, commit=_s, totalSymbols=_l, totalFiles=_l, avgComplexity=_d, avgSymbolsPerFile=_d, documentationCoverage=_d, deadCodeCount=_l, duplicateSymbolCount=_l, godSymbolCount=_l,
    topComplexSymbols=_s, godSymbols=_s, healthScore=_l, complexityTrend=_s, documentationTrend=_s, deadCodeTrend=_s,
)
#: What a row of `solutions` has where a column is missing or null.
SOLUTION_DEFAULTS = {"source": "transcript", "confidence": 0.7, "version": 1, "contentHash": "", "scope": "", "language": "", "symbols": "", "summary": "", "diffSummary": ""}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at a path, on any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def create_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An empty table with a schema; replaces what is there (drop and reset are the same act)."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def migrated(df: DataFrame, schema: T.StructType, defaults: dict) -> DataFrame:
    """df in the shape of a newer schema: missing columns appear, nulls take their defaults."""
    have = set(df.columns)
    value = lambda f: F.coalesce(F.col(f.name).cast(f.dataType), F.lit(defaults.get(f.name)).cast(f.dataType)) if f.name in have else F.lit(defaults.get(f.name)).cast(f.dataType)
    return df.select(*(value(f).alias(f.name) for f in schema.fields))


def without_keys(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those of `gone`; rows with a null key stay."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def upserted(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new`, and those rows whose key it doesn't have. Write the result to another path than is read."""
    return without_keys(rows, new, key).unionByName(new, allowMissingColumns=True)


def capped(rows: DataFrame, columns: list[str], order: list, n: int) -> DataFrame:
    """A projected scan of at most n rows, in a stated order so that the cut is always the same."""
    return rows.orderBy(*order).limit(n).select(*columns)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below the session's folder for checkpoints; it goes with the driver's JVM.

    Where that setting is unset, a local master gets a folder of its own; on a cluster that is an error.
    """
    context, at = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        at = f"file://{tempfile.mkdtemp(prefix='engram-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    import uuid

    folder = f"{at.rstrip('/')}/engram-core/{uuid.uuid4().hex}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


#: Lets Spark drop the shuffle files of a query as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written in this block leaves no shuffle files behind."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def parked(df: DataFrame) -> DataFrame:
    """df written as Parquet to a new shared folder and read back: cuts its lineage and drops its shuffle files. The
    folder goes with the driver's JVM."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/rows"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, in a folder that driver and executors share.

    Its files go once the frame and what was made from it are gone from the driver's memory.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or scratch_folder(df.sparkSession))
    # Spark's cleaner asks for this setting whenever a checkpoint is made, not only when the application begins.
    context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint()


#: Folders that a table in place is dealt into by its key.
BUCKETS = 64


def bucket_of(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _replace(rows: DataFrame, path: str) -> None:
    """Write the folders that rows have, and leave all others alone."""
    dealt = rows.repartition("_bucket")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)


def create_in_place(rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """Write a table whose rows lie in folders by a hash of their key, so that some of them can be replaced."""
    rows.withColumn("_bucket", bucket_of(key, buckets)).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)


def change_in_place(spark: SparkSession, path: str, key: str, new: DataFrame | None = None, gone: DataFrame | None = None, buckets: int = BUCKETS) -> list[int]:
    """Upsert the rows of `new` and delete those with the keys of `gone`; only the folders that hold such keys are read and written.

    Files of other folders stay as they are, name for name. Rows of `new` win over `gone`; all old rows with one of their
    keys go. What the folders are to hold is written aside first, so a change that breaks off loses nothing and can be
    made again. Gives the numbers of the folders; there are `buckets` at most. Rows with a null key are added, not matched.
    """
    old = spark.read.parquet(path)
    keys = None
    for part in (new, gone):
        if part is not None:
            some = part.select(F.col(key))
            keys = some if keys is None else keys.unionByName(some)
    if keys is None:
        return []
    touched = sorted(r[0] for r in keys.select(bucket_of(key, buckets).alias("b")).distinct().collect())
    if not touched:
        return []
    left = without_keys(old.filter(F.col("_bucket").isin(touched)), keys, key)
    if new is not None:
        left = left.unionByName(new.withColumn("_bucket", bucket_of(key, buckets)), allowMissingColumns=True)
    aside = f"{scratch_folder(spark)}/rows"
    left.select(*old.columns).write.partitionBy("_bucket").parquet(aside)
    made = spark.read.schema(old.schema).parquet(aside)
    _replace(made, path)
    # A folder that has lost all its rows isn't overwritten by any.
    empty = set(touched) - {r[0] for r in made.select("_bucket").distinct().collect()}
    for b in empty:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_bucket={b}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return touched


def read_in_place(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_bucket")

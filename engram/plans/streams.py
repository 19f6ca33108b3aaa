"""Driver queries that run as streams over the given tables until nothing more comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.plans.registry import Plans
from engram.sources.tables import scratch_folder, table
from engram.streaming import appended as A
from engram.streaming import events as EV
from engram.streaming import triggers as TG

P = Plans()
QUIET, INTERVAL = 2 * 3_600_000, 24 * 3_600_000
DUE = f"CASE WHEN before < 0 THEN last + {QUIET} ELSE greatest(last + {QUIET}, before + {INTERVAL}) END"


@P.add(
    f"""WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
f AS (
  SELECT key, n, ms AS last, CAST(-1 AS BIGINT) AS before, CAST(1 AS BIGINT) AS changes, CAST(NULL AS BIGINT) AS fired, CAST(0 AS BIGINT) AS gathered FROM e WHERE n = 1
  UNION ALL
  SELECT e.key, e.n, e.ms, CASE WHEN due <= e.ms THEN due ELSE before END, CASE WHEN due <= e.ms THEN 1 ELSE changes + 1 END, CASE WHEN due <= e.ms THEN due END, changes
  FROM (SELECT *, {DUE} AS due FROM f) f JOIN e ON e.key = f.key AND e.n = f.n + 1
), ends AS (SELECT key, {DUE} AS fired, changes FROM f QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1)
SELECT key, fired, gathered AS changes FROM f WHERE fired IS NOT NULL UNION ALL SELECT key, fired, changes FROM ends WHERE fired <= (SELECT max(ms) FROM e)"""
)
def debounced_events(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's events, fired after two quiet hours and at most once a day."""
    changes = EV.stream_table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts")
    return EV.drained(TG.debounced(changes, QUIET, INTERVAL), scratch_folder(spark)).select("key", F.unix_millis("fired").alias("fired"), "changes")


@P.add(
    """WITH c AS (SELECT * FROM events WHERE event_type = 'click'), p AS (SELECT * FROM events WHERE event_type = 'purchase'),
pairs AS (SELECT c.event_id AS click, p.event_id AS purchase FROM c JOIN p ON p.user_id = c.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 6 HOUR)
SELECT click, purchase FROM pairs UNION ALL
SELECT event_id, NULL FROM c WHERE event_id NOT IN (SELECT click FROM pairs) AND ts + INTERVAL 7 HOUR < (SELECT least((SELECT max(ts) FROM c), (SELECT max(ts) FROM p)))"""
)
def stream_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks with the purchases of the next six hours, as a join of two streams; clicks without one once their time is over."""
    side = lambda kind: EV.stream_table(spark, sf, "events").filter(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    joined = EV.interval_join(side("click"), side("purchase"), "user_id", "6 hours", "1 hour", "left")
    return EV.drained(joined.select(F.col("event_id").alias("click"), F.col("right_event_id").alias("purchase")), scratch_folder(spark))


@P.add("SELECT c.event_id AS click, p.event_id AS purchase FROM events c LEFT JOIN events p ON p.user_id = c.user_id AND p.event_type = 'purchase' AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 6 HOUR WHERE c.event_type = 'click'")
def batch_interval_join(spark: SparkSession, sf: str) -> DataFrame:
    """The same operator over the whole table."""
    side = lambda kind: table(spark, sf, "events").filter(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    joined = EV.interval_join(side("click"), side("purchase"), "user_id", "6 hours", "1 hour", "left")
    return joined.select(F.col("event_id").alias("click"), F.col("right_event_id").alias("purchase"))


@P.add("SELECT conv_id, turn, role, text, CASE WHEN turn < 2 THEN 1 ELSE 2 END AS run FROM conversations")
def transcripts_read_on(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as transcript files that grow between two runs of a stream: what each run has read.

    The files end in half a line when they are first read, which is kept back until it is whole.
    """
    folder = scratch_folder(spark)
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    turns = table(spark, sf, "conversations").select(F.concat(F.lit("s"), F.pmod("conv_id", F.lit(16)).cast("string"), F.lit(".jsonl")).alias("path"), (F.col("turn") >= 2).alias("later"), line.alias("line"), F.xxhash64("conv_id", "turn", "role", "text").alias("nth"))
    first = turns.filter("not later").select("path", F.struct("later", "nth").alias("nth"), "line", F.lit(False).alias("open"))
    # The first later line of a file, cut in the middle.
    half = turns.filter("later").groupBy("path").agg(F.min(F.struct("nth", "line")).alias("m")).select("path", F.struct(F.lit(True).alias("later"), F.col("m.nth").alias("nth")).alias("nth"), F.expr("left(m.line, length(m.line) div 2)").alias("line"), F.lit(True).alias("open"))
    rows = lambda: A.appended_lines(spark, f"{folder}/in", ".jsonl")
    A.write_lines(first.unionByName(half), f"{folder}/in")
    EV.drained(rows().withColumn("run", F.lit(1)), f"{folder}/out")
    A.write_lines(turns.select("path", F.struct("later", "nth").alias("nth"), "line", F.lit(False).alias("open")), f"{folder}/in")
    both = EV.drained(rows().withColumn("run", F.lit(2)), f"{folder}/out")
    return both.select(F.from_json("line", "conv_id long, turn long, role string, text string").alias("r"), "run").select("r.*", "run")

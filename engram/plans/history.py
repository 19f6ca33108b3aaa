"""Driver queries of line ranges and renamed files over histories that are made from orders and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.operators import history as H
from engram.operators import insights as I
from engram.plans.registry import Plans
from engram.sources.tables import parked, table

P = Plans()

#: A part is a file and an order a commit of the parts that it has lines of; seq counts from the newest day down. Both
#: engines run these, but for EACH, for which Spark has PLACES.
COMMITS = """SELECT CAST(p AS {text}) AS path, p, o, ln, q, s, CAST(o AS {text}) AS commit, o_custkey AS author, CAST(o_orderdate AS DATE) AS date,
  CAST((20000 - {day}) AS BIGINT) * 10000000 + o AS seq
  FROM (SELECT l_partkey AS p, l_orderkey AS o, min(l_linenumber) AS ln, min(l_suppkey) AS s, CAST(min(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY l_partkey, l_orderkey) l JOIN orders ON o_orderkey = o"""
#: Each commit's first hunk, and a second one further down of every other commit: inserted, replaced and deleted lines.
HUNKS = """SELECT path, seq, commit, author, date, 1 + (ln * 7 + s) % 60 AS a, ln % 3 AS m, CASE WHEN q % 4 = 0 AND ln % 3 = 0 THEN 1 ELSE q % 4 END AS n, o % 2 AS more,
  CASE WHEN (q + 1) % 3 = 0 AND (ln + 1) % 2 = 0 THEN 1 ELSE (ln + 1) % 2 END AS m2, (q + 1) % 3 AS n2 FROM commits"""
EACH = """SELECT path, seq, commit, author, date, a + CASE WHEN m = 0 THEN -1 WHEN n = 0 THEN 1 ELSE 0 END AS old_start, m AS old_count, a AS new_start, n AS new_count FROM h
  UNION ALL SELECT path, seq, commit, author, date, a + 20 + m + CASE WHEN m2 = 0 THEN -1 WHEN n2 = 0 THEN 1 ELSE 0 END, m2, a + n + 20, n2 FROM h WHERE more = 1"""
#: Shares of the files whose hunks are shuffled one after another.
PASSES = 4
#: The columns of EACH: of a first and of a second hunk.
PLACES = (
    ("old_start", "a + CASE WHEN m = 0 THEN -1 WHEN n = 0 THEN 1 ELSE 0 END", "a + 20 + m + CASE WHEN m2 = 0 THEN -1 WHEN n2 = 0 THEN 1 ELSE 0 END"),
    ("old_count", "m", "m2"),
    ("new_start", "a", "a + n + 20"),
    ("new_count", "n", "n2"),
)
RANGES = """SELECT p_partkey * 2 + j AS id, CAST(p_partkey AS {text}) AS path, 5 + p_partkey % 50 + 30 * j AS first, 5 + p_partkey % 50 + 30 * j + p_size AS last
  FROM part CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 AS j) x"""
#: A file's name changes with every third of its commits, and every fifth name is the first one again.
NAMED = """SELECT path, CAST(commit AS {text}) AS commit, author, date, seq, k, concat(path, '.', CAST(v % 4 AS {text})) AS name, concat(path, '.', CAST((v + 3) % 4 AS {text})) AS old
  FROM (SELECT *, CAST(floor((k - 1) / 3) AS BIGINT) AS v FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS k FROM commits) x) y"""
DUCK = {"text": "VARCHAR", "day": "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))"}
SPARK = {"text": "STRING", "day": "datediff(CAST(o_orderdate AS DATE), DATE '1970-01-01')"}


def rows(spark: SparkSession, sf: str, sql: str, **views: DataFrame) -> DataFrame:
    """A query over the tables that its text names, with no view left behind."""
    names = {n: table(spark, sf, n) for n in ("lineitem", "orders", "part")} | views
    used = {n: df for n, df in names.items() if f" {n}" in sql}
    for n, df in used.items():
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return spark.sql(sql, **used)


def commits(spark: SparkSession, sf: str, text: str = SPARK["text"]) -> DataFrame:
    """Lines are dealt by their orders once, for the grouping and for the join."""
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return rows(spark, sf, COMMITS.format(**SPARK | {"text": text}), lineitem=lines.repartition("l_orderkey"))


def metadata_sql(touches: str, key: str) -> str:
    """What `insights.file_metadata` gives, by key."""
    return (
        f"SELECT {key}, count(*) AS changes, count(DISTINCT author) AS authors, strftime(max(date), '%Y-%m-%d') AS last, string_agg(commit, ',' ORDER BY k) FILTER (k <= 5) AS recent "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date DESC, commit) AS k FROM {touches}) GROUP BY {key}"
    )


def metadata(touches: DataFrame, key: str) -> DataFrame:
    found = I.file_metadata(touches.select(F.col(key).alias("file"), "commit", "author", "date"))
    return found.withColumnRenamed("file", key).withColumn("last", F.date_format("last", "yyyy-MM-dd"))


def _moved(line: str, last: bool) -> str:
    """Where a line was before a commit: for hunks as a list h of structs (a, m, b, n)."""
    over = f"list_filter(h, lambda x: x.n > 0 AND x.b <= {line} AND x.b + x.n - 1 >= {line})[1]"
    at = f"{over}.a + CASE WHEN {over}.m > 0 THEN {over}.m - 1 ELSE 0 END" if last else f"{over}.a + CASE WHEN {over}.m > 0 THEN 0 ELSE 1 END"
    shift = f"coalesce(list_sum(list_transform(list_filter(h, lambda x: CASE WHEN x.n > 0 THEN x.b + x.n - 1 < {line} ELSE x.b < {line} END), lambda x: x.m - x.n)), 0)"
    return f"CAST(CASE WHEN {over} IS NOT NULL THEN {at} ELSE {line} + {shift} END AS BIGINT)"


@P.add(
    f"""WITH RECURSIVE commits AS ({COMMITS.format(**DUCK)}), h AS ({HUNKS}), hunks AS ({EACH}), ranges AS ({RANGES.format(**DUCK)}),
c AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq) AS nth FROM (SELECT path, seq, commit, author, date, list(struct_pack(a := old_start, m := old_count, b := new_start, n := new_count)) AS h FROM hunks GROUP BY path, seq, commit, author, date)),
fold AS (
  SELECT id, path, CAST(0 AS BIGINT) AS nth, CAST(first AS BIGINT) AS first, CAST(last AS BIGINT) AS last, false AS touched, '' AS commit, CAST(0 AS BIGINT) AS author, DATE '1970-01-01' AS date FROM ranges
  UNION ALL
  SELECT f.id, f.path, c.nth, {_moved("f.first", False)}, {_moved("f.last", True)},
    len(list_filter(h, lambda x: CASE WHEN x.n > 0 THEN x.b <= f.last AND x.b + x.n - 1 >= f.first ELSE x.b >= f.first AND x.b < f.last END)) > 0, c.commit, c.author, c.date
  FROM fold f JOIN c ON c.path = f.path AND c.nth = f.nth + 1 WHERE f.first <= f.last
), touches AS (SELECT * FROM fold WHERE touched)
{metadata_sql("touches", "id")}"""
)
def line_range_history(spark: SparkSession, sf: str) -> DataFrame:
    """Commits, authors and latest commits of two line ranges of every file, followed back through all its hunks."""
    # Names stay numbers until commits are listed, which is less to shuffle; parked, the commits are made once.
    h = parked(rows(spark, sf, HUNKS, commits=commits(spark, sf, "BIGINT")))
    each = h.withColumn("j", F.explode(F.expr("CASE WHEN more = 1 THEN array(0, 1) ELSE array(0) END")))
    hunks = each.select("path", "seq", "commit", "author", "date", *(F.expr(f"CASE j WHEN 0 THEN {first} ELSE {second} END").alias(c) for c, first, second in PLACES))
    touches = H.line_history(hunks, rows(spark, sf, RANGES.format(text="BIGINT")), passes=PASSES)
    return metadata(touches.withColumn("commit", F.col("commit").cast("string")), "id")


@P.add(
    f"WITH commits AS ({COMMITS.format(**DUCK)}), named AS ({NAMED.format(**DUCK)}), "
    f"touches AS (SELECT first_value(name) OVER (PARTITION BY path ORDER BY seq) AS file, commit, author, date FROM named) {metadata_sql('touches', 'file')}"
)
def renamed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every file's commits under all the names that it had, by the last one; names come back after four renames."""
    named = rows(spark, sf, NAMED.format(**SPARK), commits=commits(spark, sf))
    renames = named.filter("k > 1 and k % 3 = 1").select("seq", "old", F.col("name").alias("new"))
    found = H.followed(named.select(F.col("name").alias("path"), "seq", "commit", "author", "date"), renames)
    lives = found.withColumn("_file", F.concat_ws("#", "file", "life"))
    return metadata(lives, "_file").withColumn("file", F.substring_index("_file", "#", 1)).drop("_file")

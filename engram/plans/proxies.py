"""Stand-ins for code tables, made from the star schema; each as a frame and as the same SQL.

A part is a symbol. Lines of 49 and more of one supplier, in order of part, give calls from each part to the next;
lines of 47 and 48 give imports in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engram.sources.tables import table

SYMBOLS_SQL = """symbols AS (
  WITH calls AS (SELECT src, string_agg(dst, ',' ORDER BY dst) AS calls FROM (SELECT DISTINCT CAST(p AS VARCHAR) AS src, CAST(n AS VARCHAR) AS dst FROM (
      SELECT l_partkey AS p, lead(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_quantity >= 49) WHERE n <> p) GROUP BY src),
  imports AS (SELECT src, string_agg(dst, ',' ORDER BY dst) AS imports FROM (SELECT DISTINCT CAST(p AS VARCHAR) AS src, CAST(n AS VARCHAR) || ':' || p_brand AS dst FROM (
      SELECT l_partkey AS p, lead(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber) AS n FROM lineitem WHERE l_quantity >= 47 AND l_quantity < 49), part WHERE n <> p AND p_partkey = n) GROUP BY src)
  SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_partkey AS VARCHAR) AS symbol, CASE WHEN p_type = 'SMALL' THEN 'type' WHEN p_type = 'LARGE' THEN 'interface' ELSE 'function' END AS symbolType,
    'src/' || p_brand || '/' || p_type || '/' || (p_partkey % 40) || '.ts' AS path, CASE p_size % 3 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' ELSE 'go' END AS language,
    p_name AS body, p_size % 4 <> 0 AS documented, CAST(p_size AS BIGINT) AS complexity, coalesce(calls, '') AS calls, coalesce(imports, '') AS imports
  FROM part LEFT JOIN calls c ON c.src = CAST(p_partkey AS VARCHAR) LEFT JOIN imports i ON i.src = CAST(p_partkey AS VARCHAR))"""


def _links(lines: DataFrame, where: str) -> DataFrame:
    order = Window.partitionBy("l_suppkey").orderBy("l_partkey", "l_orderkey", "l_linenumber")
    return lines.filter(where).select(F.col("l_partkey").alias("p"), F.lead("l_partkey").over(order).alias("n")).filter("n <> p").distinct()


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    part, lines = table(spark, sf, "part"), table(spark, sf, "lineitem")
    text = lambda c: F.col(c).cast("string")
    joined = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    calls = _links(lines, "l_quantity >= 49").groupBy(F.col("p").alias("p_partkey")).agg(joined(text("n")).alias("calls"))
    target = part.select(F.col("p_partkey").alias("n"), F.col("p_brand").alias("brand"))
    imports = _links(lines, "l_quantity >= 47 and l_quantity < 49").join(target, "n").groupBy(F.col("p").alias("p_partkey")).agg(joined(F.concat(text("n"), F.lit(":"), "brand")).alias("imports"))
    rows = part.join(calls, "p_partkey", "left").join(imports, "p_partkey", "left")
    return rows.select(
        text("p_partkey").alias("id"), text("p_partkey").alias("symbol"), F.expr("case when p_type = 'SMALL' then 'type' when p_type = 'LARGE' then 'interface' else 'function' end").alias("symbolType"),
        F.expr("concat('src/', p_brand, '/', p_type, '/', p_partkey % 40, '.ts')").alias("path"), F.expr("case p_size % 3 when 0 then 'typescript' when 1 then 'python' else 'go' end").alias("language"),
        F.col("p_name").alias("body"), (F.col("p_size") % 4 != 0).alias("documented"), F.col("p_size").cast("long").alias("complexity"), F.coalesce("calls", F.lit("")).alias("calls"), F.coalesce("imports", F.lit("")).alias("imports"),
    )

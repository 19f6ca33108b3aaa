"""Results as text, Markdown or JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(rows: DataFrame) -> DataFrame:
    """(value): one JSON object a row."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def as_text(hits: DataFrame, summary: str = "summary") -> DataFrame:
    """(value): a numbered line a hit with its score and summary; hits have rank, id and score."""
    line = F.format_string("%d. [%.3f] %s", "rank", "score", F.col("id").cast("string"))
    return hits.orderBy("rank").select(F.concat_ws("\n", line, F.concat(F.lit("   "), F.left(summary, F.lit(200)))).alias("value"))


def as_markdown(title: str, facts: DataFrame) -> DataFrame:
    """(value): one Markdown document from (label, value) rows in their order of label."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("label", F.col("value").cast("string").alias("value")))), lambda x: F.concat(F.lit("- **"), x["label"], F.lit("**: "), x["value"]))
    return facts.agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(lines, "\n")).alias("value"))


def write_lines(rows: DataFrame, path: str) -> None:
    rows.select("value").write.mode("overwrite").text(path)

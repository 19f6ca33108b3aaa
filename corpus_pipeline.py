"""The corpus pipeline: quality, near duplicates, benchmark leaks, personal data, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; `run` writes each stage's
result as Parquet and reads it as the next one's documents. Documents of low quality go; of each group of linked
documents the one with the smallest doc_id stays; documents that hold a window of a benchmark item go; personal data is
masked in place; what is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.op01_ngram_jaccard import ngram_jaccard_classes
from engram.llm.op02_winnowing import contamination, small
from engram.llm.op06_rank_bpe import bpe_encode
from engram.llm.op07_quality import fit, of_quality
from engram.llm.op08_pii_bootstrap import without_personal_data
from engram.llm.shared import park, scratch

#: The network and the group search can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores below its threshold go; it is learnt from this stage's rows and their labels.

    A null text is scored as an empty one. Rows of one text fare alike. With too few labelled rows (see `fit`) all stay.
    """
    return of_quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays, once.

    Rows without a doc_id stay, null and empty texts too: they link with nothing. A row that stands there twice stays once.
    """
    rows = ngram_jaccard_classes(docs, hashes=True).filter("doc_id = component_id")
    stay = park(rows.select(F.col("doc_id").alias("__engram_id"), F.col("h").alias("__engram_s")).distinct())
    hashed = docs.withColumn("__engram_h", F.xxhash64("text"))
    kept = hashed.join(stay, (F.col("doc_id").cast("long") == F.col("__engram_id")) & (F.col("__engram_h") == F.col("__engram_s")), "left_semi")
    hashed = kept.dropDuplicates(["doc_id", "__engram_h"]).drop("__engram_h")
    return hashed.unionByName(docs.filter("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go, with all their copies.

    Null and empty texts stay, rows without a doc_id are judged like any other.
    """
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = small(park(found.filter("contaminated").select(F.col("doc_id").alias("__engram_d"), F.col("h").alias("__engram_h")).distinct()))
    return docs.join(leaks, F.col("doc_id").cast("long").eqNullSafe(F.col("__engram_d")) & (F.xxhash64("text") == F.col("__engram_h")), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Base and discovered spans give way to their kind in angle brackets; n_chars follows the text.

    No row goes. Null texts stay null, empty ones empty; repeated rows get equal texts.
    """
    clean = without_personal_data(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; null and empty texts have no ids.

    The ids are decoded as the operator does, and must give one name each; the names themselves aren't kept.
    """
    made = bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    names = F.when(F.col("n_tokens") > 0, F.length(F.regexp_replace("decoded", "[^ ]+", "")) + 1).otherwise(0)
    ids = F.when(names == F.col("n_tokens"), F.col("ids")).otherwise(F.raise_error(F.lit("ids and their names differ")))
    return made.select("doc_id", "n_tokens", ids.alias("ids"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark) as kept:
        for _, stage in STAGES:
            with scratch(spark) as mine:
                docs = park(stage(spark, docs, sf_dir))
                mine.append(docs)
        kept.append(docs)
    return docs

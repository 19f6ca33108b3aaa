"""Retrieval: nearest neighbours, BM25, exact names, reciprocal rank fusion, de-duplication, reranking.

Every ranked list has the columns id, score and rank (from 1), with ties broken by id. Scores are rounded before they
are ranked, so that the order doesn't depend on the order of summation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import scoring
from engram.functions.text import term_count, token_count, tokens
from engram.functions.vectors import cosine, distance
from engram.sources.tables import checkpointed

K1, B, RRF_K = 1.2, 0.75, 60
DIGITS = 6


def over_fetch(k: int, factor: int = 5, least: int = 50) -> int:
    """How many rows each list gives before fusion."""
    return max(factor * k, least)


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k best of (id, score, ...) with their rank. The limit comes first, so the window sees k rows at most."""
    top = rows.orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))


def knn(rows: DataFrame, query: Sequence[float], k: int, id: str = "id", vector: str = "vector", metric: str = "l2sq") -> DataFrame:
    """The k nearest rows (id, score, rank); score is 1 - distance. Filter rows first: the filter reaches the scan."""
    scored = rows.select(F.col(id).alias("id"), F.round(F.lit(1.0) - distance(F.col(vector), query, metric), DIGITS).alias("score"))
    return ranked(scored.filter("score is not null"), k)


def postings(rows: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """An inverted index (term, id, tf, length), to be written once and partitioned by term for many queries."""
    t = rows.select(F.col(id).alias("id"), tokens(F.col(text)).alias("t"))
    return t.select("id", F.size("t").cast("long").alias("length"), F.explode("t").alias("term")).groupBy("term", "id", "length").agg(F.count(F.lit(1)).alias("tf"))


def _bm25(tf: Column, df: Column, length: Column, documents: Column, average: Column) -> Column:
    idf = F.log(F.lit(1.0) + (documents - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (F.lit(1.0 - B) + B * length / average))


def bm25(rows: DataFrame, terms: Sequence[str], k: int, id: str = "id", text: str = "text") -> DataFrame:
    """The k best rows for query terms by BM25.

    Term counts are taken within each row, so no token is shuffled: texts are read and split once, and the counts (a few
    numbers a row that holds a term, sums for the others) are parked by a checkpoint, which Spark's cleaner removes once
    the frame is gone. Nothing stays in the cache.
    """
    terms = list(dict.fromkeys(terms))
    low = rows.select(F.col(id).alias("id"), F.lower(text).alias("t"))
    counted = low.select("id", token_count(F.col("t")).alias("length"), F.array(*(term_count(F.col("t"), w) for w in terms)).alias("tf"))
    counted = checkpointed(counted)
    stats = counted.agg(
        F.count(F.lit(1)).alias("documents"), F.avg("length").alias("average"), *(F.count_if(F.get("tf", F.lit(i)) > 0).alias(f"df{i}") for i in range(len(terms)))
    )
    score = reduce(
        lambda a, b: a + b,
        (F.when(F.get("tf", F.lit(i)) > 0, _bm25(F.get("tf", F.lit(i)), F.col(f"df{i}"), F.col("length"), F.col("documents"), F.col("average"))).otherwise(0.0) for i in range(len(terms))),
    )
    hits = counted.filter(F.exists("tf", lambda x: x > 0)).join(F.broadcast(stats))  # one row of statistics
    return ranked(hits.select("id", F.round(score, DIGITS).alias("score")), k)


def bm25_indexed(index: DataFrame, documents: int, average: float, terms: Sequence[str], k: int) -> DataFrame:
    """BM25 over a stored inverted index; only the postings of the query's terms are read."""
    some = index.filter(F.col("term").isin(list(dict.fromkeys(terms))))
    df = some.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    each = some.join(F.broadcast(df), "term").select("id", _bm25(F.col("tf"), F.col("df"), F.col("length"), F.lit(documents), F.lit(average)).alias("s"))
    return ranked(each.groupBy("id").agg(F.round(F.sum("s"), DIGITS).alias("score")), k)


def exact_names(rows: DataFrame, query: str, k: int, id: str = "id", name: str = "symbol") -> DataFrame:
    """Rows named so, with a member of that name, or with that prefix (id, name, score, rank): equal names first."""
    n = F.col(name)
    hit = rows.filter((n == query) | F.endswith(n, F.lit("." + query)) | F.startswith(n, F.lit(query)))
    low = F.lower(n)
    same = (low == query.lower()) | F.endswith(low, F.lit("." + query.lower()))
    return ranked(hit.select(F.col(id).alias("id"), n.alias("name"), F.when(same, 0.5).otherwise(0.2).alias("score")), k)


def fused(lists: Sequence[DataFrame], k: int, boosts: Sequence[bool] = ()) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: the sum of 1 / (60 + rank); a boosted list also adds its own score.

    Ties go to the earlier list, then the better rank, then the id. Rows (id, score, rank, lists).
    """
    parts = []
    for i, one in enumerate(lists):
        boost = F.col("score") if i < len(boosts) and boosts[i] else F.lit(0.0)
        parts.append(one.select("id", "rank", F.lit(i).alias("of"), (boost + F.lit(1.0) / (F.lit(RRF_K) + F.col("rank"))).alias("part")))
    every = reduce(DataFrame.unionByName, parts)
    sums = every.groupBy("id").agg(F.round(F.sum("part"), DIGITS + 3).alias("score"), F.min(F.struct("of", "rank")).alias("first"), F.count(F.lit(1)).alias("lists"))
    order = [F.desc("score"), F.col("first.of"), F.col("first.rank"), F.col("id")]
    top = sums.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).select("id", "score", "rank", "lists")


def deduplicated(rows: DataFrame, limit: float = 0.95, vector: str = "vector") -> DataFrame:
    """Of a short ranked list, the rows that aren't alike (cosine above the limit) to a better one that was kept.

    The outcome depends on the order, so the list (a few times the page size) is folded in one array. Rows without a
    vector are kept.
    """
    columns = [c for c in rows.columns]
    gathered = rows.agg(F.array_sort(F.collect_list(F.struct("rank", *(c for c in columns if c != "rank")))).alias("all"))
    none = F.filter("all", lambda x: F.lit(False))

    def step(kept: Column, x: Column) -> Column:
        alike = F.exists(kept, lambda y: F.coalesce(cosine(x[vector], y[vector]) > limit, F.lit(False)))
        return F.when(alike, kept).otherwise(F.array_append(kept, x))

    kept = gathered.select(F.explode(F.aggregate("all", none, step)).alias("x")).select("x.*")
    order = Window.orderBy("old")
    return kept.withColumnRenamed("rank", "old").withColumn("rank", F.row_number().over(order).cast("long")).drop("old").select(*columns)


def reranked(rows: DataFrame, query: str, as_of: str, wanted_files: Sequence[str] = ()) -> DataFrame:
    """Scores times 1 + the intent-weighted signals; rows need score, timestamp, files and haystack."""
    w = scoring.intent_weights(scoring.query_intent(F.lit(query)))
    boost = (
        w["recency"] * scoring.recency_boost(F.col("timestamp"), as_of)
        + w["files"] * scoring.file_overlap(F.col("files"), wanted_files)
        + w["keywords"] * scoring.keyword_density(F.lit(query), F.col("haystack"))
        + w["symbols"] * scoring.symbol_match(F.lit(query), F.col("haystack"))
    )
    return rows.withColumn("score", F.round(F.col("score") * (F.lit(1.0) + boost), DIGITS + 3))


def hybrid_search(
    chunks: DataFrame,
    query: str,
    vector: Sequence[float],
    k: int,
    as_of: str,
    agent: str | None = None,
    files: Sequence[str] = (),
    min_score: float = 0.0,
    dedup: float | None = 0.95,
    rerank: bool = True,
    text_search: bool = True,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """The k best chunks (id, score, rank) for a query text and its vector.

    chunks: id, text, agent, timestamp, files, and vector unless `vectors` (id, vector) holds them. The agent filter
    reaches both scans; the file filter comes after fusion, as it narrows the page, not the search.
    """
    rows = chunks if agent is None else chunks.filter(F.col("agent") == agent)
    fetch = over_fetch(k)
    source = rows if vectors is None else (vectors if agent is None else vectors.join(rows.select("id"), "id", "left_semi"))
    near = knn(source, vector, fetch)
    found = near
    if text_search:
        terms = [t for t in dict.fromkeys(_python_tokens(query))]
        found = fused([near, bm25(rows, terms, fetch)], fetch)
    page = found.select("id", "score", "rank").join(rows.select("id", "text", "timestamp", "files"), "id")
    if vectors is not None:
        page = page.join(vectors.select("id", "vector"), "id", "left")
    else:
        page = page.join(rows.select("id", "vector"), "id", "left")
    if files:
        page = page.filter(reduce(lambda a, b: a | b, (F.contains(F.lower("files"), F.lit(f.lower())) for f in files)))
    page = page.withColumnRenamed("text", "haystack")
    if dedup is not None:
        page = deduplicated(page, dedup)
    if rerank:
        page = reranked(page, query, as_of, files)
    if min_score > 0:
        page = page.filter(F.col("score") >= min_score)
    return ranked(page.select("id", "score"), k)


def _python_tokens(query: str) -> list[str]:
    import re

    from engram.functions.text import TOKEN_SPLIT

    return [t for t in re.split(TOKEN_SPLIT, query.lower()) if len(t) > 2]


def unified(transcripts: DataFrame, code: DataFrame, k: int, both: bool = True) -> DataFrame:
    """The k best of two result lists (id, score, summary); code weighs 0.85 where both are asked."""
    parts = [(transcripts, "transcript", 1.0), (code, "code", 0.85 if both else 1.0)]
    rows = reduce(DataFrame.unionByName, (d.select(F.lit(n).alias("source"), F.col("id").cast("string").alias("id"), F.round(F.col("score") * w, DIGITS + 3).alias("score"), "summary") for d, n, w in parts))
    return rows.orderBy(F.desc("score"), "source", "id").limit(k)


def search_trace(chunks: DataFrame, query: str, vector: Sequence[float], k: int, vectors: DataFrame | None = None) -> DataFrame:
    """(step, n, best): how many rows each step of a hybrid search gives, and its best score."""
    fetch = over_fetch(k)
    near = knn(chunks if vectors is None else vectors, vector, fetch)
    words = bm25(chunks, list(dict.fromkeys(_python_tokens(query))), fetch)
    both = fused([near, words], fetch)
    step = lambda name, d: d.agg(F.lit(name).alias("step"), F.count(F.lit(1)).alias("n"), F.round(F.max("score"), DIGITS).alias("best"))
    return step("vector", near).union(step("text", words)).union(step("fused", both))


def related_sessions(chunks: DataFrame, files: Sequence[str], vector: Sequence[float], as_of: str, k: int = 3, min_score: float = 0.0, vectors: DataFrame | None = None, dedup: float | None = 0.95) -> DataFrame:
    """Sessions about changed files: a search for them by name, within them."""
    query = "changes to " + ", ".join(files[:5])
    return hybrid_search(chunks, query, vector, k, as_of, files=files, min_score=min_score, vectors=vectors, dedup=dedup)

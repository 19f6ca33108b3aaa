"""From transcripts to chunks: pairing, chunk rows, incremental detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import text as X


def conversation_pairs(turns: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, pair, prompt, response): the user turns before each reply, joined by blank lines, and the reply.

    Other roles are ignored, replies without a question and questions without a reply are dropped. One window and one
    aggregation share the partitioning by session.
    """
    rows = turns.filter(F.col("role").isin("user", "assistant")).select(session, order, "role", F.coalesce("text", F.lit("")).alias("text"))
    before = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    grouped = rows.withColumn("_g", F.coalesce(F.count_if(F.col("role") == "assistant").over(before), F.lit(0)))
    asked = F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct(order, "text")))), lambda x: x["text"])
    pairs = grouped.groupBy(session, "_g").agg(asked.alias("asked"), F.max(F.when(F.col("role") == "assistant", F.col("text"))).alias("response"))
    kept = pairs.filter((F.size("asked") > 0) & F.col("response").isNotNull())
    nth = F.row_number().over(Window.partitionBy(session).orderBy("_g")) - 1
    return kept.select(session, nth.cast("long").alias("pair"), F.array_join("asked", "\n\n").alias("prompt"), "response")


def chunk_rows(pairs: DataFrame, prompts: DataFrame | None = None, diffs: DataFrame | None = None, session: str = "conv_id") -> DataFrame:
    """Chunks of sessions: id, prompt, response, diffSummary, summary, files, language, symbols, embeddingText.

    prompts: (session, prompts) for sessions without a pair, which give one chunk each. diffs: (session, diffSummary) from
    all turns, tool output included (`diff_summaries`), for a session's first chunk; else the reply's own lines are taken.
    """
    rows = pairs.select(session, "pair", "prompt", "response")
    if prompts is not None:
        alone = prompts.join(pairs.select(session).distinct(), session, "left_anti").filter("prompts <> ''")
        rows = rows.unionByName(alone.select(session, F.lit(0).cast("long").alias("pair"), F.col("prompts").alias("prompt"), F.lit("").alias("response")))
    prompt = X.clean_prompt(F.col("prompt"))
    if diffs is not None:
        rows = rows.join(diffs.select(session, F.col("diffSummary").alias("_diff")), session, "left")
    of_session = F.left(X.changed_lines(F.col("response")), F.lit(1500)) if diffs is None else F.coalesce("_diff", F.lit(""))
    diff = F.when(F.col("pair") == 0, of_session).otherwise("")
    made = rows.select(
        F.concat_ws("-", F.col(session).cast("string"), F.lit("0"), F.col("pair").cast("string")).alias("id"), prompt.alias("prompt"), X.truncated(F.col("response"), 4000).alias("response"), diff.alias("diffSummary"), F.col("response").alias("_whole")
    )
    names = F.slice(F.array_union(F.array_union(X.symbols(F.col("prompt")), X.symbols(F.col("_whole"))), X.added_symbols(F.col("diffSummary"))), 1, 30)
    files = X.files_changed(F.concat_ws("\n", "prompt", "_whole"))
    made = made.withColumn("symbols", names).withColumn("filesChanged", files)
    return made.select(
        "id", "prompt", "response", "diffSummary", X.fallback_summary(F.col("prompt"), F.col("response"), F.col("diffSummary")).alias("summary"), "filesChanged",
        X.language_of(F.col("filesChanged")).alias("language"), "symbols", X.embedding_text(F.col("symbols"), F.col("prompt"), F.col("response"), F.col("diffSummary")).alias("embeddingText"),
    )


def session_hashes(turns: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, contentHash) of each session's texts in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    return turns.groupBy(session).agg(X.content_hash(F.array_join(texts, "")).alias("contentHash"))


def new_or_changed(now: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """(key, state): `new` where the key isn't indexed, `changed` where its hash differs. One join, equal hashes dropped."""
    old = indexed.select(key, F.col("contentHash").alias("_old"), F.lit(True).alias("_known"))
    state = F.when(F.col("_known").isNull(), "new").when(~F.col("contentHash").eqNullSafe(F.col("_old")), "changed")
    return now.join(old, key, "left").select(key, state.alias("state")).filter("state is not null")


def diff_summaries(turns: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """(session, diffSummary): tool output that looks like a change, and declarations that replies add or remove, in order."""
    tool = (F.col("role") == "tool") & X.looks_like_change(F.col("text"))
    lines = X.changed_lines(F.col("text"))
    piece = F.when(tool, F.left("text", F.lit(1500))).when((F.col("role") == "assistant") & (lines != ""), F.left(lines, F.lit(1500)))
    rows = turns.select(session, order, piece.alias("piece"))
    pieces = F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct(order, "piece")))), lambda x: x["piece"])
    return rows.groupBy(session).agg(F.left(F.array_join(pieces, "\n"), F.lit(3000)).alias("diffSummary"))

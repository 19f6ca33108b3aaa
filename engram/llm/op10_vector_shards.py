"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

What is placed is a group of equal texts, or a cell of light groups: packing every group one after another is one task's
work, so groups that weigh less than 1 / `HEAVY` of a shard are folded by hash into `CELLS` cells, at every size of the
input. A heavy group stands alone, dealt out by doc_id in the fewest parts of at most `split` of a shard (a parameter of
`vector_shards`), as the law that sizes are near equal can't hold with any larger thing whole.
Cells, heavy groups and parts number a few ten thousand at most, whatever the input: only they reach the driver, where
each is placed, heaviest first, in the shard with the highest dot product of its vector and the shard's residual
capacity.

Tokens are counted as words, single digits and runs of marks, the units that byte-pair encoding works on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.shared import park

CELLS, HEAVY, SPLIT = 8192, 64, 0.25
TOKEN = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def pack(loads: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of loads: bytes, tokens, rows), by dot product with the residual capacity."""
    total = np.maximum(loads.sum(axis=0), 1)
    v = loads / total * shards  # 1 in each column fills a shard
    residual = np.ones((shards, loads.shape[1]))
    out = np.zeros(len(v), int)
    for i in np.lexsort((np.arange(len(v)), -v.max(axis=1))):
        fits = (residual >= v[i]).all(axis=1)
        dot = residual @ v[i]
        # An item that fits nowhere goes where it overflows least.
        s = int(np.argmax(np.where(fits, dot, -np.inf))) if fits.any() else int(np.argmin(np.maximum(v[i] - residual, 0).sum(axis=1)))
        residual[s] -= v[i]
        out[i] = s
    return out


def vector_shards(docs: DataFrame, shards: int = 40, split: float = SPLIT) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    size is the text's UTF-8 bytes plus 16; a null text has none and counts as a group of its own, with crc 0. The law is
    `bytes`. slot numbers a shard's rows from 0 without gaps. Rows of one text lie in one shard, unless they weigh more
    than `split` of a shard (in bytes, tokens or rows); then they are dealt out, those without a doc_id one by one. Repeated rows are separate rows of one group; a null doc_id is an
    ordinary value. An empty table gives an empty result. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = park(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
            F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long").alias("tokens"),
            F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
            F.xxhash64("text").alias("group"),
        )
    )
    load = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = rows.agg(*load).first()
    per = [max(1.0, (x or 0) / shards) for x in total]  # what a shard holds
    weight = F.greatest(*(F.col(c) / F.lit(p) for c, p in zip(("bytes", "tokens", "rows"), per, strict=True)))
    # At most 3 * shards * HEAVY groups weigh that much, so this table is small by construction.
    heavy = (
        rows.groupBy("group")
        .agg(*load)
        .withColumn("weight", weight)
        .filter(F.col("weight") >= 1 / HEAVY)
        .select("group", F.ceil(F.col("weight") / split).cast("long").alias("parts"))
    )
    placed = park(
        rows.join(F.broadcast(heavy), "group", "left").select(
            "doc_id",
            "size",
            "tokens",
            "text_crc32",
            F.when(F.col("parts").isNull(), F.pmod("group", F.lit(CELLS))).otherwise(F.col("group")).alias("cell"),
            F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id")), F.col("parts"))).cast("long").alias("part"),
        )
    )
    items = placed.groupBy("cell", "part").agg(*load).toPandas().sort_values(["cell", "part"])
    items["shard"] = pack(items[["bytes", "tokens", "rows"]].to_numpy(float).reshape(-1, 3), shards)
    items["first"] = items.groupby("shard")["rows"].cumsum() - items["rows"]
    where = spark.createDataFrame(
        pd.DataFrame({c: items[c].astype("int64").to_numpy() for c in ("cell", "part", "shard", "first")}), "cell long, part long, shard long, first long"
    )
    order = Window.partitionBy("cell", "part").orderBy("doc_id", "text_crc32")
    return (
        placed.withColumn("nth", F.row_number().over(order))
        .join(F.broadcast(where), ["cell", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("first") + F.col("nth") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )

"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable. A
conversation whose last turn isn't the assistant's also gets a closing example without a target, so the output holds
every turn. Turns are written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is doubled
and ``<|`` becomes ``<\\|``, so no text can forge a mark, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    """A role stands on one line: its line feeds become a backslash and n."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def chat_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_chars): loss_start counts code points from 0; no target: 0 and 0.

    Turns are ordered by turn (nulls first), equal turns by role, then text. Null roles and texts are empty. Rows with a
    null conv_id form one conversation. Repeated rows are repeated turns. Other columns are ignored. An empty table
    gives no example. The method itself writes a conversation up to each reply into one text, so a conversation is
    gathered in a row; it can be as long as a row may be, and different conversations are spread by hash.
    """
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    parts = talks.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                F.concat(F.lit(OPEN), escaped_role(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("target")
            ),
        ).alias("parts"),
    )
    ends = parts.select("conv_id", "parts", F.posexplode("parts").alias("at", "turn")).filter(F.col("turn.target") | (F.col("at") == F.size("parts") - 1))
    before = F.array_join(F.transform(F.slice("parts", 1, F.col("at")), lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return ends.select(
        "conv_id",
        F.col("at").cast("long").alias("example"),
        F.concat(before, "turn.head", "turn.body", F.lit(CLOSE)).alias("text"),
        F.when(F.col("turn.target"), F.length(before) + F.length("turn.head")).otherwise(0).cast("long").alias("loss_start"),
        F.when(F.col("turn.target"), F.length("turn.body")).otherwise(0).cast("long").alias("loss_chars"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: its turns, the text under the loss masks and the characters written."""
    masked = F.substring("text", F.col("loss_start") + 1, F.col("loss_chars"))
    talks = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"),
        F.array_sort(F.collect_list(F.struct("example", masked.alias("loss")))).alias("losses"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    turns = F.transform(
        F.slice(F.split("whole", r"<\|im_start\|>", -1), 2, 1 << 30),
        lambda t: F.struct(unescaped_role(F.substring_index(t, "\n", 1)).alias("role"), unescaped(F.substring(t, F.instr(t, "\n") + 1, F.length(t) - F.instr(t, "\n") - len(CLOSE))).alias("text")),
    )
    return talks.select("conv_id", turns.alias("turns"), F.transform("losses", lambda x: unescaped(x["loss"])).alias("losses"), "formatted_chars")


def chat_digests(turns: DataFrame) -> DataFrame:
    """The digests of each conversation, read back from its examples."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return read_back(chat_examples(turns)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )

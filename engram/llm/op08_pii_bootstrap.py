"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are the matches of fixed expressions (email, ip, card, phone) and long mixed hexadecimal strings. The two runs of
characters before an identifier-like token are its lexical pattern: words between blanks, or what stands glued to the
token's left; a text's start counts as such a run. Patterns and token values form a bipartite graph; scores run over it
for a few rounds: a pattern's score is the smoothed mean of its values' scores, a value's the best of its patterns', and
seeds stay at 1. Patterns with enough distinct values and a high score then mark every other token they introduce as an
identifier, which finds what the expressions miss. Base matches always stay.

Places in a text are running sums over arrays (`scan`) and text is cut through blocks of it, so time is in proportion to
the length of a text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.shared import hot_join, park, scratch

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the expressions, with the same leftmost matches: a failed run of characters is not tried again.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: An identifier-like token: a run of these characters with a digit or an @ in it.
TOKEN = r"(?<![A-Za-z0-9._%+@/:-])[A-Za-z._%+/:-]*+[0-9@][A-Za-z0-9._%+@/:-]*+"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SECRET = r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}$"
#: Parameters of the method: characters of a token at least, rounds of scores, and what makes a pattern confident: so many
#: distinct values at least, and such a score.
LEAST_TOKEN, ROUNDS, SUPPORT, CONFIDENT = 6, 3, 5, 0.6
#: Elements that a scan works on at a time, and characters of a block of text.
SCAN, BLOCK = 128, 1024

SPAN = "struct<start:int,rank:int,kind:string,end:int,value:string>"
NONE = f"cast(array() as array<{SPAN}>)"
NO_TOKENS = f"cast(array() as array<{SPAN[:-1]},pattern:bigint>>)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once for a row, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(array: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The running results of a fold: zero, then step(result before, element) for each element.

    Folds append to an array by copying it, so they run over SCAN elements at a time.
    """
    blocks = F.when(F.size(array) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / SCAN).cast("int")), lambda b: F.slice(array, b * SCAN + 1, SCAN)))
    last = lambda x: F.element_at(x, -1)
    inner = lambda out, block: F.aggregate(block, F.array(last(last(out))), lambda o, x: F.concat(o, F.array(step(last(o), x))))
    done = F.aggregate(blocks, F.array(F.array(zero)), lambda out, block: F.concat(out, F.array(inner(out, block))))
    # Each block begins with the result before it.
    return F.coalesce(F.concat(F.array(zero), F.flatten(F.transform(F.slice(done, 2, 1 << 30), lambda o: F.slice(o, 2, SCAN)))), F.array(zero))


def found(text: Column, pattern: str, rank: int, kind: str, keep: Callable[[Column], Column], gate: Column) -> Column:
    """The spans (code points, end exclusive) of the leftmost matches that `keep` admits."""

    def spans(hits: Column) -> Column:
        both = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits, lambda p, h: F.length(p) + F.length(h))
        ends = lambda e: F.transform(
            hits,
            lambda h, i: F.struct(
                (F.get(e, i + 1) - F.length(h)).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.get(e, i + 1).alias("end"), h.alias("value")
            ),
        )
        return let(let(both, lambda n: scan(n, F.lit(0), lambda at, x: at + x)), ends)

    every = F.when(gate, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(F.expr(NONE))
    return F.filter(every, lambda s: keep(s["value"]))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    d = F.reverse(digits(value))

    def step(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    n = F.length(d)
    # Both tests read digits only where there are 14 to 19 of them.
    return F.when(n.between(14, 19), F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(19))), F.lit(0), step) % 10 == 0).otherwise(False)


def base_spans(text: Column) -> Column:
    """The base matches, by start, then kind in the order of KINDS."""
    some = text.rlike("[0-9]")
    return F.array_sort(
        F.concat(
            found(text, EMAIL, 0, "email", lambda v: F.lit(True), F.contains(text, F.lit("@"))),
            found(text, IP, 1, "ip", lambda v: v.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"), text.rlike(r"[0-9]\.[0-9]")),
            found(text, CARD, 2, "card", luhn, some),
            found(text, PHONE, 3, "phone", lambda v: F.length(digits(v)).between(10, 15), F.contains(text, F.lit("+"))),
        )
    )


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def tokens(text: Column) -> Column:
    """The identifier-like tokens of a text, in order, as (start, rank, kind, end, value, pattern).

    The text is cut into words, blanks before them included. A token's pattern hashes, with digits as 0 and in lower
    case, the two runs before it: the word's characters between the token before (that one included) and it, if any, then
    the words before.
    """
    plain = lambda x: F.lower(F.translate(x, "123456789", "000000000"))
    word = lambda words, i: F.when(i < 0, "").otherwise(F.trim(plain(F.get(words, i)), F.lit(" \t\n\x0b\f\r")))

    def of_word(words: Column, starts: Column, i: Column) -> Column:
        def spans(hits: Column, between: Column) -> Column:
            both = F.zip_with(F.slice(between, 1, F.size(hits)), hits, lambda p, h: F.length(p) + F.length(h))

            def one(ends: Column) -> Column:
                def token(h: Column, k: Column) -> Column:
                    end = F.get(starts, i) + F.get(ends, k + 1)
                    # All blanks of a word stand before its first token.
                    glued = F.concat(F.when(k > 0, plain(F.get(hits, k - 1))).otherwise(""), F.trim(plain(F.get(between, k)), F.lit(" \t\n\x0b\f\r")))
                    pattern = F.when(glued == "", F.xxhash64(word(words, i - 2), word(words, i - 1))).otherwise(F.xxhash64(word(words, i - 1), glued))
                    return F.struct((end - F.length(h)).alias("start"), F.lit(4).alias("rank"), F.lit("id").alias("kind"), end.alias("end"), h.alias("value"), pattern.alias("pattern"))

                return F.transform(hits, token)

            return let(scan(both, F.lit(0), lambda at, x: at + x), one)

        w = F.get(words, i)
        return let(F.regexp_extract_all(w, F.lit(TOKEN), F.lit(0)), lambda hits: let(F.split(w, TOKEN, -1), lambda between: spans(hits, between)))

    def of_words(words: Column) -> Column:
        def placed(starts: Column) -> Column:
            marked = F.filter(F.transform(words, lambda w, i: F.when(w.rlike("[0-9@]"), i)), lambda i: i.isNotNull())
            return F.flatten(F.transform(marked, lambda i: of_word(words, starts, i)))

        return let(let(F.transform(words, lambda w: F.length(w)), lambda n: scan(n, F.lit(0), lambda at, x: at + x)), placed)

    every = F.when(text.rlike("[0-9@]"), let(F.regexp_extract_all(text, F.lit(r"\s*+\S++"), F.lit(0)), of_words)).otherwise(F.expr(NO_TOKENS))
    return F.filter(every, lambda t: F.length(t["value"]) >= LEAST_TOKEN)


def overlapping(tokens: Column, base: Column) -> Column:
    """For each token, in order, whether a base span overlaps it: tokens and spans are walked together, from both ends."""
    event = lambda s, t: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(t).alias("token"))
    merged = F.array_sort(F.concat(F.transform(tokens, lambda t: event(t, 1)), F.transform(base, lambda b: event(b, 0))))

    def marks(e: Column) -> Column:
        # How far the spans that began before reach, and where the next span begins.
        reach = lambda a, x: F.greatest(a, F.when(x["token"] == 0, x["end"]).otherwise(0))
        near = lambda a, x: F.least(a, F.when(x["token"] == 0, x["start"]).otherwise((1 << 31) - 1))
        ends, starts, n = scan(e, F.lit(0), reach), scan(F.reverse(e), F.lit((1 << 31) - 1), near), F.size(e)
        both = lambda far, close: F.filter(
            F.transform(e, lambda x, i: F.when(x["token"] == 1, (F.get(far, i) > x["start"]) | (F.get(close, n - 1 - i) < x["end"]))), lambda k: k.isNotNull()
        )
        return let(ends, lambda far: let(starts, lambda close: both(far, close)))

    return F.when(F.size(base) == 0, F.transform(tokens, lambda t: F.lit(False))).otherwise(let(merged, marks))


def confident_patterns(seen: DataFrame) -> DataFrame:
    """Patterns (pattern, score) with SUPPORT distinct values at least and a score of CONFIDENT, from (pattern, value, seed)."""
    with scratch(seen.sparkSession) as kept:
        edges = park(seen.groupBy("pattern", "value").agg(F.max("seed").cast("double").alias("seed")))
        mass = lambda x: (F.count(F.lit(1)).alias("support"), F.sum(x).alias("mass"))
        score = (F.col("mass") / (F.col("support") + 1)).alias("score")
        patterns = park(edges.groupBy("pattern").agg(*mass("seed")))
        for _ in range(ROUNDS):
            scores = patterns.select("pattern", score)
            values = park(hot_join(edges, scores, "pattern").groupBy("value").agg(F.greatest(F.max("seed"), F.max("score")).alias("belief")))
            patterns = park(hot_join(edges, values, "value").groupBy("pattern").agg(*mass("belief")))
        sure = park(patterns.select("pattern", "support", score).filter(f"support >= {SUPPORT} and score >= {CONFIDENT}").select("pattern", "score"))
        kept.append(sure)
    return sure


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, h, base, spans) for every row: arrays of (start, rank, kind, end, value), by start, then kind.

    A null text is empty and has no spans. Repeated rows get equal results; a null doc_id is an ordinary value. Other
    columns are ignored. An empty table gives an empty result. Spans of kind `id` are the discovered ones; they don't
    overlap base spans.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    with scratch(docs.sparkSession) as kept:
        with_known = lambda base: lambda t: F.zip_with(
            t, overlapping(t, base), lambda s, k: F.struct(*(s[c].alias(c) for c in ("start", "rank", "kind", "end", "value", "pattern")), k.alias("known"))
        )
        both = let(base_spans(F.col("text")), lambda base: F.struct(base.alias("base"), let(tokens(F.col("text")), with_known(base)).alias("tokens")))
        rows = park(keyed.select("doc_id", "h", both.alias("both")).select("doc_id", "h", "both.base", "both.tokens"))
        each = rows.select("doc_id", "h", F.explode("tokens").alias("t")).select("doc_id", "h", "t.*")
        seen = each.select("pattern", F.xxhash64("value").alias("value"), (F.col("known") | F.col("value").rlike(SECRET)).cast("int").alias("seed"))
        sure = confident_patterns(seen)
        fresh = park(each.filter("not known"))
        new = park(
            hot_join(fresh, sure, "pattern")
            .groupBy(F.col("doc_id").alias("d"), F.col("h").alias("k"))
            .agg(F.collect_set(F.struct("start", "rank", "kind", "end", "value")).alias("new"))
        )
        kept += [rows, new]
    return rows.join(new, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left").select(
        "doc_id", "h", "base", F.array_sort(F.concat("base", F.coalesce("new", F.expr(NONE)))).alias("spans")
    )


def personal_data_digest(docs: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return personal_data(docs).select("doc_id", *(count(k) for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans, the first counts."""

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        part = lambda k: F.substring(F.get(blocks, k), F.greatest(a - k * BLOCK, F.lit(0)) + 1, F.least(b - k * BLOCK, F.lit(BLOCK)) - F.greatest(a - k * BLOCK, F.lit(0)))
        ks = F.sequence(F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int"))
        return F.when(b > a, F.array_join(F.transform(ks, part), "")).otherwise("")

    def put(blocks: Column, ends: Column) -> Column:
        # A span that begins before the ones before it end is left out.
        kept = lambda s, i: F.when(s["start"] >= F.get(ends, i), F.concat(piece(blocks, F.get(ends, i), s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")
        n = F.length(text)
        return F.concat(F.array_join(F.transform(spans, kept), ""), piece(blocks, F.element_at(ends, -1), n))

    ends = scan(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(let(blocks, lambda b: let(ends, lambda e: put(b, e))))


def without_personal_data(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns; texts with spans have them masked. Null texts stay null."""
    found = personal_data(docs).filter("size(spans) > 0").select(F.col("doc_id").alias("__engram_d"), F.col("h").alias("__engram_h"), F.col("spans").alias("__engram_spans")).dropDuplicates(["__engram_d", "__engram_h"])
    same = F.col("__engram_key").eqNullSafe(F.col("__engram_d")) & (F.col("__engram_hash") == F.col("__engram_h"))
    joined = docs.withColumn("__engram_key", F.col("doc_id").cast("long")).withColumn("__engram_hash", F.xxhash64("text")).join(found, same, "left")
    text = F.when(F.col("__engram_spans").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.coalesce("__engram_spans", F.expr(NONE)))).alias("text")
    return joined.select(*(text if c == "text" else F.col(c) for c in docs.columns))

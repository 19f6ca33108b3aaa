"""Ranking signals and score steps as column expressions. "Now" is always a parameter."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions.text import QUERY_SYMBOL_PATTERN, tokens

# Rerank weights (recency, file overlap, keyword density, symbol match) and the patterns of each intent.
INTENT_WEIGHTS = {
    "recent_change": (0.5, 0.2, 0.2, 0.1),
    "how_it_works": (0.05, 0.15, 0.5, 0.3),
    "find_code": (0.05, 0.2, 0.25, 0.5),
    "debug": (0.2, 0.3, 0.3, 0.2),
    "default": (0.15, 0.25, 0.35, 0.25),
}
INTENT_PATTERNS = {
    "recent_change": [
        r"\b(last|latest|recent|newest|new)\b",
        r"\b(changed?|updated?|modified)\b",
        r"\b(yesterday|today|week|session)\b",
        r"\bwhat.*(changed?|added?|updated?|modified)\b",
        r"\b(current|now)\b",
    ],
    "how_it_works": [
        r"\bhow\s+(does|do|is|are|can|to)\b",
        r"\bwhat\s+(is|are|does|do)\b",
        r"\b(explain|understand|learn|know)\b",
        r"\b(works?|working|implement(s|ed|ation)?)\b",
        r"\b(mechanism|approach|strategy|pattern)\b",
    ],
    "find_code": [
        r"\b(find|locate|search|where)\b",
        r"\bwhere\s+(is|are|can|to)\b",
        r"\b(function|class|method|component|module)\s+\w+",
        r"\b\w+(function|class|method|component)\b",
        r"\bcode\s+for\b",
    ],
    "debug": [
        r"\b(error|bug|issue|problem|fail|crash|break)\b",
        r"\b(fix|solve|debug|troubleshoot)\b",
        r"\b(why|when|where).*(error|fail|break|wrong)\b",
        r"\b(not\s+work|doesn't\s+work|isn't\s+work)\b",
        r"\b(exception|stack\s+trace)\b",
    ],
}
HALF_LIFE_DAYS = 14
#: Weights of vector, full text, exact name, popularity, freshness, simplicity and context.
SIGNALS = {"vector": 0.35, "text": 0.20, "exact": 0.15, "popularity": 0.15, "freshness": 0.05, "simplicity": 0.05, "context": 0.05}


def query_intent(query: Column) -> Column:
    q = F.lower(F.trim(query))
    out = F.lit("default")
    for intent in reversed(INTENT_PATTERNS):
        hits = sum((q.rlike(p).cast("int") for p in INTENT_PATTERNS[intent]), F.lit(0))
        out = F.when((hits >= 2) | ((hits == 1) & (F.length(q) < 50)), F.lit(intent)).otherwise(out)
    return out


def intent_weights(intent: Column) -> Column:
    """struct(recency, files, keywords, symbols) of an intent."""
    rows = {k: F.struct(*(F.lit(x).alias(n) for x, n in zip(v, ("recency", "files", "keywords", "symbols"), strict=True))) for k, v in INTENT_WEIGHTS.items()}
    out = rows["default"]
    for k in ("recent_change", "how_it_works", "find_code", "debug"):
        out = F.when(intent == k, rows[k]).otherwise(out)
    return out


def age_days(timestamp: Column, as_of: str) -> Column:
    """Days from an ISO timestamp (text) to as_of; null where it is empty or no timestamp."""
    micros = lambda t: F.unix_micros(t)
    return (micros(F.lit(as_of).cast("timestamp")) - micros(F.try_to_timestamp(timestamp))) / 86_400_000_000.0


def recency_boost(timestamp: Column, as_of: str) -> Column:
    return F.coalesce(F.exp(F.lit(-math.log(2)) * age_days(timestamp, as_of) / HALF_LIFE_DAYS), F.lit(0.0))


def file_overlap(files: Column, wanted: Sequence[str]) -> Column:
    """The share of the wanted files that are mentioned."""
    if not wanted:
        return F.lit(0.0)
    hits = sum((F.contains(F.lower(files), F.lit(w.lower())).cast("int") for w in wanted), F.lit(0))
    return F.coalesce(hits / float(len(wanted)), F.lit(0.0))


def keyword_density(query: Column, haystack: Column) -> Column:
    """The share of the query's tokens, repeats counted, that occur in the haystack."""
    t = tokens(query)
    low = F.lower(haystack)
    return F.when(F.size(t) > 0, F.size(F.filter(t, lambda x: F.contains(low, x))) / F.size(t)).otherwise(0.0)


def symbol_match(query: Column, text: Column) -> Column:
    """The share of the names that the query declares or mentions that occur in the text."""
    declared = F.transform(F.regexp_extract_all(query, F.lit(QUERY_SYMBOL_PATTERN), F.lit(1)), F.lower)
    free = F.filter(tokens(query), lambda t: (F.length(t) >= 4) & t.rlike("^[a-z]"))
    names, low = F.array_union(declared, free), F.lower(text)
    return F.when(F.size(names) > 0, F.size(F.filter(names, lambda x: F.contains(low, x))) / F.size(names)).otherwise(0.0)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def min_max(x: Column, low: Column, high: Column, clamped: bool = True) -> Column:
    """x on the scale from low to high; 0.5 where they are equal."""
    scaled = (x - low) / F.nullif(high - low, F.lit(0.0))
    return F.when(high == low, 0.5).otherwise(clamp(scaled) if clamped else scaled)


def exact_name_score(symbol: Column, query: Column) -> Column:
    s, q = F.lower(symbol), F.lower(query)
    initials = F.lower(F.regexp_replace(symbol, "[a-z]", ""))
    return F.when(s == q, 1.0).when(F.startswith(s, q), 0.8).when(F.contains(s, q), 0.5).when(initials == q, 0.6).otherwise(0.0)


def steps(x: Column, bounds: Sequence[tuple[float, float]], rest: float, inclusive: bool = True) -> Column:
    """The value of the first bound that x doesn't exceed (or, exclusive, is below); rest beyond all and for null."""
    out = F.when(F.lit(False), F.lit(rest))
    for bound, value in bounds:
        out = out.when(x <= bound if inclusive else x < bound, value)
    return out.otherwise(rest)


def freshness(age: Column) -> Column:
    return steps(age, [(7, 1.0), (30, 0.8), (90, 0.5)], 0.2, inclusive=False)


def simplicity(cyclomatic: Column) -> Column:
    return steps(cyclomatic, [(5, 1.0), (10, 0.8), (15, 0.5), (20, 0.3)], 0.1)


def context_score(path: Column, current_file: str | None, current_dir: str | None) -> Column:
    if not current_file and not current_dir:
        return F.lit(0.5)
    same = (path == current_file).cast("double") if current_file else F.lit(0.0)
    near = F.contains(path, F.lit(current_dir)).cast("double") * 0.5 if current_dir else F.lit(0.0)
    return F.least(F.lit(1.0), same + near)


def multi_signal(exact: Column, score: Column, popularity: Column, fresh: Column, simple: Column, context: Column) -> Column:
    """The weighted sum of seven signals; a search score stands for the vector part by 0.7 and the text part by 0.3."""
    w = SIGNALS
    return (
        w["exact"] * exact + w["vector"] * clamp(0.7 * score) + w["text"] * clamp(0.3 * score) + w["popularity"] * popularity
        + w["freshness"] * fresh + w["simplicity"] * simple + w["context"] * context
    )


def js_round(x: Column) -> Column:
    """Round half up, also below zero."""
    return F.floor(x + 0.5)

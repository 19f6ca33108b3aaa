"""Short texts for people: ages, pairs of files, risks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions.code import risk_level


def relative_time(at: Column, now: str) -> Column:
    """The age of a time (without zone) in whole minutes, hours, days or months of thirty days."""
    minutes = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 60_000_000)
    text = lambda n, unit: F.concat(n.cast("long").cast("string"), F.lit(f"{unit} ago"))
    in_units = [(60, 1, "m"), (24 * 60, 60, "h"), (30 * 24 * 60, 24 * 60, "d")]
    out = F.when(minutes < 1, "just now")
    for below, size, unit in in_units:
        out = out.when(minutes < below, text(F.floor(minutes / size), unit))
    return out.otherwise(text(F.floor(minutes / (30 * 24 * 60)), "mo"))


def percent(share: Column) -> Column:
    return F.concat(F.floor(share * 100 + 0.5).cast("string"), F.lit("%"))


def pair_label(one: Column, two: Column, confidence: Column, times: Column) -> Column:
    return F.concat(one, F.lit(" ↔ "), two, F.lit(" ("), percent(confidence), F.lit(", "), times.cast("string"), F.lit(" times)"))


def risk_label(score: Column) -> Column:
    return F.concat(risk_level(score), F.lit(" "), F.floor(score + 0.5).cast("string"), F.lit("/100"))


def pattern_label(pattern: Column, symbol: Column, confidence: Column) -> Column:
    return F.concat(pattern, F.lit(" in "), symbol, F.lit(" ("), percent(confidence), F.lit(")"))


def signals_label(signals: dict[str, Column]) -> Column:
    """Ranking signals by name, to three digits."""
    return F.concat_ws(", ", *(F.format_string(f"{name}: %.3f", value) for name, value in signals.items()))

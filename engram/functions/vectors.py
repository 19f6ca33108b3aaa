"""Vector expressions in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to this width a vector expression is written out, so that it is compiled with the rest of its stage.
UNROLLED = 128


def _sum(terms: list[Column]) -> Column:
    """A balanced sum: a deep left-leaning tree would exhaust the stack of the compiler."""
    while len(terms) > 1:
        terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
    return terms[0]


def dot_literal(v: Column, q: Sequence[float]) -> Column:
    if len(q) <= UNROLLED:
        return _sum([F.get(v, F.lit(i)).cast("double") * F.lit(float(x)) for i, x in enumerate(q)])
    return dot(v, F.array(*(F.lit(float(x)) for x in q)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def distance(v: Column, q: Sequence[float], metric: str = "l2sq") -> Column:
    """Distance to a literal query vector: `l2sq` (squared Euclidean), `cosine` (1 - similarity) or `dot` (negated product)."""
    if metric == "l2sq":
        if len(q) <= UNROLLED:
            each = [F.get(v, F.lit(i)).cast("double") - F.lit(float(x)) for i, x in enumerate(q)]
            return _sum([d * d for d in each])
        other = F.array(*(F.lit(float(x)) for x in q))
        return F.aggregate(F.zip_with(v, other, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    product = dot_literal(v, q)
    if metric == "dot":
        return -product
    if metric == "cosine":
        length = float(sum(float(x) ** 2 for x in q)) ** 0.5
        n = norm(v) * F.lit(length)
        return F.lit(1.0) - F.when(n > 0, product / n).otherwise(0.0)
    raise ValueError(f"unknown metric {metric}")

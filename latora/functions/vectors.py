"""Vector expressions over ARRAY<DOUBLE> columns, written out term by term so that they are compiled."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def total(terms: Sequence[Column]) -> Column:
    """Sum as a balanced tree, so that wide vectors don't nest deeply."""
    terms = list(terms) or [F.lit(0.0)]
    while len(terms) > 1:
        terms = [reduce(lambda a, b: a + b, terms[k : k + 2]) for k in range(0, len(terms), 2)]
    return terms[0]


def dot(a: Column, b: Column | Sequence[float], width: int) -> Column:
    other = b if isinstance(b, Column) else [F.lit(float(x)) for x in b]
    return total([a[k] * other[k] for k in range(width)])


def clip(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))


def norm(a: Column, width: int) -> Column:
    return F.sqrt(dot(a, a, width))


def unit(a: Column, width: int) -> Column:
    """The vector at length 1; a vector shorter than ``TINY`` stays."""
    n = norm(a, width)
    safe = F.when(n < TINY, F.lit(1.0)).otherwise(n)
    return F.transform(a, lambda x: x / safe)


def cosine(a: Column, b: Column, width: int) -> Column:
    """Cosine in [-1, 1]; 0 where a vector is shorter than ``TINY``."""
    na, nb = norm(a, width), norm(b, width)
    return F.when((na < TINY) | (nb < TINY), 0.0).otherwise(clip(F.try_divide(dot(a, b, width), na * nb)))


def linear(a: Column, rows: Sequence[Sequence[float]], shift: Sequence[float] | None = None) -> Column:
    """rows x a + shift, as an array."""
    shift = shift if shift is not None else [0.0] * len(rows)
    return F.array(*(dot(a, row, len(row)) + F.lit(float(s)) for row, s in zip(rows, shift)))

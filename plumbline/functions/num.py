"""Numeric expressions that give the same value in every engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def rnd(x: Column, digits: int) -> Column:
    """Half up on the binary value; unlike ``round`` it does not go through decimal text."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def log_saturate(n: Column, scale: float, base: float = 10.0) -> Column:
    return F.least(F.lit(1.0), F.log(base, n + 1) / scale)


def band(score: Column, medium: float, high: float) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0))


def jsd(p: list[Column], q: list[Column], eps: float = 1e-10) -> Column:
    """Jensen-Shannon divergence (natural log) of two distributions, smoothed and normalised again."""
    sp, sq = total([x + eps for x in p]), total([x + eps for x in q])
    terms = []
    for x, y in zip(p, q, strict=True):
        a, b = (x + eps) / sp, (y + eps) / sq
        m = (a + b) / 2
        terms.append(a * F.log(a / m) / 2 + b * F.log(b / m) / 2)
    return total(terms)

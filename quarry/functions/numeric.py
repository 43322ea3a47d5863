"""Scores as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 if either has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def bm25_weight(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(tf: Column, length: Column, mean: Column, weight: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.greatest(mean, F.lit(1.0))))


def rrf(rank: Column, k: int = 60) -> Column:
    """Share of a hit by its rank, from 1."""
    return F.lit(1.0) / (F.lit(k) + rank)


def grade_band(percent: Column) -> Column:
    return F.when(percent >= 80, "good").when(percent >= 60, "pass").otherwise("weak")


# Prices for 1,000 tokens in and out.
PRICES = {"deepseek-chat": (0.001, 0.002), "deepseek-reasoner": (0.004, 0.016), "gpt-4o": (0.015, 0.060), "gpt-4o-mini": (0.00015, 0.00060)}


def cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """-1 for a model without a price."""
    prices = F.create_map(*[x for k, v in PRICES.items() for x in (F.lit(k), F.array(F.lit(v[0]), F.lit(v[1])))])
    return F.coalesce(tokens_in / 1000 * prices[model][0] + tokens_out / 1000 * prices[model][1], F.lit(-1.0))


def backoff(attempt: Column, base: float = 0.8) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), attempt)


def half_up(x: Column, places: int) -> Column:
    """``x`` in steps of 10**-places, halves away from 0, as SQL's round of a double: decided on the scaled double, not on its decimal digits."""
    return F.round(x * float(10**places)) / float(10**places)

"""Cosine similarity of float arrays, computed in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(dot_product: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine in [-1, 1]; 0 if one of the vectors is zero."""
    raw = dot_product / (norm_a * norm_b)
    kept = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))
    return F.when((norm_a == 0) | (norm_b == 0), F.lit(0.0)).otherwise(kept)


def match_percent(score: Column) -> Column:
    return F.round(score * 100, 1)

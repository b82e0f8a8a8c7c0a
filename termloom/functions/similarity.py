"""Similarity of a found key to the searched one, and the score scale, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def similar(searched: str, found: Column) -> Column:
    """1 for equal words, 0.75 for equal length, else half the share of the searched length; 0 if the found is shorter."""
    n = len(searched)
    length = F.length(found)
    return (
        F.when(found == searched, 1.0).when(length == n, 0.75).when(length > n, F.lit(0.5 * n) / length).otherwise(0.0)
    )


def sigma(mean: Column) -> Column:
    return F.greatest(F.abs(mean), F.lit(10.0)) / F.lit(10.0)


def _bell(mean: Column, found: Column) -> Column:
    return F.exp(-F.pow(found - mean, F.lit(2.0)) / (F.lit(2.0) * F.pow(sigma(mean), F.lit(2.0))))


def similar_int(searched: int, found: Column) -> Column:
    """Bell curve around the searched value."""
    return _bell(F.lit(float(searched)), found.cast("double"))


def similar_range_int(lower: int, upper: int, found: Column) -> Column:
    """Bell curve around the middle of the range."""
    return _bell(F.lit((lower + upper) / 2), found.cast("double"))


def default_similarity(_: object = None) -> Column:
    return F.lit(1.0)


def make_score(value: Column) -> Column:
    """0 stands for 'not set'; nothing is less."""
    return F.greatest(value, F.lit(0.0))


def to_default_score(value: Column) -> Column:
    return F.when(value == 0.0, 1.0).otherwise(value)


def from_default_score(value: Column) -> Column:
    return F.when(value == 1.0, 0.0).otherwise(value)


def mean_score(scores: Column) -> Column:
    """Mean of an array of scores; 0 for none."""
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(scores) > 0, total / F.size(scores)).otherwise(0.0)

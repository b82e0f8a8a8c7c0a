"""Occurrences (doc_id, positions) and position arrays as set algebra."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Positions: sorted arrays without repetition.


def positions(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def union_positions(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def intersect_positions(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def subtract_positions(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def has_position(a: Column, position: int) -> Column:
    return F.array_contains(a, position)


# Occurrences: DataFrames of doc_id, positions; each document once.


def merge(*parts: DataFrame) -> DataFrame:
    """Positions of a document in any part."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("doc_id").agg(positions(F.flatten(F.collect_list("positions"))).alias("positions"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents of ``a`` that are not in ``b``."""
    return a.join(b, "doc_id", "left_anti")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a`` without the positions in ``b``; documents without positions go."""
    rows = a.join(b.select("doc_id", F.col("positions").alias("_b")), "doc_id", "left")
    left = F.when(F.col("_b").isNull(), F.col("positions")).otherwise(subtract_positions(F.col("positions"), F.col("_b")))
    return rows.select("doc_id", left.alias("positions")).where(F.size("positions") > 0)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents of both, with the positions they share; documents without go."""
    rows = a.join(b.select("doc_id", F.col("positions").alias("_b")), "doc_id")
    return rows.select("doc_id", intersect_positions(F.col("positions"), F.col("_b")).alias("positions")).where(F.size("positions") > 0)


def size(a: DataFrame) -> DataFrame:
    """doc_id, n: positions of each document."""
    return a.select("doc_id", F.size("positions").alias("n"))

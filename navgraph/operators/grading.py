"""Candidates and graded evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(grades: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The label of the first condition that holds; a null condition does not hold."""
    out = None
    for condition, label in grades:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(otherwise) if otherwise is not None else out


def count_levels(graded: DataFrame, keys: list[str], level: str = "level") -> DataFrame:
    """Rows by key and level."""
    return graded.groupBy(*keys, level).agg(F.count("*").alias("n"))


def best_rank(candidates: DataFrame, keys: list[str], rank: str, ties: list[str]) -> DataFrame:
    """For each key the first candidate of the lowest rank, ties by ``ties``; one aggregate over structs."""
    rest = [c for c in candidates.columns if c not in {*keys, rank, *ties}]
    best = candidates.groupBy(*keys).agg(F.min(F.struct(rank, *ties, *rest)).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in [rank, *ties, *rest]))

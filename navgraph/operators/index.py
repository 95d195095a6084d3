"""Inverted index over text (token to document, line and order)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"


def token_index(df: DataFrame, id_col: str, text_col: str, pattern: str = IDENTIFIER) -> DataFrame:
    """``id_col, line, ord, token``: lines and the tokens in a line count from 1. A projection: nothing is shuffled."""
    lines = df.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line0", "text"))
    tokens = lines.select(id_col, "line0", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("ord0", "token"))
    return tokens.select(id_col, (F.col("line0") + 1).cast("long").alias("line"), (F.col("ord0") + 1).cast("long").alias("ord"), "token")


def first_occurrences(index: DataFrame, id_col: str) -> DataFrame:
    """The first place of each token in each document: an aggregate (combined map-side) instead of a window."""
    first = index.groupBy(id_col, "token").agg(F.min(F.struct("line", "ord")).alias("first"))
    return first.select(id_col, F.col("first.line").alias("line"), F.col("first.ord").alias("ord"), "token")


def usages(index: DataFrame, token: str, id_col: str, limit: int) -> DataFrame:
    """Places of one token in order; one more than ``limit`` so that a caller sees whether there are more."""
    return index.where(F.col("token") == token).orderBy(id_col, "line", "ord").limit(limit + 1)

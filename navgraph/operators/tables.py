"""Set comparison, pairing, roll-up, paging, coverage and hierarchy descent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drift(known: DataFrame, found: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """``key, change``: added, removed, or changed in a compared column; rows that agree are left out."""
    a = known.select(F.col(key).alias("__a"), *(F.col(c).alias(f"__a_{c}") for c in compared))
    b = found.select(F.col(key).alias("__b"), *(F.col(c).alias(f"__b_{c}") for c in compared))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~same, "changed")
    return a.join(b, F.col("__a") == F.col("__b"), "full_outer").select(F.coalesce("__a", "__b").alias(key), change.alias("change")).where("change IS NOT NULL")


def roll_up(df: DataFrame, key: Column, size: str | None = None) -> DataFrame:
    """Rows, and the sum of ``size``, by a key expression."""
    sums = [F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes")] if size else []
    return df.groupBy(key.alias("folder")).agg(F.count("*").alias("n"), *sums)


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page in ``order`` with the total, whether there is more and where the next page starts.

    The total is its own aggregate beside the page, so that the page is a top-k and no window holds all rows.
    """
    if not 0 <= offset or not 1 <= limit <= 200:
        raise ValueError("offset must be 0 or more, limit from 1 to 200")
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))
    more = F.col("total") > offset + limit
    return rows.withColumns({"has_more": more, "next_offset": F.when(more, F.lit(offset + limit).cast("long"))})


def coverage(df: DataFrame, scope: str, sound: Column) -> DataFrame:
    """By scope: rows, unsound rows, and ``complete`` or ``partial``."""
    failed = F.count_if(~sound)
    return df.groupBy(scope).agg(F.count("*").alias("n"), failed.alias("failed"), F.when(failed == 0, "complete").otherwise("partial").alias("coverage"))


def descend(start: DataFrame, closure: DataFrame, names: DataFrame, segments: list[str]) -> DataFrame:
    """Nodes reached from ``start`` (``root, node``) by a path of names whose steps may skip levels.

    ``closure`` has every ``anc, node`` pair (a node is not its own ancestor), ``names`` has ``node, name``; the last
    segment may end in ``*`` for a beginning.
    """
    here = start
    for k, segment in enumerate(segments):
        last_prefix = k == len(segments) - 1 and segment.endswith("*")
        fits = F.col("name").startswith(segment[:-1]) if last_prefix else F.col("name") == segment
        below = closure.join(names.where(fits), "node").select(F.col("anc"), "node")
        here = here.withColumnRenamed("node", "anc").join(below, "anc").select("root", "node").distinct()
    return here


def grade_hits(wanted: DataFrame, hits: DataFrame, key: list[str]) -> DataFrame:
    """``level`` by the number of hits: EXACT for one, MULTI for more, MISS for none."""
    n = hits.groupBy(*key).agg(F.count("*").alias("n"))
    counted = wanted.join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.withColumn("level", F.when(F.col("n") == 1, "EXACT").when(F.col("n") > 1, "MULTI").otherwise("MISS"))

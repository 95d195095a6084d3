"""As-of lookup and interval overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, value_cols: list[str], tie: str | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of its key at or before it (null if there is none).

    Both sides go through one window in order of time, so work follows the rows, not their pairs. ``tie`` orders right
    rows of one time; a left row sees all right rows of its own time.
    """
    own = [c for c in left.columns if c not in keys]
    r = right.select(*keys, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.col(tie).alias("__tie") if tie else F.lit(0).alias("__tie"), F.struct(F.col(right_at).alias("__seen"), *value_cols).alias("__value"), *(F.lit(None).cast(left.schema[c].dataType).alias(c) for c in own))
    tie_type = r.schema["__tie"].dataType
    value_type = r.schema["__value"].dataType
    both = r.unionByName(left.select(*keys, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(tie_type).alias("__tie"), F.lit(None).cast(value_type).alias("__value"), *own))
    order = Window.partitionBy(*keys).orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__value", F.last("__value", ignorenulls=True).over(order)).where("__side = 1")
    return met.select(*left.columns, F.col("__value.__seen").alias("matched_at"), *(F.col(f"__value.{c}").alias(c) for c in value_cols))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of one key whose closed intervals meet; the key keeps this an equi-join with a residual range test."""
    r = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & (left[k] == r[f"__{k}"])
    on = on & (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(left_span[1]) >= F.col(right_span[0]))
    return left.join(r, on).drop(*(f"__{k}" for k in keys))

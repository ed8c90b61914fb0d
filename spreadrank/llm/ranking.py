"""Global positions and prefix sums without a global task.

Rows are dealt into key ranges, which are fixed by a reliable checkpoint; each
range's totals (one row a range) give the offsets of the ranges after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut, parts


def with_prefix(df: DataFrame, keys: list[str], sums: dict[str, Column], group: str | None = None) -> DataFrame:
    """Adds, for each name, the sum of its column over all rows before this one.

    Rows come in the order of ``group`` (if any), then ``keys``; with a group
    the sums start anew in each. Rows that tie in all keys come in any order.
    """
    names = list(sums)
    by = ([group] if group else []) + keys
    ranged = cut(
        df.withColumns({f"_{k}": c.cast("long") for k, c in sums.items()})
        .repartitionByRange(parts(df.sparkSession), *by)
        .withColumn("_pid", F.spark_partition_id())
    )
    own = ["_pid"] + ([group] if group else [])
    totals = ranged.groupBy(*own).agg(*[F.sum(f"_{k}").alias(f"_t_{k}") for k in names])
    before = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_pid").alias("_p"), *([F.col(group).alias("_g")] if group else []), *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in names]
    )
    here = Window.partitionBy(*own).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_pid") == F.col("_p")
    if group:
        same = same & F.col(group).eqNullSafe(F.col("_g"))
    out = ranged.withColumns({f"_h_{k}": F.coalesce(F.sum(f"_{k}").over(here), F.lit(0)) for k in names}).join(offsets, same)
    return out.withColumns({k: F.col(f"_h_{k}") + F.col(f"_o_{k}") for k in names}).drop(
        "_pid", "_p", "_g", *[f"{x}{k}" for k in names for x in ("_", "_h_", "_o_")]
    )

"""Column-wise scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def minmax(df: DataFrame, columns: list[str], suffix: str = "_norm") -> DataFrame:
    """Guarded scaling to [0, 1]: a constant column becomes 0. One global aggregate row is broadcast."""
    ends = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(ends))
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out = out.withColumn(f"{c}{suffix}", F.when(span > EPS, (F.col(c) - F.col(f"_lo_{c}")) / span).otherwise(F.lit(0.0)))
    return out.drop(*[f"_{n}_{c}" for c in columns for n in ("lo", "hi")])


def padded(value, low, high):
    """The scaling of the plots: (x - min) / (max - min + 1e-12)."""
    return (value - low) / (high - low + F.lit(EPS))

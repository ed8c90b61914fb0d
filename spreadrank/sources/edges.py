"""Edge sources and graph cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """(u, v) pairs of a whitespace-separated text file (gzip is transparent); # begins a comment.

    Further tokens of a line are ignored. Blank lines give nothing; a line of
    one token or with a token that is no integer raises, as a silent null would
    lose an edge.
    """
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    parts = F.split(line, r"\s+")
    return spark.read.text(path).where(line != "").select(F.element_at(parts, 1).cast("long").alias("u"), F.element_at(parts, 2).cast("long").alias("v"))


def read_datasets(spark: SparkSession, sources: dict[str, str]) -> tuple[DataFrame | None, list[str]]:
    """(dataset, u, v) of all sources that exist, and the names of those that do not."""
    from pyspark.errors import AnalysisException

    out, missing = None, []
    for name, path in sources.items():
        try:
            one = read_edge_list(spark, path).select(F.lit(name).alias("dataset"), "u", "v")
        except AnalysisException:
            missing.append(name)
            continue
        out = one if out is None else out.union(one)
    return out, missing


def simple_edges(pairs: DataFrame) -> DataFrame:
    """Distinct undirected edges u < v without loops."""
    return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def nodes_of(pairs: DataFrame) -> DataFrame:
    """All nodes, also those that stand in loops only."""
    return pairs.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()


def co_return_edges(spark: SparkSession, sf_dir: str, min_discount: float | None = None) -> DataFrame:
    """Parts returned in the same order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'")
    if min_discount is not None:
        lines = lines.where(F.col("l_discount") >= min_discount)
    p = lines.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("n")).distinct()
    a, b = p.alias("a"), p.alias("b")
    return a.join(b, F.expr("a.o = b.o and a.n < b.n")).select(F.col("a.n").alias("u"), F.col("b.n").alias("v")).distinct()

"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of texts are long; smaller Arrow batches bound what JVM and Python hold of them.
_ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("64MB", "16MB")}


def small_batches(spark: SparkSession) -> None:
    """Lowers the sizes of Arrow batches where the session has not set its own."""
    for name, (usual, ours) in _ARROW.items():
        if spark.conf.get(name, usual) in (usual, str(64 << 20), "67108864b"):
            spark.conf.set(name, ours)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Only where that setting is absent (tests on one machine) a local folder is set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = have.get() if have.isDefined() else None
    if not where:
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage with a reliable checkpoint in the shared folder.

    What led to it is then garbage; collecting it lets Spark delete the shuffle
    files now instead of at the end of the job.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    kept = df.checkpoint(eager=True)
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return kept


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def open_uri(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a URI or plain path."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def docs_only(df: DataFrame) -> DataFrame:
    """doc_id and text alone; other columns never reach an operator."""
    small_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


#: The struct column in which carried() puts the other columns.
CARRIED = "__carried_row"


def carried(df: DataFrame) -> DataFrame:
    """doc_id and text for an operator, and all other columns of df in one struct column, whatever their names are."""
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "text"]).alias(CARRIED)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest)


def is_carried(df: DataFrame) -> bool:
    """Whether carried() made the table; a column of the same name in another table is just a column."""
    return df.columns == ["doc_id", "text", CARRIED] and df.schema[CARRIED].dataType.typeName() == "struct"


def restored(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that carried() was given, from text and the struct."""
    return df.select(*[F.col("text") if c == "text" else F.col(f"{CARRIED}.`{c}`").alias(c) for c in columns])

"""Corpus pipeline: STAGES over documents, each written as Parquet and read again.

1. quality classifier: documents that it rejects go
2. n-gram Jaccard join: one document of each group of near-duplicates stays
3. benchmark decontamination: contaminated documents go
4. mixing: rows and files stand in the order of the Pfair schedule
5. token output: the ids are written in that order

All stages but the last return the columns of documents. A stage that finds no
labels or no benchmark items lets all documents pass. Nulls, empty tables and
repeated rows are as the operators define them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadrank.llm.classifier import classify, fit
from spreadrank.llm.decontamination import find_contamination, judged
from spreadrank.llm.frames import CARRIED, carried, parts, restored, scratch, table
from spreadrank.llm.jaccard_join import one_of_each
from spreadrank.llm.mixing import ROW_BYTES, mix_sources
from spreadrank.llm.token_output import read_tokens, write_tokens


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs, table(spark, sf_dir, "labels"))
    return restored(classify(carried(docs), model).where("predicted = 1"), docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return restored(one_of_each(carried(docs)), docs.columns)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = find_contamination(carried(docs), table(spark, sf_dir, "benchmark"))
    return restored(judged(found).where("not contaminated"), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # places are worked out on narrow rows; rows alike in these three columns share a place, and all of them stay
    key = ["doc_id", "source", "size"]
    placed = mix_sources(docs.select("doc_id", "source", "text")).groupBy(*key).agg(F.min("slot").alias("slot"), F.min("place_in_source").alias("place"))
    placed = placed.toDF(*[f"_{k}" for k in key], "slot", "place")
    size = F.octet_length(F.coalesce("text", F.lit(""))) + F.lit(ROW_BYTES)
    own = [F.col("doc_id"), F.col(f"{CARRIED}.source").cast("string"), size.cast("long")]
    same = [x.eqNullSafe(F.col(f"_{k}")) for k, x in zip(key, own, strict=True)]
    rows = carried(docs).hint("merge").join(placed, same[0] & same[1] & same[2])
    return restored(rows.repartitionByRange(parts(spark), "slot", "place").sortWithinPartitions("slot", "place"), docs.columns)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = F.col("_metadata.file_name")
    order = [F.regexp_extract(name, r"part-(\d+)", 1).try_cast("long"), name, F.col("_metadata.row_index")]
    try:  # the order of the rows in the files of the stage before
        docs.select(*order)
    except AnalysisException:  # rows that come from no files: the order of doc_id
        order = None
    return read_tokens(write_tokens(docs, scratch(spark, "tokens"), order))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", keep_clean),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", write_ids),
]

#: Hash sampling, a fitted model and a tokenizer are beyond SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, where = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{k}")
        docs = spark.read.parquet(f"{where}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""A training-data pipeline over `documents`: five stages, each written as Parquet and read again as the next one's input.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of documents:
quality drops what the classifier rejects, near_duplicates keeps the document of least doc_id of each group (rows of one doc_id and
text are one document, of which the least other columns stay), decontaminate drops
documents with a benchmark passage, secrets writes a mark over secrets and keeps the document, pieces adds the ids of its encoding.

Stages that run Python set the session's batches to it to BATCH bytes, as what they return is run later, under what is set then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varspark.llm import decontaminate as benchmark
from varspark.llm import jaccard, pieces
from varspark.llm import quality as classifier
from varspark.llm import secrets as scans
from varspark.llm.common import saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_QUALITY = 0.7
#: Bytes of text that Spark hands to Python at once. By its own default, 10000 rows or 64 MB, a task's JVM and Python hold several times that.
BATCH = "2m"


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").cast("int").alias("label"))
    return classifier.score_quality(docs, labels, score="_score").where(F.col("_score") >= LEAST_QUALITY).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    groups = jaccard.jaccard_components(docs)
    rest = groups.where("doc_id != component_id").select("doc_id")
    kept = docs.join(rest, "doc_id", "left_anti")
    once = kept.groupBy("doc_id", "text").agg(F.min(F.struct(*COLUMNS[2:])).alias("others"))
    return once.select("doc_id", "text", "others.*").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return benchmark.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scanned = scans.scan_secrets(docs.select(*COLUMNS))
    text = scans.redacted(F.col("text"), F.col("spans"))
    return scanned.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    encoded = pieces.encode(docs.select("doc_id", "text"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("pieces", encode)]
#: SQL can't express the classifier, the alignment or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs

"""In-house counts kept up to date from a stream of call files.

The state has two parts, both of which a batch adds to and never rewrites: `calls` has the classified calls of a case as they are after a
batch, `counts` those of a range of variants. What a case or range is like now stands under the last batch that touched it; small logs say
which these are. A batch reads the calls of its own cases and the counts of the ranges in which these changed, so its cost follows the
batch, not what was streamed before. A batch that is run again starts from what earlier batches left and writes the same once more.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from varspark.operators.counts import CLASSES, KEY, classified

CALLS = "case_id long, sample string, chrom_no int, pos int, ref string, alt string, gt string"
STATE = "case_id long, sample string, chrom_no int, pos int, ref string, alt string, class string, batch long"
COUNTS = ", ".join(["chrom_no int, pos int, ref string, alt string", *(f"{c} long" for c in CLASSES), "batch long, part string"])
#: Bases of a range of variants, as a power of 2.
RANGE = 20


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], schema)


def range_of() -> Column:
    return F.concat_ws("-", F.col("chrom_no").cast("string"), F.shiftright("pos", RANGE).cast("string"))


def latest(spark: SparkSession, table: str, what: str, key: str, before: int | None = None) -> DataFrame:
    """(key, batch): the last batch, before a number if given, that touched each case or range."""
    log = read_or_none(spark, f"{table}/{what}_log", f"{key} string, batch long")
    log = log if before is None else log.where(F.col("batch") < before)
    return log.groupBy(key).agg(F.max("batch").alias("batch"))


def store_batch(batch: DataFrame, number: int, pedigree: DataFrame, table: str, release: str = "grch37") -> None:
    """Take a batch of calls into the state as batch `number`."""
    spark = batch.sparkSession
    names = ["case_id", "sample", *KEY]

    def log(rows: DataFrame, what: str, key: str) -> DataFrame:
        path = f"{table}/{what}_log/batch={number}"
        rows.select(F.col(key).cast("string").alias(key)).distinct().write.mode("overwrite").parquet(path)
        return spark.read.schema(f"{key} string").parquet(path)

    def put(rows: DataFrame, what: str) -> DataFrame:
        """In a column of its own name, the partition that it belongs to is written again as a whole."""
        path = f"{table}/{what}"
        rows.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "part").parquet(path)
        return spark.read.parquet(path).where(F.col("batch") == number)

    cases = batch.select("case_id").distinct()
    earlier = latest(spark, table, "case", "case_id", number).withColumn("case_id", F.col("case_id").cast("long")).join(cases, "case_id", "left_semi")
    state = read_or_none(spark, f"{table}/calls", f"{STATE}, part string").where(F.col("batch") < number)
    places = earlier.withColumn("part", F.col("case_id").cast("string"))
    old = state.join(F.broadcast(places), ["case_id", "batch", "part"], "left_semi").select(*names, "class")
    new = classified(batch, pedigree, release).select(*names, "class")
    merged = old.unionByName(new).groupBy(*names).agg(F.min("class").alias("class"))
    now = put(merged.withColumn("part", F.col("case_id").cast("string")), "calls").select(*names, "class")
    changed = now.withColumn("n", F.lit(1)).unionByName(old.withColumn("n", F.lit(-1)))
    sums = [F.sum(F.when(F.col("class") == c, F.col("n") * k).otherwise(0)).alias(c) for c, k in CLASSES.items()]
    # what changes a count, and variants that come for the first time, if only as calls that don't count
    change = changed.groupBy(*KEY).agg(*sums, F.min("n").alias("n")).where(" OR ".join(["n > 0", *(f"{c} != 0" for c in CLASSES)])).drop("n")
    change = change.withColumn("part", range_of())
    touched = log(change, "range", "part")
    known = read_or_none(spark, f"{table}/counts", COUNTS).where(F.col("batch") < number)
    before = latest(spark, table, "range", "part", number).join(touched, "part", "left_semi")
    counts = known.join(F.broadcast(before), ["part", "batch"], "left_semi").select(*KEY, *CLASSES, "part")
    put(counts.unionByName(change).groupBy(*KEY, "part").agg(*(F.sum(c).cast("long").alias(c) for c in CLASSES)), "counts")
    log(cases, "case", "case_id")


def stream_counts(spark: SparkSession, calls_dir: str, pedigree: DataFrame, table: str, checkpoint: str, release: str = "grch37") -> StreamingQuery:
    """Read Parquet files of calls as they come and keep the state in `table`. Neither a replay of a batch nor a case whose calls come again
    changes a count; calls of a case may come in several files."""
    calls = spark.readStream.schema(CALLS).parquet(calls_dir)
    store = lambda batch, number: store_batch(batch, number, pedigree, table, release)
    return calls.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_stream(spark: SparkSession, table: str) -> DataFrame:
    """The counts of everything streamed so far, as count_classes() gives them: the last state of each range, without any grouping."""
    now = latest(spark, table, "range", "part")
    return read_or_none(spark, f"{table}/counts", COUNTS).join(F.broadcast(now), ["part", "batch"], "left_semi").select(*KEY, *CLASSES)

"""What the operators share: tables in the shared folder, tokens, blocks of Arrow rows, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varspark.sources.scratch import release, shared_dir  # noqa: F401  the operators take release from here


def saved(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that saved() wrote and nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def small_batches(spark: SparkSession, most: str) -> Iterator[None]:
    """What runs within hands Python at most about `most` bytes at once, not 10000 rows, which JVM and Python would hold several times."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, most)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def crc_mod(column: str, n: int):
    """crc32 of the column as text, modulo n: the held-out folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of bytes other than space and 0x09 to 0x0D (bytes.split() does exactly that)."""
    return text.lower().split()


def as_bytes(column: pa.Array) -> list[bytes]:
    """A text column as bytes objects, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def in_blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text, so that array work stays small; a longer text is alone."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        part, first = np.cumsum(sizes) // most, 0
        for last in [*(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]:
            if last > first:
                yield batch.slice(first, last - first)
            first = last


def row_numbers(first: int, n: int) -> np.ndarray:
    """Numbers for the rows of this task that no other task gives; stable once they are written to a table."""
    return (TaskContext.get().partitionId() << 40) + np.arange(first, first + n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finish for 64-bit hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def are_stars(edges: DataFrame) -> bool:
    """Whether the edges (u, v), u > v, are stars around their smallest ids: each u has one edge, and no v is a u. Counted by node."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).union(edges.select("v", F.lit(0), F.lit(1)))
    odd = ends.groupBy("node").agg(F.sum("as_u").alias("as_u"), F.max("as_v").alias("as_v")).where("as_u > 1 OR as_u = 1 AND as_v = 1")
    return odd.agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component_id): the smallest id reachable over edges (src, dst); nodes without an edge to another are left out.

    Alternates large-star and small-star steps until the edges are stars around the smallest ids. Each step is a minimum by
    node (combined before the shuffle) and a join back; edges are never gathered by node or on the driver.
    """
    now = saved(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u != v").distinct())
    while not are_stars(now):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        spent, now = now, saved(small)
        discard(spent)
    return now.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, each: int, most_bytes: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """About `each` rows (key, text, label) of each label, and the number of rows of each label. labels: (key, label int).

    Distinct texts of a label are taken whose hash falls below the share that leaves `each`, so copies count once and no other
    column has a say. They are found from hashes alone; the sample's keys (bounded by `each`) are then broadcast to fetch the texts.
    With most_bytes the share also leaves at most that many bytes of text to a label on average, and of what it leaves texts are taken
    in order of hash up to twice that many, so a sample of long texts has fewer rows; each is taken whole. Of the texts of a repeated
    key any copy with the chosen hash is the same text.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    short = docs.select(key, F.xxhash64(whole).alias("h"), (F.octet_length(whole) + 1).cast("long").alias("size"))
    known = short.join(labels.select(key, "label").where("label IS NOT NULL"), key)
    known = saved(known.groupBy("label", "h").agg(F.min(key).alias(key), F.first("size").alias("size"), F.count("*").alias("rows")))
    counts = known.groupBy("label").agg(F.sum("rows").alias("rows"), F.count("*").alias("texts"), F.sum("size").alias("bytes")).collect()
    limit = F.lit(0.0)
    for c in counts:
        share = each / c.texts if most_bytes is None else min(each / c.texts, most_bytes / c.bytes)
        limit = F.when(F.col("label") == c.label, F.lit(share)).otherwise(limit)
    picked = known.where(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < limit)
    if most_bytes is not None:
        so_far = F.sum("size").over(Window.partitionBy("label").orderBy("h"))
        picked = picked.withColumn("so_far", so_far).where(F.col("so_far") <= 2 * most_bytes)
    picked = picked.select(key, "label", F.col("h").alias("chosen"))
    texts = docs.select(key, whole.alias("text")).join(F.broadcast(picked), key).where(F.xxhash64("text") == F.col("chosen")).drop("chosen")
    return texts.dropDuplicates([key, "label", "text"]), {c.label: c.rows for c in counts}

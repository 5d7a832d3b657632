"""The pipeline's stages hand texts to Python in batches of bounded bytes."""

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F


def test_a_stage_bounds_the_bytes_of_a_batch(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    try:
        corpus_pipeline.encode(spark, spark.createDataFrame([(1, "a text")], "doc_id long, text string"), "")
        texts = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("word "), 400).alias("text"))
        largest = texts.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    finally:
        spark.conf.set(setting, before)
    assert largest < 3 << 20

"""The Jaccard operator hands texts to Python in small batches and works on them in small pieces."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from varspark.llm import jaccard

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_small_while_it_runs_only(spark, monkeypatch):
    seen, write, before = [], jaccard.saved, spark.conf.get(SETTING)

    def saved(df):
        seen.append(spark.conf.get(SETTING))
        return write(df)

    monkeypatch.setattr(jaccard, "saved", saved)
    docs = spark.range(0, 6, 1, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three four five "), (F.col("id") % 3).cast("string")).alias("text"))
    rows = jaccard.jaccard_components(docs).orderBy("doc_id").collect()
    assert [r.component_id for r in rows] == [0, 1, 2, 0, 1, 2]
    assert seen and set(seen) == {jaccard.BATCH}
    assert spark.conf.get(SETTING) == before


def test_words_of_a_long_text_take_little_more_than_their_hashes():
    data = np.frombuffer(b"word " * (1 << 19), np.uint8)
    jaccard.HELD.clear()
    tracemalloc.start()
    try:
        jaccard.word_hashes(data)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40 << 20

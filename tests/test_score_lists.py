"""Numbers in delimited lists are read once for each use of them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from varspark.operators import stats
from varspark.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="needs the small tables")
def test_score_extremes_reads_each_list_once(spark):
    plan = registry.queries()["score_extremes"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(split(") == 3


def test_lists_without_numbers_and_with_some(spark):
    rows = spark.createDataFrame([(".;3;-1",), (". ; 2.5 ;NA;x",), (".;-;",), ("",), (None,)], "t string")
    got = [(r.a, r.b) for r in rows.select(stats.max_of_list(F.col("t")).alias("a"), stats.max_of_list(F.col("t"), least=True).alias("b")).collect()]
    assert got == [(3.0, -1.0), (2.5, 2.5), (None, None), (None, None), (None, None)]

"""Queries on tables that hold the smallest ones several times, their keys shifted: places repeat, ids don't."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from test_queries import SF, plain
from varspark.plans import more, registry  # noqa: F401  more registers its queries too

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: Shifts of 200000 repeat a place of a site, region and variant, and of its contig.
SHIFT = 200_000
KEYS = {"orders": ("o_orderkey", "o_custkey"), "lineitem": ("l_orderkey", "l_partkey", "l_suppkey"), "part": ("p_partkey",)}


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    folder, duck = str(tmp_path_factory.mktemp("repeated")), duckdb.connect()
    for name, keys in KEYS.items():
        rows = spark.read.parquet(f"{SF}/{name}.parquet").crossJoin(spark.range(2).select(F.col("id").alias("turn")))
        rows.withColumns({k: F.col(k) + SHIFT * F.col("turn") for k in keys}).drop("turn").write.parquet(f"{folder}/{name}.parquet")
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return folder, duck


def compare(spark, repeated, name):
    folder, duck = repeated
    df = registry.QUERIES[name](spark, folder)
    got = duck.execute(registry.SQL[name])
    columns = [d[0] for d in got.description]
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert ours == sorted(tuple(map(plain, r)) for r in got.fetchall())


@pytest.mark.parametrize("name", ["ingest_blocks", "annotation_blocks"])
def test_sites_of_one_place_are_variants_of_their_own(spark, repeated, name):
    compare(spark, repeated, name)

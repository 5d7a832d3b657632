"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from varspark.plans import more, registry  # noqa: F401  more registers its queries too

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem", "part")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = duck.execute(registry.SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(map(plain, r)) for r in got.fetchall())
    assert ours == theirs



"""What readers and writers leave in the shared folder."""

import os
import tempfile

import pytest

from test_queries import SF, plain  # noqa: F401
from varspark.plans import more  # noqa: F401
from varspark.plans.registry import QUERIES
from varspark.sources import scratch

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture
def folder(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: path)
    return path


def test_background_texts_and_what_is_between_are_dropped(spark, folder):
    assert QUERIES["background_sources"](spark, SF).count() > 0
    assert {name.split("-")[0] for name in os.listdir(folder)} == {"background"}


def test_vcf_files_are_compressed_and_a_large_case_has_several_with_a_header_each(spark, folder, monkeypatch):
    want = sorted(map(tuple, QUERIES["vcf_seqvars"](spark, SF).collect()))
    monkeypatch.setattr(more, "FILE_ROWS", 100)
    assert sorted(map(tuple, QUERIES["vcf_seqvars"](spark, SF).collect())) == want
    files = [[f for _, _, fs in os.walk(f"{folder}/{d}") for f in fs if f.startswith("part-")] for d in sorted(os.listdir(folder), key=lambda d: os.path.getmtime(f"{folder}/{d}")) if d.startswith("seqvars-")]
    assert [f for fs in files for f in fs if not f.endswith(".gz")] == []
    assert len(files[0]) == 20 and len(files[1]) > 40

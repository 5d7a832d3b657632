"""Settings of many cases: recessive queries and the others are joined apart, with the tests that one of them asks for."""

import json
import random

import pytest
from pyspark.sql import functions as F

from varspark.operators import seqvars
from varspark.sources import tables


def variants(spark):
    draw = random.Random(7)
    gts = ["0/0", "0|1", "1/1", "./.", "1"]
    rows = [(k, "c", "1", 0 if k % 9 else 24, k, "A", "T", [(s, draw.choice(gts), draw.randrange(40), draw.randrange(30), draw.randrange(15)) for s in "IFM"], [(f"G{k % 7}", [draw.choice(["stop_gained", "missense_variant"])])], draw.randrange(6)) for k in range(120)]
    df = spark.createDataFrame(rows, "id int, case_id string, chrom string, chrom_no int, pos int, ref string, alt string, calls array<struct<sample:string,gt:string,gq:int,dp:int,ad:int>>, ann array<struct<gene_id:string,consequences:array<string>>>, n int")
    counts = F.struct(F.lit(1000).alias("an"), F.lit(0).alias("hom"), F.col("n").alias("het"), F.lit(0).alias("hemi"))
    return df.withColumns({n: counts for n in ("gnomad_exomes", "gnomad_genomes", "inhouse", "gnomad_mtdna", "helixmtdb")}).drop("n")


FAMILY = [{"sample": s, "genotype": f"recessive-{role}"} for s, role in zip("IFM", ("index", "father", "mother"), strict=True)]
LEAST = {"filter_active": True, "min_dp_het": 8, "min_gq": 9, "min_ad": 2}
SETTINGS = {
    "calls": {"sample_genotypes": [{"sample": "I", "genotype": "variant"}, {"sample": "F", "genotype": "non-hom", "include_no_call": True}, {"sample": "nobody", "genotype": "any"}][:2], "consequences": ["stop_gained"]},
    "nobody": {"sample_genotypes": [{"sample": "nobody", "genotype": "any"}]},
    "limits": {"sample_qualities": [{"sample": "X", "filter_active": False, "min_gq": 99}, {"sample": "M", **LEAST}], "helixmtdb": {"enabled": True, "max_het": 2}, "gnomad_exomes": {"enabled": True, "max_het": 3}},
    "both": {"recessive_mode": "any", "sample_genotypes": FAMILY, "inhouse": {"enabled": True, "max_het": 3}},
    "pair": {"recessive_mode": "compound-heterozygous", "sample_genotypes": FAMILY[:2]},
    "all": {},
}


def queries_of(spark, tmp_path, names):
    for name in names:
        (tmp_path / f"{name}.json").write_text(json.dumps({"query_id": name, "case_id": "c", **SETTINGS[name]}))
    read = tables.load_queries(spark, [str(tmp_path / f"{name}.json") for name in names])
    return spark.createDataFrame(read.collect(), read.schema)


@pytest.mark.parametrize("written_out", [0, 8])
@pytest.mark.parametrize("names", [tuple(SETTINGS), ("both",), ("limits",)])
def test_each_query_gives_what_it_gives_alone(spark, tmp_path, monkeypatch, names, written_out):
    monkeypatch.setattr(seqvars, "WRITTEN_OUT", written_out)
    df = variants(spark)
    got = seqvars.filter_by_queries(df, queries_of(spark, tmp_path, names)).select("query_id", "id").collect()
    for name in names:
        own = {k: {x["sample"]: x for x in v} if k.startswith("sample_") else v for k, v in SETTINGS[name].items()}
        want = [r.id for r in seqvars.filter_seqvars(df, own).collect()]
        assert sorted(r.id for r in got if r.query_id == name) == sorted(want), name


def test_no_queries(spark, tmp_path):
    assert seqvars.filter_by_queries(variants(spark), queries_of(spark, tmp_path, ["all"]).where("false")).count() == 0


def test_what_no_query_asks_for_is_not_in_the_plan(spark, tmp_path):
    got = seqvars.filter_by_queries(variants(spark), queries_of(spark, tmp_path, ["nobody", "pair", "all"])).select("query_id", "id")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    # tests of samples compile; what doesn't fit a recessive mode goes before the shuffle, which a semi join would put after it
    assert "forall" not in plan and "exists" not in plan and "LeftSemi" not in plan

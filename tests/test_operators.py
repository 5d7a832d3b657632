"""Cases of single functions and operators: genotype choices, recessive genes, regions, intervals, readers, streaming."""

import random

import pytest
from pyspark.sql import functions as F

from varspark.functions import scalars as S
from varspark.operators import counts, intervals, reshape, seqvars, strucvars
from varspark.sources import sinks, tables, vcf
from varspark.streaming import counts as stream


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("text", "no"), [("1", 0), ("chr1", 0), ("22", 21), ("chrX", 22), ("y", 23), ("MT", 24), ("chrM", 24), ("m", 24), ("GL000", None)])
def test_chromosomes(spark, text, no):
    assert value(spark, S.chrom_no(F.lit(text))) == no


@pytest.mark.parametrize(("a", "b", "expected"), [((0, 100), (0, 100), 1.0), ((0, 100), (50, 150), 0.5), ((0, 100), (100, 200), 0.0), ((0, 10), (0, 100), 0.1), ((5, 5), (5, 5), 0.0)])
def test_reciprocal_overlap(spark, a, b, expected):
    assert value(spark, S.reciprocal_overlap(*map(F.lit, (*a, *b)))) == pytest.approx(expected)


@pytest.mark.parametrize(("text", "expected"), [("chr1:1,000-2,000", (0, 1000, 2000)), ("X", (22, None, None)), ("2:5", (1, 5, 5)), ("nothing here", None)])
def test_regions(spark, text, expected):
    got = value(spark, S.parse_region(F.lit(text)))
    assert (None if got is None else tuple(got)) == expected


@pytest.mark.parametrize(("begin", "end", "expected"), [(0, 1, 585), (0, 1 << 17, 585), (1 << 17, (1 << 17) + 1, 586), (0, (1 << 17) + 1, 73), (0, 1 << 29, 0)])
def test_genome_bins(spark, begin, end, expected):
    assert value(spark, S.genome_bin(F.lit(begin), F.lit(end))) == expected


def test_identifiers(spark):
    assert value(spark, S.numeric_gene_id(F.lit("ENSG00000000042.3"))) == 42
    assert value(spark, S.ensembl_id(F.lit(42))) == "ENSG00000000042"
    assert value(spark, S.rcv_id(F.lit(7))) == "RCV000000007"
    assert value(spark, S.significance_level(F.lit("Pathogenic/Likely pathogenic"))) == 4
    assert value(spark, S.significance_level(F.lit("odd"))) is None


@pytest.mark.parametrize(("gt", "kind"), [("0/0", "HomRef"), ("/0/1", "Het"), ("1|0", "Het"), ("1", "HomAlt"), (".|.", "WithNoCall"), ("./1", "WithNoCall")])
def test_genotypes(spark, gt, kind):
    assert value(spark, S.genotype_kind(F.lit(gt))) == kind


def test_unknown_genotype_is_an_error(spark):
    with pytest.raises(Exception, match="not a genotype"):
        value(spark, S.genotype_kind(F.lit("1/2")))


CALL = "array<struct<sample:string,gt:string,gq:int,dp:int,ad:int,ps:int>>"


def variants(spark, rows):
    """rows: (case_id, gene, chrom_no, gt index, gt father, gt mother)."""
    data = [(c, no, k, "A", "T", [(s, g, 90, 30, 15, None) for s, g in zip(("index", "father", "mother"), gts, strict=True)], [(gene, ["missense_variant"], 1)] if gene else []) for k, (c, gene, no, *gts) in enumerate(rows)]
    return spark.createDataFrame(data, f"case_id int, chrom_no int, pos int, ref string, alt string, calls {CALL}, ann array<struct<gene_id:string,consequences:array<string>,distance:int>>")


TRIO = {"index": {"genotype": "recessive-index"}, "father": {"genotype": "recessive-father"}, "mother": {"genotype": "recessive-mother"}}


@pytest.mark.parametrize(("choice", "passing"), [("ref", {"0/0", "0|0"}), ("het", {"0/1", "1|0"}), ("hom", {"1/1"}), ("variant", {"0/1", "1|0", "1/1"}), ("any", {"0/0", "0|0", "0/1", "1|0", "1/1"}), ("non-hom", {"0/0", "0|0", "0/1", "1|0"}), ("non-het", {"0/0", "0|0", "1/1"})])
def test_choices(spark, choice, passing):
    gts = ["0/0", "0|0", "0/1", "1|0", "1/1", "./.", None]
    df = variants(spark, [(1, "g", 0, g, "0/0", "0/0") for g in gts])
    got = df.where(seqvars.pass_genotype({"sample_genotypes": {"index": {"genotype": choice}}})).select("pos").collect()
    assert {gts[r.pos] for r in got} == passing


@pytest.mark.parametrize(
    ("rows", "mode", "kept"),
    [
        ([("1/1", "0/1", "0/1")], "any", 1),
        ([("1/1", "0/1", "0/0")], "any", 0),
        ([("0/1", "0/1", "0/0"), ("0/1", "0/0", "0/1")], "any", 2),
        ([("0/1", "0/1", "0/0"), ("0/1", "0/1", "0/0")], "any", 0),
        ([("0/1", "0/1", "0/0"), ("0/1", "0/0", "0/1")], "homozygous", 0),
        ([("1/1", "0/1", "0/1")], "compound-heterozygous", 0),
        ([("0/1", "0/1", "0/0")], "any", 0),
    ],
)
def test_recessive_genes(spark, rows, mode, kept):
    df = variants(spark, [(1, "g", 0, *r) for r in rows])
    assert seqvars.filter_gene_recessive(df, {"recessive_mode": mode, "sample_genotypes": TRIO}).count() == kept


def test_genes_without_annotation_are_one_group(spark):
    df = variants(spark, [(1, None, 0, "0/1", "0/1", "0/0"), (1, None, 3, "0/1", "0/0", "0/1")])
    assert seqvars.filter_gene_recessive(df, {"recessive_mode": "any", "sample_genotypes": TRIO}).count() == 2


def test_two_indexes_are_an_error():
    with pytest.raises(ValueError, match="more than one"):
        seqvars.roles({"recessive_mode": "any", "sample_genotypes": {"a": {"genotype": "recessive-index"}, "b": {"genotype": "recessive-index"}}})


def test_quality(spark):
    df = variants(spark, [(1, "g", 0, "0/1", "0/0", "0/0")])
    ok = lambda **s: df.where(seqvars.pass_quality({"sample_qualities": {"index": {"filter_active": True, **s}}})).count() == 1
    assert ok(min_dp_het=30, min_ab=0.5, min_gq=90, min_ad=15, max_ad=15, min_dp_hom=1000)
    assert not ok(min_dp_het=31)
    assert not ok(min_gq=91)
    assert not ok(max_ad=14)
    with pytest.raises(Exception, match="not found in call info"):
        df.where(seqvars.pass_quality({"sample_qualities": {"nobody": {"filter_active": True}}})).collect()


def test_gene_list_that_names_nothing_passes_nothing(spark):
    df = variants(spark, [(1, "g", 0, "0/1", "0/0", "0/0")])
    assert df.where(seqvars.pass_genes({})).count() == 1
    assert df.where(seqvars.pass_genes({"gene_allowlist": []})).count() == 0


def test_range_join_is_the_naive_join(spark):
    draw = random.Random(3)

    def table(n, prefix):
        rows = [(k, draw.randrange(3), b := draw.randrange(3_000_000), b + draw.choice((1, 50, 5000, 40_000, 1_500_000))) for k in range(n)]
        return rows, spark.createDataFrame(rows, f"{prefix}id int, {prefix}c int, {prefix}b int, {prefix}e int")

    (a, left), (b, right) = table(120, "x"), table(150, "y")
    got = sorted((r.xid, r.yid) for r in intervals.range_join(left, right, {"xc": "yc"}, ("xb", "xe"), ("yb", "ye")).select("xid", "yid").collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and x[3] > y[2])


def test_masked_breakpoints(spark):
    svs = spark.createDataFrame([(1, 0, 100, 300, "DEL"), (2, 0, 100, 150, "INS"), (3, 1, 100, 300, "DEL")], "sv_id int, chrom_no int, pos int, sv_end int, sv_type string")
    regions = spark.createDataFrame([("repeat", 0, 99, 100), ("repeat", 0, 250, 299), ("segdup", 0, 0, 1000)], "kind string, chrom_no int, b int, e int")
    got = {r.sv_id: (r.masked_repeat, r.masked_segdup) for r in intervals.masked_breakpoints(svs, regions, ["repeat", "segdup"]).collect()}
    assert got == {1: (1, 2), 2: (2, 2), 3: (0, 0)}


def test_counts_take_a_call_once(spark):
    calls = [("a", "s", 22, 5_000_000, "0/1"), ("a", "s", 22, 5_000_000, "0/1"), ("a", "t", 22, 5_000_000, "1/1"), ("a", "t", 0, 9, "1|1"), ("a", "s", 0, 9, "./.")]
    df = spark.createDataFrame([(c, s, no, p, "A", "T", g) for c, s, no, p, g in calls], "case_id string, sample string, chrom_no int, pos int, ref string, alt string, gt string")
    ped = spark.createDataFrame([("a", "s", 0, "Male"), ("a", "t", 1, "Female")], "case_id string, sample string, idx int, sex string")
    got = {r.chrom_no: (r.het, r.homalt_alleles, r.hemialt) for r in counts.count_carriers(df, ped).collect()}
    assert got == {22: (0, 2, 1), 0: (0, 2, 0)}
    assert counts.update_counts(counts.count_carriers(df, ped), counts.count_carriers(df.limit(0), ped)).count() == 2


def test_stream_counts(spark, tmp_path):
    schema = stream.CALLS
    df = spark.createDataFrame([(1, "s", 0, 9, "A", "T", "0/1"), (2, "s", 0, 9, "A", "T", "1/1")], schema)
    ped = spark.createDataFrame([(1, "s", 0, "Male"), (2, "s", 0, "Female")], "case_id long, sample string, idx int, sex string")
    for _ in range(2):  # the same calls in two files
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "calls"))
        stream.stream_counts(spark, str(tmp_path / "calls"), ped, str(tmp_path / "table"), str(tmp_path / "ck")).awaitTermination()
    row = stream.count_stream(spark, str(tmp_path / "table")).first()
    assert (row.het, row.homalt_alleles) == (1, 2)


@pytest.mark.parametrize(("gt", "allele", "expected"), [("1/2", 1, "1/0"), ("1/2", 2, "0/1"), ("2|0", 2, "1|0"), ("./.", 1, "./."), (".", 1, "."), ("0/3", 2, "0/0")])
def test_recode(spark, gt, allele, expected):
    assert value(spark, reshape.recode_genotype(F.lit(gt), F.lit(allele))) == expected


@pytest.mark.parametrize(("alt", "kind", "expected"), [("<DEL>", "DEL", "3to5"), ("<DUP>", "DUP", "5to3"), ("<INV>", "INV", "NA"), ("N[2:5[", "BND", "3to5"), ("]2:5]N", "BND", "5to3"), ("N]2:5]", "BND", "3to3"), ("[2:5[N", "BND", "5to5")])
def test_orientation(spark, alt, kind, expected):
    assert value(spark, reshape.strand_orientation(F.lit(alt), F.lit(kind))) == expected


def test_unknown_caller_is_an_error(spark):
    assert value(spark, reshape.caller_name(F.lit("DELLYv1.2"))) == "Delly"
    with pytest.raises(Exception, match="unknown caller"):
        value(spark, reshape.caller_name(F.lit("other")))


VCF = """##fileformat=VCFv4.2
##SAMPLE=<ID=kid,Sex="Male",Disease="Affected">
##SAMPLE=<ID=dad,Sex="Male",Disease="Unaffected">
##PEDIGREE=<ID=kid,Father="dad">
##x-lab-case-uuid=case-7
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tkid\tdad
1\t100\t.\tA\tT\t.\t.\tgnomad_exomes_an=10;gnomad_exomes_het=2;ANN=T|missense_variant&intron_variant|HIGH|G|HGNC:1|transcript|NM|x|1/2|c.1|p.1|1|1|1|12|\tGT:AD:DP:GQ\t0/1:10,20:30:99\t0/0:30,0:30
"""


def test_read_vcf(spark, tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    (tmp_path / "list.txt").write_text(f"{tmp_path}/a.vcf\n\n")
    row = vcf.load_seqvars(spark, [f"@{tmp_path}/list.txt"]).first()
    assert (row.case_id, row.chrom_no, row.pos, row.gnomad_exomes.het, row.gnomad_genomes.an) == ("case-7", 0, 100, 2, 0)
    assert [(c.sample, c.gt, c.gq, c.ad) for c in row.calls] == [("kid", "0/1", 99, 20), ("dad", "0/0", None, 0)]
    assert (row.ann[0].gene_id, row.ann[0].consequences, row.ann[0].distance) == ("HGNC:1", ["missense_variant", "intron_variant"], 12)
    ped = {r["sample"]: (r.idx, r.sex, r.father) for r in vcf.load_pedigree(spark, [str(tmp_path / "a.vcf")]).collect()}
    assert ped == {"kid": (0, "Male", "dad"), "dad": (1, "Male", None)}


def test_background(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("# note\nchr1\t10\t20\t3\tdeletion\n1\t30\t31\t2\tinsertion\n")
    rows = {r.sv_type: (r.chrom_no, r.b, r.e, r.cnt) for r in tables.load_background(spark, "dbvar", str(tmp_path / "d.tsv")).collect()}
    assert rows == {"DEL": (0, 10, 20, 1), "INS": (0, 29, 30, 1)}


def test_query_settings(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"case_id": "c", "recessive_mode": "disabled", "sample_genotypes": [{"sample": "a", "genotype": "het"}], "consequences": ["stop_gained"]}')
    settings = tables.query_settings(tables.load_queries(spark, [str(tmp_path / "q.json")]).first())
    assert settings["sample_genotypes"] == {"a": {"genotype": "het"}}
    (tmp_path / "bad.json").write_text('{"case_id": "c", "sample_genotypes": [{"sample": "a", "genotype": "odd"}]}')
    with pytest.raises(Exception, match="unknown genotype choice"):
        tables.load_queries(spark, [str(tmp_path / "bad.json")]).collect()


def test_prefilter_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "param_id string, x int")
    sinks.write_prefiltered(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/param_id=b")).count() == 2


CALLS = [({"pr_cov": 10.0, "pr_var": 4.0}, {"min_pr_ab": 0.4}, True), ({"pr_cov": 10.0, "pr_var": 4.0}, {"max_pr_ab": 0.3}, False), ({"pr_cov": None, "pr_var": 4.0}, {"min_pr_ref": 1, "missing_pr_ok": True}, True), ({"pr_cov": None, "pr_var": 4.0}, {"min_pr_ref": 1}, False), ({"pr_cov": 3.0, "pr_var": 5.0}, {"max_pr_ref": 0}, True), ({"sr_var": 2.0, "pr_var": 4.0}, {"min_srpr_var": 6}, True)]


@pytest.mark.parametrize(("values", "criteria", "expected"), CALLS)
def test_sv_criteria(spark, values, criteria, expected):
    names = ("gq", "pr_cov", "pr_var", "sr_cov", "sr_var", "cn", "anc", "pc", "amq")
    row = spark.createDataFrame([("0/1", *(values.get(n) for n in names))], "gt string, " + ", ".join(f"{n} double" for n in names))
    assert row.select(strucvars.criteria_pass(F.struct("*"), criteria).alias("v")).first().v is expected


def test_a_region_is_parsed_by_one_run_of_its_pattern(spark):
    from pyspark.sql import functions as F

    from varspark.functions import scalars as S

    texts = ["chr1", " CHRX:1,000 \n", "2:1,000-2,000", "2:-5", "chr1:5-", "MT:7-8", "01:1-2", "contig:1", "", "1\x1f2\x1f3", "chr1:5\x1f", "chr3:,", "4:99999999999999999999-7", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("r", S.parse_region(F.col("t")))
    got = [tuple(r.r) if r.r else None for r in df.collect()]
    assert got == [(0, None, None), (22, 1000, 1000), (1, 1000, 2000), None, None, (24, 7, 8), None, None, None, None, None, (2, None, None), (3, None, 7), None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(t#") == 1


def test_marks_of_missing_numbers_are_not_cast(spark):
    from pyspark.sql import functions as F

    from varspark.operators import stats

    df = spark.createDataFrame([(".; 2 ;-1",), (".;-; ;NA",), ("x;-1e2;3.",), ("NaN",), ("-.5;.",), (None,)], "t string")
    out = df.select(stats.max_of_list(F.col("t")).alias("most"), stats.max_of_list(F.col("t"), least=True).alias("least"))
    assert [tuple(map(str, r)) for r in out.collect()] == [("2.0", "-1.0"), ("None", "None"), ("3.0", "-100.0"), ("nan", "nan"), ("-0.5", "-0.5"), ("None", "None")]
    assert "IN (.,,-,NA)" in out._jdf.queryExecution().optimizedPlan().toString()

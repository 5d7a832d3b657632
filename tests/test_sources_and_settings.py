"""Readers as the sources are written, settings of many cases, long lists, crowded cells and the streamed state."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from varspark.operators import annotate, counts, intervals, reshape, seqvars, strucvars
from varspark.sources import tables, vcf
from varspark.streaming import counts as stream


def text(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


# background sources


def test_dbvar_counts_records(spark, tmp_path):
    lines = ["#chromosome\tbegin\tend\tn\ttype", "1\t10\t20\t7\tdeletion", "chrX\t10\t20\t3\talu_insertion;insertion", "MT\t1\t2\t1\tline1_deletion", "2\t1\t9\t4\tdeletion;copy_number_loss"]
    rows = {tuple(r) for r in tables.load_background(spark, "dbvar", text(tmp_path, "dbvar", lines)).select("chrom_no", "sv_type", "b", "e", "cnt").collect()}
    assert rows == {(0, "DEL", 10, 20, 1), (22, "INS", 9, 10, 1), (24, "DEL", 1, 2, 1), (1, "DEL", 1, 9, 1)}


def test_dgv_keeps_mobile_element_deletions_and_leaves_out_complex_ones(spark, tmp_path):
    lines = ["1\t1\t2\tmobile element deletion\t2\t3", "1\t1\t2\tcomplex\t2\t3", "1\t1\t2\tsequence alteration\t2\t3", "1\t1\t2\tOTHER\t2\t3"]
    (row,) = tables.load_background(spark, "dgv", text(tmp_path, "dgv", lines)).collect()
    assert (row.sv_type, row.cnt) == ("DEL", 5)


@pytest.mark.parametrize(("source", "line"), [("dbvar", "1\t1\t2\t1\tloss"), ("dgv", "1\t1\t2\tDEL\t1\t1"), ("dgv_gs", "1\t1\t2\tDEL\t1"), ("exac", "1\t1\t2\tCNV"), ("g1k", "1\t1\t2\tBND\t1\t1"), ("gnomad_sv2", "1\t1\t2\tCNV\t1\t1"), ("gnomad_cnv4", "1\t1\t2\tINS\t1\t1"), ("exac", "GL000\t1\t2\tDEL")])
def test_unknown_types_and_contigs_are_errors(spark, tmp_path, source, line):
    with pytest.raises(Exception, match=f"unknown (type|contig) in source {source}"):
        tables.load_background(spark, source, text(tmp_path, source, [line])).collect()


# ClinVar


def record(**changes):
    own = {
        "accession": {"accession": "VCV000000012", "version": 3}, "rcvs": [{"accession": {"accession": "RCV000000034", "version": 1}, "title": "x"}],
        "name": "n", "variation_type": "VARIATION_TYPE_DELETION", "classifications": {"germline_classification": {"description": "Pathogenic", "review_status": 3}},
        "sequence_location": {"assembly": "GRCh37", "chr": "CHROMOSOME_X", "start": 11, "stop": 20},
    }
    return {k: v for k, v in (own | changes).items() if v is not None}


def test_clinvar_records(spark, tmp_path):
    place = lambda **x: {"sequence_location": {"chr": "CHROMOSOME_X", **x}}
    camel = {"accession": {"accession": "VCV000000012"}, "variationType": 2, "classifications": {"germlineClassification": {"description": "pathogenic"}}, "sequenceLocation": {"chr": 23, "innerStart": 5, "innerStop": 9}}
    kept = [
        (record(), (22, 10, 20, "DEL", 5, 34, 12)), (record(rcvs=[]), (22, 10, 20, "DEL", 5, 0, 12)), (record(rcvs=None), (22, 10, 20, "DEL", 5, 0, 12)), (camel, (22, 4, 9, "DEL", 5, 0, 12)),
        (record(**place(outer_start=3, outer_stop=8, inner_start=4)), (22, 2, 8, "DEL", 5, 34, 12)), (record(**place(start=3, inner_start=4, inner_stop=6, outer_start=1, outer_stop=9)), (22, 3, 6, "DEL", 5, 34, 12)),
        (record(**place(position_vcf=100, reference_allele_vcf="ACGT", alternate_allele_vcf="A")), (22, 100, 104, "DEL", 5, 34, 12)), (record(variation_type=12), (22, 10, 20, "INV", 5, 34, 12)),
    ]
    left_out = [record(variation_type="VARIATION_TYPE_SNV"), record(variation_type=77), record(classifications={}), record(classifications={"germline_classification": {"description": "drug response"}}), record(**place(position_vcf=100, reference_allele_vcf="A")), record(sequence_location={"chr": "CHROMOSOME_UN", "start": 1, "stop": 2})]
    lines = [json.dumps(r) for r, _ in kept] + [json.dumps(r) for r in left_out] + ["{broken", "[1, 2]"]
    got = [tuple(r) for r in tables.load_clinvar_sv(spark, text(tmp_path, "clinvar.jsonl", lines)).select("chrom_no", "b", "e", "sv_type", "significance", "rcv", "vcv").collect()]
    assert sorted(got) == sorted(want for _, want in kept)


@pytest.mark.parametrize("bad", [{"accession": None}, {"rcvs": [{"title": "x"}]}])
def test_clinvar_records_without_accessions_are_errors(spark, tmp_path, bad):
    with pytest.raises(Exception, match="without (VCV|RCV) accession"):
        tables.load_clinvar_sv(spark, text(tmp_path, "clinvar.jsonl", [json.dumps(record(**bad))])).collect()


# VCF and reshaping


def test_keys_that_come_twice_and_strands(spark, tmp_path):
    ann = "T|missense_variant&x|HIGH|SYM|HGNC:5|transcript|NM_1.2|protein_coding|2/5|c.1|p.1|1|1|1|-7|-1|note"
    lines = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA", f"1\t5\t.\tA\tT\t.\t.\tflag;gnomad_exomes_het=3;flag;gnomad_exomes_het=9;ANN={ann},T|stop_gained|LOW|G|HGNC:1|transcript|NM_2.1|x|||||||7|old\tGT:DP:DP\t0/1:4:8"]
    (row,) = vcf.load_seqvars(spark, [text(tmp_path, "a.vcf", lines)]).collect()
    assert row.gnomad_exomes.het == 3 and row.calls[0].dp == 4
    assert (row.ann[0].distance, row.ann[0].strand, row.ann[0].messages) == (-7, -1, "note")
    assert (row.ann[1].distance, row.ann[1].strand, row.ann[1].messages) == (7, None, "old")


@pytest.mark.parametrize(("gt", "allele", "want"), [("/1/2", 2, "0/1"), ("|1|2", 1, "1|0"), ("1|2", 2, "0|1"), ("./.", 1, "./."), ("/./.", 1, "./."), ("1", 1, "1"), ("./2", 2, "./1"), (".", 2, ".")])
def test_recoded_genotypes(spark, gt, allele, want):
    df = spark.createDataFrame([(gt, allele)], "gt string, k int")
    assert df.select(reshape.recode_genotype(F.col("gt"), F.col("k"))).first()[0] == want


def test_cap_of_records(spark):
    assert reshape.capped(spark.range(10), 3).count() == 3 and reshape.capped(spark.range(10), None).count() == 10


def test_prefilter_params(spark, tmp_path):
    path = text(tmp_path, "params", ['{"prefilter_path": "b", "max_freq": 0.5, "max_exon_dist": 3}', '{"max_freq": 0.1, "max_exon_dist": 4}'])
    rows = tables.load_prefilter_params(spark, ['{"prefilter_path": "a", "max_freq": 0.2, "max_exon_dist": 7}', f"@{path}"]).collect()
    assert {(r.max_freq, r.max_exon_dist) for r in rows} == {(0.2, 7), (0.5, 3), (0.1, 4)} and {"a", "b"} < {r.param_id for r in rows}


def test_tokens_of_genes(spark):
    """By each kind of name; one that names nothing is reported, one that names several genes gives them all."""
    links = spark.createDataFrame([("HGNC:5", 121, 7, "ONE"), ("HGNC:6", 122, 8, "TWO"), ("HGNC:9", 122, 8, "TWO")], "hgnc_id string, ensembl_id long, entrez_id long, symbol string")
    found, unknown = seqvars.translate_genes(spark.createDataFrame([(x,) for x in ("HGNC:5", "7", "ENSG00000000122", "TWO", "8", "what", "TWO")], "token string"), links)
    want = {("HGNC:5", "HGNC:5"), ("7", "HGNC:5"), *((x, g) for x in ("ENSG00000000122", "TWO", "8") for g in ("HGNC:6", "HGNC:9"))}
    assert {tuple(r) for r in found.collect()} == want and [r.token for r in unknown.collect()] == ["what"]


# a whole run over a small family, by hand


def test_variants_of_a_family(spark, tmp_path):
    """Settings with limits on frequency, quality and genotype over records that each fail, or pass, for one reason."""
    head = ["##fileformat=VCFv4.2", "##x-test-case-uuid=c1", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tI\tF\tM"]
    ann = "ANN=T|missense_variant|HIGH|SYM|HGNC:5|transcript|NM_1.2|p|2/5|c.1|p.1|1|1|1||1|"
    line = lambda chrom, pos, info, calls: "\t".join([chrom, str(pos), ".", "A", "T", ".", ".", f"{info};{ann}", "GT:DP:AD:GQ", *calls])
    ref, het, hom = "0/0:30:30,0:99", "0/1:30:15,15:99", "1/1:30:0,30:99"
    lines = [
        line("MT", 100, "helix_an=1000;helix_hom=2", [hom, ref, hom]), line("MT", 101, "helix_an=1000;helix_hom=300", [hom, ref, hom]), line("chr1", 102, "gnomad_exomes_an=1000;gnomad_exomes_het=1", [het, ref, ref]),
        line("1", 103, "gnomad_exomes_an=1000;gnomad_exomes_het=90", [het, ref, ref]), line("1", 104, "x=1", ["0/1:5:3,2:99", ref, ref]), line("1", 105, "x=1", ["0/1:30:28,2:99", ref, ref]), line("1", 106, "x=1", ["0/1:30:15,15:5", ref, ref]), line("1", 107, "x=1", [ref, het, het]),
        line("1", 108, "x=1", ["./.:30:15,15:99", ref, ref]), line("X", 109, "x=1", [hom, ref, het]),
    ]
    rows = vcf.load_seqvars(spark, [text(tmp_path, "case.vcf", head + lines)])
    query = {
        "gnomad_exomes": {"enabled": True, "max_af": 0.01}, "helixmtdb": {"enabled": True, "max_hom": 200}, "consequences": ["missense_variant"],
        "sample_qualities": {"I": {"filter_active": True, "min_dp_het": 10, "min_ab": 0.2, "min_gq": 10}}, "sample_genotypes": {"I": {"genotype": "variant"}, "F": {"genotype": "ref"}},
    }
    assert sorted(r.pos for r in seqvars.filter_seqvars(rows, query).collect()) == [100, 102, 109]
    settings = spark.createDataFrame([("c1", json.dumps({
        "query_id": "q", "case_id": "c1", "gnomad_exomes": query["gnomad_exomes"], "helixmtdb": query["helixmtdb"], "consequences": query["consequences"],
        "sample_qualities": [{"sample": "I", **query["sample_qualities"]["I"]}], "sample_genotypes": [{"sample": s, **g} for s, g in query["sample_genotypes"].items()],
    }))], "k string, value string")
    settings.select("value").write.text(str(tmp_path / "q"))
    queries = tables.load_queries(spark, [str(tmp_path / "q")])
    assert sorted(r.pos for r in seqvars.filter_by_queries(rows, queries).collect()) == [100, 102, 109]


def settings_of(spark, tmp_path, *queries):
    for k, q in enumerate(queries):
        text(tmp_path, f"q{k}.json", [json.dumps(q)])
    return tables.load_queries(spark, [str(tmp_path / f"q{k}.json") for k in range(len(queries))])


def trio(spark, rows):
    calls = [(k, "c", "1", 0, k, "A", "T", [("I", i), ("F", f), ("M", m)], [("G", ["x"])]) for k, (i, f, m) in enumerate(rows)]
    none = F.struct(*(F.lit(0).alias(n) for n in ("an", "hom", "het", "hemi")))
    df = spark.createDataFrame(calls, "id int, case_id string, chrom string, chrom_no int, pos int, ref string, alt string, calls array<struct<sample:string,gt:string>>, ann array<struct<gene_id:string,consequences:array<string>>>")
    call = lambda c: F.struct(c["sample"].alias("sample"), c["gt"].alias("gt"), *(F.lit(None).cast("int").alias(n) for n in ("gq", "dp", "ad", "ps")))
    return df.withColumns({"calls": F.transform("calls", call), **{n: none for n in ("gnomad_exomes", "gnomad_genomes", "inhouse", "gnomad_mtdna", "helixmtdb")}})


@pytest.mark.parametrize("mode", seqvars.MODES)
@pytest.mark.parametrize("members", ["I", "IF", "IM", "IFM"])
def test_recessive_settings_as_one_query_and_as_many(spark, tmp_path, mode, members):
    draw = random.Random(mode + members)
    df = trio(spark, [[draw.choice(["0/0", "0|1", "1/1", "./."]) for _ in "IFM"] for _ in range(40)])
    roles = {"I": "recessive-index", "F": "recessive-father", "M": "recessive-mother"}
    queries = settings_of(spark, tmp_path, {"query_id": "q", "case_id": "c", "recessive_mode": mode, "sample_genotypes": [{"sample": s, "genotype": roles[s]} for s in members]}, {"query_id": "all", "case_id": "c"})
    got = seqvars.filter_by_queries(df, queries).collect()
    want = {r.id for r in seqvars.filter_seqvars(df, {"recessive_mode": mode, "sample_genotypes": {s: {"genotype": roles[s]} for s in members}}).collect()}
    assert {r.id for r in got if r.query_id == "q"} == want and sum(r.query_id == "all" for r in got) == 40


def test_recessive_settings_without_one_index_and_clinvar_without_its_table(spark, tmp_path):
    df = trio(spark, [["0/1", "0/0", "0/0"]])
    with pytest.raises(Exception, match="needs one index"):
        seqvars.filter_by_queries(df, settings_of(spark, tmp_path, {"query_id": "q", "case_id": "c", "recessive_mode": "any", "sample_genotypes": [{"sample": "F", "genotype": "recessive-father"}]})).collect()
    with pytest.raises(ValueError, match="ClinVar"):
        seqvars.filter_by_queries(df, settings_of(spark, tmp_path, {"query_id": "q", "case_id": "c", "clinvar": {"presence_required": True}}))
    with pytest.raises(Exception, match="not found in call info"):
        seqvars.filter_by_queries(df, settings_of(spark, tmp_path, {"query_id": "q", "case_id": "c", "sample_qualities": [{"sample": "nobody", "filter_active": True}]})).collect()


def test_recessive_rule_compiles(spark):
    df = trio(spark, [["0/1", "0/0", "0/0"]])
    roles = {"I": {"genotype": "recessive-index"}, "F": {"genotype": "recessive-father"}}
    plan = seqvars.filter_seqvars(df, {"recessive_mode": "any", "sample_genotypes": roles})._jdf.queryExecution().toString()
    assert "ArrowEval" not in plan and "BatchEval" not in plan


# structural variants


def sv_rows(spark, samples):
    call = lambda s: (s, "0/1", 30.0, *[None] * 8)
    kind = "sv_id int, case_id string, chrom_no int, chrom_no2 int, pos int, sv_end int, sv_type string, sv_sub_type string, calls array<struct<sample:string,gt:string,gq:double,pr_cov:double,pr_var:double,sr_cov:double,sr_var:double,cn:double,anc:double,pc:double,amq:double>>"
    return spark.createDataFrame([(1, "c", 0, 0, 100, 900, "DEL", "DEL", [call(s) for s in samples])], kind)


@pytest.mark.parametrize(("samples", "asked", "fits"), [(["A"], {"A": "any"}, True), (["A", "B"], {"A": "any"}, False), (["A"], {"A": "any", "B": "any"}, False), (["B", "A"], {"A": "any", "B": "het"}, True)])
def test_samples_of_query_and_variant(spark, samples, asked, fits):
    criteria = [{"genotype": "het", "select_sv_sub_type": ["DEL"], "min_gq": 20}]
    svs = sv_rows(spark, samples).withColumns({"masked_segdup": F.lit(0), "masked_repeat": F.lit(0)})
    one = strucvars.match_criteria(svs, {"genotype": asked, "genotype_criteria": criteria})
    q = F.from_json(F.lit(json.dumps({"genotype": asked, "genotype_criteria": criteria})), tables.SV_QUERY.format(limits=", ".join(f"{m}_{n} double" for n in strucvars.call_values(F.struct(*(F.lit(None).cast("double").alias(x) for x in ("gq", "amq", "anc", "pr_cov", "pr_var", "sr_cov", "sr_var")))) for m in ("min", "max")), databases="unused int"))
    many = strucvars.match_criteria_by_queries(svs.withColumns({"query_id": F.lit("q"), "q": q}))
    if not fits:
        for df in (one, many):
            with pytest.raises(Exception, match="samples of query and variant differ"):
                df.collect()
        return
    (a,), (b,) = one.collect(), many.collect()
    assert a.pass_all and sorted(a.matched) == sorted(b.matched) and {m.effective for m in b.matched} == {"het"}


def test_settings_in_flat_fields(spark, tmp_path):
    path = text(tmp_path, "q.json", [json.dumps({"query_id": "q", "case_id": "c", "svdb_dgv_enabled": True, "svdb_dgv_min_overlap": 0.75, "svdb_dgv_max_count": 3, "svdb_g1k_enabled": False, "clinvar_sv_min_overlap": 0.5, "clinvar_sv_min_pathogenicity": "likely-pathogenic"})])
    (row,) = tables.load_sv_queries(spark, [path]).collect()
    assert row.background["dgv"].asDict() == {"enabled": True, "min_overlap": 0.75, "max_count": 3} and row.background["g1k"].min_overlap is None and set(row.background) == {"dgv", "g1k"}


def test_limits_by_database(spark):
    svs = spark.createDataFrame([(1, 0, 1, 100, "DEL")], "sv_id int, chrom_no int, pos int, sv_end int, sv_type string")
    known = spark.createDataFrame([(s, 0, 0, e, "DEL", 1) for s in ("a", "b", "c") for e in (10, 60, 95)], "source string, chrom_no int, b int, e int, sv_type string, cnt int")
    (row,) = intervals.overlap_counts(svs, known, ["a", "b", "c"], {"a": 0.9, "b": 0.5}).collect()
    assert (row.count_a, row.count_b, row.count_c) == (1, 2, 3)


# long lists and crowded cells


def test_long_lists(spark):
    draw = random.Random(2)
    rows = [(k, "c", str(k % 3 + 1), k % 3, draw.randrange(10**7), "A" * draw.choice([1, 1, 1, 9, 6000]), "T", [(f"HGNC:{draw.randrange(60_000)}",), (f"HGNC:{draw.randrange(60_000)}",)] if k % 5 else []) for k in range(2000)]
    df = spark.createDataFrame(rows, "id int, case_id string, chrom string, chrom_no int, pos int, ref string, alt string, ann array<struct<gene_id:string>>")
    genes = {f"HGNC:{3 * k}" for k in range(20_000)}
    got = {r.id for r in seqvars.keep_genes(df, spark.createDataFrame([(g,) for g in genes], "gene_id string"), []).collect()}
    assert got == {r[0] for r in rows if any(g in genes for (g,) in r[7])}
    regions = [(draw.randrange(2), b := draw.randrange(10**7), b + draw.choice([0, 5, 80, 3000])) for _ in range(50_000)] + [(0, 5, 1)]
    regions = [r for r in regions if r[1] % 7 < 2]
    hit = lambda c, s, e: any(c == x and y <= e and z >= s for x, y, z in regions)
    kept = seqvars.keep_regions(df, spark.createDataFrame(regions, "chrom_no int, start long, stop long"), []).collect()
    some = [r for r in rows if r[0] % 20 == 0]
    assert len({r.id for r in kept}) == len(kept) and {r.id for r in kept if r.id % 20 == 0} == {r[0] for r in some if hit(r[3], r[4], r[4] + len(r[5]) - 1)}


def test_long_lists_in_a_query(spark):
    df = trio(spark, [["0/1", "0/0", "0/0"]] * 30)
    genes = ["G", *(f"HGNC:{k}" for k in range(20_000))]
    regions = [(0, 10 * k, 10 * k) for k in range(50_000)]
    assert seqvars.filter_seqvars(df, {"gene_allowlist": genes}).count() == 30
    assert sorted(r.pos for r in seqvars.filter_seqvars(df, {"region_allowlist": regions}).collect()) == [0, 10, 20]


def test_long_lists_in_many_queries(spark, tmp_path):
    df = trio(spark, [["0/1", "0/0", "0/0"]] * 30)
    genes, regions = [f"HGNC:{k}" for k in range(1000)], [{"chrom": "1", "start": 10 * k, "stop": 10 * k} for k in range(1000)]
    queries = settings_of(spark, tmp_path, {"query_id": "genes", "case_id": "c", "gene_allowlist": ["G", *genes]}, {"query_id": "other", "case_id": "c", "gene_allowlist": genes}, {"query_id": "regions", "case_id": "c", "region_allowlist": regions}, {"query_id": "short", "case_id": "c", "gene_allowlist": ["G"], "region_allowlist": regions[:2]})
    got = seqvars.filter_by_queries(df, queries).collect()
    want = {"genes": list(range(30)), "regions": [0, 10, 20], "short": [0, 10]}
    assert {q: sorted(r.pos for r in got if r.query_id == q) for q in {r.query_id for r in got}} == want


def test_long_lists_of_places_by_query(spark):
    svs = spark.createDataFrame([(k, q, 0, 0, 100 * k, 100 * k + 50, "DEL") for k in range(20) for q in "ab"], "sv_id int, query_id string, chrom_no int, chrom_no2 int, pos int, sv_end int, sv_type string")
    places = spark.createDataFrame([("a", 0, 0, 250), ("b", 0, 1000, 1010), ("b", 1, None, None)], "query_id string, chrom_no int, begin long, end long")
    got = {(r.query_id, r.sv_id) for r in strucvars.keep_places(svs, places, by=("query_id",)).collect()}
    assert got == {("a", 0), ("a", 1), ("a", 2), ("b", 10)}


def test_long_lists_of_places(spark):
    draw = random.Random(4)
    rows = [(k, k % 2, 1 - k % 2, p := draw.randrange(10**6), p + draw.randrange(2000), draw.choice(["DEL", "INS", "BND"])) for k in range(300)]
    svs = spark.createDataFrame(rows, "sv_id int, chrom_no int, chrom_no2 int, pos int, sv_end int, sv_type string")
    places = [(draw.randrange(2), b := draw.randrange(10**6), b + 900) for _ in range(150)]
    want = {r.sv_id for r in svs.where(strucvars.pass_region({"genomic_region": places})).collect()}
    got = [r.sv_id for r in strucvars.keep_places(svs, spark.createDataFrame(places, "chrom_no int, begin long, end long")).collect()]
    assert 0 < len(want) < 300 and len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("spread", [None, 10, 1])
def test_crowded_cells_are_dealt_out(spark, spread):
    draw = random.Random(6)
    table = lambda n, x: [(k, 0, b := draw.choice([100, draw.randrange(10**6)]), b + draw.choice([10, 40_000])) for k in range(n)]
    a, b = table(150, "x"), table(200, "y")
    left, right = spark.createDataFrame(a, "xid int, xc int, xb int, xe int"), spark.createDataFrame(b, "yid int, yc int, yb int, ye int")
    got = sorted((r.xid, r.yid) for r in intervals.range_join(left, right, {"xc": "yc"}, ("xb", "xe"), ("yb", "ye"), spread).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[2] < y[3] and x[3] > y[2])


def test_a_crowded_cell_is_many_parts(spark):
    one = spark.range(1000).select(F.col("id"), F.lit(7).alias("cell"))
    full = intervals.crowded(one, ["cell"], 100)
    assert [tuple(r) for r in full.collect()] == [(7, 10)]
    left = spark.createDataFrame([(k, 7) for k in range(3)], "xid int, xcell int")
    a, b, on = intervals.dealt(left, one, (["xcell"], ["cell"]), 100)
    sizes = [r["count"] for r in b.groupBy("_part1_own").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 200 and a.join(b, [F.col("xcell") == F.col("cell"), *on]).count() == 3000


# point tables


def test_point_tables_are_not_shuffled(spark, tmp_path):
    key = "chrom string, pos int, ref string, alt string"
    kinds = {"dbsnp": ", rs bigint", "clinvar": ", record_no int, vcv string, version int, significance string, review_status string", "cadd": ", PHRED double", "dbnsfp": ", REVEL_score string"}
    values = {"dbsnp": (7,), "clinvar": (1, "VCV1", 2, "Benign", "x"), "cadd": (3.5,), "dbnsfp": ("0.1;0.9;.",)}
    loaded = []
    for kind, more in kinds.items():
        path = str(tmp_path / kind)
        tables.write_point_table(spark.createDataFrame([("1", k, "A", "T", *values[kind]) for k in range(50)], key + more), kind, path, 4)
        spark.sql(f"DROP TABLE {tables.table_name(path)}")  # as in a session that didn't write it
        loaded.append(tables.load_point_table(spark, kind, path))
    zero = F.struct(*(F.lit(1).alias(n) for n in ("an", "hom", "het", "hemi")))
    df = spark.createDataFrame([("1", k, "A", "T") for k in range(30, 80)], key).withColumns({n: zero for n in ("gnomad_exomes", "gnomad_genomes", "gnomad_mtdna", "helixmtdb", "inhouse")})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = annotate.annotate_variants(df, *loaded)
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = {r.pos: r for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1  # the cohort, once for all four tables
    assert rows[40].rs_id == "rs7" and rows[40].scores == {"cadd_phred": "3.5", "revel": "0.9"} and rows[40].clinvar.vcv_accession == "VCV1.2"
    assert rows[70].rs_id is None and rows[70].scores == {} and rows[70].clinvar is None


def test_point_table_without_a_column(spark, tmp_path):
    with pytest.raises(ValueError, match="rs"):
        tables.write_point_table(spark.createDataFrame([("1", 1, "A", "T")], "chrom string, pos int, ref string, alt string"), "dbsnp", str(tmp_path / "x"))


# streamed counts


def test_streamed_state_follows_its_batches(spark, tmp_path):
    ped = spark.createDataFrame([(c, "s", 0, "Female") for c in range(4)], "case_id long, sample string, idx int, sex string")
    call = lambda c, pos, gt: (c, "s", 1, pos, "A", "T", gt)
    far = 5 << stream.RANGE
    batches = [[call(0, 10, "0/1"), call(0, far, "1/1"), call(1, 10, "0/0")], [call(1, far + 1, "0/1")], [call(0, 10, "0/1"), call(0, far, "1/1")], [call(2, 10, "./."), call(2, 11, "./.")]]
    table, whole = str(tmp_path / "state"), []

    def read():
        return {tuple(r) for r in stream.count_stream(spark, table).collect()}

    assert read() == set()
    for k, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, stream.CALLS)
        whole += rows
        for _ in range(2 if k != 2 else 1):  # a batch that is run again
            stream.store_batch(batch, k, ped, table)
        want = {tuple(r) for r in counts.count_carriers(spark.createDataFrame(whole, stream.CALLS).distinct(), ped).select(*counts.KEY, *counts.CLASSES).collect()}
        assert read() == want
    written = lambda k: sorted(os.listdir(f"{table}/counts/batch={k}")) if os.path.isdir(f"{table}/counts/batch={k}") else []
    ranges = lambda k: [x for x in written(k) if x.startswith("part=")]
    assert ranges(0) == ["part=1-0", "part=1-5"] and ranges(1) == ["part=1-5"] and ranges(2) == [] and ranges(3) == ["part=1-0"]
    assert {x for x in os.listdir(f"{table}/calls/batch=1") if x.startswith("part=")} == {"part=1"}


def test_reference_rows_are_worked_out_once_before_their_ranges_are_found(spark, tmp_path):
    from pyspark.sql import functions as F

    from varspark.sources import sinks

    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(40).select((F.col("id") % 2).cast("int").alias("chrom_no"), (50 - F.col("id")).alias("b")).mapInArrow(passing, "chrom_no int, b long")
    sinks.write_background(rows, str(tmp_path / "t"), "grch37")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 40 and seen.value == 40

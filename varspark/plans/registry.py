"""The library's registered queries over the driver's tables, and the same results as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varspark.functions import scalars as S
from varspark.operators import annotate, cluster, counts, intervals, reshape, seqvars, stats, strucvars
from varspark.plans.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a function under its name, with its SQL over the named views."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# the library's layouts over the derived views


def trio_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small variants with the calls of index, father and mother; frequencies from the view's counts."""
    calls = F.array(*(F.struct(F.lit(s).alias("sample"), F.col(f"gt_{s}").alias("gt"), F.col("gq").cast("int").alias("gq"), F.col("dp").cast("int").alias("dp"), F.col("ad").cast("int").alias("ad"), F.lit(None).cast("int").alias("ps")) for s in ("index", "father", "mother")))
    nuclear = F.struct("an", "hom", "het", "hemi")
    mito = F.struct("an", "hom", "het")
    ann = F.array(F.struct("gene_id", F.array("csq").alias("consequences"), F.col("exon_dist").cast("int").alias("distance")))
    return view(spark, sf_dir, "fx_calls").select("case_id", "site_id", F.col("chrom_no").cast("int").alias("chrom_no"), "pos", F.lit("A").alias("ref"), F.lit("T").alias("alt"), calls.alias("calls"), ann.alias("ann"), nuclear.alias("gnomad_exomes"), nuclear.alias("gnomad_genomes"), nuclear.alias("inhouse"), mito.alias("gnomad_mtdna"), mito.alias("helixmtdb"))


def own_alleles(rows: DataFrame) -> DataFrame:
    """rows with an alternative allele for each site: sites whose numbers are 200000 apart share contig and position, and would else be one variant."""
    turn = F.conv(F.floor(F.col("site_id") / 200000).cast("string"), 10, 4)
    return rows.withColumn("alt", F.concat(F.lit("T"), F.translate(turn, "0123", "ACGT")))


def by_site(df: DataFrame) -> DataFrame:
    return df.groupBy("case_id", "site_id").agg(F.count("*").alias("n"))


SITES = "GROUP BY case_id, site_id"
PLAIN = "CASE WHEN {0} IN ('0/1', '0|1', '1/0', '1|0') THEN 'het' WHEN {0} IN ('1/1', '1|1', '1') THEN 'hom' WHEN {0} IN ('0/0', '0|0', '0') THEN 'ref' ELSE 'none' END"
GI, GF, GM = (PLAIN.format(f"gt_{s}") for s in ("index", "father", "mother"))
TRIO = {"index": {"genotype": "recessive-index"}, "father": {"genotype": "recessive-father"}, "mother": {"genotype": "recessive-mother"}}


@query(f"""SELECT case_id, site_id, count(*) AS n FROM fx_calls
WHERE CASE WHEN chrom_no = 24 THEN het <= 4 AND cast((hom + het) / 1000.0 AS float) <= cast(0.005 AS float)
      ELSE cast((2 * hom + het + hemi) / 1000.0 AS float) <= cast(0.006 AS float) AND hom <= 1 AND hemi <= 1 END {SITES}""", "fx_calls")  # fmt: skip
def freq_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"gnomad_exomes": {"enabled": True, "max_af": 0.006}, "gnomad_genomes": {"enabled": True, "max_hom": 1, "max_hemi": 1}, "helixmtdb": {"enabled": True, "max_het": 4}, "gnomad_mtdna": {"enabled": True, "max_af": 0.005}}
    return by_site(trio_variants(spark, sf_dir).where(seqvars.pass_frequency(settings)))


def quality_sql(s: str) -> str:
    g = PLAIN.format(f"gt_{s}")
    ab = "ad / cast(dp AS double)"
    return f"""NOT (({g} = 'het' AND (dp < 10 OR least({ab}, 1 - {ab}) + 0.000001 < 0.2)) OR ({g} = 'hom' AND dp < 5) OR gq < 20 OR ({g} <> 'ref' AND (ad < 3 OR ad > 45)))"""


@query(f"SELECT case_id, site_id, count(*) AS n FROM fx_calls WHERE {' AND '.join(map(quality_sql, ('index', 'mother')))} {SITES}", "fx_calls")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = {"filter_active": True, "min_dp_het": 10, "min_dp_hom": 5, "min_ab": 0.2, "min_gq": 20, "min_ad": 3, "max_ad": 45}
    return by_site(trio_variants(spark, sf_dir).where(seqvars.pass_quality({"sample_qualities": {"index": own, "mother": own, "father": {"filter_active": False}}})))


@query(f"SELECT case_id, site_id, count(*) AS n FROM fx_calls WHERE {GI} IN ('het', 'hom') AND {GF} IN ('ref', 'het') AND (gt_mother LIKE '%.%' OR {GM} = 'ref') {SITES}", "fx_calls")
def genotype_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"sample_genotypes": {"index": {"genotype": "variant"}, "father": {"genotype": "non-hom"}, "mother": {"genotype": "ref", "include_no_call": True}}}
    return by_site(trio_variants(spark, sf_dir).where(seqvars.pass_genotype(settings)))


@query(f"SELECT case_id, site_id, count(*) AS n FROM fx_calls WHERE chrom_no = 24 OR csq IN ('stop_gained', 'frameshift_variant') {SITES}", "fx_calls")
def consequence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_site(trio_variants(spark, sf_dir).where(seqvars.pass_consequence({"consequences": ["stop_gained", "frameshift_variant"]})))


@query(f"SELECT case_id, site_id, count(*) AS n FROM fx_calls WHERE (chrom_no = 3 AND pos BETWEEN 20000 AND 90000) OR chrom_no = 7 {SITES}", "fx_calls")
def region_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_site(trio_variants(spark, sf_dir).where(seqvars.pass_regions({"region_allowlist": [(3, 20000, 90000), (7, None, None)]})))


@query(f"SELECT case_id, site_id, count(*) AS n FROM fx_calls WHERE gene_id IN ('HGNC:3', 'HGNC:5', 'HGNC:8') {SITES}", "fx_calls")
def gene_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_site(trio_variants(spark, sf_dir).where(seqvars.pass_genes({"gene_allowlist": ["HGNC:3", "HGNC:5", "HGNC:8"]})))


@query("""SELECT p.param_id, count(*) AS n, sum(site_id) AS sites FROM fx_calls, (VALUES ('a', 0.004, 50), ('b', 0.008, 200)) AS p(param_id, max_freq, max_dist)
WHERE CASE WHEN chrom_no = 24 THEN true ELSE cast((2 * hom + het + hemi) / 1000.0 AS float) <= cast(p.max_freq AS float) AND exon_dist <= p.max_dist END GROUP BY p.param_id""", "fx_calls")  # fmt: skip
def prefilter_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = spark.createDataFrame([("a", 0.004, 50), ("b", 0.008, 200)], "param_id string, max_freq double, max_exon_dist int")
    return seqvars.prefilter(trio_variants(spark, sf_dir), params).groupBy("param_id").agg(F.count("*").alias("n"), F.sum("site_id").alias("sites"))


def count_of(kind: str) -> str:
    return f"((CASE WHEN {GF} = '{kind}' THEN 1 ELSE 0 END) + (CASE WHEN {GM} = '{kind}' THEN 1 ELSE 0 END))"


RECESSIVE = f"""CASE WHEN chrom_no < 22 THEN ({GI} = 'hom' AND {GF} = 'het' AND {GM} = 'het') OR ({GI} = 'het' AND {count_of('hom')} = 0 AND {count_of('het')} <= 1 AND {count_of('ref')} <= 1)
     WHEN chrom_no = 22 THEN {GI} = 'hom' AND {GF} = 'ref' AND {GM} = 'het' ELSE false END"""


@query(f"SELECT case_id, site_id, count(*) AS n FROM fx_calls WHERE {RECESSIVE} {SITES}", "fx_calls")
def recessive_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_site(trio_variants(spark, sf_dir).where(seqvars.pass_genotype({"recessive_mode": "any", "sample_genotypes": TRIO})))


@query(f""", kept AS (SELECT *, {GI} AS gi, {GF} AS gf, {GM} AS gm FROM fx_calls WHERE {RECESSIVE}),
genes AS (SELECT case_id, gene_id FROM (SELECT *, gf <> 'hom' AND gm <> 'hom' AND gi = 'het' AND ((gf = 'het' AND gm = 'ref') OR (gf = 'ref' AND gm = 'het')) AS fits FROM kept) AS k GROUP BY case_id, gene_id
  HAVING bool_or((chrom_no <> 22 AND gi = 'hom' AND gf = 'het' AND gm = 'het') OR (chrom_no = 22 AND gi = 'hom' AND gf = 'ref' AND gm = 'het'))
      OR (sum(CASE WHEN fits THEN 1 ELSE 0 END) >= 2 AND bool_or(fits AND gf = 'het') AND bool_or(fits AND gf = 'ref') AND bool_or(fits AND gm = 'het') AND bool_or(fits AND gm = 'ref')))
SELECT case_id, site_id, count(*) AS n FROM kept JOIN genes USING (case_id, gene_id) {SITES}""", "fx_calls")  # fmt: skip
def recessive_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_site(seqvars.filter_seqvars(trio_variants(spark, sf_dir), {"recessive_mode": "any", "sample_genotypes": TRIO}))


def long_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_calls")
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("sample"), F.col(f"gt_{s}").alias("gt")) for s in ("index", "father", "mother"))))
    return rows.select("case_id", F.col("chrom_no").cast("int").alias("chrom_no"), "pos", F.lit("A").alias("ref"), F.lit("T").alias("alt"), each.alias("c")).select("case_id", "c.sample", "chrom_no", "pos", "ref", "alt", "c.gt")


def pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = F.array(F.struct(F.lit("index").alias("sample"), F.lit(0).alias("idx"), F.col("sex_index").alias("sex")), F.struct(F.lit("father").alias("sample"), F.lit(1).alias("idx"), F.lit("Male").alias("sex")), F.struct(F.lit("mother").alias("sample"), F.lit(2).alias("idx"), F.lit("Female").alias("sex")))
    return view(spark, sf_dir, "fx_ped").select("case_id", F.explode(members).alias("m")).select("case_id", "m.*")


def class_sql(where: str = "true") -> str:
    return f""", long AS (SELECT case_id, 'index' AS sample, 0 AS idx, chrom_no, pos, gt_index AS gt FROM fx_calls WHERE {where} UNION ALL SELECT case_id, 'father', 1, chrom_no, pos, gt_father FROM fx_calls WHERE {where} UNION ALL SELECT case_id, 'mother', 2, chrom_no, pos, gt_mother FROM fx_calls WHERE {where}),
single AS (SELECT case_id, sample, idx, chrom_no, pos, min(gt) AS gt FROM long GROUP BY ALL),
known AS (SELECT s.*, CASE sample WHEN 'index' THEN sex_index WHEN 'father' THEN 'Male' ELSE 'Female' END AS sex, {PLAIN.format('gt')} AS k,
  (chrom_no = 22 AND pos BETWEEN 60001 AND 2699520) OR (chrom_no = 23 AND pos BETWEEN 10001 AND 2649520) AS par FROM single s JOIN fx_ped USING (case_id)),
classes AS (SELECT *, CASE WHEN k = 'none' THEN NULL WHEN chrom_no NOT IN (22, 23) OR (sex = 'Male' AND par) OR (sex = 'Female' AND chrom_no = 22) THEN CASE k WHEN 'ref' THEN 'homref' WHEN 'het' THEN 'het' ELSE 'homalt' END
  WHEN sex = 'Male' THEN CASE k WHEN 'ref' THEN 'hemiref' ELSE 'hemialt' END END AS class FROM known),
tallied AS (SELECT chrom_no, pos, sum(CASE WHEN class = 'homref' THEN 1 ELSE 0 END) AS homref, sum(CASE WHEN class = 'hemiref' THEN 1 ELSE 0 END) AS hemiref, sum(CASE WHEN class = 'het' THEN 1 ELSE 0 END) AS het,
  sum(CASE WHEN class = 'homalt' THEN 2 ELSE 0 END) AS homalt_alleles, sum(CASE WHEN class = 'hemialt' THEN 1 ELSE 0 END) AS hemialt FROM classes GROUP BY chrom_no, pos)"""


SUMS = ("homref", "hemiref", "het", "homalt_alleles", "hemialt")


@query(class_sql() + " SELECT chrom_no, pos, " + ", ".join(f"cast({c} AS bigint) AS {c}" for c in SUMS) + " FROM tallied", "fx_calls", "fx_ped")
def inhouse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_carriers(long_calls(spark, sf_dir), pedigree(spark, sf_dir)).select(F.col("chrom_no").cast("long").alias("chrom_no"), "pos", *(F.col(c).cast("long").alias(c) for c in SUMS))


@query(class_sql() + """ SELECT chrom_no, pos, count(*) AS n, string_agg(tag, ',' ORDER BY tag) AS carriers FROM
  (SELECT DISTINCT chrom_no, pos, concat(lpad(cast(case_id AS varchar), 4, '0'), ':', cast(idx AS varchar), ':', class) AS tag FROM classes WHERE class IN ('het', 'homalt', 'hemialt')) AS t GROUP BY chrom_no, pos""", "fx_calls", "fx_ped")  # fmt: skip
def inhouse_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counts.list_carriers(long_calls(spark, sf_dir), pedigree(spark, sf_dir))
    tag = lambda c: F.concat_ws(":", F.lpad(c["case_id"].cast("string"), 4, "0"), c["idx"].cast("string"), F.regexp_replace(c["genotype"], "_alleles", ""))
    return rows.select(F.col("chrom_no").cast("long").alias("chrom_no"), "pos", F.size("carriers").cast("long").alias("n"), F.array_join(F.array_sort(F.transform("carriers", tag)), ",").alias("carriers"))


@query(class_sql() + " SELECT case_id, count(*) AS n, cast(sum(homref + hemiref + tallied.het + homalt_alleles + hemialt) AS bigint) AS an, cast(sum(homalt_alleles) AS bigint) AS hom, cast(sum(tallied.het) AS bigint) AS het, cast(sum(hemialt) AS bigint) AS hemi FROM fx_calls JOIN tallied USING (chrom_no, pos) GROUP BY case_id", "fx_calls", "fx_ped")
def inhouse_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = counts.count_carriers(long_calls(spark, sf_dir), pedigree(spark, sf_dir))
    rows = counts.add_inhouse(trio_variants(spark, sf_dir), table)
    return rows.groupBy("case_id").agg(F.count("*").alias("n"), *(F.sum(f"inhouse.{c}").cast("long").alias(c) for c in ("an", "hom", "het", "hemi")))


@query(class_sql() + " SELECT chrom_no, pos, " + ", ".join(f"cast({c} AS bigint) AS {c}" for c in SUMS) + " FROM tallied", "fx_calls", "fx_ped")
def inhouse_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calls of even cases, then of odd cases and of case 4 once more: counted as if each had come once."""
    calls, ped = long_calls(spark, sf_dir), pedigree(spark, sf_dir)
    old, new = (counts.classified(calls.where(test), ped, "grch37") for test in ("case_id % 2 = 0", "case_id % 2 = 1 OR case_id = 4"))
    return counts.count_classes(counts.update_classified(old, new)).select(F.col("chrom_no").cast("long").alias("chrom_no"), "pos", *(F.col(c).cast("long").alias(c) for c in SUMS))


def sv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    call = F.struct(F.lit("index").alias("sample"), "gt", (F.col("sv_id") % 99).cast("double").alias("gq"), (F.col("sv_id") % 30).cast("double").alias("pr_cov"), (F.col("sv_id") % 12).cast("double").alias("pr_var"), (F.col("sv_id") % 20).cast("double").alias("sr_cov"), F.when(F.col("sv_id") % 5 != 0, (F.col("sv_id") % 9).cast("double")).alias("sr_var"), F.lit(2.0).alias("cn"), F.lit(1.0).alias("anc"), F.lit(5.0).alias("pc"), F.lit(50.0).alias("amq"))
    return view(spark, sf_dir, "fx_sv").select("sv_id", "case_id", F.col("chrom_no").cast("int").alias("chrom_no"), F.col("chrom_no").cast("int").alias("chrom_no2"), "pos", "sv_end", "sv_type", F.col("sv_type").alias("sv_sub_type"), F.array(call).alias("calls"), "gt")


@query("""SELECT sv_id FROM fx_sv WHERE sv_type IN ('DEL', 'DUP', 'INS', 'BND') AND (sv_type IN ('INS', 'BND') OR (sv_end - pos + 1 >= 500 AND sv_end - pos + 1 <= 4000))
AND CASE WHEN sv_type = 'INS' THEN chrom_no IN (1, 2) AND pos - 51 < 100000 AND pos + 50 > 10000
  WHEN sv_type = 'BND' THEN chrom_no IN (1, 2) AND ((pos - 51 < 100000 AND pos + 50 > 10000) OR (sv_end - 51 < 100000 AND sv_end + 50 > 10000)) ELSE chrom_no IN (1, 2) AND pos - 1 < 100000 AND sv_end > 10000 END""", "fx_sv")  # fmt: skip
def sv_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = {"sv_types": ["DEL", "DUP", "INS", "BND"], "sv_size_min": 500, "sv_size_max": 4000, "genomic_region": [(1, 10000, 100000), (2, 10000, 100000)]}
    return sv_table(spark, sf_dir).where(strucvars.pass_selection(settings) & strucvars.pass_region(settings)).select("sv_id")


CRITERIA = [
    {"genotype": "het", "select_sv_sub_type": ["DEL", "DUP", "INS"], "select_sv_min_size": 200, "gt_one_of": ["0/1"], "min_gq": 10, "min_sr_var": 3, "missing_sr_ok": True, "max_pr_ab": 0.4},
    {"genotype": "hom", "select_sv_sub_type": ["DEL", "DUP", "INV", "INS", "BND"], "gt_one_of": ["1/1"], "min_pr_cov": 5, "min_srpr_var": 6},
]


CALL_SQL = "SELECT *, sv_id % 99 AS gq, sv_id % 30 AS pc, sv_id % 12 AS pv, sv_id % 20 AS sc, CASE WHEN sv_id % 5 <> 0 THEN sv_id % 9 END AS sv FROM fx_sv"
HET_SQL = """sv_type IN ('DEL', 'DUP', 'INS') AND (sv_type = 'INS' OR sv_end - pos + 1 >= 200) AND gt = '0/1' AND gq >= 10 AND coalesce(sv >= 3, true)
    AND (CASE WHEN pc = 0 THEN false ELSE least(pv / cast(pc AS double), 1 - pv / cast(pc AS double)) <= 0.4 END)"""
HOM_SQL = "gt = '1/1' AND pc >= 5 AND coalesce(pv + sv >= 6, false)"


@query(f""", v AS ({CALL_SQL}) SELECT sv_id, 'het' AS effective FROM v WHERE {HET_SQL} UNION ALL SELECT sv_id, 'hom' FROM v WHERE {HOM_SQL}""", "fx_sv")
def sv_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The criteria of either genotype choice, with the genotypes that they ask for."""
    out = None
    for choice in ("het", "hom"):
        rows = strucvars.match_criteria(sv_table(spark, sf_dir), {"genotype": {"index": choice}, "genotype_criteria": CRITERIA}).where("pass_all")
        rows = rows.select("sv_id", F.col("matched")[0]["effective"].alias("effective"))
        out = rows if out is None else out.union(rows)
    return out


SOURCES = ["dgv", "gnomad", "inhouse"]
HITS = """, asks AS (SELECT sv_id, chrom_no, sv_type, CASE WHEN sv_type IN ('INS', 'BND') THEN pos - 51 ELSE pos - 1 END AS pb, CASE WHEN sv_type IN ('INS', 'BND') THEN pos + 50 ELSE sv_end END AS pe FROM fx_sv),
hits AS (SELECT a.sv_id, b.source, b.cnt FROM asks a JOIN fx_bg b ON a.chrom_no = b.chrom_no AND a.pb < b.e AND a.pe > b.b
  AND (a.sv_type = b.sv_type OR (a.sv_type IN ('DEL', 'DUP') AND b.sv_type = 'CNV'))
  AND (a.sv_type IN ('INS', 'BND') OR cast(least(a.pe, b.e) - greatest(a.pb, b.b) AS double) / cast(greatest(a.pe - a.pb, b.e - b.b) AS double) >= 0.75)),
tally AS (SELECT sv_id, """ + ", ".join(f"cast(coalesce(sum(CASE WHEN source = '{s}' THEN cnt END), 0) AS bigint) AS count_{s}" for s in SOURCES) + " FROM (SELECT DISTINCT sv_id FROM fx_sv) AS i LEFT JOIN hits USING (sv_id) GROUP BY sv_id)"  # fmt: skip


@query(HITS + " SELECT * FROM tally", "fx_sv", "fx_bg")
def bg_overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.overlap_counts(view(spark, sf_dir, "fx_sv"), view(spark, sf_dir, "fx_bg"), SOURCES, 0.75)


#: Seven background databases with a least overlap each, None for any.
SEVEN = {"dbvar": 0.5, "dgv": 0.75, "dgv_gs": None, "g1k": 0.9, "gnomad_exomes": None, "gnomad_genomes": 0.6, "inhouse": 0.8}
SEVEN_SQL = "SELECT *, CASE (b + cnt) % 7 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(SEVEN)) + " END AS name FROM fx_bg"


@query(f""", seven AS ({SEVEN_SQL}), least_of(name, most) AS (VALUES {", ".join(f"('{s}', {'NULL' if x is None else x})" for s, x in SEVEN.items())}),
asks AS (SELECT sv_id, chrom_no, sv_type, CASE WHEN sv_type IN ('INS', 'BND') THEN pos - 51 ELSE pos - 1 END AS pb, CASE WHEN sv_type IN ('INS', 'BND') THEN pos + 50 ELSE sv_end END AS pe FROM fx_sv),
hits AS (SELECT a.sv_id, b.name, b.cnt FROM asks a JOIN seven b ON a.chrom_no = b.chrom_no AND a.pb < b.e AND a.pe > b.b AND (a.sv_type = b.sv_type OR (a.sv_type IN ('DEL', 'DUP') AND b.sv_type = 'CNV')) JOIN least_of l ON b.name = l.name
  AND (most IS NULL OR a.sv_type IN ('INS', 'BND') OR cast(least(a.pe, b.e) - greatest(a.pb, b.b) AS double) / cast(greatest(a.pe - a.pb, b.e - b.b) AS double) >= most))
SELECT sv_id, """ + ", ".join(f"cast(coalesce(sum(CASE WHEN name = '{s}' THEN cnt END), 0) AS bigint) AS count_{s}" for s in SEVEN) + " FROM (SELECT DISTINCT sv_id FROM fx_sv) AS i LEFT JOIN hits USING (sv_id) GROUP BY sv_id", "fx_sv", "fx_bg")
def bg_overlap_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven background databases, each with its own least overlap or none."""
    which = F.get(F.array(*map(F.lit, SEVEN)), F.pmod(F.col("b") + F.col("cnt"), F.lit(7)).cast("int"))
    return intervals.overlap_counts(view(spark, sf_dir, "fx_sv"), view(spark, sf_dir, "fx_bg").withColumn("source", which), list(SEVEN), SEVEN)


@query(HITS + " SELECT sv_id FROM tally WHERE count_dgv <= 20 AND count_gnomad <= 30", "fx_sv", "fx_bg")
def bg_overlap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {"dgv": {"enabled": True, "max_count": 20}, "gnomad": {"enabled": True, "max_count": 30}, "inhouse": {"enabled": False, "max_count": 0}}
    rows = intervals.overlap_counts(view(spark, sf_dir, "fx_sv"), view(spark, sf_dir, "fx_bg"), SOURCES, 0.75)
    return rows.where(strucvars.pass_counts(limits, SOURCES)).select("sv_id")


@query(""", points AS (SELECT sv_id, chrom_no, 0 AS which, pos AS spot FROM fx_sv UNION ALL SELECT sv_id, chrom_no, 1, CASE WHEN sv_type IN ('INS', 'BND') THEN pos ELSE sv_end END FROM fx_sv),
hits AS (SELECT DISTINCT sv_id, which, kind FROM points p JOIN fx_region r ON p.chrom_no = r.chrom_no AND spot - 1 < e AND spot > b AND kind IN ('repeat', 'segdup'))
SELECT sv_id, count(CASE WHEN kind = 'segdup' THEN 1 END) AS masked_segdup, count(CASE WHEN kind = 'repeat' THEN 1 END) AS masked_repeat FROM (SELECT DISTINCT sv_id FROM fx_sv) AS i LEFT JOIN hits USING (sv_id) GROUP BY sv_id""", "fx_sv", "fx_region")  # fmt: skip
def masked_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.masked_breakpoints(view(spark, sf_dir, "fx_sv"), view(spark, sf_dir, "fx_region"), ["segdup", "repeat"])


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_region").where("kind = 'tad'").select("region_id", "chrom_no", "b", "e")


@query(""", tads AS (SELECT * FROM fx_region WHERE kind = 'tad'), edges AS (SELECT chrom_no, e AS spot FROM tads UNION SELECT chrom_no, min(b) FROM tads GROUP BY chrom_no),
points AS (SELECT sv_id, chrom_no, pos AS p FROM fx_sv UNION SELECT sv_id, chrom_no, CASE WHEN sv_type IN ('INS', 'BND') THEN pos ELSE sv_end END FROM fx_sv)
SELECT sv_id, min(CASE WHEN abs(p - spot) <= 10000 THEN abs(p - spot) END) AS distance FROM points LEFT JOIN edges USING (chrom_no) GROUP BY sv_id""", "fx_sv", "fx_region")  # fmt: skip
def nearest_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.nearest_boundary(view(spark, sf_dir, "fx_sv"), annotate.tad_boundaries(domains(spark, sf_dir)))


@query("SELECT q.query_id, count(*) AS n, cast(sum(cnt) AS bigint) AS cnt FROM fx_bg, (VALUES ('a', 1, 10000, 30000), ('b', 4, 0, 1073741824)) AS q(query_id, c, s, t) WHERE chrom_no = q.c AND b < q.t AND e > q.s GROUP BY q.query_id", "fx_bg")
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = spark.createDataFrame([("a", 1, 10000, 30000), ("b", 4, None, None)], "query_id string, q_chrom int, q_begin int, q_end int")
    return intervals.lookup_regions(asks, view(spark, sf_dir, "fx_bg")).groupBy("query_id").agg(F.count("*").alias("n"), F.sum("cnt").cast("long").alias("cnt"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_exon").groupBy("tx_id", "gene_id", "chrom_no").agg(F.min("exon_start").alias("tx_begin"), F.max("exon_end").alias("tx_end"))


PROBES = """probes AS (SELECT sv_id, sv_type, chrom_no, pos - 1 AS pb, CASE WHEN sv_type IN ('INS', 'BND') THEN pos ELSE sv_end END AS pe FROM fx_sv)"""


@query(f""", tx AS (SELECT tx_id, gene_id, chrom_no, min(exon_start) AS tb, max(exon_end) AS te FROM fx_exon GROUP BY ALL), {PROBES},
wide AS (SELECT sv_id, chrom_no, CASE WHEN sv_type IN ('INS', 'BND') THEN pos - 51 ELSE pos - 1 END AS pb, CASE WHEN sv_type IN ('INS', 'BND') THEN pos + 50 ELSE sv_end END AS pe FROM fx_sv
  UNION SELECT sv_id, chrom_no, sv_end - 51, sv_end + 50 FROM fx_sv WHERE sv_type = 'BND'),
doms AS (SELECT DISTINCT sv_id, r.chrom_no, r.b, r.e FROM wide w JOIN fx_region r ON w.chrom_no = r.chrom_no AND pb < e AND pe > b AND kind = 'tad'),
inside AS (SELECT DISTINCT sv_id, gene_id FROM doms d JOIN tx ON d.chrom_no = tx.chrom_no AND d.b < te AND d.e > tb),
direct AS (SELECT DISTINCT sv_id, gene_id FROM probes p JOIN tx ON p.chrom_no = tx.chrom_no AND pb < te AND pe > tb)
SELECT sv_id, gene_id FROM inside EXCEPT SELECT sv_id, gene_id FROM direct""", "fx_sv", "fx_region", "fx_exon")  # fmt: skip
def tad_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.tad_genes(view(spark, sf_dir, "fx_sv"), domains(spark, sf_dir), transcripts(spark, sf_dir))


REGIONS = """, lagged AS (SELECT *, lag(exon_end) OVER w AS before, lead(exon_start) OVER w AS after FROM fx_exon WINDOW w AS (PARTITION BY tx_id ORDER BY exon_start, exon_end)),
regions AS (SELECT tx_id, gene_id, chrom_no, 'exon' AS kind, exon_start AS b, exon_end AS e FROM lagged UNION ALL SELECT tx_id, gene_id, chrom_no, 'intron', before, exon_start FROM lagged WHERE before IS NOT NULL
  UNION ALL SELECT tx_id, gene_id, chrom_no, 'splice_region', exon_start - 8, exon_start + 3 FROM lagged WHERE before IS NOT NULL UNION ALL SELECT tx_id, gene_id, chrom_no, 'splice_region', exon_end - 3, exon_end + 8 FROM lagged WHERE after IS NOT NULL
  UNION ALL SELECT tx_id, gene_id, chrom_no, CASE WHEN strand = '+' THEN 'upstream' ELSE 'downstream' END, exon_start - 5000, exon_start FROM lagged WHERE before IS NULL
  UNION ALL SELECT tx_id, gene_id, chrom_no, CASE WHEN strand = '+' THEN 'downstream' ELSE 'upstream' END, exon_end, exon_end + 5000 FROM lagged WHERE after IS NULL)"""


@query(REGIONS + " SELECT * FROM regions", "fx_exon")
def tx_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.tx_regions(view(spark, sf_dir, "fx_exon"))


EFFECTS = REGIONS + """, ends AS (SELECT sv_id, sv_type IN ('INS', 'BND') AS point, chrom_no, pos - 1 AS pb, CASE WHEN sv_type IN ('INS', 'BND') THEN pos ELSE sv_end END AS pe FROM fx_sv
  UNION ALL SELECT sv_id, true, chrom_no, sv_end - 1, sv_end FROM fx_sv WHERE sv_type = 'BND'),
found AS (SELECT DISTINCT sv_id, point, gene_id, concat(kind, '_variant') AS effect FROM ends p JOIN regions r ON p.chrom_no = r.chrom_no AND pb < e AND pe > b),
more AS (SELECT sv_id, gene_id, effect FROM found UNION SELECT sv_id, gene_id, 'transcript_variant' FROM found WHERE NOT point GROUP BY sv_id, gene_id HAVING bool_or(effect = 'upstream_variant') AND bool_or(effect = 'downstream_variant')
  UNION SELECT sv_id, NULL, 'intergenic_variant' FROM fx_sv WHERE sv_id NOT IN (SELECT sv_id FROM found))"""


@query(EFFECTS + " SELECT sv_id, gene_id, string_agg(effect, ',' ORDER BY effect) AS effects FROM more GROUP BY sv_id, gene_id", "fx_exon", "fx_sv")
def tx_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotate.tx_effects(view(spark, sf_dir, "fx_sv"), annotate.tx_regions(view(spark, sf_dir, "fx_exon")))
    return rows.select("sv_id", "gene_id", F.array_join("effects", ",").alias("effects"))


@query(f""", tx AS (SELECT tx_id, gene_id, chrom_no, min(exon_start) AS tb, max(exon_end) AS te FROM fx_exon GROUP BY ALL), {PROBES}
SELECT sv_id, count(DISTINCT gene_id) AS n, min(gene_id) AS first_gene FROM probes p JOIN tx ON p.chrom_no = tx.chrom_no AND pb < te AND pe > tb GROUP BY sv_id""", "fx_sv", "fx_exon")  # fmt: skip
def sv_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = annotate.overlapping_genes(view(spark, sf_dir, "fx_sv"), transcripts(spark, sf_dir))
    return rows.select("sv_id", F.size("gene_ids").cast("long").alias("n"), F.array_min("gene_ids").alias("first_gene"))


def xlink(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = view(spark, sf_dir, "fx_exon").select("gene_id").distinct()
    number = F.split_part("gene_id", F.lit(":"), F.lit(2)).cast("long")
    return own.select(F.col("gene_id").alias("hgnc_id"), (number + 100000).alias("ensembl_id"), (number + 5000).alias("entrez_id"), F.concat(F.lit("SYM"), number.cast("string")).alias("symbol"))


LINK = """xl AS (SELECT DISTINCT gene_id, cast(split_part(gene_id, ':', 2) AS bigint) AS no FROM fx_exon)"""


@query(f", {LINK} SELECT DISTINCT c.gene_id, CASE WHEN no IS NULL THEN NULL ELSE concat('SYM', cast(no AS varchar)) END AS symbol, no + 5000 AS entrez_id, CASE WHEN no IS NULL THEN NULL ELSE concat('ENSG', lpad(cast(no + 100000 AS varchar), 11, '0')) END AS ensembl, coalesce(no % 7 = 0, false) AS is_acmg, coalesce(no % 3 = 0, false) AS is_disease_gene FROM fx_calls c LEFT JOIN xl USING (gene_id)", "fx_calls", "fx_exon")
def gene_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = xlink(spark, sf_dir)
    ids = view(spark, sf_dir, "fx_calls").select("gene_id").distinct()
    return annotate.gene_details(ids, links, links.where((F.col("entrez_id") - 5000) % 7 == 0), links.where((F.col("entrez_id") - 5000) % 3 == 0))


@query(f""", {LINK}, terms AS (SELECT no, CASE no % 4 WHEN 0 THEN 'AutosomalDominant' WHEN 1 THEN 'AutosomalRecessive' WHEN 2 THEN 'XLinkedRecessive' END AS mode FROM xl UNION SELECT no, 'Mitochondrial' FROM xl WHERE no % 5 = 0)
SELECT concat('HGNC:', cast(no AS varchar)) AS hgnc_id, string_agg(mode, ',' ORDER BY mode) AS modes FROM terms WHERE mode IS NOT NULL GROUP BY no""", "fx_exon")  # fmt: skip
def moi_by_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = xlink(spark, sf_dir)
    no = F.col("entrez_id") - 5000
    kind = F.when(no % 4 == 0, "HP:0000006").when(no % 4 == 1, "HP:0000007").when(no % 4 == 2, "HP:0001423").otherwise("HP:0000118")
    terms = links.select("entrez_id", kind.alias("hpo_id")).union(links.where(no % 5 == 0).select("entrez_id", F.lit("HP:0001427")))
    return stats.moi_by_gene(terms, links).select("hgnc_id", F.array_join("modes", ",").alias("modes"))


@query(""", s AS (SELECT DISTINCT site_id, dp, ad, gq FROM fx_calls) SELECT site_id, dp, ad, gq, cast(greatest(dp, ad, gq) AS double) AS best, CASE WHEN dp = greatest(dp, ad, gq) THEN 'dp' WHEN ad = greatest(dp, ad, gq) THEN 'ad' ELSE 'gq' END AS which FROM s""", "fx_calls")
def score_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_calls").select("site_id", "dp", "ad", "gq").distinct()
    # columns of their own: the best and its name use each several times
    texts = {n: stats.max_of_list(F.concat(F.lit(".;"), F.col(n).cast("string"), F.lit(";-1"))).alias(f"most_{n}") for n in ("dp", "ad", "gq")}
    best, which = stats.extreme_of({n: F.col(f"most_{n}") for n in texts})
    return rows.select("*", *texts.values()).select(*rows.columns, best.alias("best"), which.alias("which"))


@query(f"SELECT 'total' AS what, count(*) AS n FROM fx_calls UNION ALL SELECT 'passed', count(*) FROM fx_calls WHERE {GI} = 'het' UNION ALL SELECT csq, count(*) FROM fx_calls WHERE {GI} = 'het' GROUP BY csq", "fx_calls")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trio_variants(spark, sf_dir)
    return stats.query_stats(rows.where(seqvars.pass_genotype({"sample_genotypes": {"index": {"genotype": "het"}}})), rows)


@query("SELECT sv_type, count(*) AS n FROM fx_sv GROUP BY sv_type", "fx_sv")
def sv_type_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sv_stats(view(spark, sf_dir, "fx_sv"))


@query(""", padded AS (SELECT *, b - 1 - slack AS pb, e + slack AS pe FROM (SELECT sv_id, chrom_no, sv_type, pos - 1 AS b, sv_end AS e, CASE WHEN sv_type IN ('INS', 'BND') THEN 50 ELSE 0 END AS slack FROM fx_sv) AS p),
marked AS (SELECT *, CASE WHEN pb < max(pe) OVER (PARTITION BY chrom_no, sv_type ORDER BY pb, pe ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM padded)
SELECT chrom_no, sv_type, cast(sum(opens) AS bigint) AS islands, count(*) AS n FROM marked GROUP BY chrom_no, sv_type""", "fx_sv")  # fmt: skip
def sv_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster_input(spark, sf_dir)
    slack = F.when(F.col("sv_type").isin("INS", "BND"), 50).otherwise(0)
    placed = intervals.islands(rows.withColumns({"pb": F.col("b") - slack - 1, "pe": F.col("e") + slack}), ["chrom_no", "sv_type"], "pb", "pe")
    return placed.groupBy("chrom_no", "sv_type").agg(F.max("island").cast("long").alias("islands"), F.count("*").alias("n"))


def cluster_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_sv").select("sv_id", "case_id", "chrom_no", "sv_type", (F.col("pos") - 1).alias("b"), F.col("sv_end").alias("e"), F.lit(1).cast("long").alias("carriers"))


def greedy_sql(keys: str) -> str:
    """Clusters by their definition: the rows of all keys in step, one of each at a time, with every member of every cluster at hand."""
    near = "CASE WHEN sv_type IN ('INS', 'BND') THEN b - 50 < c.own[1].e AND e + 50 > c.own[1].b ELSE len(list_filter(c.own, lambda m: least(e, m.e) - greatest(b, m.b) < cast(0.8 AS DOUBLE) * greatest(e - b, m.e - m.b))) = 0 END"
    return f""", own AS (SELECT sv_id, case_id, chrom_no, sv_type, pos - 1 AS b, sv_end AS e FROM fx_sv),
stepped AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY b, e, sv_id) AS n FROM own),
run({keys}, n, clusters) AS (SELECT DISTINCT {keys}, cast(0 AS BIGINT), cast([] AS STRUCT(own STRUCT(b BIGINT, e BIGINT, sv_id BIGINT)[])[]) FROM own
  UNION ALL SELECT {keys}, n, CASE WHEN k IS NULL THEN list_append(clusters, {{'own': [me]}}) ELSE list_transform(clusters, lambda c, i: CASE WHEN i = k THEN {{'own': list_append(c.own, me)}} ELSE c END) END
  FROM (SELECT *, list_position(list_transform(clusters, lambda c: {near}), true) AS k, {{'b': cast(b AS BIGINT), 'e': cast(e AS BIGINT), 'sv_id': cast(sv_id AS BIGINT)}} AS me FROM (SELECT s.*, run.clusters FROM run JOIN stepped s USING ({keys}) WHERE s.n = run.n + 1))),
found AS (SELECT {keys}, unnest(clusters).own AS own FROM run JOIN (SELECT {keys}, max(n) AS n FROM stepped GROUP BY ALL) AS last USING ({keys}, n))"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(greedy_sql("chrom_no, sv_type") + " SELECT chrom_no, sv_type, own[1].b AS b, own[1].e AS e, own[1].sv_id AS sv_id, cast(len(own) AS bigint) AS carriers, cast(len(own) AS bigint) AS size FROM found", "fx_sv")
def sv_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.cluster_svs(cluster_input(spark, sf_dir), ["carriers"])


@query(greedy_sql("case_id, chrom_no, sv_type") + """ SELECT case_id, chrom_no, sv_type, own[1].b AS b, own[1].e AS e, own[1].sv_id AS sv_id,
  array_to_string(list_sort(list_distinct(list_transform(own, lambda m: CASE m.sv_id % 2 WHEN 0 THEN 'Delly' ELSE 'Manta' END))), ',') AS callers FROM found""", "fx_sv")  # fmt: skip
def sv_merge_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cluster_input(spark, sf_dir).withColumn("callers", F.array(F.when(F.col("sv_id") % 2 == 0, "Delly").otherwise("Manta")))
    return cluster.merge_callers(rows).withColumn("callers", F.array_join("callers", ","))


for _name in ("sv_cluster", "sv_merge_callers"):
    SQL[_name] = recursive(SQL[_name])


@query(""", known AS (SELECT sv_id, chrom_no, gt, CASE case_id % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Unknown' END AS sex FROM fx_sv),
flags AS (SELECT sv_id, gt, chrom_no IN (22, 23) AND sex = 'Male' AND gt <> '0/0' AS hemi, gt <> '0/0' AND (chrom_no NOT IN (22, 23) OR (sex = 'Female' AND chrom_no = 22)) AS dip FROM known)
SELECT sv_id, count(CASE WHEN dip AND gt = '0/1' THEN 1 END) AS carriers_het, count(CASE WHEN dip AND gt = '1/1' THEN 1 END) AS carriers_hom, count(CASE WHEN hemi THEN 1 END) AS carriers_hemi, count(CASE WHEN hemi OR dip THEN 1 END) AS carriers FROM flags GROUP BY sv_id""", "fx_sv")  # fmt: skip
def sv_carriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_sv").select("sv_id", "case_id", F.lit("index").alias("sample"), F.col("chrom_no").cast("int").alias("chrom_no"), "gt")
    sex = F.when(F.col("case_id") % 3 == 0, "Male").when(F.col("case_id") % 3 == 1, "Female").otherwise("Unknown")
    ped = rows.select("case_id").distinct().select("case_id", F.lit("index").alias("sample"), sex.alias("sex"))
    return counts.count_sv_carriers(rows, ped)


@query("""SELECT site_id, k AS allele, CASE WHEN gt = '0/1' THEN CASE k WHEN 1 THEN '0/1' ELSE '0/0' END WHEN gt = '1|2' THEN CASE k WHEN 1 THEN '1|0' ELSE '0|1' END ELSE './.' END AS gt, dp - ad_k AS ad_ref, ad_k AS ad_alt, count(*) AS n
FROM (SELECT site_id, k, CASE site_id % 3 WHEN 0 THEN '0/1' WHEN 1 THEN '1|2' ELSE './.' END AS gt, dp, CASE k WHEN 1 THEN ad ELSE gq END AS ad_k FROM fx_calls CROSS JOIN (VALUES (1), (2)) AS v(k)) AS x GROUP BY ALL""", "fx_calls")  # fmt: skip
def multiallelic_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    gt = F.when(F.col("site_id") % 3 == 0, "0/1").when(F.col("site_id") % 3 == 1, "1|2").otherwise("./.")
    call = F.struct(F.lit("index").alias("sample"), gt.alias("gt"), "dp", F.array(F.lit(0).cast("long"), "ad", "gq").alias("ads"), F.lit(9).alias("gq"))
    raw = view(spark, sf_dir, "fx_calls").select("site_id", F.lit("A").alias("ref"), F.lit("C,G,*").alias("alt"), F.array(call).alias("calls"))
    rows = reshape.split_alleles(raw).select("site_id", F.when(F.col("alt") == "C", 1).otherwise(2).alias("allele"), F.col("calls")[0].alias("c"))
    return rows.groupBy("site_id", "allele", F.col("c.gt").alias("gt"), F.col("c.ads")[0].alias("ad_ref"), F.col("c.ads")[1].alias("ad_alt")).agg(F.count("*").alias("n"))


@query("SELECT case_id, sample, count(*) AS n FROM (SELECT case_id, concat('case', cast(case_id AS varchar), '-', role) AS sample FROM fx_calls CROSS JOIN (VALUES ('index'), ('father'), ('mother')) AS v(role)) AS x GROUP BY case_id, sample", "fx_calls")
def id_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = long_calls(spark, sf_dir).withColumn("file", F.col("case_id").cast("string"))
    mapping = calls.select("case_id", "file", F.col("sample").alias("src")).distinct().select("file", "src", F.concat(F.lit("case"), F.col("case_id").cast("string"), F.lit("-"), F.col("src")).alias("dst"))
    return reshape.rename_samples(calls, mapping).groupBy("case_id", "sample").agg(F.count("*").alias("n"))


@query(""", sets AS (SELECT case_id, site_id % 4 AS file, string_agg(DISTINCT CASE WHEN site_id % 4 = 0 AND case_id % 2 = 0 THEN 'index' ELSE 'other' END, ',') AS samples FROM fx_calls GROUP BY ALL)
SELECT case_id, count(*) AS files, count(DISTINCT samples) AS sample_sets, count(DISTINCT samples) = 1 AS same FROM sets GROUP BY case_id""", "fx_calls")  # fmt: skip
def sample_set_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.col("site_id") % 4
    rows = view(spark, sf_dir, "fx_calls").select("case_id", file.alias("file"), F.when((file == 0) & (F.col("case_id") % 2 == 0), "index").otherwise("other").alias("sample"))
    return reshape.check_samples(rows)


@query(f", {LINK} SELECT token, gene_id AS hgnc_id FROM (SELECT CASE no % 4 WHEN 0 THEN gene_id WHEN 1 THEN cast(no + 5000 AS varchar) WHEN 2 THEN concat('ENSG', lpad(cast(no + 100000 AS varchar), 11, '0')) ELSE concat('SYM', cast(no AS varchar)) END AS token, gene_id FROM xl) AS t", "fx_exon")
def gene_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = xlink(spark, sf_dir)
    no = F.col("entrez_id") - 5000
    token = F.when(no % 4 == 0, F.col("hgnc_id")).when(no % 4 == 1, F.col("entrez_id").cast("string")).when(no % 4 == 2, S.ensembl_id(F.col("ensembl_id"))).otherwise(F.col("symbol"))
    found, _ = seqvars.translate_genes(links.select(token.alias("token")).union(links.limit(1).select(F.lit("nothing"))), links)
    return found


@query("""SELECT sv_id, CASE WHEN cast(floor((pos - 1) / 131072) AS bigint) = cast(floor((sv_end - 1) / 131072) AS bigint) THEN 585 + cast(floor((pos - 1) / 131072) AS bigint) ELSE 73 + cast(floor((pos - 1) / 1048576) AS bigint) END AS bin FROM fx_sv""", "fx_sv")
def genome_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_sv").select("sv_id", S.genome_bin(F.col("pos") - 1, F.col("sv_end")).cast("long").alias("bin"))


@query(""", cv AS (SELECT chrom_no, b, e, region_id, 1 + region_id % 5 AS sig FROM fx_region),
hits AS (SELECT sv_id, region_id FROM fx_sv s JOIN cv ON s.chrom_no = cv.chrom_no AND sig >= 4 AND sv_type NOT IN ('INS', 'BND') AND pos - 1 < e AND sv_end > b
  AND cast(least(sv_end, e) - greatest(pos - 1, b) AS double) / cast(greatest(sv_end - pos + 1, e - b) AS double) >= 0.5)
SELECT sv_id, string_agg(DISTINCT concat('RCV', lpad(cast(region_id AS varchar), 9, '0')), ',' ORDER BY concat('RCV', lpad(cast(region_id AS varchar), 9, '0'))) AS rcvs FROM hits GROUP BY sv_id""", "fx_sv", "fx_region")  # fmt: skip
def clinvar_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = view(spark, sf_dir, "fx_region").select("chrom_no", "b", "e", (F.col("region_id") % 5 + 1).alias("significance"), F.col("region_id").alias("rcv"))
    rows = annotate.clinvar_overlaps(view(spark, sf_dir, "fx_sv"), known, 0.5, 4)
    return rows.select("sv_id", F.array_join("rcvs", ",").alias("rcvs"))

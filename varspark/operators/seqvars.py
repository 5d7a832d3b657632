"""Filters on small variants. A predicate takes settings (a dict, missing ones off) and gives a Column that is never null.

The table: case_id, chrom, chrom_no, pos, ref, alt; calls array<struct<sample,gt,gq,dp,ad,ps>>; ann array of structs with gene_id,
consequences, distance; gnomad_exomes, gnomad_genomes, inhouse struct<an,hom,het,hemi>; gnomad_mtdna, helixmtdb struct<an,hom,het>.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varspark.functions.scalars import allele_frequency, spelled

#: Genotypes, without phase, that a choice stands for.
REF, HET, HOM = ("0", "0/0"), ("0/1",), ("1", "1/1")
CHOICES = {"ref": REF, "het": HET, "hom": HOM, "variant": HET + HOM, "any": REF + HET + HOM, "non-hom": REF + HET, "non-het": REF + HOM}
RECESSIVE_ROLES = {"recessive-index": "index", "recessive-father": "father", "recessive-mother": "mother"}


def every(tests: list[Column]) -> Column:
    return reduce(Column.__and__, (F.coalesce(t, F.lit(False)) for t in tests), F.lit(True))


def call_of(sample: str | Column) -> Column:
    """The sample's call, null if it has none; no lambda over the calls, so that it compiles."""
    return F.get("calls", F.array_position(F.col("calls.sample"), sample).cast("int") - 1)


def genotype_of(sample: str | Column) -> Column:
    """As it is written; compare it with spelled() forms."""
    return call_of(sample)["gt"]


def has(gt: Column, kind: tuple[str, ...]) -> Column:
    return gt.isin(spelled(kind))


def kind_codes(gts: list[Column]) -> Column:
    """One letter per genotype, in order: r ref, h het, H hom, - anything else or none. A look-up in a literal map, so that it compiles."""
    letters = {gt: letter for letter, kind in (("r", REF), ("h", HET), ("H", HOM)) for gt in spelled(kind)}
    table = F.create_map(*(F.lit(x) for kv in letters.items() for x in kv))
    return F.concat(*(F.coalesce(F.try_element_at(table, g), F.lit("-")) for g in gts))


def within(settings: dict, counts: Column, nuclear: bool = True, with_af: bool = True) -> Column:
    """Not above any of max_af, max_het, max_hom, max_hemi that is set; everything passes if not enabled. Missing counts are 0."""
    if not settings.get("enabled"):
        return F.lit(True)
    value = lambda name: F.coalesce(counts[name], F.lit(0))
    tests = []
    if with_af and settings.get("max_af") is not None:
        af = allele_frequency(value("an"), value("hom"), value("het"), value("hemi") if nuclear else None)
        tests.append(af <= F.lit(settings["max_af"]).cast("float"))
    for name in ("het", "hom", "hemi") if nuclear else ("het", "hom"):
        if settings.get(f"max_{name}") is not None:
            tests.append(value(name) <= settings[f"max_{name}"])
    return every(tests)


def pass_frequency(query: dict) -> Column:
    """Nuclear contigs by exomes, genomes and in-house counts, mitochondrial ones by their own sources and in-house counts."""
    own = lambda name: query.get(name) or {}
    nuclear = every([within(own("gnomad_exomes"), F.col("gnomad_exomes")), within(own("gnomad_genomes"), F.col("gnomad_genomes")), within(own("inhouse"), F.col("inhouse"), with_af=False)])
    mito = every([within(own("helixmtdb"), F.col("helixmtdb"), False), within(own("gnomad_mtdna"), F.col("gnomad_mtdna"), False), within(own("inhouse"), F.col("inhouse"), False, False)])
    return F.when(F.col("chrom_no") == 24, mito).otherwise(nuclear)


def pass_consequence(query: dict) -> Column:
    """No terms asked, a mitochondrial variant, or any annotation with one of the terms."""
    terms = query.get("consequences") or []
    if not terms:
        return F.lit(True)
    wanted = F.array(*map(F.lit, terms))
    return F.coalesce(F.col("chrom_no") == 24, F.lit(False)) | F.coalesce(F.exists("ann", lambda a: F.arrays_overlap(a["consequences"], wanted)), F.lit(False))


def quality_ok(s: Column | dict, call: Column) -> Column:
    """Whether a call meets the limits of s: a dict of literals, or a struct of the row in which null is none."""
    is_het, is_hom, is_ref = (F.coalesce(has(call["gt"], kind), F.lit(False)) for kind in (HET, HOM, REF))
    ab = F.try_divide(call["ad"].cast("double"), call["dp"].cast("double"))
    fails = {
        "min_dp_het": lambda x: is_het & (call["dp"] < x),
        "min_dp_hom": lambda x: is_hom & (call["dp"] < x),
        "min_ab": lambda x: is_het & ((F.least(ab, 1 - ab) + F.lit(1e-6) < x) | ((call["dp"] == 0) & (call["ad"] > 0))),
        "min_gq": lambda x: call["gq"] < x,
        "min_ad": lambda x: ~is_ref & (call["ad"] < x),
        "max_ad": lambda x: ~is_ref & (call["ad"] > x),
    }
    if isinstance(s, dict):
        tests = [~F.coalesce(fail(F.lit(s[name])), F.lit(False)) for name, fail in fails.items() if s.get(name) is not None]
    else:
        tests = [s[name].isNull() | ~F.coalesce(fail(s[name]), F.lit(False)) for name, fail in fails.items()]
    return reduce(Column.__and__, tests, F.lit(True))


def pass_quality(query: dict) -> Column:
    """Each sample with filter_active: depth of het and hom calls, allele balance of het ones (folded at one half), quality, and alternate
    depth of all but ref calls.

    A missing metric passes; a sample without a call is an error. Every call is looked at once, by the limits of its sample.
    """
    active = {sample: s for sample, s in (query.get("sample_qualities") or {}).items() if s.get("filter_active")}
    if not active:
        return F.lit(True)
    names = F.array(*map(F.lit, active))
    missing = F.array_except(names, F.col("calls.sample"))
    found = F.when(F.size(missing) == 0, True).otherwise(F.raise_error(F.concat(F.lit("sample "), F.array_join(missing, ", "), F.lit(" not found in call info"))).cast("boolean"))

    def ok(c: Column) -> Column:
        out = None
        for sample, s in active.items():
            test = c["sample"] == sample
            out = F.when(test, quality_ok(s, c)) if out is None else out.when(test, quality_ok(s, c))
        return out.otherwise(True)

    return found & F.forall("calls", ok)


def pass_genes(query: dict) -> Column:
    """No allow list, or any annotation of a gene on it. A list that was asked for but names no known gene passes nothing."""
    genes = query.get("gene_allowlist")
    if genes is None:
        return F.lit(True)
    return F.coalesce(F.exists("ann", lambda a: a["gene_id"].isin(list(genes))), F.lit(False)) if genes else F.lit(False)


def pass_regions(query: dict) -> Column:
    """No regions, or any closed overlap of pos to pos + len(ref) - 1 with (chrom_no, start, stop); null start: the whole contig."""
    regions = query.get("region_allowlist") or []
    if not regions:
        return F.lit(True)
    stop = F.col("pos") + F.length("ref") - 1
    hits = [(F.col("chrom_no") == no) & (F.lit(True) if start is None else (F.lit(start) <= stop) & (F.lit(end) >= F.col("pos"))) for no, start, end in regions]
    return F.coalesce(reduce(Column.__or__, hits), F.lit(False))


def roles(query: dict) -> dict[str, str]:
    """index, father and mother of a recessive query; more or fewer than one index is an error."""
    found: dict[str, str] = {}
    for sample, s in (query.get("sample_genotypes") or {}).items():
        role = RECESSIVE_ROLES.get(s["genotype"])
        if role in found:
            raise ValueError(f"more than one {role}")
        if role:
            found[role] = sample
    if query.get("recessive_mode", "disabled") != "disabled" and "index" not in found:
        raise ValueError("recessive mode needs an index")
    return found


def pass_genotype(query: dict) -> Column:
    """Each sample's choice: a missing call fails, a no-call passes only where include_no_call is set. Recessive queries by their rules."""
    if query.get("recessive_mode", "disabled") != "disabled":
        return pass_recessive(query)
    tests = []
    for sample, s in (query.get("sample_genotypes") or {}).items():
        if s["genotype"] in RECESSIVE_ROLES:
            continue
        gt = genotype_of(sample)
        tests.append(has(gt, CHOICES[s["genotype"]]) | gt.contains(".") if s.get("include_no_call") else has(gt, CHOICES[s["genotype"]]))
    return every(tests)


def trio_rules(members: list[str], mode: str) -> dict[str, set[str]]:
    """Which codes (a letter per member, index first) fit: `auto` and `x` for one variant, `gene_auto` and `gene_x` as a gene's hom variant,
    `gene_het` as one of its het variants.

    One variant: on autosomes a hom index of het parents, or a het index with no hom, one het and one ref parent at most; on X a hom index
    with a ref father and a het mother. Missing parents set no condition. In a gene, variants with a hom parent don't count, and a het one
    has one het and one ref parent.
    """
    out: dict[str, set[str]] = {k: set() for k in ("auto", "x", "gene_auto", "gene_x", "gene_het")}
    for letters in map("".join, product("rhH-", repeat=len(members))):
        of = dict(zip(members, letters, strict=True))
        parents = letters[1:]
        hom = of["index"] == "H" and all(p == "h" for p in parents)
        het = of["index"] == "h" and "H" not in parents and parents.count("h") <= 1 and parents.count("r") <= 1
        on_x = of["index"] == "H" and of.get("father", "r") == "r" and of.get("mother", "h") == "h"
        one_each = of["index"] == "h" and set(parents) <= {"r", "h"} and len(set(parents)) == len(parents)
        if mode != "compound-heterozygous":
            out["auto"] |= {letters} if hom else set()
            for name in ("x", "gene_x"):
                out[name] |= {letters} if on_x else set()
            out["gene_auto"] |= {letters} if hom else set()
        if mode != "homozygous":
            out["auto"] |= {letters} if het else set()
            out["gene_het"] |= {letters} if one_each else set()
    return out


def members_of(found: dict[str, str]) -> list[str]:
    return [r for r in ("index", "father", "mother") if r in found]


def pass_recessive(query: dict) -> Column:
    """Whether one variant fits a recessive mode; nothing does on Y and MT."""
    found = roles(query)
    members = members_of(found)
    rules = trio_rules(members, query["recessive_mode"])
    place = F.when(F.col("chrom_no") < 22, "A").when(F.col("chrom_no") == 22, "X").otherwise("-")
    fits = ["A" + c for c in sorted(rules["auto"])] + ["X" + c for c in sorted(rules["x"])]
    return F.coalesce(F.concat(place, kind_codes([genotype_of(found[m]) for m in members])).isin(fits), F.lit(False))


def filter_gene_recessive(df: DataFrame, query: dict, gene: Column | None = None) -> DataFrame:
    """Keep the variants of genes (of a case) with a hom recessive variant, or with two or more het ones whose parents were each seen het
    and ref. The gene is that of the first annotation, an empty one if there is none. Variants with a hom parent don't count.

    Aggregates by case and gene, then a semi join: no gene's variants meet in one place.
    """
    if query.get("recessive_mode", "disabled") == "disabled":
        return df
    gene = F.coalesce(F.get("ann", F.lit(0))["gene_id"], F.lit("")) if gene is None else gene
    found = roles(query)
    members = members_of(found)
    rules = trio_table(df.sparkSession).where((F.col("mode") == query["recessive_mode"]) & (F.col("members") == "".join(m[0] for m in members))).drop("mode", "members")
    df = df.withColumn("_gene", gene)
    # nothing of the variants but case, gene and what their code shows goes into the shuffle
    coded = df.select("case_id", "_gene", "chrom_no", kind_codes([genotype_of(found[m]) for m in members]).alias("code")).join(F.broadcast(rules), "code")
    genes = passing_genes(coded, ["case_id", "_gene"], [m[0] for m in members[1:]])
    return df.join(genes, ["case_id", "_gene"], "left_semi").drop("_gene")


def passing_genes(coded: DataFrame, by: list[str], parents: list[str], members: str | None = None) -> DataFrame:
    """The groups of variants with the flags of trio_table that have a hom recessive variant, or two or more het ones with each parent
    (f, m) that is given seen het and ref. The column `members`, if named, is the same within a group and says which parents are given."""
    hom = F.bool_or(F.when(F.col("chrom_no") == 22, F.col("gene_x")).otherwise(F.col("gene_auto")))
    # as booleans, with which the aggregate needs no sort
    given = [F.bool_or(F.contains(members, F.lit(p))).alias(f"{p}_given") for p in parents] if members else []
    groups = coded.groupBy(*by).agg(*given, hom.alias("hom"), F.count_if("gene_het").alias("het"), *(F.bool_or(f"{p}_{k}").alias(f"{p}_{k}") for p in parents for k in ("het", "ref")))
    absent = lambda p: ~F.col(f"{p}_given") if members else F.lit(False)
    seen = [absent(p) | (F.col(f"{p}_het") & F.col(f"{p}_ref")) for p in parents]
    return groups.where(F.col("hom") | reduce(Column.__and__, seen, F.col("het") >= 2)).select(*by)


def filter_clinvar(df: DataFrame, clinvar: DataFrame, query: dict) -> DataFrame:
    """Keep variants with a record of the wanted classes (benign, likely-benign, ...; the first record of a variant counts).

    clinvar: chrom, pos, ref, alt, record_no, significance, conflicting. Combined classes pass if either part is wanted; conflicting ones
    by allow_conflicting. Off unless presence_required.
    """
    if not query.get("presence_required"):
        return df
    key = ["chrom", "pos", "ref", "alt"]
    first = clinvar.groupBy(*key).agg(F.min_by(F.struct("significance", "conflicting"), "record_no").alias("_first"))
    wanted = [c.replace("-", " ") for c in query.get("significances") or []]
    parts = F.transform(F.split(F.lower("_first.significance"), "/"), lambda c: F.trim(c))
    fits = F.arrays_overlap(parts, F.array(*map(F.lit, wanted))) if wanted else F.lit(True)
    fits = F.when(F.col("_first.conflicting"), F.lit(bool(query.get("allow_conflicting")))).otherwise(fits)
    return df.join(first.where(F.coalesce(fits, F.lit(False))).select(*key), key, "left_semi")


#: Lists of genes and regions of more entries than this are joined as tables, not compiled into the plan.
MANY = 200


def keep_genes(rows: DataFrame, allowed: DataFrame, by: list[str]) -> DataFrame:
    """The rows with an annotation of a gene on the list: allowed has gene_id and the columns `by`, which rows have too.

    What is joined with the list are the distinct sets of genes that annotations name; rows then meet the sets that have a hit.
    """
    rows = rows.withColumn("_genes", F.array_sort(F.array_distinct(F.transform("ann", lambda a: a["gene_id"]))))
    sets = rows.select(*by, "_genes").distinct()
    hits = sets.select("*", F.explode("_genes").alias("gene_id")).join(allowed.select(*by, "gene_id").distinct(), [*by, "gene_id"], "left_semi").select(*by, "_genes").distinct()
    return rows.join(hits, [*by, "_genes"], "left_semi").drop("_genes")


def keep_regions(rows: DataFrame, regions: DataFrame, by: list[str]) -> DataFrame:
    """The rows that overlap a region (closed, as pass_regions): chrom_no, start (null: the whole contig), stop and the columns `by`."""
    from varspark.operators.intervals import range_semi_join

    half_open = regions.select(*(F.col(c).alias(f"_r_{c}") for c in ("chrom_no", *by)), F.coalesce("start", F.lit(0)).cast("long").alias("_b"), F.when(F.col("start").isNull(), 1 << 31).otherwise(F.col("stop").cast("long") + 1).alias("_e"))
    own = rows.withColumns({"_from": F.col("pos").cast("long"), "_to": F.col("pos").cast("long") + F.length("ref")})
    return range_semi_join(own, half_open, {c: f"_r_{c}" for c in ("chrom_no", *by)}, ("_from", "_to"), ("_b", "_e")).drop("_from", "_to")


def filter_seqvars(df: DataFrame, query: dict, clinvar: DataFrame | None = None) -> DataFrame:
    """All predicates, then long lists of genes and regions as joins, the gene rule of recessive queries and the join with ClinVar."""
    spark = df.sparkSession
    genes, regions = query.get("gene_allowlist") or [], query.get("region_allowlist") or []
    short = {k: v for k, v in query.items() if not (k == "gene_allowlist" and len(genes) > MANY or k == "region_allowlist" and len(regions) > MANY)}
    passed = df.where(every([pass_frequency(query), pass_consequence(query), pass_quality(query), pass_genes(short), pass_regions(short), pass_genotype(query)]))
    if len(genes) > MANY:
        passed = keep_genes(passed, spark.createDataFrame([(g,) for g in genes], "gene_id string"), [])
    if len(regions) > MANY:
        passed = keep_regions(passed, spark.createDataFrame(regions, "chrom_no int, start long, stop long"), [])
    passed = filter_gene_recessive(passed, query)
    return passed if clinvar is None else filter_clinvar(passed, clinvar, query.get("clinvar") or {})


def order_results(df: DataFrame, most: int | None = None, by_number: bool = False) -> DataFrame:
    """Results by contig (as text, or by its number) and position, then by the alleles and the case, so that ties have one order; at most
    `most` of them if given (then only that many come together)."""
    rows = df.orderBy("chrom_no" if by_number else "chrom", "pos", "ref", "alt", "case_id")
    return rows if most is None else rows.limit(most)


MODES = ("any", "homozygous", "compound-heterozygous")


def trio_table(spark: SparkSession) -> DataFrame:
    """trio_rules as rows: mode, members (i, f and m for those given), code (a letter each), whether the code fits as one variant (auto, x)
    or in a gene (gene_auto, gene_x, gene_het), and what a het one of a gene shows of the parents (f_het, f_ref, m_het, m_ref)."""
    rows = []
    for mode in MODES:
        for members in (["index"], ["index", "father"], ["index", "mother"], ["index", "father", "mother"]):
            rules = trio_rules(members, mode)
            for code in sorted(set().union(*rules.values())):
                of = dict(zip(members, code, strict=True))
                seen = [code in rules["gene_het"] and of.get(parent) == letter for parent in ("father", "mother") for letter in "hr"]
                rows.append((mode, "".join(m[0] for m in members), code, *(code in rules[k] for k in ("auto", "x", "gene_auto", "gene_x", "gene_het")), *seen))
    names = "auto x gene_auto gene_x gene_het f_het f_ref m_het m_ref".split()
    return spark.createDataFrame(rows, "mode string, members string, code string, " + ", ".join(f"{n} boolean" for n in names))


def family_of(genotypes: Column) -> Column:
    """The samples that a recessive query's choices name as index, father and mother, and `members`: i, and f and m for those given; null
    where there is more or fewer than one index, or a parent twice."""
    all_as = lambda role: F.filter(genotypes, lambda s: s["genotype"] == f"recessive-{role}")
    of_role = {role: all_as(role) for role in ("index", "father", "mother")}
    fits = F.coalesce((F.size(of_role["index"]) == 1) & (F.size(of_role["father"]) <= 1) & (F.size(of_role["mother"]) <= 1), F.lit(False))
    given = F.concat(F.lit("i"), *(F.when(F.size(of_role[role]) > 0, role[0]).otherwise("") for role in ("father", "mother")))
    return F.struct(*(F.get(found, F.lit(0))["sample"].alias(role) for role, found in of_role.items()), F.when(fits, given).alias("members"))


def keep_recessive(rows: DataFrame) -> DataFrame:
    """Of variants with the settings of a recessive query as `q`, its family_of() in q.family, those that fit its mode alone and in their gene.

    Genotypes are coded by the query's roles and joined with the table of rules; the gene rule is an aggregate by query, case and gene that
    combines before its shuffle. Its groups have one row each, so an inner join keeps each variant once (a semi join would be moved below
    the join with the rules, and shuffle what doesn't fit). More or fewer than one index, or a parent twice, is an error.
    """
    names = rows.columns
    members = F.col("q.family.members")
    code = lambda role: kind_codes([genotype_of(F.col(f"q.family.{role}"))])
    parents = [F.when(F.contains(members, F.lit(role[0])), code(role)).otherwise("") for role in ("father", "mother")]
    checked = F.when(members.isNull(), F.raise_error(F.lit("a recessive query needs one index, and each parent once at most"))).otherwise(members)
    gene = F.coalesce(F.get("ann", F.lit(0))["gene_id"], F.lit(""))
    coded = rows.withColumns({"mode": F.col("q.recessive_mode"), "members": checked, "code": F.concat(code("index"), *parents), "_gene": gene})
    fits = coded.join(F.broadcast(trio_table(rows.sparkSession)), ["mode", "members", "code"])
    fits = fits.where(((F.col("chrom_no") < 22) & F.col("auto")) | ((F.col("chrom_no") == 22) & F.col("x")))
    by = ["query_id", "case_id", "_gene"]
    return fits.join(passing_genes(fits, by, ["f", "m"], "members"), by).select(*names)


#: Settings of so many samples are written out one by one, which compiles; longer lists go through a lambda, which doesn't.
WRITTEN_OUT = 8


def all_of(items: Column, most: int, test) -> Column:
    """Whether the test holds for each of an array of at most `most` items; a null one passes."""
    if most > WRITTEN_OUT:
        return items.isNull() | F.forall(items, test)
    return every([(F.coalesce(F.size(items), F.lit(0)) <= k) | test(F.get(items, F.lit(k))) for k in range(most)])


def choices_of(genotypes: Column) -> Column:
    """The choices of a query as (sample, allowed, include_no_call): the genotypes as they are written, null for all."""

    def one(s: Column) -> Column:
        forms = [F.when(s["genotype"] == name, F.array(*map(F.lit, spelled(kind)))) for name, kind in CHOICES.items()]
        return F.struct(s["sample"].alias("sample"), F.coalesce(*forms).alias("allowed"), F.coalesce(s["include_no_call"], F.lit(False)).alias("include_no_call"))

    return F.transform(genotypes, one)


def joined_choice(s: Column) -> Column:
    """Whether the sample of one of choices_of() has an allowed genotype, or a no-call where these are included."""
    gt = genotype_of(s["sample"])
    return s["allowed"].isNull() | F.coalesce(F.array_contains(s["allowed"], gt) | (s["include_no_call"] & gt.contains(".")), F.lit(False))


def joined_quality(s: Column) -> Column:
    """pass_quality with the active settings for one sample of a row's own query."""
    call = call_of(s["sample"])
    missing = F.raise_error(F.concat(F.lit("sample "), s["sample"], F.lit(" not found in call info"))).cast("boolean")
    return F.when(call.isNull(), missing).otherwise(quality_ok(s, call))


def keep_clinvar(rows: DataFrame, clinvar: DataFrame) -> DataFrame:
    """filter_clinvar with the settings of a row's own query (q.clinvar), for rows whose query requires presence."""
    key = ["chrom", "pos", "ref", "alt"]
    own = F.col("q.clinvar")
    first = clinvar.groupBy(*key).agg(F.min_by(F.struct("significance", "conflicting"), "record_no").alias("_first"))
    wanted = F.transform(own["significances"], lambda c: F.replace(c, F.lit("-"), F.lit(" ")))
    parts = F.transform(F.split(F.lower("_first.significance"), "/"), lambda c: F.trim(c))
    fits = (F.coalesce(F.size(wanted), F.lit(0)) <= 0) | F.arrays_overlap(parts, wanted)
    fits = F.when(F.col("_first.conflicting"), F.coalesce(own["allow_conflicting"], F.lit(False))).otherwise(fits)
    return rows.join(first, key).where(F.coalesce(fits, F.lit(False))).select(*rows.columns)


def filter_by_queries(df: DataFrame, queries: DataFrame, clinvar: DataFrame | None = None) -> DataFrame:
    """Every variant once per query (query_id) of its case that it passes: one job for all cases and queries, settings as columns of
    load_queries(). All settings are covered; one that is null passes. query_id must be unique within a case.
    Lists of more than MANY genes or regions become tables and joins.

    queries is joined by case_id; it is a few rows a case, so Spark broadcasts it while that is small and shuffles beyond. Recessive
    queries and those that require ClinVar (clinvar: as for filter_clinvar) go on to further joins, the others are done. Recessive queries
    and the others are joined apart, each with those tests only that one of them asks for: a test that all leave off would still read and
    carry its columns for every variant and query.
    """
    lists = ("gene_allowlist", "region_allowlist")
    size = lambda name: F.coalesce(F.size(name), F.lit(0))
    # long lists don't go along with the rows
    active = F.filter("sample_qualities", lambda s: F.coalesce(s["filter_active"], F.lit(False)))
    changed = {**{c: F.when(size(c) <= MANY, F.col(c)) for c in lists}, "sample_qualities": active}
    own = [changed.get(c, F.col(c)).alias(c) for c in queries.columns if c not in ("case_id", "query_id")]
    recessive = F.coalesce("recessive_mode", F.lit("disabled")) != "disabled"
    of_samples = [F.when(recessive, family_of(F.col("sample_genotypes"))).alias("family"), choices_of(F.col("sample_genotypes")).alias("choices")]
    q = queries.select("case_id", "query_id", F.struct(*own, *((size(c) > MANY).alias(f"long_{c}") for c in lists), *of_samples).alias("q"), recessive.alias("_recessive"))
    setting = lambda *path: reduce(lambda c, name: c[name], path, F.col("q"))
    sources = ("gnomad_exomes", "gnomad_genomes", "inhouse", "helixmtdb", "gnomad_mtdna")
    asks = {
        **{name: F.col(name)["enabled"] for name in sources}, "consequences": size("consequences") > 0, "genes": F.col("gene_allowlist").isNotNull(), "regions": size("region_allowlist") > 0,
        "qualities": F.size(active) > 0, "genotypes": ~recessive & (size("sample_genotypes") > 0), "clinvar": F.col("clinvar.presence_required"),
    }
    most = [F.max(size(c)).alias(f"most_{c}") for c in (*lists, "sample_qualities", "sample_genotypes")]
    asked = {r.recessive: r for r in queries.groupBy(recessive.alias("recessive")).agg(*(F.coalesce(F.bool_or(test), F.lit(False)).alias(name) for name, test in asks.items()), *most).collect()}
    if clinvar is None and any(r.clinvar for r in asked.values()):
        raise ValueError("a query requires ClinVar, but its table isn't given")

    def limits(name: str, nuclear: bool) -> Column:
        counts = F.col(name)
        n = lambda k: F.coalesce(counts[k], F.lit(0))
        own = [("hom", n("hom")), ("het", n("het"))] + ([("hemi", n("hemi"))] if nuclear else [])
        if name != "inhouse":
            own.append(("af", allele_frequency(n("an"), n("hom"), n("het"), n("hemi") if nuclear else None)))
        fields = queries.schema[name].dataType.fieldNames()
        tests = [F.coalesce(value <= setting(name, f"max_{k}"), F.lit(True)) for k, value in own if f"max_{k}" in fields]
        return ~F.coalesce(setting(name, "enabled"), F.lit(False)) | reduce(Column.__and__, tests)

    terms = F.coalesce(setting("consequences"), F.array().cast("array<string>"))
    listed = lambda name: setting(f"long_{name}")  # noqa: E731  these go on to joins
    stop = F.col("pos") + F.length("ref") - 1
    near = lambda r: (r["chrom_no"] == F.col("chrom_no")) & (r["start"].isNull() | ((r["start"] <= stop) & (r["stop"] >= F.col("pos"))))
    tests = {
        "consequences": lambda _: (F.size(terms) == 0) | (F.col("chrom_no") == 24) | F.exists("ann", lambda a: F.arrays_overlap(a["consequences"], setting("consequences"))),
        "genes": lambda _: setting("gene_allowlist").isNull() | F.exists("ann", lambda a: F.array_contains(setting("gene_allowlist"), a["gene_id"])),
        "regions": lambda _: (F.size(F.coalesce(setting("region_allowlist"), F.array())) <= 0) | listed("region_allowlist") | F.exists(setting("region_allowlist"), near),
        "qualities": lambda any_of: all_of(setting("sample_qualities"), any_of.most_sample_qualities, joined_quality),
        "genotypes": lambda any_of: all_of(setting("choices"), any_of.most_sample_genotypes, joined_choice),
    }
    by = ["case_id", "query_id"]

    def of_group(group: bool) -> DataFrame:
        """The variants that pass the recessive queries, or the others."""
        any_of = asked[group]
        nuclear, mito = ([limits(name, of == "nuclear") for name in names if any_of[name]] for of, names in (("nuclear", sources[:3]), ("mito", ("helixmtdb", "gnomad_mtdna", "inhouse"))))
        frequency = [F.when(F.col("chrom_no") == 24, every(mito)).otherwise(every(nuclear))] if nuclear or mito else []
        rows = df.join(q.where(F.col("_recessive") == group).drop("_recessive"), "case_id")
        passed = rows.where(every([*frequency, *(test(any_of) for name, test in tests.items() if any_of[name])]))
        own = queries.where(recessive == group)
        if (any_of.most_gene_allowlist or 0) > MANY:
            long = listed("gene_allowlist")
            passed = passed.where(~long).unionByName(keep_genes(passed.where(long), own.where(size("gene_allowlist") > MANY).select(*by, F.explode("gene_allowlist").alias("gene_id")), by))
        if (any_of.most_region_allowlist or 0) > MANY:
            long = listed("region_allowlist")
            passed = passed.where(~long).unionByName(keep_regions(passed.where(long), own.where(size("region_allowlist") > MANY).select(*by, F.explode("region_allowlist").alias("r")).select(*by, "r.*"), by))
        if group:
            passed = keep_recessive(passed)
        if any_of.clinvar:
            required = F.coalesce(setting("clinvar", "presence_required"), F.lit(False))
            passed = passed.where(~required).unionByName(keep_clinvar(passed.where(required), clinvar))
        return passed.drop("q")

    if not asked:
        return df.join(q, "case_id").drop("q", "_recessive")
    return reduce(DataFrame.unionByName, map(of_group, sorted(asked)))


def freq_and_distance(df: DataFrame) -> DataFrame:
    """df with freq (the greater of the exomes' and genomes' frequencies) and exon_dist (first annotation); 0 and 0 on MT."""
    af = lambda c: allele_frequency(F.coalesce(c["an"], F.lit(0)), F.coalesce(c["hom"], F.lit(0)), F.coalesce(c["het"], F.lit(0)), F.coalesce(c["hemi"], F.lit(0)))
    mito = F.col("chrom_no") == 24
    freq = F.when(mito, F.lit(0.0).cast("float")).otherwise(F.greatest(af(F.col("gnomad_exomes")), af(F.col("gnomad_genomes"))))
    return df.withColumns({"freq": freq, "exon_dist": F.when(mito, 0).otherwise(F.abs(F.get("ann", F.lit(0))["distance"]))})


def prefilter(df: DataFrame, params: DataFrame) -> DataFrame:
    """Each row once per parameter set (param_id, max_freq, max_exon_dist) that it passes; rows without a distance pass none. One read."""
    df = freq_and_distance(df)
    return df.join(F.broadcast(params), (F.col("freq") <= F.col("max_freq").cast("float")) & (F.col("exon_dist") <= F.col("max_exon_dist")))


def translate_genes(tokens: DataFrame, xlink: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, hgnc_id) of the tokens that name a gene by HGNC id, entrez number, ENSG id or symbol, and the tokens that name none."""
    from varspark.functions.scalars import ensembl_id

    names = xlink.select("hgnc_id", F.explode(F.array("hgnc_id", F.col("entrez_id").cast("string"), ensembl_id(F.col("ensembl_id")), "symbol")).alias("name"))
    own = tokens.select("token").distinct()
    return own.join(names, own.token == names.name).select("token", "hgnc_id").distinct(), own.join(names, own.token == names.name, "left_anti")

"""Counts over many cases: carriers of small variants and of structural ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varspark.functions.scalars import contig_class, genotype_kind, is_par

KEY = ["chrom_no", "pos", "ref", "alt"]
#: The carrier classes that are counted, with the alleles that one carrier adds.
CLASSES = {"homref": 1, "hemiref": 1, "het": 1, "homalt_alleles": 2, "hemialt": 1}


def carrier_class(chrom_no: Column, pos: Column, sex: Column, gt: Column, release: str) -> Column:
    """homref, hemiref, het, homalt_alleles or hemialt of a call; null if it is not counted (no-call, female Y, unknown sex on X and Y)."""
    kind, contig = genotype_kind(gt), contig_class(chrom_no)
    sexual, par = contig.isin("X", "Y"), is_par(chrom_no, pos, release)
    diploid = F.when(kind == "HomRef", "homref").when(kind == "Het", "het").when(kind == "HomAlt", "homalt_alleles")
    hemi = F.when(kind == "HomRef", "hemiref").when(kind.isin("Het", "HomAlt"), "hemialt")
    male = F.when(par, diploid).otherwise(hemi)
    return F.when(~sexual, diploid).when(sex == "Male", male).when((sex == "Female") & (contig == "X"), diploid)


def classified(calls: DataFrame, pedigree: DataFrame, release: str) -> DataFrame:
    """One row per distinct call (case_id, sample, variant) with its class. calls: case_id, sample, KEY, gt. pedigree: case_id, sample, idx, sex.

    A call that comes twice (a file read again) counts once, as the first by genotype text. Samples without a pedigree row are an error.
    """
    own = calls.groupBy("case_id", "sample", *KEY).agg(F.min("gt").alias("gt"))
    known = own.join(pedigree.select("case_id", "sample", "idx", "sex"), ["case_id", "sample"], "left")
    sex = F.when(F.col("sex").isNotNull(), F.col("sex")).otherwise(F.raise_error(F.concat(F.lit("not in the pedigree: "), F.col("sample"))))
    return known.withColumn("class", carrier_class(F.col("chrom_no"), F.col("pos"), sex, F.col("gt"), release))


def count_classes(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(*(F.sum(F.when(F.col("class") == c, n).otherwise(0)).alias(c) for c, n in CLASSES.items()))


def count_carriers(calls: DataFrame, pedigree: DataFrame, release: str = "grch37") -> DataFrame:
    """KEY, homref, hemiref, het, homalt_alleles (two a carrier), hemialt."""
    return count_classes(classified(calls, pedigree, release))


def list_carriers(calls: DataFrame, pedigree: DataFrame, release: str = "grch37") -> DataFrame:
    """KEY, carriers: the sorted distinct (case_id, idx, genotype) of those that carry the variant."""
    rows = classified(calls, pedigree, release).where(F.col("class").isin("het", "homalt_alleles", "hemialt"))
    return rows.groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("case_id", "idx", F.col("class").alias("genotype")))).alias("carriers"))


def update_classified(old: DataFrame, new: DataFrame) -> DataFrame:
    """Classified calls of both tables, each call once: those of cases in `new` take the place of the ones in `old`, so a case that comes
    again changes nothing. Only the case ids of `new` meet those of `old`."""
    columns = ["case_id", "sample", "idx", *KEY, "class"]
    return old.select(*columns).join(new.select("case_id").distinct(), "case_id", "left_anti").select(*columns).unionByName(new.select(*columns))


def update_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts of both tables together, for tables of different cases (see update_classified where cases may come again)."""
    return old.unionByName(new).groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in CLASSES))


def add_inhouse(df: DataFrame, counts: DataFrame) -> DataFrame:
    """df with `inhouse` (an, hom, het, hemi) from the counts; zeros where a variant isn't there."""
    an = sum((F.coalesce(F.col(c), F.lit(0)) for c in CLASSES), F.lit(0))
    joined = df.drop("inhouse").join(counts, KEY, "left")
    own = F.struct(an.alias("an"), F.coalesce("homalt_alleles", F.lit(0)).alias("hom"), F.coalesce("het", F.lit(0)).alias("het"), F.coalesce("hemialt", F.lit(0)).alias("hemi"))
    return joined.withColumn("inhouse", own).drop(*CLASSES)


def count_sv_carriers(calls: DataFrame, pedigree: DataFrame) -> DataFrame:
    """sv_id, carriers, carriers_het, carriers_hom, carriers_hemi. calls: sv_id, case_id, sample, chrom_no, gt. Alternate calls of males
    on X and Y are hemizygous; females on Y and samples of unknown sex on X and Y don't count."""
    known = calls.join(pedigree.select("case_id", "sample", "sex"), ["case_id", "sample"], "left")
    kind, sexual = genotype_kind(F.col("gt")), F.col("chrom_no").isin(22, 23)
    alt = kind.isin("Het", "HomAlt")
    hemi = alt & sexual & (F.col("sex") == "Male")
    diploid = alt & (~sexual | ((F.col("sex") == "Female") & (F.col("chrom_no") == 22)))
    sums = {"carriers_het": diploid & (kind == "Het"), "carriers_hom": diploid & (kind == "HomAlt"), "carriers_hemi": hemi}
    out = known.groupBy("sv_id").agg(*(F.count_if(F.coalesce(t, F.lit(False))).alias(name) for name, t in sums.items()))
    return out.withColumn("carriers", F.col("carriers_het") + F.col("carriers_hom") + F.col("carriers_hemi"))

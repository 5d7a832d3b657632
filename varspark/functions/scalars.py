"""Column functions on chromosomes, intervals, genotypes and identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pseudoautosomal regions of X and Y by release, 1-based and closed.
PAR = {
    "grch37": {"X": ((60001, 2699520), (154931044, 155260560)), "Y": ((10001, 2649520), (59034050, 59363566))},
    "grch38": {"X": ((10001, 2781479), (155701383, 156030895)), "Y": ((10001, 2781479), (56887903, 57217415))},
}
#: Lengths of chromosomes 1 to 22, X, Y, M by release.
CONTIG_LENGTHS = {
    "grch37": (249250621, 243199373, 198022430, 191154276, 180915260, 171115067, 159138663, 146364022, 141213431, 135534747, 135006516, 133851895, 115169878, 107349540, 102531392, 90354753, 81195210, 78077248, 59128983, 63025520, 48129895, 51304566, 155270560, 59373566, 16569),
    "grch38": (248956422, 242193529, 198295559, 190214555, 181538259, 170805979, 159345973, 145138636, 138394717, 133797422, 135086622, 133275309, 114364328, 107043718, 101991189, 90338345, 83257441, 80373285, 58617616, 64444167, 46709983, 50818468, 156040895, 57227415, 16569),
}
#: Phenotype terms that name a mode of inheritance.
INHERITANCE = {
    "HP:0000006": "AutosomalDominant",
    "HP:0012275": "AutosomalDominant",
    "HP:0000007": "AutosomalRecessive",
    "HP:0001419": "XLinkedDominant",
    "HP:0001423": "XLinkedRecessive",
    "HP:0001450": "YLinked",
    "HP:0001427": "Mitochondrial",
}
#: Levels of clinical significance, 1 benign to 5 pathogenic.
SIGNIFICANCE = {
    "benign": 1,
    "benign/likely benign": 1,
    "likely benign": 2,
    "uncertain significance": 3,
    "conflicting classifications of pathogenicity": 3,
    "likely pathogenic": 4,
    "pathogenic/likely pathogenic": 4,
    "pathogenic": 5,
}
CHROMOSOMES = tuple(str(k) for k in range(1, 23)) + ("X", "Y", "M")


def chrom_no(chrom: Column) -> Column:
    """0 to 24 for 1-22, X, Y, M with or without chr, MT and lower case included; null for other contigs."""
    upper = F.upper(chrom)
    name = F.when(F.startswith(upper, F.lit("CHR")), F.substr(upper, F.lit(4))).otherwise(upper)
    numbers = F.create_map(*(F.lit(x) for k, c in enumerate(CHROMOSOMES) for x in (c, k)), F.lit("MT"), F.lit(24))
    return F.try_element_at(numbers, name)


def contig_class(number: Column) -> Column:
    """Auto, X, Y or MT of a chromosome number."""
    return F.when(number < 22, "Auto").when(number == 22, "X").when(number == 23, "Y").when(number == 24, "MT")


def contig_lengths(spark: SparkSession, release: str) -> DataFrame:
    """(chrom_no, chrom, length) of a release; names carry chr in the later one."""
    prefix = "chr" if release == "grch38" else ""
    return spark.createDataFrame([(k, prefix + CHROMOSOMES[k], n) for k, n in enumerate(CONTIG_LENGTHS[release])], "chrom_no int, chrom string, length long")


def is_par(number: Column, pos: Column, release: str) -> Column:
    """Whether a 1-based position of X or Y is pseudoautosomal."""
    own = PAR[release]
    tests = [(number == n) & pos.between(a, b) for n, c in ((22, "X"), (23, "Y")) for a, b in own[c]]
    return F.coalesce(reduce(Column.__or__, tests), F.lit(False))


def overlaps(begin: Column, end: Column, begin2: Column, end2: Column) -> Column:
    """Half-open intervals have a base in common."""
    return (begin < end2) & (end > begin2)


def overlaps_closed(begin: Column, end: Column, begin2: Column, end2: Column) -> Column:
    return (begin <= end2) & (end >= begin2)


def reciprocal_overlap(begin: Column, end: Column, begin2: Column, end2: Column) -> Column:
    """Common length over that of the longer of two half-open intervals; 0 if disjoint."""
    common = F.greatest(F.least(end, end2) - F.greatest(begin, begin2), F.lit(0)).cast("double")
    return F.coalesce(F.try_divide(common, F.greatest(end - begin, end2 - begin2).cast("double")), F.lit(0.0))


def numeric_id(text: Column, prefix: str) -> Column:
    """The number of an identifier like ENSG00000000012 or RCV000000012 (version dropped); null if it isn't one."""
    return F.regexp_replace(F.split_part(text, F.lit("."), F.lit(1)), f"^{prefix}", "").try_cast("long") if prefix else text.try_cast("long")


def numeric_gene_id(text: Column) -> Column:
    return numeric_id(text, "ENSG")


def ensembl_id(number: Column) -> Column:
    return F.format_string("ENSG%011d", number)


def rcv_id(number: Column) -> Column:
    return F.format_string("RCV%09d", number)


def spelled(plain: tuple[str, ...]) -> list[str]:
    """All ways to write the plain genotypes: with phase, either allele first, with a leading separator."""
    own = {"".join(x) for g in plain for a, sep, b in [g.partition("/")] for x in ([(a,)] if not sep else [(u, s, v) for s in "/|" for u, v in ((a, b), (b, a))])}
    return sorted(lead + g for g in own for lead in ("", "/", "|"))


def genotype_kind(gt: Column) -> Column:
    """HomRef, Het, HomAlt or WithNoCall; raises on anything else. Null stays null."""
    names = {"HomRef": ("0/0", "0"), "Het": ("0/1",), "HomAlt": ("1/1", "1")}
    out = F.when(gt.isNull(), F.lit(None).cast("string"))
    for name, plain in names.items():
        out = out.when(gt.isin(spelled(plain)), name)
    return out.when(gt.contains("."), "WithNoCall").otherwise(F.raise_error(F.concat(F.lit("not a genotype: "), gt)))


def is_no_call(gt: Column) -> Column:
    return gt.contains(".")


def parse_region(text: Column) -> Column:
    """chr1, chr1:1,000 or chr1:1,000-2,000 to (chrom_no, start, stop), 1-based; null where it is none of these."""
    pattern = r"^\s*((?:chr)?[0-9A-Za-z]+)(?::([0-9,]+)(?:-([0-9,]+))?)?\s*$"
    mark = "\x1f"  # no region holds one, so what has one after the replacement has matched; the pattern is run once for a text
    parts = F.when(~text.contains(mark), F.regexp_replace(text, pattern, f"$1{mark}$2{mark}$3"))
    part = lambda p, k: F.split_part(p, F.lit(mark), F.lit(k))
    number = lambda p, k: F.replace(part(p, k), F.lit(","), F.lit("")).try_cast("long")
    matched = F.filter(F.array(parts), lambda p: p.contains(mark))
    rows = F.transform(matched, lambda p: F.struct(chrom_no(part(p, 1)).alias("chrom_no"), number(p, 2).alias("start"), F.coalesce(number(p, 3), number(p, 2)).alias("stop")))
    return F.get(F.filter(rows, lambda r: r["chrom_no"].isNotNull()), F.lit(0))


def accession_parts(text: Column) -> Column:
    """accession.version to (accession, version)."""
    return F.struct(F.split_part(text, F.lit("."), F.lit(1)).alias("accession"), F.split_part(text, F.lit("."), F.lit(2)).try_cast("int").alias("version"))


def location_of(consequences: Column, distance: Column) -> Column:
    """Exon where an annotation has no distance to the next exon, else Upstream or Downstream by its terms, else Intron."""
    has = lambda term: F.coalesce(F.array_contains(consequences, term), F.lit(False))
    return F.when(distance.isNull(), "Exon").when(has("upstream_gene_variant"), "Upstream").when(has("downstream_gene_variant"), "Downstream").otherwise("Intron")


def genome_bin(begin: Column, end: Column) -> Column:
    """The bin of a 0-based half-open interval in the usual five-level scheme (leaves of 2^17 bases)."""
    first, last = begin.cast("int"), (end - 1).cast("int")
    out = None
    for shift, offset in ((17, 585), (20, 73), (23, 9), (26, 1)):
        a, b = F.shiftright(first, shift), F.shiftright(last, shift)
        out = F.when(a == b, a + offset) if out is None else out.when(a == b, a + offset)
    return out.otherwise(0)


def significance_level(text: Column) -> Column:
    """1 (benign) to 5 (pathogenic) of a class in words; null if unknown."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in SIGNIFICANCE.items() for x in kv)), F.lower(F.trim(text)))


def inheritance_mode(hpo: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in INHERITANCE.items() for x in kv)), hpo)


def row_id(*columns: Column) -> Column:
    """A reproducible id from the columns."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns)), 256)


def compatible_types(sv_type: Column) -> Column:
    """The types that count as the same: equal ones, and CNV with DEL and DUP."""
    return F.when(sv_type == "CNV", F.array(*map(F.lit, ("CNV", "DEL", "DUP")))).when(sv_type.isin("DEL", "DUP"), F.array(sv_type, F.lit("CNV"))).otherwise(F.array(sv_type))


def allele_frequency(an: Column, hom: Column, het: Column, hemi: Column | None = None) -> Column:
    """Of nuclear counts (2 hom + het + hemi) / an, of mitochondrial ones (no hemi) (hom + het) / an; 0 if an is 0 or null. Single precision."""
    carried = hom + het if hemi is None else hom * 2 + het + hemi
    return F.coalesce(F.try_divide(carried.cast("double"), an.cast("double")), F.lit(0.0)).cast("float")


#: Consequence terms that the output knows; others are left out.
CONSEQUENCES = (
    "transcript_ablation",
    "exon_loss_variant",
    "splice_acceptor_variant",
    "splice_donor_variant",
    "stop_gained",
    "frameshift_variant",
    "stop_lost",
    "start_lost",
    "transcript_amplification",
    "disruptive_inframe_insertion",
    "disruptive_inframe_deletion",
    "conservative_inframe_insertion",
    "conservative_inframe_deletion",
    "missense_variant",
    "splice_donor_5th_base_variant",
    "splice_region_variant",
    "splice_donor_region_variant",
    "splice_polypyrimidine_tract_variant",
    "start_retained_variant",
    "stop_retained_variant",
    "synonymous_variant",
    "coding_sequence_variant",
    "5_prime_UTR_exon_variant",
    "5_prime_UTR_intron_variant",
    "3_prime_UTR_exon_variant",
    "3_prime_UTR_intron_variant",
    "non_coding_transcript_exon_variant",
    "non_coding_transcript_intron_variant",
    "upstream_gene_variant",
    "downstream_gene_variant",
    "intergenic_variant",
    "intron_variant",
)


def shown_consequences(terms: Column) -> Column:
    """The names that the output gives to consequence terms: CONSEQUENCE_ and the term in capitals, its digits in words."""
    known = F.filter(terms, lambda t: t.isin(*CONSEQUENCES))
    spell = lambda t: F.replace(F.replace(F.replace(F.upper(t), F.lit("5_PRIME"), F.lit("FIVE_PRIME")), F.lit("3_PRIME"), F.lit("THREE_PRIME")), F.lit("5TH"), F.lit("FIFTH"))
    return F.transform(known, lambda t: F.concat(F.lit("CONSEQUENCE_"), spell(t)))

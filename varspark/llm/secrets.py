"""Secret scans. DataFrame functions only: no Python, pandas or RDD code runs on the executors.

Three base kinds come from patterns. The method adds long tokens that look random: for each run of 20 or more token characters an
encoding is inferred (decimal, hex, base 32, base 36 or base 64), and three tests hold it against uniform noise over that alphabet:
chi-squared counts, runs above and below the middle, and the correlation of neighbours. A token is put forward if none of the three
rejects (Bonferroni). Whether that means anything depends on its length, as a short word passes too; so its number of equal pairs of
characters is also held against running text of the same length, and Benjamini and Hochberg's rule over all tokens of an encoding
and length class limits the share of ordinary words among the finds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the base kinds, in the order that breaks ties.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN = 8

#: A candidate of the randomness tests.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: Encoding, pattern, alphabet, chance that two characters of running text in it are equal.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "0123456789", 0.18),
    ("hex", r"^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.2),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.075),
    ("base36", r"^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 0.075),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.065),
)
LENGTHS = (24, 32, 40, 64, 128)
BINS = 300


def let(value: Column, then) -> Column:
    """then(value), with value worked out once however often then uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running_sums(lengths: Column) -> Column:
    """For an array of ints, the sum before each element. In blocks of 256, so that long arrays don't cost the square of their size."""

    def within(start: Column, part: Column) -> Column:
        zero = F.struct(start.alias("s"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, zero, lambda a, x: F.struct((a.s + x).alias("s"), F.concat(a.out, F.array(a.s)).alias("out")), lambda a: a.out)

    blocks = F.transform(F.sequence(F.lit(0), F.call_function("div", F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(256)).cast("int")), lambda b: F.slice(lengths, b * 256 + 1, F.lit(256)))
    sums = F.transform(blocks, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
    return F.flatten(F.zip_with(within(F.lit(0), sums), blocks, within))


def found(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches as an array of (start, kind, end, token), in code points. What lies between matches gives the places."""
    def gaps(match: Column) -> Column:
        return F.zip_with(match, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(match)), lambda m, b: F.struct(F.length(b).alias("gap"), F.length(m).alias("n"), m.alias("m")))

    def placed(span: Column) -> Column:
        starts = let(F.transform(span, lambda x: x.gap + x.n), running_sums)
        return F.zip_with(span, starts, lambda x, s: F.struct((s + x.gap).alias("start"), F.lit(kind).alias("kind"), (s + x.gap + x.n).alias("end"), x.m.alias("token")))

    out = let(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), gaps), placed)
    if kind == 0:
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        kept = F.zip_with(out, value, lambda x, v: F.when(F.length(v) >= LEAST_ASSIGN, x))
        out = F.filter(kept, lambda x: x.isNotNull())
    return F.when(text.rlike(pattern), out).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,token:string>>"))


def normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a logistic curve (error under 2e-4; far tails too large, so on the safe side)."""
    z = F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))
    return 1 / (1 + F.exp(z * 1.5976 + z * z * z * 0.07056))


def tested(c: Column) -> Column:
    """A candidate (start, kind, end, token) with its class (encoding and length) and bin (tenths of -log10 p against running text; -1: a test of randomness rejects)."""
    token = F.translate(F.rtrim(c.token, F.lit("=")), "-_", "+/")

    def of(k: int, alphabet: str, equal: float) -> Column:
        def from_codes(codes: Column) -> Column:
            n = F.size(codes).cast("double")
            size = float(len(alphabet))
            seen = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda a, x: a + F.pow(F.size(F.filter(codes, lambda y: y == x)).cast("double"), F.lit(2.0)))
            mean = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x) / n
            var = F.aggregate(codes, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
            pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
            lag = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p.x - mean) * (p.y - mean))
            high = F.size(F.filter(codes, lambda x: x >= size / 2)).cast("double")
            runs = F.size(F.filter(pairs, lambda p: (p.x >= size / 2) != (p.y >= size / 2))).cast("double") + 1
            return F.struct(n.alias("n"), seen.alias("seen"), var.alias("var"), lag.alias("lag"), high.alias("high"), runs.alias("runs"))

        lower = F.lower(token) if k == 1 else token
        codes = F.transform(F.split(lower, ""), lambda x: (F.call_function("locate", x, F.lit(alphabet)) - 1).cast("double"))
        size = float(len(alphabet))

        def judged(s: Column) -> Column:
            n, other = s.n, s.n - s.high
            chi = (s.seen * size / n - n - (size - 1)) / F.sqrt(F.lit(2 * (size - 1)) * (n - 1) / n)
            middle = s.high * other * 2 / n
            spread = F.sqrt(F.greatest(middle * (middle - 1) / (n - 1), F.lit(1e-9)))
            p_chi = normal_tail(chi)
            p_runs = normal_tail(F.abs(s.runs - middle - 1) / spread) * 2
            p_lag = F.when(s.var > 0, normal_tail(F.abs(s.lag / s.var * F.sqrt(n) + 1 / F.sqrt(n))) * 2).otherwise(F.lit(0.0))
            random = F.least(p_chi, p_runs, p_lag) * 3 >= 0.001
            alike, all_pairs = (s.seen - n) / 2, n * (n - 1) / 2
            p_text = normal_tail((all_pairs * equal - alike) / F.sqrt(all_pairs * equal * 2.25))
            return F.when(random, F.least(F.floor(-F.log10(p_text) * 10), F.lit(BINS))).otherwise(F.lit(-1)).cast("int")

        return let(let(codes, from_codes), judged)

    length = sum((F.when(F.length(token) > x, 1).otherwise(0) for x in LENGTHS), F.lit(0))
    kind, bins = None, None
    for k, (_, pattern, alphabet, equal) in enumerate(ENCODINGS):
        here = token.rlike(pattern)
        kind = F.when(here, k) if kind is None else (kind.when(here, k) if pattern else kind.otherwise(k))
        b = of(k, alphabet, equal)
        bins = F.when(here, b) if bins is None else (bins.when(here, b) if pattern else bins.otherwise(b))
    return F.struct(c.start.alias("start"), c.kind.alias("kind"), c.end.alias("end"), (kind * 10 + length).alias("class"), bins.alias("bin"))


def candidates(text: Column) -> Column:
    return F.transform(found(text, TOKEN, 3), tested)


def least_bins(docs: DataFrame, text: str, rate: float) -> dict[int, int]:
    """For each class the least bin that is a find at false-discovery rate `rate`: Benjamini and Hochberg over the counts by class and bin.

    What comes to the driver are counts for at most 30 classes of BINS + 2 bins, whatever the size of the table.
    """
    counted = docs.select(F.explode(candidates(F.col(text))).alias("c")).groupBy("c.class", "c.bin").count().collect()
    out = {}
    for kind in {r["class"] for r in counted}:
        own = sorted(((r["bin"], r["count"]) for r in counted if r["class"] == kind), reverse=True)
        total, above = sum(n for _, n in own), 0
        for b, n in own:
            above += n
            if b > 0 and 10 ** (-b / 10) <= rate * above / total:
                out[kind] = b
    return out


def scan_secrets(docs: DataFrame, text: str = "text", rate: float = 0.001) -> DataFrame:
    """docs with `base` and `spans`: arrays of (start, kind, end) in code points, ordered by start, then kind as in KINDS.

    Null and empty texts have empty arrays. Texts of any length are scanned as wholes. Columns named base or spans in docs are replaced. Rows that are alike get the same spans.
    A random token that overlaps a base span adds nothing and is left out.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    least = least_bins(docs.select(plain.alias("_text")), "_text", rate)
    base = F.concat(found(plain, ASSIGN, 0), found(plain, ACCESS, 1), found(plain, HEX, 2))
    base = F.array_sort(F.transform(base, lambda x: F.struct(x.start.alias("start"), x.kind.alias("kind"), x.end.alias("end"))))
    docs = docs.withColumn("base", base)
    if least:
        limits = F.create_map(*(F.lit(x) for kv in sorted(least.items()) for x in kv))
        new = F.filter(candidates(plain), lambda c: (c["bin"] >= F.coalesce(F.try_element_at(limits, c["class"]), F.lit(BINS + 1))) & ~F.exists(F.col("base"), lambda b: (b.start < c.end) & (c.start < b.end)))
        new = F.transform(new, lambda c: F.struct(c.start.alias("start"), c.kind.alias("kind"), c.end.alias("end")))
        return docs.withColumn("spans", F.array_sort(F.concat(F.col("base"), new)))
    return docs.withColumn("spans", F.col("base"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x.kind + 1), x.start.cast("string"), x.end.cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each maximal run of spans replaced by the mark. spans: ordered by start."""
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    last = F.aggregate(
        spans,
        empty,
        lambda a, x: F.when(x.end <= a["at"], a).otherwise(
            F.struct(F.greatest(x.end, a["at"]).alias("at"), F.concat(a.out, F.when(x.start >= a["at"], F.concat(F.substring(text, a["at"] + 1, x.start - a["at"]), F.lit(mark))).otherwise(F.lit(""))).alias("out"))
        ),
    )
    done = let(last, lambda a: F.concat(a.out, F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def count_of(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x.kind == kind)).cast("long")

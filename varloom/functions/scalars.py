"""Scalar functions on sequences, strings, sizes and regions, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The two code-collapse tables (they differ at K and B), and complements.
IUPAC, IUPAC_FIRST, IUPAC_SECOND = "WSKMYRVDBH", "ACGACAAACA", "ACTACAAATA"
BASES, COMPLEMENT = "ACGTacgt", "TGCAtgca"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_set(s, delimiters: str) -> Column:
    """split at any of the delimiters, empty parts dropped."""
    return F.filter(F.split(_c(s), "[" + "".join("\\" + c for c in delimiters) + "]+"), lambda x: x != "")


def revcomp(s) -> Column:
    """F02."""
    return F.reverse(F.translate(_c(s), BASES, COMPLEMENT))


def iupac(s) -> Column:
    """F03."""
    return F.translate(_c(s), IUPAC, IUPAC_FIRST)


def iupac_alt(s) -> Column:
    """the other table."""
    return F.translate(_c(s), IUPAC, IUPAC_SECOND)


def revcomp_rna(s) -> Column:
    """U reads as T."""
    return F.reverse(F.translate(_c(s), BASES + "Uu", COMPLEMENT + "Aa"))


def flip(start, end, length) -> tuple[Column, Column]:
    """Coordinates on the other strand."""
    return _c(length) - _c(end) + 1, _c(length) - _c(start) + 1


def subsequence(s, start, end) -> Column:
    """1-based, clamped."""
    lo = F.greatest(_c(start), F.lit(1))
    hi = F.least(_c(end), F.length(_c(s)))
    return F.when(hi >= lo, F.substring(_c(s), lo, hi - lo + 1)).otherwise(F.lit(""))


def n_count(s) -> Column:
    """F07."""
    return F.length(_c(s)) - F.length(F.translate(_c(s), "Nn", ""))


def n_ratio(s) -> Column:
    """F08."""
    return F.format_string("%.6f", F.when(F.length(_c(s)) > 0, n_count(s) / F.length(_c(s))).otherwise(F.lit(0.0)))


def is_nucleotides(s) -> Column:
    """F09, S08."""
    return F.upper(_c(s)).rlike("^[ACGTUXNRYMKSWBDHV]*$")


def same_base(a, b) -> Column:
    """F09, G12."""
    return (F.upper(_c(a)) == F.upper(_c(b))) & F.upper(_c(a)).isin(*"ACGTU")


def mismatches(a, b, quality=None) -> Column:
    """number of mismatches, or the sum of their phred33 qualities."""
    pairs = F.arrays_zip(F.split(_c(a), ""), F.split(_c(b), ""))
    if quality is None:
        return F.aggregate(F.zip_with(F.split(_c(a), ""), F.split(_c(b), ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    at = F.zip_with(pairs, F.split(_c(quality), ""), lambda p, q: F.when(p["0"] == p["1"], 0).otherwise(F.ascii(q) - 33))
    return F.aggregate(at, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def trim_space(s) -> Column:
    """all white space goes."""
    return F.regexp_replace(_c(s), "\\s", "")


def size_bin(size, width: int) -> Column:
    """linear bins 1..width, ...; 0-0 for nothing."""
    k = F.ceil(_c(size) / width)
    return F.when(_c(size) <= 0, "0-0").otherwise(F.concat((k - 1) * width + 1, F.lit("-"), k * width))


def size_bin_log(size, base: int = 2) -> Column:
    """bins up to powers of the base, the first one at 2; exact at powers (no logarithm)."""
    powers = [base**i for i in range(63) if base**i < 2**62]
    lo = F.coalesce(*[F.when(_c(size) > p, F.lit(p + 1)) for p in reversed(powers)], F.lit(2))
    hi = F.coalesce(*[F.when(_c(size) <= p, F.lit(p)) for p in powers[1:]])
    return F.concat(lo, F.lit("-"), hi)


def size_bin_decade(size) -> Column:
    """1 to 10 by 1, 11 to 100 by 10, and so on."""
    s = _c(size)
    width = F.coalesce(*[F.when(s <= 10 ** (i + 1), F.lit(10**i)) for i in range(17)])
    k = F.ceil(s / width)
    return F.when(s <= 0, "0-0").otherwise(F.concat(((k - 1) * width + 1).cast("long"), F.lit("-"), (k * width).cast("long")))


def interval_bin(start, end) -> Column:
    """the smallest bin of a five-level hierarchy (2**14 to 2**26 positions) that holds [start, end), 0-based."""
    s, e = _c(start), _c(end) - 1
    levels = [(14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)]
    return F.coalesce(*[F.when(F.shiftright(s, b) == F.shiftright(e, b), F.shiftright(s, b) + first) for b, first in levels], F.lit(0))


def overlapping_bins(start, end) -> Column:
    """all bins that can hold something that overlaps [start, end)."""
    s, e = _c(start), _c(end) - 1
    levels = [(26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)]
    return F.concat(F.array(F.lit(0)), *[F.sequence(F.shiftright(s, b) + first, F.shiftright(e, b) + first) for b, first in levels])


def overlap(a_id, a_start, a_end, b_id, b_start, b_end) -> Column:
    """F15."""
    return (_c(a_id) == _c(b_id)) & (_c(a_start) <= _c(b_end)) & (_c(a_end) >= _c(b_start))


def joined(parts, delimiter: str) -> Column:
    """F13."""
    return F.array_join(_c(parts), delimiter)


def mean_of(values) -> Column:
    """of an array; null for none."""
    v = _c(values)
    return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v))


def variance_of(values) -> Column:
    """population variance of an array."""
    v, m = _c(values), mean_of(values)
    return mean_of(F.transform(v, lambda x: (x - m) * (x - m)))


def hull(spans) -> Column:
    """F16: first and last place of an array of (first, second); (0, 0) for none."""
    v = _c(spans)
    ends = lambda f, k: F.coalesce(f(F.transform(v, lambda x: x[k])).cast("long"), F.lit(0).cast("long"))
    return F.struct(ends(F.array_min, "first").alias("first"), ends(F.array_max, "second").alias("second"))


def log_sum_exp(values) -> Column:
    """of an array, from its largest value."""
    v = _c(values)
    top = F.array_max(v)
    return top + F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def log_normal(x, mean, sd) -> Column:
    """logarithm of a normal density."""
    z = (_c(x) - _c(mean)) / _c(sd)
    return -0.5 * z * z - F.log(_c(sd)) - 0.5 * F.log(F.lit(2 * math.pi))


def vcf_interval(pos, ref, info) -> Column:
    """0-based half-open place of a VCF line: up to END where the INFO text has it, else the reference allele."""
    end = F.regexp_extract(_c(info), "(?:^|;)END=(\\d+)", 1)
    return F.struct((_c(pos) - 1).cast("long").alias("first"), F.when(end != "", end.try_cast("long")).otherwise(_c(pos) - 1 + F.length(_c(ref))).cast("long").alias("last"))


def sam_interval(pos, cigar) -> Column:
    """0-based half-open place of a read: what its CIGAR text takes of the reference, one base for none."""
    parts = F.regexp_extract_all(_c(cigar), F.lit("(\\d+)[MDN=X]"), F.lit(1))
    size = F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return F.struct((_c(pos) - 1).cast("long").alias("first"), (_c(pos) - 1 + F.greatest(size, F.lit(1))).cast("long").alias("last"))


def parse_region(text) -> Column:
    """Chr, chr:pos, chr:a-b, chr:a..b, with thousands commas, as struct(id, start, end); end null for open."""
    t = F.translate(_c(text), ",", "")
    pattern = "^([^:]+)(?::(\\d+)(?:(?:-|\\.\\.)(\\d+))?)?$"
    lo, hi = F.regexp_extract(t, pattern, 2), F.regexp_extract(t, pattern, 3)
    return F.struct(
        F.regexp_extract(t, pattern, 1).alias("id"),
        F.when(lo != "", lo.cast("long")).otherwise(F.lit(1)).alias("start"),
        F.when(hi != "", hi.cast("long")).alias("end"),
    )


def info_value(info, key: str) -> Column:
    """Value of key in a;b=c text, null where missing."""
    v = F.regexp_extract(_c(info), f"(?:^|;){key}=([^;]*)", 1)
    return F.when(_c(info).rlike(f"(?:^|;){key}="), v)


def info_flag(info, key: str) -> Column:
    """P35."""
    return _c(info).rlike(f"(?:^|;){key}")


def first_alt(gt) -> Column:
    """Index of the first allele that is not the reference; null where none."""
    return F.get(F.filter(F.transform(F.split(_c(gt), "[/|]"), lambda x: x.try_cast("int")), lambda x: x > 0), 0)


def collapse_gt(gt) -> Column:
    """Alleles over 1 become 1, the separator stays."""
    return F.regexp_replace(_c(gt), "([2-9]|[1-9][0-9]+)", "1")


def register(spark: SparkSession) -> None:
    """The functions that SQL texts can use."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION revcomp(s STRING) RETURNS STRING RETURN reverse(translate(s, '{BASES}', '{COMPLEMENT}'))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION iupac(s STRING) RETURNS STRING RETURN translate(s, '{IUPAC}', '{IUPAC_FIRST}')")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION n_count(s STRING) RETURNS INT RETURN length(s) - length(translate(s, 'Nn', ''))")

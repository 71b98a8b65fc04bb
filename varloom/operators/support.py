"""Smaller operators of the pipeline: alleles, borrowed fields, format conversion, joins by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# GT of a missing sample, and the chromosome order of the two builds.
MISSING = "./."
CHROMOSOMES = [*map(str, range(1, 23)), "X", "Y", "MT"]


def on_chromosome(df: DataFrame, name: str, col: str = "t_id") -> DataFrame:
    """One sequence, or ALL of them in any case."""
    return df if name.upper() == "ALL" else df.where(F.col(col) == name)


def alt_allele(alts: Column, gt: Column) -> Column:
    """P20: the allele that the second part of a genotype names, the first alternative by default."""
    second = F.regexp_extract(gt, "^[^/|]*[/|](\\d+)", 1)
    i = F.when(second != "", F.greatest(F.lit(1), second.try_cast("int"))).otherwise(1)
    return F.get(alts, i - 1)


def is_snp(ref: Column, alts: Column) -> Column:
    """P21."""
    return (F.length(ref) == 1) & F.forall(alts, lambda x: F.length(x) == 1)


def borrowed(genotypes: DataFrame, keys: list[str]) -> DataFrame:
    """Per site, the fields of the first sample with a variant, else of the first one with a genotype."""
    rank = F.when(F.col("gt") == MISSING, 2).when(F.col("gt") == "0/0", 1).otherwise(0)
    first = F.min_by(F.struct(*keys), F.struct(rank, "sample_ord"))
    return genotypes.groupBy("site").agg(first.alias("x")).select("site", "x.*")


def has_genotype(gts: Column) -> Column:
    """P33."""
    return F.exists(gts, lambda x: ~x.isin("0/0", "0|0", MISSING))


def present(values: Column) -> Column:
    """Without missing values."""
    return F.filter(values, lambda x: x.isNotNull() & ~x.isin(".", MISSING, ""))


def with_lengths(df: DataFrame, lengths: DataFrame) -> DataFrame:
    """(sample, scaffold) with its length; a missing one is an error, raised where it is met."""
    out = df.join(lengths, ["sample", "scaffold"], "left")
    return out.where(F.when(F.col("len").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no length of "), "sample", F.lit(" "), "scaffold")).cast("boolean")))


def scored_lines(lines: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores back onto their lines, by chromosome, position and line number."""
    return lines.join(scores, ["chrom", "pos", "line_no"])


def translocation_mates(df: DataFrame) -> DataFrame:
    """Both halves of a translocation by query interval; a half alone stays."""
    keys = ["q_id", "q_start", "q_end"]
    half = lambda e, s: df.where(F.col("expected") == e).select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in ("t_id", "t_start", "t_end")])
    return half(False, "a").join(half(True, "e"), keys, "full")


def candidates(reads: DataFrame, names: DataFrame) -> DataFrame:
    """Reads whose name is among the candidates of their group."""
    return reads.join(names, ["rg", "name"], "left_semi")


def marked(df: DataFrame, sites: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Whether a row's keys are among the sites (which may repeat)."""
    there = sites.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(there, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def full_merge(tables: list[DataFrame]) -> DataFrame:
    """Sites of all samples: one row per site with its samples' genotypes in order; an aggregation instead of a
    chain of outer joins."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("chrom", "pos", "ref").agg(F.array_sort(F.collect_list(F.struct("sample_ord", "gt", "alt"))).alias("samples"))


def alignment_records(spark, paths) -> DataFrame:
    """Records of alignment text, one per block that begins with '# ': its header, match score and identities."""
    rows = spark.read.text(paths, lineSep="\n# ").where("trim(value) != ''")
    number = lambda p: F.regexp_extract("value", p, 1).try_cast("int")
    return rows.select(
        F.regexp_replace(F.substring_index("value", "\n", 1), "^# *", "").alias("info"),
        number(r"Score:\s*(-?\d+)").alias("score"), number(r"Aligned:\s*(\d+)").alias("aligned"),
        F.transform(F.regexp_extract_all("value", F.lit(r"Identic:\s*(\d+)"), F.lit(1)), lambda x: x.cast("int")).alias("identic"),
        F.transform(F.regexp_extract_all("value", F.lit(r"\[\s*(\d+),\s*\d+\]"), F.lit(1)), lambda x: x.cast("int")).alias("starts"),
    )


def converted_type(df: DataFrame) -> Column:
    """Type name of a converted record by what is excised on either side."""
    t, q = F.col("t_gap"), F.col("q_gap")
    return (
        F.when((t > 0) & (q == 0), F.when(F.col("simul"), "SDEL").otherwise("DEL")).when((t == 0) & (q > 0), F.when(F.col("simul"), "SINS").otherwise("INS"))
        .when((t == 1) & (q == 1), "SNP").when(t == q, "BSubstitution").when((t > 0) & (q > 0), "SimulGap").otherwise("NULL")
    )


def random_reads(points: DataFrame, reads: DataFrame) -> DataFrame:
    """For each random place the first read at or after it; points: ref, pos (seeded by the caller)."""
    from varloom.operators.intervals import first_at_or_after

    return first_at_or_after(points, reads, "ref", "pos", "at", "read_no")


def random_points(spark, lengths: DataFrame, n: int, seed: int) -> DataFrame:
    """N seeded places, sequences by their length."""
    from varloom.operators.intervals import first_at_or_after

    # the sequences end to end, a row each; a drawn place belongs to the first that ends at or after it
    ends = lengths.where("len > 0").select("ref", "len", F.sum("len").over(Window.orderBy("ref").rowsBetween(Window.unboundedPreceding, 0)).alias("hit"))
    size = lengths.agg(F.sum("len")).first()[0]
    drawn = spark.range(n).select("id", (F.floor(F.rand(seed) * size) + 1).alias("pos"))
    which = first_at_or_after(drawn.select(F.lit(0).alias("k"), "pos").distinct(), ends.select(F.lit(0).alias("k"), "hit", F.col("hit").alias("v")), "k", "pos", "hit", "v")
    rows = drawn.join(which.select("pos", "hit"), "pos").join(ends, "hit")
    return rows.select("ref", (F.col("pos") - F.col("hit") + F.col("len")).cast("long").alias("pos"))


def support_per_read(reads: DataFrame, sites: DataFrame, clip: str = "clip") -> DataFrame:
    """Reads that cover a site and end two or more bases past it, with their mismatches against the
    reference and the alternative from the site on."""
    from varloom.functions.scalars import mismatches
    from varloom.operators.intervals import points_in
    from varloom.operators.reads import query_position

    hit = points_in(sites, reads, "chrom", "pos", "start", "end")
    hit = hit.where(F.col("pos") <= F.col("start") - F.col(clip) + F.length("seq") - 2)
    at = query_position(F.col("start"), F.col("cigar"), F.col("pos"))
    rest = hit.withColumn("_q", F.substr(F.col("seq"), at + 1)).where("_q is not null")
    bad = lambda c: F.coalesce(mismatches(F.substring(F.col(c), F.lit(1), F.length("_q")), F.substring("_q", F.lit(1), F.length(c))), F.lit(0))
    return rest.select("site", bad("ref_seq").alias("ref_bad"), bad("alt_seq").alias("alt_bad"))


def supported_vcf(sites: DataFrame, genotypes: DataFrame, counts: DataFrame, sample: str, chrom: str = "ALL") -> DataFrame:
    """Lines of one sample with the support of its alleles: (line_no, chrom, pos, id, ref, alt, format, cell). counts: line_no, ref, alt, both and neither
    (A12) of the sites that reads could tell.

    Sites without an alternative go; the alternative is the one that the sample's genotype names. Sites other than SNPs have the counts as AA
    (zeros where no read tells); SNPs that the sample lacks go. A missing sample has VT and VS of the first one with a variant (else with a
    genotype). Alleles over 1 become 1; FORMAT has GT first, then the others by key."""
    from varloom.functions.scalars import collapse_gt

    rows = on_chromosome(sites, chrom, "chrom").where("alts[0] != '.'")
    own = genotypes.where(F.col("sample") == sample).select("line_no", F.col("gt").alias("_gt"), F.col("fmt").alias("_fmt"))
    lent = borrowed(genotypes.select(F.col("line_no").alias("site"), "sample_ord", F.coalesce("gt", F.lit(MISSING)).alias("gt"), F.col("fmt").getItem("VT").alias("vt"), F.col("fmt").getItem("VS").alias("vs")), ["vt", "vs"])
    rows = rows.join(own, "line_no", "left").join(lent.withColumnRenamed("site", "line_no"), "line_no", "left")
    missing = F.coalesce("_gt", F.lit(MISSING)) == MISSING
    rows = rows.withColumns({"_gt": F.coalesce("_gt", F.lit(MISSING)), "_missing": missing, "alt": alt_allele(F.col("alts"), F.coalesce("_gt", F.lit(MISSING)))})
    rows = rows.withColumn("_snp", is_snp(F.col("ref"), F.array("alt"))).where("not (_snp and _missing)")
    n = counts.select("line_no", F.concat_ws(",", *[F.col(c).cast("string") for c in ("ref", "alt", "both", "neither")]).alias("_aa"))
    rows = rows.join(n, "line_no", "left").withColumn("_aa", F.coalesce("_aa", F.lit("0,0,0,0")))
    none = F.create_map().cast("map<string,string>")
    base = F.when(F.col("_missing"), F.create_map(F.lit("VT"), F.col("vt"), F.lit("VS"), F.col("vs"))).otherwise(F.map_filter("_fmt", lambda k, _: ~k.isin("GT", "AA")))
    fields = F.map_concat(base, F.when(~F.col("_snp"), F.create_map(F.lit("AA"), F.col("_aa"))).otherwise(none))
    entries = F.array_sort(F.map_entries(fields))
    cell = F.concat_ws(":", F.array(collapse_gt(F.col("_gt"))), F.transform(entries, lambda e: e["value"]))
    names = F.concat_ws(":", F.array(F.lit("GT")), F.transform(entries, lambda e: e["key"]))
    return rows.select("line_no", "chrom", "pos", "id", "ref", "alt", names.alias("format"), cell.alias("cell"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """The table that a histogram shows."""
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) * bins / (high - low)))
    return df.where(F.col(value).between(low, high)).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))

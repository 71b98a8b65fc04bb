"""Text outputs as tables of lines (value, with columns to order them by), and their writing. A line is made by column
expressions where its row is; only headers, which are constant, and orders are added when a file is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.operators.variants import FAMILIES, variant_size

# Order of the families in the call table, and columns of the coverage table.
CALL_TABLE_ORDER = ["INS", "DEL", "INV", "SIMUL", "CLIP", "NOMADIC", "NOSOL", "TRANS", "SNP", "REFCALL", "N"]
COVERAGE = [
    ("PROPER_PAIR_COV", "properPair"), ("LOW_ALIGN_SCORE_PROPER_PAIR", "pLowAlignScore"), ("CROSS_READ_COV", "crossSignal"), ("BAD_INSERT_COV", "badInserSizePair"),
    ("WRONG_ORIETATION_COV", "wrongOrientation"), ("SINGLE_END_COV", "single"), ("CLIP_AND_SA_COV", "clipAlign"),
]
# FORMAT entries of a detected call (id, number, type, description) and its filters.
FORMATS = [
    ("AGE", "1", "String", "AGE aligment information. (T/F,Strand,ave_base,ave_iden,left_base,left_iden,right_base,right_iden)"), ("AS", "1", "Integer", "Alignment score In LAST Aligner"),
    ("END", "1", "Integer", "Stop position of the interval"), ("GT", "1", "String", "Genotype"), ("HR", "1", "Integer", "Largest Contiguous Homopolymer Run of Variant Allele In Either Direction"),
    ("MS", "1", "Float", "Mismatch probability In LAST Align"), ("NR", "1", "Float", "The 'N' ratio around variant region in query"), ("QR", "1", "String", "Variant regions in query"),
    ("TR", "1", "String", "Variant regions in reference"), ("VS", "1", "Integer", "SV Size. For SNP it'll be 1"), ("VT", "1", "String", "SV Type"),
]
FILTERS = [
    ("AGEFALSE", "Filtered in AGE realignment process"), ("INTERGAP", "Unmapped reference region."), ("INTRAGAP", "Mapped, but contained N in Query"),
    ("REFCALL", "Represents a homozygous reference call"), ("REFGAP", "Mapped, but contained N in Reference"),
]


def tabbed(*cells: Column | str) -> Column:
    return F.concat_ws("\t", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(".")) for c in cells])


def six_digits(x: Column | str) -> Column:
    """a number with six significant digits, without trailing zeros, in scientific form from 10**6 on and below 10**-4."""
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    text = F.format_string("%.5e", F.abs(x))
    e = F.split_part(text, F.lit("e"), F.lit(2)).cast("int")
    digits = F.regexp_replace(F.replace(F.split_part(text, F.lit("e"), F.lit(1)), F.lit("."), F.lit("")), "0+$", "")
    point = lambda whole, part: F.when(F.length(part) > 0, F.concat(whole, F.lit("."), part)).otherwise(whole)
    fixed = F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)).otherwise(point(F.rpad(F.substring(digits, F.lit(1), e + 1), e + 1, F.lit("0")), F.substr(digits, e + 2)))
    science = F.concat(point(F.left(digits, F.lit(1)), F.substr(digits, F.lit(2))), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.format_string("%02d", F.abs(e)))
    number = F.when(e.between(-4, 5), fixed).otherwise(science)
    return F.when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), number))


def call_lines(calls: DataFrame, t_lengths: DataFrame, q_lengths: DataFrame) -> DataFrame:
    """The call table: 15 columns a call, in the order of families, then by place; a translocation has a second row with
    its expected place and the type's name with -E. calls: family, t_id, t_start, t_end, q_id, q_start, q_end, strand, score,
    mismap, type, realigned, expected_id, expected_start, expected_end. lengths: id, len."""
    rows = calls.join(t_lengths.select(F.col("id").alias("t_id"), F.col("len").alias("_tl")), "t_id").join(q_lengths.select(F.col("id").alias("q_id"), F.col("len").alias("_ql")), "q_id")
    # most calls expect no other place: joined by their own target, as rows without a key would meet in one task
    place = F.coalesce(F.col("expected_id"), F.col("t_id"))
    rows = rows.join(t_lengths.select(F.col("id").alias("_eid"), F.col("len").alias("_el")), place == F.col("_eid"), "left")
    size = lambda s: F.col(f"{s}_end") - F.col(f"{s}_start") + 1
    query = ["q_id", "q_start", "q_end", size("q"), "_ql", "strand", "score", six_digits("mismap")]
    line = tabbed("t_id", "t_start", "t_end", size("t"), "_tl", *query, "type", F.when(F.col("realigned"), "CanAGE").otherwise("CanotAGE"))
    second = tabbed("expected_id", "expected_start", "expected_end", size("expected"), "_el", *query, F.concat("type", F.lit("-E")))
    both = F.array(F.struct(F.lit(1).alias("part"), line.alias("value")), F.when(F.col("expected_id").isNotNull(), F.struct(F.lit(2).alias("part"), second.alias("value"))))
    rank = F.array_position(F.array(*map(F.lit, CALL_TABLE_ORDER)), F.col("family")).cast("int")
    return rows.select(rank.alias("rank"), "t_id", "t_start", "t_end", F.inline(F.array_compact(both)))


def gap_lines(alignments: DataFrame) -> DataFrame:
    """Gaps and overlaps between neighbouring query sequences on a target, with both neighbours."""
    from varloom.operators.intervals import before

    reach = F.struct(F.col("t_end").alias("e"), (-F.col("t_start")).alias("s"), "q_id", "q_start", "q_end")
    rows = before(alignments, ["t_id"], "t_start", ["t_start", "t_end", "q_id"], {"p": ("max", reach)})
    rows = rows.where(F.col("p.q_id").isNotNull() & (F.col("p.q_id") != F.col("q_id")))
    over = F.col("p.e") >= F.col("t_start") - 1
    place = lambda t, s, e: F.concat(t.cast("string"), F.lit(":"), s.cast("string"), F.lit("-"), e.cast("string"))
    t = F.col("t_id")
    both = F.concat(place(t, -F.col("p.s"), F.col("p.e")), F.lit("|"), place(F.col("p.q_id"), F.col("p.q_start"), F.col("p.q_end")), F.lit("#"), place(t, F.col("t_start"), F.col("t_end")), F.lit("|"), place(F.col("q_id"), F.col("q_start"), F.col("q_end")))
    line = tabbed(t, F.when(over, F.col("p.e")).otherwise(F.col("p.e") + 1), F.when(over, F.col("t_start")).otherwise(F.col("t_start") - 1), F.col("t_start") - F.col("p.e") - 1, F.when(over, "Overlap").otherwise("InterGap"), both)
    return rows.select("t_id", "t_start", line.alias("value"))


def detector_header(sample: str) -> list[str]:
    """Header lines of a detected call set, in order."""
    lines = [f'##FILTER=<ID={k},Description="{d}">' for k, d in FILTERS]
    lines += [f'##FORMAT=<ID={k},Number={n},Type={t},Description="{d}">' for k, n, t, d in FORMATS]
    return [*lines, f"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{sample}"]


def detector_lines(calls: DataFrame) -> DataFrame:
    """A VCF line per detected call (realign.detected with identity, homo_run and n_count, the N within 100 of it in the
    query), FORMAT keys in order after GT."""
    size = variant_size(F.col("type"), F.col("t_end") - F.col("t_start") + 1, F.col("ref"), F.col("alt"))
    gap = F.col("type") == "INTERGAP"
    place = lambda s: F.concat(F.col(f"{s}_id"), F.lit("="), F.col(f"{s}_start").cast("string"), F.lit("-"), F.col(f"{s}_end").cast("string"))
    numbers = F.array_join(F.flatten(F.transform("identity", lambda x: F.array(x["len"].cast("string"), x["pct"].cast("string")))), ",")
    age = F.when(F.col("is_success_align"), F.concat_ws(",", F.when(F.col("is_good_realign"), "T").otherwise("F"), "strand", numbers)).otherwise(".")
    ratio = six_digits(F.when(gap, F.lit(0.0)).otherwise(F.col("n_count") / (F.abs(size) + 200)))
    cells = F.concat_ws(":", *[x.cast("string") for x in (F.col("gt"), age, F.col("score"), F.col("t_end"), F.col("homo_run"), six_digits("mismap"), ratio, F.when(gap, ".").otherwise(place("q")), place("t"), size, F.col("type"))])
    keys = F.lit("GT:" + ":".join(k for k, *_ in FORMATS if k != "GT"))
    return calls.select("t_id", "t_start", tabbed("t_id", "t_start", F.lit("."), "ref", "alt", F.lit(255), "filter", F.lit("."), keys, cells).alias("value"))


def summary_lines(summary: DataFrame, covered: DataFrame, t_lengths: DataFrame) -> DataFrame:
    """Key, number and length, then the covered length of each target and its share. summary: key, num, len; covered:
    t_id, covered; t_lengths: id, len."""
    top = summary.select(F.lit(1).alias("rank"), "key", tabbed("key", "num", "len").alias("value"))
    rows = covered.join(t_lengths.select(F.col("id").alias("t_id"), "len"), "t_id")
    share = tabbed(F.concat(F.lit("# "), F.col("t_id").cast("string")), F.concat(F.col("covered").cast("string"), F.lit("/"), F.col("len").cast("string")), six_digits(F.col("covered") / F.col("len")))
    return top.unionByName(rows.select(F.lit(2).alias("rank"), F.col("t_id").cast("string").alias("key"), share.alias("value")))


COVERAGE_HEADER = "\t".join(["#CHROM", "POS", "TOTAL_COV", *(name for name, _ in COVERAGE)])


def coverage_lines(spans: DataFrame, total: DataFrame) -> DataFrame:
    """A line per covered base with its depth in all and by class. spans: ref, class, start, end (reads.depth_spans);
    total: ref, start, end of all reads."""
    from varloom.operators.intervals import BITS, window_of

    # spans are dealt out once, to the windows that they touch; what follows stays there: depths of all classes change together, a row per place
    names = ["all", *(c for _, c in COVERAGE)]
    every = spans.select("ref", "class", "start", "end").unionByName(total.select("ref", F.lit("all").alias("class"), "start", "end"))
    coded = F.array_position(F.array(*map(F.lit, names)), F.col("class")).cast("byte")
    rows = every.where("start <= end and ref is not null and class is not null").select("ref", coded.alias("k"), "start", "end", F.explode(F.sequence(window_of("start"), window_of("end"))).alias("_w")).repartition("ref", "_w")
    lo, hi = F.shiftleft("_w", BITS), F.shiftleft(F.col("_w") + 1, BITS)
    edges = F.array(F.struct(F.greatest(F.col("start"), lo).alias("pos"), F.lit(1).alias("d")), F.struct(F.least(F.col("end") + 1, hi).alias("pos"), F.lit(-1).alias("d")))
    steps = rows.select("ref", "_w", "k", F.inline(edges)).groupBy("ref", "_w", "pos").agg(*[F.sum(F.when(F.col("k") == n, F.col("d")).otherwise(0)).alias(c) for n, c in enumerate(names, 1)], F.sum("d").alias("_any"))
    own = Window.partitionBy("ref", "_w").orderBy("pos")
    deep = steps.select("ref", "pos", F.lead("pos").over(own).alias("_next"), *[F.sum(c).over(own).alias(c) for c in (*names, "_any")])
    deep = deep.where("_any > 0").select("ref", F.explode(F.sequence("pos", F.col("_next") - 1)).alias("pos"), *names)
    return deep.select("ref", "pos", tabbed("ref", "pos", *names).alias("value"))


def qc_header(lines: DataFrame, threshold: float) -> DataFrame:
    """Header lines (line_no, value) with the filters after ##fileformat and SPN before #CHROM."""
    # The texts of these header lines.
    more = [("DUPLIC", "Duplication variants. Don't need to keep them!"), ("FALSE", "unconfident variant"), (f"q{threshold:g}", f"Variant quality below {threshold:g}")]
    after = F.when(F.col("value").startswith("##fileformat"), F.array(F.col("value"), *[F.lit(f'##FILTER=<ID={k},Description="{d}">') for k, d in more]))
    spn = F.lit('##INFO=<ID=SPN,Number=1,Type=Integer,Description="The count of assambly which support this variant region">')
    full = after.when(F.col("value").startswith("#CHROM"), F.array(spn, F.col("value"))).otherwise(F.array("value"))
    return lines.where("value like '#%'").select("line_no", F.posexplode(full).alias("part", "value"))


def qc_lines(lines: DataFrame, decided: DataFrame) -> DataFrame:
    """Data lines (line_no, value) that were decided (line_no, filter, samples), with the filter and SPN."""
    rows = lines.where("value not like '#%'").join(decided, "line_no").withColumn("c", F.split("value", "\t"))
    info = F.concat(F.regexp_replace(F.get("c", F.lit(7)), ";SPN=[^;]+", ""), F.lit(";SPN="), F.col("samples").cast("string"))
    return rows.select("line_no", "filter", F.array_join(F.transform("c", lambda x, i: F.when(i == 6, F.col("filter")).when(i == 7, info).otherwise(x)), "\t").alias("value"))


def qc_summary(decided: DataFrame) -> DataFrame:
    """How many sites there are, and number and share of each filter."""
    n = decided.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in (("pass", F.col("filter") == "PASS"), ("low", F.col("filter").startswith("q")), ("false", F.col("filter") == "FALSE"), ("duplic", F.col("filter").startswith("DUPLIC")))])
    return n.select("*", *[F.format_string("%.3f", F.col(k) / F.col("total")).alias(f"{k}_ratio") for k in ("pass", "low", "false", "duplic")])


def families(kind: Column) -> Column:
    """The family that a call's type belongs to in the call table."""
    return F.when(kind.isin(*FAMILIES), kind).when(kind.startswith("TRANS"), "TRANS").when(kind.startswith("Nos-"), "NOSOL").when(kind.startswith("gap-"), "SIMUL").otherwise(kind)


def write_lines(lines: DataFrame, path: str, *order: str, header: list[str] | None = None) -> None:
    """Text files whose names follow the order of the lines; the header is a file of its own before them."""
    if header:
        spark = lines.sparkSession
        spark.createDataFrame([("\n".join(header),)], "value string").coalesce(1).write.text(f"{path}/header")
    (lines.orderBy(*order) if order else lines).select("value").write.text(f"{path}/lines")


def write_parts(df: DataFrame, good: Column, path: str, *order: str) -> None:
    """Rows for which good holds go to one place, all others to another."""
    write_lines(df.where(good), f"{path}/kept", *order)
    write_lines(df.where(~F.coalesce(good, F.lit(False))), f"{path}/false", *order)

"""Text files made of the driver's tables and read back: queries of the readers, and of the outputs' lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.plans.views import LETTERS
from varloom.sources import readers
from varloom.sources.shared import new_path


def as_file(df: DataFrame, name: str, compression: str = "none") -> str:
    """A text file of the rows' value, in the shared folder; a compressed one is read as one split for each task that wrote it."""
    path = new_path(df.sparkSession, name)
    df.select("value").write.text(path, compression=compression)
    return path


def fasta_of(docs: DataFrame) -> DataFrame:
    """Whole texts as records, letters as bases, in lines of 50."""
    letters = F.translate("text", LETTERS.lower(), LETTERS)
    seq = F.translate(F.regexp_replace(letters, "[^A-Z]", "N"), "BDEFHIJKLMOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTA")
    return docs.where("length(text) > 0").select(F.concat(F.lit(">d"), "doc_id", F.lit(" from >"), "source", F.lit("\n"), F.regexp_replace(seq, "(.{50})", "$1\n")).alias("value"))


def maf_of(aligned: DataFrame) -> DataFrame:
    """Blocks of the aligned view; odd targets have the query on the other strand of a sequence of 10**7."""
    bases = lambda s: F.length(F.translate(s, "-", "")).cast("string")
    head = F.concat(F.lit("a score="), F.col("q_id").cast("string"), F.lit(" mismap=1e-05"))
    t = F.concat_ws(" ", F.lit("s"), F.concat(F.lit("t"), "t_id"), (F.col("t_start") - 1).cast("string"), bases("t_seq"), F.lit("+"), F.lit("9999999"), "t_seq")
    q = F.concat_ws(" ", F.lit("s"), F.concat(F.lit("q"), "q_id"), (F.col("q_start") - 1).cast("string"), bases("q_seq"), F.when(F.col("t_id") % 2 == 1, "-").otherwise("+"), F.lit("10000000"), "q_seq")
    return aligned.select(F.concat(F.concat_ws("\n", head, t, q), F.lit("\n")).alias("value"))


def vcf_of(sites: DataFrame) -> DataFrame:
    line = F.concat_ws("\t", F.col("chrom").cast("string"), F.col("start").cast("string"), F.concat(F.lit("r"), "line_no"), F.lit("A"), F.lit("AC,G"), F.col("vq").cast("string"), "filter", F.concat(F.lit("AC="), "size", F.lit(";NEG")), F.lit("GT:VT"), F.concat(F.lit("0/1:"), "type"), F.lit("./."))
    head = sites.sparkSession.createDataFrame([("##fileformat=VCFv4.1",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2",)], "value string").coalesce(1)
    return head.unionByName(sites.select(line.alias("value")))


def genotyped_vcf_of(sites: DataFrame) -> DataFrame:
    """Two samples with the fields that recalibration and support need: s1 always, s2 missing on a quarter of the lines and without a place on some."""
    s = lambda c: F.col(c).cast("string")
    info = F.when(F.col("size") % 7 == 0, "AC=1").otherwise(F.concat(F.lit("InbCoeff="), s("inb"), F.lit(";AC=1;NEG")))
    alt = F.when(F.col("size") % 3 == 0, "AC,G").when(F.col("size") % 3 == 1, "AC").otherwise("T")
    one = F.concat_ws(":", F.when(F.col("size") % 3 == 0, "0/2").otherwise("0/1"), F.concat_ws(",", s("size"), s("vq"), F.lit("0"), (F.col("line_no") % 5).cast("string")), s("nr"), F.concat(F.lit("sc"), s("chrom"), F.lit("-"), s("start"), F.lit("-"), s("end")), s("size"), F.lit("INS"))
    place = F.when(F.col("size") % 5 == 0, ".").otherwise(F.concat(F.lit("y-"), (F.col("chrom") % 3).cast("string"), F.lit("-"), s("size"), F.lit("-"), (F.col("size") + 100).cast("string")))
    two = F.when(F.col("size") % 4 == 0, "./.").otherwise(F.concat_ws(":", F.lit("1/1"), F.lit("1,2,3,4"), F.lit("0.25"), place, F.lit("7"), F.lit("DEL")))
    line = F.concat_ws("\t", s("chrom"), s("start"), F.concat(F.lit("r"), "line_no"), F.lit("A"), alt, s("vq"), "filter", info, F.lit("GT:AA:NR:QR:VS:VT"), one, two)
    head = sites.sparkSession.createDataFrame([("##fileformat=VCFv4.1",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2",)], "value string").coalesce(1)
    return head.unionByName(sites.select(line.alias("value")))


def sam_of(reads: DataFrame) -> DataFrame:
    mate = F.when(F.col("mate_ref") == F.col("ref"), "=").otherwise(F.col("mate_ref"))
    line = F.concat_ws("\t", F.concat(F.lit("r"), "name_no"), F.col("flag").cast("string"), "ref", F.col("pos").cast("string"), F.col("mapq").cast("string"), F.lit("4M1I5M"), mate, F.col("mate_pos").cast("string"), F.col("insert_size").cast("string"), F.lit("ACGTACGTAC"), F.lit("IIIIIIIIII"), F.concat(F.lit("RG:Z:"), "rg"), F.concat(F.lit("AS:i:"), F.col("mapq").cast("string")))
    return reads.select(line.alias("value"))


def read_back(spark, name: str, lines: DataFrame, compression: str = "none") -> DataFrame | tuple[DataFrame, DataFrame]:
    return getattr(readers, f"read_{name}")(spark, as_file(lines, name, compression))

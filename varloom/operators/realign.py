"""Refining calls (V06, V07): each call's flanks are aligned again with gap excision, and what lies between the two
fragments becomes the final variant. A chain of equi-joins: flanks, bases (pieces of sequences), alignment dealt over
tasks, bases of the alleles. Nothing holds a whole sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.operators.align import Scores, gap_excision
from varloom.operators.variants import alignable, excised_type, final_type, flank, good_alignment, vcf_call
from varloom.sources.readers import fetch
from varloom.sources.shared import stored

#: Columns of a call; expected_* is where a translocated piece would stand (null for other calls).
CALL = ["call_id", "type", "t_id", "t_start", "t_end", "q_id", "q_start", "q_end", "score", "mismap"]
EXPECTED = ["expected_id", "expected_start", "expected_end"]


def with_flanks(calls: DataFrame, t_lengths: DataFrame, q_lengths: DataFrame, size: int = 500) -> DataFrame:
    """The regions to align (a_id, a_start, a_end and b_...), of translocations at the expected place, and whether they
    fit the memory guard. lengths: id, len."""
    moved = F.col("expected_id").isNotNull()
    at = lambda c: F.when(moved, F.col(f"expected_{c}")).otherwise(F.col(f"t_{c}"))
    rows = calls.withColumns({"a_id": at("id"), "_s": at("start"), "_e": at("end")})
    rows = rows.join(t_lengths.select(F.col("id").alias("a_id"), F.col("len").alias("_tl")), "a_id")
    rows = rows.join(q_lengths.select(F.col("id").alias("q_id"), F.col("len").alias("_ql")), "q_id")
    (a_start, a_end), (b_start, b_end) = flank("_s", "_e", "_tl", size), flank("q_start", "q_end", "_ql", size)
    rows = rows.withColumns({"a_start": a_start, "a_end": a_end, "b_start": b_start, "b_end": b_end})
    fits = alignable(F.col("a_end") - F.col("a_start"), F.col("b_end") - F.col("b_start"))
    return rows.withColumn("fits", fits).drop("_s", "_e", "_tl", "_ql")


def bases(rows: DataFrame, chunks: DataFrame, key: str, names: list[str], out: str, size: int, overlap: int) -> DataFrame:
    """(key, out): the bases of each row's region; names: its id, start and end."""
    regions = rows.select(key, *[F.col(n).alias(x) for n, x in zip(names, ("id", "start", "end"), strict=True)])
    return fetch(regions, chunks, size, overlap).select(key, F.col("seq").alias(out))


def between(rows: DataFrame) -> DataFrame:
    """Type and place of what lies between two fragments. rows: with_flanks() joined with the alignment."""
    place = lambda c, s: F.col(c) + F.col(f"{s}_start") - 1
    rows = rows.withColumns({"_lt": place("left_a_end", "a"), "_rt": place("right_a_start", "a"), "_lq": place("left_b_end", "b"), "_rq": place("right_b_start", "b")})
    rows = rows.withColumns({"t_len": F.col("_rt") - F.col("_lt") - 1, "q_len": F.abs(F.col("_rq") - F.col("_lq")) - 1})
    kind = excised_type(F.col("t_len"), F.col("q_len"))
    # a change of length keeps the base before it, one of equal lengths doesn't
    skip = (F.col("t_len") == F.col("q_len")).cast("int")
    q_start = F.when((kind == "DEL") | (F.col("strand") == "+"), F.col("_lq") + skip).otherwise(F.col("_rq") + 1)
    identity = F.array(*[F.struct(F.col(n).alias("len"), F.col(p).alias("pct")) for n, p in (("same", "pct"), ("left_same", "left_pct"), ("right_same", "right_pct"))])
    hull = lambda c, start: F.when(F.col(c) > 0, F.col(c) + F.col("a_start") - 1 - F.col(start)).otherwise(0)
    rows = rows.withColumns({"found": kind, "v_t_start": F.col("_lt") + skip, "v_t_end": F.col("_lt") + F.col("t_len"), "v_q_start": q_start, "v_q_end": q_start + F.col("q_len") - skip, "identity": identity})
    rows = rows.withColumns({"cipos": F.array(hull("a_start_lo", "v_t_start"), hull("a_start_hi", "v_t_start")), "ciend": F.array(hull("a_end_lo", "v_t_end"), hull("a_end_hi", "v_t_end"))})
    return rows.withColumn("is_good_realign", good_alignment()).drop("_lt", "_rt", "_lq", "_rq")


def _status() -> Column:
    whole = (F.col("left_len") > 0) & (F.col("right_len") > 0) & ((F.col("t_len") > 0) | (F.col("q_len") > 0))
    return F.when(~F.col("fits") | F.col("left_len").isNull(), "CanotAGE").when(whole, "variant").otherwise("RefHomo_Or_SNP")


def realign(calls: DataFrame, targets: DataFrame, queries: DataFrame, t_lengths: DataFrame, q_lengths: DataFrame, sc: Scores | None = None, flank_size: int = 500, both: bool = True, size: int = 10_000, overlap: int = 600) -> DataFrame:
    """Every call with its status (variant, RefHomo_Or_SNP, CanotAGE) and, for a variant, its final type, place, strand,
    identity, cipos and ciend. calls: CALL and EXPECTED columns, call_id unique; targets, queries: pieces of sequences
    (readers.sequence_chunks with the same size and overlap); lengths: id, len.

    Calls keep the first variant between their fragments. An inversion keeps its own type and place; a translocation is
    aligned where it was expected and its type ends in =>TRANS# and the places it came from. A call whose sequences have no
    length is left out; one without bases is CanotAGE. Nulls in places give no alignment."""
    rows = with_flanks(calls.select(*CALL, *EXPECTED), t_lengths, q_lengths, flank_size)
    fit = rows.where("fits")
    a = bases(fit, targets, "call_id", ["a_id", "a_start", "a_end"], "a", size, overlap)
    b = bases(fit, queries, "call_id", ["q_id", "b_start", "b_end"], "b", size, overlap)
    pairs = a.join(b, "call_id").select(F.col("call_id").alias("pair_id"), "a", "b")
    aligned = gap_excision(pairs, sc, both=both).withColumnRenamed("pair_id", "call_id")
    # b_start is a column of either side: of the flanks here
    aligned = aligned.select(*[c for c in aligned.columns if c not in ("score",)])
    rows = between(rows.join(aligned, "call_id", "left")).withColumn("status", _status())
    moved, inverted, found = F.col("expected_id").isNotNull(), F.col("type") == "INV", F.col("status") == "variant"
    came = F.concat(F.lit("=>TRANS#"), F.concat_ws("-", "t_id", F.col("t_start").cast("string"), F.col("t_end").cast("string")), F.lit("#"), F.concat_ws("-", "q_id", F.col("q_start").cast("string"), F.col("q_end").cast("string")))
    kind = F.when(inverted, F.col("type")).when(moved, F.concat("found", came)).otherwise(F.col("found"))
    new = lambda c: F.when(found & ~inverted, F.col(f"v_{c}")).otherwise(F.col(c))
    return rows.select(
        "call_id", "status", F.col("type").alias("call_type"), F.when(found, kind).otherwise(F.concat(F.col("type"), F.lit("=>"), F.col("status"))).alias("type"),
        F.when(found & moved, F.col("a_id")).otherwise(F.col("t_id")).alias("t_id"), *[new(c).alias(c) for c in ("t_start", "t_end")], "q_id", *[new(c).alias(c) for c in ("q_start", "q_end")],
        F.coalesce("strand", F.lit("+")).alias("strand"), "score", "mismap", "identity", "cipos", "ciend", found.alias("is_success_align"), F.coalesce("is_good_realign", F.lit(False)).alias("is_good_realign"),
    )


def with_alleles(variants: DataFrame, targets: DataFrame, queries: DataFrame, size: int = 10_000, overlap: int = 600) -> DataFrame:
    """Ref and alt of each variant (call_id and places), bases of both sides by joins on pieces, with types of N."""
    ref = bases(variants, targets, "call_id", ["t_id", "t_start", "t_end"], "ref", size, overlap)
    alt = bases(variants, queries, "call_id", ["q_id", "q_start", "q_end"], "alt", size, overlap)
    return final_type(variants.join(ref, "call_id").join(alt, "call_id"))


def from_alignments(alignments: DataFrame, targets: DataFrame, queries: DataFrame, t_lengths: DataFrame, q_lengths: DataFrame, sc: Scores | None = None, flank_size: int = 500, size: int = 10_000, overlap: int = 600) -> DataFrame:
    """Detect from alignments (read_maf) to VCF fields, V01 to V08: structural calls of each query, the solved ones realigned, each place once, with
    alleles, filter and genotype; heterozygous where another query agrees with the target there (reference calls of the aligned rows)."""
    from varloom.operators.variants import stored_runs, structural_calls

    calls = structural_calls(alignments, evidence=True).where("kind not like 'Nos-%'").distinct()
    places = ["q_id", "kind", "t_id", "t_start", "t_end", "q_start", "q_end"]
    calls = stored(calls.select(F.concat_ws("|", *[F.col(c).cast("string") for c in places]).alias("call_id"), F.col("kind").alias("type"), *CALL[2:], *EXPECTED), "calls")
    targets, queries = stored(targets, "targets"), stored(queries, "queries")
    same = stored_runs(alignments, "same").select("t_id", "t_start", "t_end", "q_id")
    return detected(calls, targets, queries, t_lengths, q_lengths, same, sc, flank_size, size, overlap)


def detected(calls: DataFrame, targets: DataFrame, queries: DataFrame, t_lengths: DataFrame, q_lengths: DataFrame, references: DataFrame, sc: Scores | None = None, flank_size: int = 500, size: int = 10_000, overlap: int = 600) -> DataFrame:
    """Detect from calls to VCF fields: realigned variants, each place once, with alleles, heterozygosity against reference calls
    (t_id, t_start, t_end, q_id), filter and genotype."""
    from varloom.operators.variants import first_arrivals, heterozygous

    # each call is aligned once; the rows are used for the first arrivals, either allele and the calls themselves
    rows = stored(realign(calls, targets, queries, t_lengths, q_lengths, sc, flank_size, size=size, overlap=overlap).where("status = 'variant'"), "realigned")
    once = first_arrivals(rows.drop("identity", "cipos", "ciend"), ["t_id", "t_start", "t_end", "q_id", "q_start", "q_end", "type"], ["call_id"])
    rows = rows.join(once.select("call_id"), "call_id", "left_semi")
    return vcf_call(heterozygous(with_alleles(rows, targets, queries, size, overlap), references))

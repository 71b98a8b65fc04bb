"""Variant calling on alignments: per-column walk, gap runs, the adjacency machine, typing, masks."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.scalars import iupac, n_count, revcomp
from varloom.operators.intervals import interval_join, merge_pairs, window_of

#: Order in which the families of calls come (A37, U01). Fixed.
FAMILIES = ["INS", "DEL", "SIMUL", "NOSOL", "TRANS", "INV", "SNP", "REFCALL", "N", "INTERGAP"]


def drop_double_gaps(df: DataFrame) -> DataFrame:
    """Alignment columns where both rows have a gap go."""
    pairs = F.filter(F.arrays_zip(F.split("t_seq", "").alias("t"), F.split("q_seq", "").alias("q")), lambda x: (x["t"] != "-") | (x["q"] != "-"))
    df = df.withColumn("_p", pairs)
    return df.withColumns({"t_seq": F.array_join(F.transform("_p", lambda x: x["t"]), ""), "q_seq": F.array_join(F.transform("_p", lambda x: x["q"]), "")}).drop("_p")


#: What columns walk() can be asked for.
KINDS = ("all", "snps", "same", "n", "clear")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow column of strings."""
    large = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return off - off[:1], data[off[0] : off[-1]]


def _placed(b: pa.RecordBatch, seq: str, start: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(each row's first column, and the number of columns; bases; the place of each column's base, or of the one before a gap)."""
    off, data = _bytes(b.column(seq))
    count = np.concatenate([[0], np.cumsum(data != GAP)])
    row = np.repeat(np.arange(b.num_rows), np.diff(off))
    return off, data, b.column(start).to_numpy(zero_copy_only=False).astype(np.int64)[row] - 1 + count[1:] - count[off[:-1]][row]


GAP, UNKNOWN, CASE = ord("-"), ord("N"), 0xDF


def _letters(data: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(data), pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


#: The plain letter of each byte: ambiguous bases as the alternative allele has them.
CLEAR = np.arange(256, dtype=np.uint8)
CLEAR[ord("a") : ord("z") + 1] &= CASE
CLEAR[list(b"WSKMYRVDBH")] = list(b"ACTACAAATA")
CLEAR[list(b"wskmyrvdbh")] = list(b"ACTACAAATA")


def _columns(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple]:
    """Batches of alignments with their columns: (batch, first column of each row, bases and places of target and query, columns of the kind, their rows)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            b = whole.slice(at, 2000)
            off, t, t_pos = _placed(b, "t_seq", "t_start")
            q_off, q, q_pos = _placed(b, "q_seq", "q_start")
            if not np.array_equal(off, q_off):
                raise ValueError("aligned rows of unequal length")
            if kind == "clear":
                hit = np.flatnonzero(CLEAR[t] != CLEAR[q])
            elif kind == "all":
                hit = np.arange(len(t))
            else:
                up, uq = t & CASE, q & CASE
                bases = (t != GAP) & (q != GAP)
                if kind == "snps":
                    hit = np.flatnonzero(bases & (up != uq) & (up != UNKNOWN) & (uq != UNKNOWN))
                elif kind == "same":
                    hit = np.flatnonzero(bases & (up == uq) & (up != UNKNOWN))
                else:
                    hit = np.flatnonzero(bases & ((up == UNKNOWN) | (uq == UNKNOWN)))
            yield b, off, t, t_pos, q, q_pos, hit, np.repeat(np.arange(b.num_rows), np.diff(off))[hit]


def _walk(batches: Iterator[pa.RecordBatch], keep: list[str], kind: str) -> Iterator[pa.RecordBatch]:
    for b, off, t, t_pos, q, q_pos, hit, row in _columns(batches, kind):
        cols = [b.column(c).take(pa.array(row)) for c in keep]
        yield pa.RecordBatch.from_arrays([*cols, pa.array((hit - off[row]).astype(np.int32)), pa.array(t_pos[hit]), pa.array(q_pos[hit]), _letters(t[hit]), _letters(q[hit])], [*keep, "col", "t_pos", "q_pos", "t_base", "q_base"])


def _kept(df: DataFrame, drop: tuple[str, ...]) -> tuple[list[str], str]:
    keep = [f for f in df.schema.fields if f.name not in drop]
    return [f.name for f in keep], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)


def walk(df: DataFrame, kind: str = "all") -> DataFrame:
    """A row per alignment column: t_pos, q_pos (of the base, or of the base before a gap), t_base, q_base. Places are counted
    over a batch of alignments at once. kind: all columns, or those of snps(), reference_calls() ('same') or n_calls() ('n') only, or those whose clear alleles differ ('clear')."""
    if kind not in KINDS:
        raise ValueError(f"no kind of columns: {kind}")
    keep, schema = _kept(df, ("t_seq", "q_seq"))
    return df.mapInArrow(lambda it: _walk(it, keep, kind), f"{schema}, col int, t_pos long, q_pos long, t_base string, q_base string")


def snps(columns: DataFrame) -> DataFrame:
    """P05."""
    ok = (F.col("t_base") != "-") & (F.col("q_base") != "-") & ~F.upper("t_base").isin("N") & ~F.upper("q_base").isin("N")
    return columns.where(ok & (F.upper("t_base") != F.upper("q_base")))


def _runs(rows: DataFrame) -> DataFrame:
    """Runs of columns that go on on both sides. Neighbours of one alignment are put together first, on the map side."""
    at = rows.select("t_id", "q_id", "t_pos", "q_pos")
    return merge_pairs(at.mapInArrow(_joined, f"t_id {dict(at.dtypes)['t_id']}, q_id {dict(at.dtypes)['q_id']}, t_start long, t_end long, q_start long, q_end long"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t, q = (b.column(c).to_numpy() for c in ("t_pos", "q_pos"))
        on = np.zeros(len(t), bool)
        on[1:] = (np.diff(t) == 1) & (np.diff(q) == 1)
        for c in ("t_id", "q_id"):
            ids = b.column(c).dictionary_encode().indices.to_numpy()
            on[1:] &= ids[1:] == ids[:-1]
        s = np.flatnonzero(~on)
        e = np.concatenate([s[1:], [len(t)]])[: len(s)] - 1
        first = pa.array(s)
        yield pa.RecordBatch.from_arrays([b.column("t_id").take(first), b.column("q_id").take(first), pa.array(t[s]), pa.array(t[e]), pa.array(q[s]), pa.array(q[e])], ["t_id", "q_id", "t_start", "t_end", "q_start", "q_end"])


RUN = ["t_id", "q_id", "t_start", "t_end", "q_start", "q_end"]


def _kind_runs(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """The runs of each alignment by itself."""
    for b, _, _, t_pos, _, q_pos, hit, row in _columns(batches, kind):
        t, q = t_pos[hit], q_pos[hit]
        on = np.zeros(len(t), bool)
        on[1:] = (np.diff(t) == 1) & (np.diff(q) == 1) & (np.diff(row) == 0)
        s = np.flatnonzero(~on)
        e = np.append(s[1:], len(t))[: len(s)] - 1
        first = pa.array(row[s])
        yield pa.RecordBatch.from_arrays([b.column("t_id").take(first), b.column("q_id").take(first), pa.array(t[s]), pa.array(t[e]), pa.array(q[s]), pa.array(q[e])], RUN)


def _merged(b: pa.Table, pair: np.ndarray) -> pa.RecordBatch:
    """merge_pairs() of whole pairs. pair: a rising number for each run's pair."""
    t, t_end, q, q_end = (b.column(c).to_numpy() for c in RUN[2:])
    order = np.lexsort((q_end, q, t_end, t, pair))
    pair, t, t_end, q, q_end = (v[order] for v in (pair, t, t_end, q, q_end))
    on = np.zeros(len(t), bool)
    on[1:] = pair[1:] == pair[:-1]
    for start, end in ((t, t_end), (q, q_end)):
        lift = pair * (int(end.max()) - int(end.min()) + 1)  # ends of a later pair are all higher
        reach = np.maximum.accumulate(end + lift)[:-1] - lift[:-1]
        on[1:] &= start[1:] <= reach + 1
    s = np.flatnonzero(~on)
    first = pa.array(order[s])
    ids = [b.column(c).combine_chunks().take(first) for c in RUN[:2]]
    return pa.RecordBatch.from_arrays([*ids, *map(pa.array, (t[s], np.maximum.reduceat(t_end, s), np.minimum.reduceat(q, s), np.maximum.reduceat(q_end, s)))], RUN)


def _merged_runs(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Runs of alignments that come pair by pair; the last pair of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for runs in _kind_runs(batches, kind):
        if not runs.num_rows:
            continue
        held.append(runs)
        rows = pa.Table.from_batches(held)
        number = [rows.column(c).combine_chunks().dictionary_encode() for c in RUN[:2]]
        number = [(x.chunk(0) if isinstance(x, pa.ChunkedArray) else x).indices.fill_null(-1).to_numpy(zero_copy_only=False) for x in number]
        change = np.flatnonzero((np.diff(number[0]) != 0) | (np.diff(number[1]) != 0)) + 1
        if len(change):
            pair = np.zeros(rows.num_rows, np.int64)
            pair[change] = 1
            last = int(change[-1])
            yield _merged(rows.slice(0, last), np.cumsum(pair)[:last])
            held = rows.slice(last).to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield _merged(rows, np.zeros(rows.num_rows, np.int64))


def called_runs(df: DataFrame, kind: str, pairs: DataFrame | None = None) -> DataFrame:
    """P06 ('n'), P07 ('same') from alignments: as n_calls() and reference_calls() of their columns, but only runs leave a task. What has to meet
    are alignments of one pair, so those that are the only one of their pair are not dealt out. Of the others, pairs whose alignments begin in one
    window of the target go to a task each, those of longer ones through merge_pairs(). pairs: t_id and q_id of every alignment, where they are had for less than those of df."""
    from varloom.sources.shared import stored

    if kind not in ("same", "n"):
        raise ValueError(f"no kind of runs: {kind}")
    keys, w = ["t_id", "q_id"], window_of("t_start")
    at = df.select(*keys, "t_start", "q_start", "t_seq", "q_seq")
    schema = f"t_id {dict(at.dtypes)['t_id']}, q_id {dict(at.dtypes)['q_id']}, t_start long, t_end long, q_start long, q_end long"
    several = (df if pairs is None else pairs).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    several = stored(several.select(F.col("t_id").alias("_t"), F.col("q_id").alias("_q")), "pairs")
    if several.isEmpty():
        return at.mapInArrow(lambda it: _kind_runs(it, kind), schema)
    met = F.col("t_id").eqNullSafe(F.col("_t")) & F.col("q_id").eqNullSafe(F.col("_q"))
    alone = at.join(several, met, "left_anti").mapInArrow(lambda it: _kind_runs(it, kind), schema)
    at = at.join(several, met, "left_semi")
    long = at.groupBy(*keys).agg(F.min(w).alias("_lo"), F.max(w).alias("_hi")).where("_lo < _hi").select(*keys)
    short = at.join(long, keys, "left_anti").repartition(*keys).sortWithinPartitions(*keys)
    whole = short.mapInArrow(lambda it: _merged_runs(it, kind), schema)
    return alone.unionByName(whole).unionByName(merge_pairs(at.join(long, keys, "left_semi").mapInArrow(lambda it: _kind_runs(it, kind), schema)))


def stored_runs(df: DataFrame, kind: str) -> DataFrame:
    """called_runs() of alignments of any length, few of a pair: the runs of each by itself are made in its task, once, and stored; those of a pair that meet are joined."""
    from varloom.sources.shared import stored

    at = df.select("t_id", "q_id", "t_start", "q_start", "t_seq", "q_seq")
    schema = f"t_id {dict(at.dtypes)['t_id']}, q_id {dict(at.dtypes)['q_id']}, t_start long, t_end long, q_start long, q_end long"
    return merge_pairs(stored(at.mapInArrow(lambda it: _kind_runs(it, kind), schema), "runs"))


def reference_calls(columns: DataFrame) -> DataFrame:
    """Runs of equal bases that aren't N."""
    return _runs(columns.where((F.upper("t_base") == F.upper("q_base")) & ~F.upper("t_base").isin("N", "-")))


def n_calls(columns: DataFrame) -> DataFrame:
    """Runs of columns with an N on either side."""
    return _runs(columns.where(((F.upper("t_base") == "N") | (F.upper("q_base") == "N")) & (F.col("t_base") != "-") & (F.col("q_base") != "-")))


def gap_runs(df: DataFrame, gapped: str = "t_seq", other: str = "q_seq", gapped_start: str = "t_start", other_start: str = "q_start") -> DataFrame:
    """Maximal runs of - in one row: anchor (the base before, on the gapped side; 0 at its start as the
    scan counts from start - 1), and the first and last position on the other side. Insertions as
    called; deletions with the two sides exchanged (P02). Runs stay inside the task."""
    keep, schema = _kept(df, (gapped, other))
    return df.mapInArrow(lambda it: _gap_runs(it, keep, gapped, other, gapped_start, other_start), f"{schema}, anchor long, first long, last long")


def _gap_runs(batches: Iterator[pa.RecordBatch], keep: list[str], gapped: str, other: str, gapped_start: str, other_start: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        off, g, g_pos = _placed(b, gapped, gapped_start)
        o_off, o, o_pos = _placed(b, other, other_start)
        if not np.array_equal(off, o_off):
            raise ValueError("aligned rows of unequal length")
        gap = g == GAP
        new, last = gap.copy(), gap.copy()
        edge = np.zeros(len(g) + 1, bool)
        edge[off] = True  # a run ends with its row
        new[1:] &= ~gap[:-1] | edge[1:-1]
        last[:-1] &= ~gap[1:] | edge[1:-1]
        s, e = np.flatnonzero(new), np.flatnonzero(last)
        before = o_pos[s] - (o[s] != GAP)
        hit = o_pos[e] > before
        s, e, before = s[hit], e[hit], before[hit]
        row = np.searchsorted(off, s, side="right") - 1
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row)) for c in keep), pa.array(g_pos[s]), pa.array(before + 1), pa.array(o_pos[e])], [*keep, "anchor", "first", "last"])


def swap(df: DataFrame) -> DataFrame:
    """Target and query exchanged."""
    name = lambda c: "q_" + c[2:] if c.startswith("t_") else "t_" + c[2:] if c.startswith("q_") else c
    return df.select(*[F.col(c).alias(name(c)) for c in df.columns])


def pair_gap(df: DataFrame) -> DataFrame:
    """P10: of two alignments (columns with _a and _b) the gap between them and its kind."""
    out = {}
    for s in ("t", "q"):
        first_end = F.when(F.col(f"{s}_start_a") <= F.col(f"{s}_start_b"), F.col(f"{s}_end_a")).otherwise(F.col(f"{s}_end_b"))
        second = F.greatest(f"{s}_start_a", f"{s}_start_b")
        out |= {f"{s}_gap_start": F.least(first_end, second), f"{s}_gap_end": F.greatest(first_end, second), f"_{s}": first_end >= second}
    df = df.withColumns(out)
    kind = F.when(F.col("_t") & F.col("_q"), "gap-X1").when(F.col("_q"), "gap-X2").when(F.col("_t"), "gap-1").otherwise("gap-2")
    return df.withColumns({"type": kind, "score": F.least("score_a", "score_b"), "mismap": F.least("mismap_a", "mismap_b")}).drop("_t", "_q")


def flank(start: str, end: str, length: str, size: int = 500) -> tuple[Column, Column]:
    """P11."""
    return F.greatest(F.lit(1), F.col(start) - size), F.least(F.col(length), F.col(end) + size)


def alignable(n: Column, m: Column, most_gb: float = 10.0) -> Column:
    """Whether an alignment of n by m fits the memory guard."""
    return 5.0 * n * m / 1e9 + 0.5 <= most_gb


def good_alignment(identity: str = "identity", mismap: str = "mismap") -> Column:
    """Identity is (len, pct) of the whole, left and right."""
    x = lambda i, f: F.get(F.col(identity), i)[f]
    good = (F.size(identity) >= 3) & (x(0, "pct") > 98) & (x(1, "len") > 30) & (x(1, "pct") > 95) & (x(2, "len") > 30) & (x(2, "pct") > 95)
    return F.coalesce(good & (F.col(mismap) < 0.01), F.lit(False))


def excised_type(t_len: Column, q_len: Column) -> Column:
    """Of what lies between two fragments."""
    return (
        F.when((t_len > 0) & (q_len == 0), "DEL").when((t_len == 0) & (q_len > 0), "INS").when((t_len == 1) & (q_len == 1), "SNP")
        .when((t_len == q_len) & (t_len > 0), "MNP").when((t_len > 0) & (q_len > 0), "REPLACEMENT").otherwise("REFCALL")
    )


def final_type(df: DataFrame) -> DataFrame:
    """Bases of both sides (ref, alt as cut from the sequences), collapsed and turned to the target's strand; types of N."""
    ref, alt = iupac(F.upper("ref")), iupac(F.upper("alt"))
    alt = F.when(F.col("strand") == "-", revcomp(alt)).otherwise(alt)
    kind = F.when(n_count(ref) > 0, "REFGAP").when(n_count(alt) > 0, "INTRAGAP").otherwise(F.col("type"))
    return df.withColumns({"type": kind, "ref": ref, "alt": F.when(ref == alt, "N").otherwise(alt)})


def vcf_call(df: DataFrame) -> DataFrame:
    """Genotype and filter."""
    kind = F.col("type")
    filters = F.when(kind.isin("REFGAP", "INTRAGAP", "INTERGAP"), kind).when(F.col("is_success_align") & ~F.col("is_good_realign"), "AGEFALSE").otherwise(".")
    gt = F.when(kind == "INTERGAP", "./.").when(kind == "REFCALL", "0/0").when(F.col("is_hete"), "0/1").otherwise("1/1")
    return df.withColumns({"filter": filters, "gt": gt})


def variant_size(kind: Column, t_len: Column, ref: Column, alt: Column) -> Column:
    """P18."""
    return F.when(kind.isin("SNP", "MNP", "REFCALL", "INTERGAP"), t_len).otherwise(F.length(alt) - F.length(ref))


def n_ratio_around(seq: Column, start: Column, end: Column, size: Column, flank_size: int = 100) -> Column:
    """Share of N in the query around a variant; the size counts without its sign."""
    lo, hi = F.greatest(F.lit(1), start - flank_size), F.least(F.length(seq), end + flank_size)
    return n_count(F.substring(seq, lo, hi - lo + 1)) / (F.abs(size) + 2 * flank_size)


def size_type(ref: Column, alt: Column, info_type: Column) -> tuple[Column, Column]:
    """(type, size) of an allele."""
    diff = F.length(alt) - F.length(ref)
    kind = (
        F.when(info_type.contains("INV"), "5.INV").when(info_type.contains("TRANS"), "6.TRANS").when(info_type.rlike("COMPLEX|REPLACEMENT"), "7.REPLACEMENT").when(info_type.contains("MNP"), "3.MNP")
        .when(alt == ".", "9.REF").when(diff > 0, "1.INS").when(diff < 0, "2.DEL").when(F.length(ref) == 1, "4.SNP").otherwise("3.MNP")
    )
    return kind, F.when(diff == 0, F.length(ref)).otherwise(F.abs(diff))


def length_type(ref: Column, alt: Column) -> tuple[Column, Column]:
    """By length only."""
    diff = F.length(alt) - F.length(ref)
    kind = F.when(diff > 0, "1.INS").when(diff < 0, "2.DEL").when(F.length(ref) == 1, "4.SNP").otherwise("3.MNP")
    return kind, F.when(diff == 0, F.length(ref)).otherwise(F.abs(diff))


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two alleles."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y)
    return F.aggregate(same, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, x: F.struct((s["on"] & F.coalesce(x, F.lit(False))).alias("on"), (s["n"] + (s["on"] & F.coalesce(x, F.lit(False))).cast("int")).alias("n")), lambda s: s["n"])


def heterozygous(variants: DataFrame, references: DataFrame) -> DataFrame:
    """J04, is_hete: inside a reference call of another query; reference calls and gaps are exempt."""
    key = F.struct("t_id", "t_start", "t_end", "q_id")
    from varloom.operators.intervals import contained

    inside = contained(variants.where(~F.col("type").isin("REFCALL", "INTERGAP")), references.select("t_id", "t_start", "t_end", "q_id")).select(key.alias("_k")).distinct()
    return variants.withColumn("_k", key).join(inside.withColumn("is_hete", F.lit(True)), "_k", "left").withColumn("is_hete", F.coalesce("is_hete", F.lit(False))).drop("_k")


def without_no_solution(variants: DataFrame, no_solution: DataFrame, compat: bool = False) -> DataFrame:
    """Calls whose query interval overlaps a no-solution interval go; compat leaves all."""
    if compat:
        return variants
    return interval_join(variants, no_solution, "q_id", ("q_start", "q_end"), ("q_start", "q_end"), how="left_anti")


def union_families(parts: dict[str, DataFrame]) -> DataFrame:
    """The families of calls as one table, with their rank in the order in which they come."""
    out = None
    for rank, kind in enumerate(k for k in FAMILIES if k in parts):
        part = parts[kind].withColumns({"family": F.lit(kind), "rank": F.lit(FAMILIES.index(kind))})
        out = part if rank == 0 else out.unionByName(part)
    if out is None:
        raise ValueError(f"no family of {FAMILIES}")
    return out


def first_arrivals(df: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """The first row of each key in arrival order. An aggregation, so frequent keys combine early."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*arrival, *[c for c in rest if c not in arrival])).alias("_r")
    return df.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def single_hits(df: DataFrame) -> DataFrame:
    """Sites seen more than once go altogether."""
    once = df.groupBy("t_id", "q_id", "t_start").agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return df.join(once, ["t_id", "q_id", "t_start"], "left_semi")


def nomadic(sequences: DataFrame, alignments: DataFrame) -> DataFrame:
    """Query sequences without an alignment."""
    return sequences.join(alignments.select(F.col("q_id").alias("id")), "id", "left_anti")


def neighbour_ranks(df: DataFrame) -> DataFrame:
    """Rank of each alignment of a query by target position, and how far it is from the one before it in query order."""
    by_target = Window.partitionBy("q_id").orderBy("t_id", "t_start", "q_start")
    by_query = Window.partitionBy("q_id").orderBy("q_start", "t_id", "t_start")
    rows = df.withColumn("ord", F.row_number().over(by_target))
    return rows.withColumn("step", F.col("ord") - F.lag("ord").over(by_query))


def simultaneous(a: Column, c: Column) -> Column:
    """Alignments a and c (structs) can have a gap between them."""
    return (a["t_id"] == c["t_id"]) & (a["strand"] == c["strand"])


def translocated(a: Column, b: Column, c: Column) -> Column:
    """B stands elsewhere than between a and c, which go together."""
    lo, hi = F.least(a["t_start"], c["t_start"]), F.greatest(a["t_end"], c["t_end"])
    return simultaneous(a, c) & ~((b["t_id"] == a["t_id"]) & (b["t_start"] <= hi) & (b["t_end"] >= lo))


def inverted(a: Column, b: Column, c: Column) -> Column:
    """B begins between a and c, on the other strand."""
    lo, hi = F.least(a["t_start"], c["t_start"]), F.greatest(a["t_end"], c["t_end"])
    return simultaneous(a, c) & (b["t_id"] == a["t_id"]) & (b["strand"] != a["strand"]) & b["t_start"].between(lo, hi)


# The adjacency machine (V01 to V05, V08): a fold over one query's alignments, two of which it remembers.
CALLS = "q_id string, kind string, t_id string, t_start long, t_end long, q_start long, q_end long"
CALL_COLUMNS = ["q_id", "kind", "t_id", "t_start", "t_end", "q_start", "q_end"]
#: What a call carries on to realignment, besides.
EVIDENCE = {"score": "long", "mismap": "double", "expected_id": "string", "expected_start": "long", "expected_end": "long"}


def _spans_gap(a, c) -> tuple[int, int]:
    lo, hi = sorted((a, c), key=lambda r: r.t_start)
    return min(lo.t_end, hi.t_start), max(lo.t_end, hi.t_start)


def _gap_kind(a, c) -> str:
    t_over = min(a.t_end, c.t_end) >= max(a.t_start, c.t_start)
    q_over = min(a.q_end, c.q_end) >= max(a.q_start, c.q_start)
    return {(True, True): "gap-X1", (False, True): "gap-X2", (True, False): "gap-1", (False, False): "gap-2"}[t_over, q_over]


def call_query(rows: list, compat: bool = False) -> list[tuple]:
    """Calls of one query, with score, mismap and, for a translocation, where it was expected. rows: its alignments, any order."""
    by_query = sorted(rows, key=lambda r: (r.q_start, r.t_id, r.t_start, r.t_end, r.q_end, r.strand))
    ranks: dict[int, int] = {}
    for i, r in enumerate(sorted(rows, key=lambda r: (r.t_id, r.t_start, r.q_start, r.t_end, r.q_end, r.strand))):
        ranks[r.q_start] = i  # of several with one query start the last counts
    near = lambda x, y: abs(ranks[x.q_start] - ranks[y.q_start]) == 1
    out: list[tuple] = []

    def emit(kind: str, x, t: tuple[int, int], q: tuple[int, int], score: int | None, mismap: float | None, expected: tuple = (None, None, None)) -> None:
        out.append((x.q_id, kind, x.t_id, *t, *q, score, mismap, *expected))

    def simultaneous(a, c) -> bool:
        if a.t_id != c.t_id or a.strand != c.strand:
            return False
        lo, hi = _spans_gap(a, c)
        scored = a.score is not None
        emit(_gap_kind(a, c), a, (lo, hi), (min(a.q_end, c.q_start), max(a.q_end, c.q_start)), min(a.score, c.score) if scored else None, min(a.mismap, c.mismap) if scored else None)
        return True

    def outer(a, c) -> tuple[int, int]:
        return min(a.t_start, c.t_start), a.t_end if compat else max(a.t_end, c.t_end)

    def translocated(a, b, c) -> bool:
        if a.t_id != c.t_id or a.strand != c.strand:
            return False
        lo, hi = outer(a, c)
        if b.t_id == a.t_id and b.t_start <= hi and b.t_end >= lo:
            return False
        kind = f"TRANS-{'INTRA' if b.t_id == a.t_id else 'INTER'}{1 if b.strand == a.strand else 2}"
        emit(kind, b, (b.t_start, b.t_end), (b.q_start, b.q_end), b.score, b.mismap, (a.t_id, *_spans_gap(a, c)))
        return True

    def inverted(a, b, c) -> bool:
        lo, hi = outer(a, c)
        if not (a.t_id == b.t_id == c.t_id and a.strand == c.strand != b.strand and lo <= b.t_start <= hi):
            return False
        emit("INV", b, (b.t_start, b.t_end), (b.q_start, b.q_end), b.score, b.mismap)
        return True

    def unsolved(a, kind: str) -> None:
        emit(kind, a, (a.t_start, a.t_end), (a.q_start, a.q_end), a.score, a.mismap)

    held: list = []
    for c in by_query:
        if len(held) == 1:
            if near(c, held[0]) and simultaneous(held[0], c):
                held = []
        elif len(held) == 2:
            a, b = held
            if near(c, a):
                held = [] if translocated(a, b, c) else [] if near(c, b) and simultaneous(b, c) else [b]
            elif near(b, a) and near(c, b):
                held = [] if inverted(a, b, c) else [] if simultaneous(b, c) else [b]
            else:
                unsolved(a, "Nos-JustNo" if near(b, a) else "Nos-Complex")
                held = [b]
        held.append(c)
    if len(held) == 2 and not simultaneous(*held):
        for r in held:
            unsolved(r, "Nos-Strand" if held[0].t_id == held[1].t_id else "Nos-Complex")
    return out


def by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple]:
    """(first columns, rows) of each run of rows that agree on so many first columns; runs may straddle batches."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, key=itemgetter(*range(keys)))


Alignment = namedtuple("Alignment", "q_id t_id t_start t_end q_start q_end strand score mismap", defaults=(None, None))


#: Alignments beyond which a query is taken apart over several tasks.
LONG_QUERY = 100_000


def structural_calls(alignments: DataFrame, compat: bool = False, long_query: int = LONG_QUERY, evidence: bool = False) -> DataFrame:
    """Runs query by query over partitions sorted by query, where a query's alignments (one assembled
    sequence's) are held one query at a time; queries of more than long_query alignments go by joins and scans (long_queries), unless compat.
    evidence: with the columns EVIDENCE; alignments have score and mismap then."""
    more = [F.col("score").cast("long"), F.col("mismap").cast("double")] if evidence else [F.lit(None).cast("long").alias("score"), F.lit(None).cast("double").alias("mismap")]
    rows = alignments.select(F.col("q_id").cast("string"), F.col("t_id").cast("string"), *[F.col(c).cast("long") for c in Alignment._fields[2:6]], "strand", *more)
    names = [*CALL_COLUMNS, *EVIDENCE]
    kinds = [pa.string()] * 3 + [pa.int64()] * 5 + [pa.float64(), pa.string(), pa.int64(), pa.int64()]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, group in by_key(batches, 1):
            own = list(map(Alignment._make, group))
            if len(own) > 1:
                out += call_query(own, compat)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    folded = lambda df: df.repartition("q_id").sortWithinPartitions("q_id", "q_start", "t_id", "t_start").mapInArrow(fold, CALLS + "".join(f", {n} {k}" for n, k in EVIDENCE.items())).select(*(names if evidence else CALL_COLUMNS))
    if compat:
        return folded(rows)
    from varloom.operators import long_queries

    sizes = rows.groupBy("q_id").agg(F.count(F.lit(1)).alias("n"))
    if not sizes.where(F.col("n") > long_query).limit(1).count():
        return folded(rows)
    long = sizes.where(F.col("n") > long_query).select("q_id")
    return folded(rows.join(long, "q_id", "left_anti")).unionByName(long_queries.calls(rows.join(long, "q_id", "left_semi")).select(*(names if evidence else CALL_COLUMNS)))


def summary(df: DataFrame, key: str, length: str) -> DataFrame:
    """Count and length by key."""
    return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("num"), F.sum(length).alias("len"))


def vcf_summary(df: DataFrame) -> DataFrame:
    """The length of a call depends on its type; all translocations are one key."""
    t, q = F.col("t_end") - F.col("t_start"), F.col("q_end") - F.col("q_start")
    kind = F.when(F.col("type").contains("TRANS"), "TRANS").otherwise(F.col("type"))
    length = F.when(kind.isin("INTERGAP", "N", "REFCALL"), F.greatest(t, q) + 1).when(kind == "REPLACEMENT", F.abs(t - q)).otherwise(F.greatest(t, q))
    return df.groupBy(F.concat(F.lit("2.[VCF]"), kind).alias("key")).agg(F.count(F.lit(1)).alias("num"), F.sum(length).alias("len"))

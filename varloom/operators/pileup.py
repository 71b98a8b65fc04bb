"""Pileup with bases: for each position the reads over it, their bases, marks and qualities.

Reads go to windows of positions and stream through a window in order; a batch of reads is expanded through the CIGAR at once, in numpy, and
positions that no later read can reach are given out. So what is shuffled are reads, once per window that they touch, and a task
holds a batch and the open positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.operators.reads import alignment_end, flag

#: Positions of a window, as a power of two.
BITS = 10
#: Operations by what they move along, and where a stretch of a read begins or ends anew.
BASES, BREAKS = frozenset("M=X"), frozenset("SNH")


def _mark(quality: int) -> str:
    """A mapping quality as a printable character."""
    return chr(min(quality, 93) + 33)


def _stretches(cigar: list[dict]) -> Iterator[tuple[str, int, int, int, bool, bool, dict | None]]:
    """(kind, length, reference offset, read offset, begins, ends, next) of the operations that cover positions. A stretch begins after the start or a
    break; it ends where the read does or a break follows, with at most one insertion or deletion between."""
    ref = read = 0
    begins = True
    for i, x in enumerate(cigar):
        op, n = x["op"], x["len"]
        after = [y["op"] for y in cigar[i + 1 : i + 3]]
        if op in BASES:
            indel = after[:1] in (["I"], ["D"])
            last = after[1:] if indel else after[:1]
            yield "M", n, ref, read, begins, not last or last[0] in BREAKS, cigar[i + 1] if indel else None
            ref, read = ref + n, read + n
        elif op == "D":
            yield "D", n, ref, read, False, False, None
            ref += n
        elif op == "N":
            ref += n
        elif op in "IS":
            read += n
        begins = op in BREAKS


def expand(read: dict, lo: int, hi: int) -> list[tuple[int, list[str], str]]:
    """[(first position, texts, qualities)] of a read's stretches between two positions. read: pos, cigar, seq, qual, mapq, reverse and ref_seq, the
    bases of the reference from pos on (or less)."""
    seq, qual, against, out = read["seq"] or "", read["qual"] or "", (read["ref_seq"] or "").upper(), []
    fold = str.lower if read["reverse"] else str.upper
    same = "," if read["reverse"] else "."
    for kind, n, ref, at, begins, ends, follows in _stretches(read["cigar"] or []):
        first = read["pos"] + ref
        s, e = max(lo, first) - first, min(hi, first + n) - first
        if s >= e:
            continue
        marks = qual[at + s : at + e].ljust(e - s)
        if kind == "D":
            out.append((first + s, ["*"] * (e - s), marks))
            continue
        own, theirs = seq[at + s : at + e], against[ref + s : ref + e].ljust(e - s, "N")
        texts = [same if b == "=" or b.upper() == r else fold(b) for b, r in zip(own.ljust(e - s, "N"), theirs, strict=True)]
        if begins and s == 0:
            texts[0] = "^" + _mark(read["mapq"]) + texts[0]
        if e == n:
            if follows and follows["op"] == "I":
                texts[-1] += f"+{follows['len']}{fold(seq[at + n : at + n + follows['len']])}"
            elif follows:
                texts[-1] += f"-{follows['len']}{fold(against[ref + n : ref + n + follows['len']].ljust(follows['len'], 'N'))}"
            if ends:
                texts[-1] += "$"
        out.append((first + s, texts, marks))
    return out


_SCHEMA = pa.schema([("ref", pa.string()), ("pos", pa.int64()), ("base", pa.string()), ("depth", pa.int64()), ("bases", pa.string()), ("quals", pa.string()), ("mapqs", pa.string())])


class _Open:
    """The positions of a window that later reads may still reach."""

    def __init__(self) -> None:
        self.pos, self.text, self.qual, self.mapq, self.base = [], [], [], [], []

    def add(self, read: dict, lo: int, hi: int) -> None:
        for first, texts, marks in expand(read, lo, hi):
            off = first - read["pos"]
            self.pos.append(np.arange(first, first + len(texts)))
            self.text += texts
            self.qual += list(marks)
            self.mapq += [_mark(read["mapq"])] * len(texts)
            self.base += list((read["ref_seq"] or "")[off : off + len(texts)].ljust(len(texts), "N"))

    def done(self, ref: str, upto: int | None) -> Iterator[tuple]:
        """Rows of the positions below upto, or of all; the others stay."""
        if not self.pos:
            return
        pos = np.concatenate(self.pos)
        order = np.argsort(pos, kind="stable")  # reads stay in their order
        cut = len(pos) if upto is None else int(np.searchsorted(pos[order], upto))
        edges = np.flatnonzero(np.diff(pos[order[:cut]], prepend=-1)).tolist()
        own = order.tolist()
        for s, e in zip(edges, [*edges[1:], cut][: len(edges)], strict=True):
            i = own[s:e]
            yield ref, int(pos[i[0]]), self.base[i[0]], e - s, "".join([self.text[k] for k in i]), "".join([self.qual[k] for k in i]), "".join([self.mapq[k] for k in i])
        rest = np.sort(order[cut:])  # as they came
        self.pos = [pos[rest]] if len(rest) else []
        for name in ("text", "qual", "mapq", "base"):
            old = getattr(self, name)
            setattr(self, name, [old[k] for k in rest.tolist()])


def _pile(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held, key, rows = _Open(), None, []
    for b in batches:
        for r in b.to_pylist():
            if (now := (r["ref"], r["_w"])) != key:
                if key:
                    rows += held.done(key[0], None)
                held, key = _Open(), now
            held.add(r, r["_w"] << bits, (r["_w"] + 1) << bits)
        if key:
            rows += held.done(key[0], max(r["pos"], key[1] << bits))
        if len(rows) > 10_000:
            yield _pack(rows)
            rows = []
    if key:
        rows += held.done(key[0], None)
    if rows:
        yield _pack(rows)


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def pileup(reads: DataFrame, reference: DataFrame | None = None, size: int = 10_000, overlap: int = 600, bits: int = BITS) -> DataFrame:
    """Ref, pos, base, depth, bases, quals and mapqs of every position that a mapped read covers; reads that skip it don't count. reads: as
    read_sam gives them, in the order of line_no. reference: pieces of the sequences (places.fasta_pieces, of that size and overlap); without it
    every reference base is N. Bases that agree are . or , (reverse), others are in upper or lower case; ^ and the mapping
    quality begin a stretch, $ ends it, + and - and a number come before inserted and deleted bases, * stands for a deleted one."""
    own = reads.where(~flag("unmapped") & (F.col("ref") != "*") & (F.size("cigar") > 0))
    own = own.select("line_no", "ref", "pos", "mapq", "cigar", "seq", "qual", flag("reverse").alias("reverse")).withColumn("end", alignment_end(F.col("pos"), F.col("cigar")).cast("long"))
    if reference is None:
        own = own.withColumn("ref_seq", F.lit(""))
    else:
        from varloom.sources.readers import fetch

        regions = own.select(F.col("ref").alias("id"), F.col("pos").alias("start"), "end").distinct()
        bases = fetch(regions, reference, size, overlap).select(F.col("id").alias("ref"), F.col("start").alias("pos"), "end", F.col("seq").alias("ref_seq"))
        own = own.join(bases, ["ref", "pos", "end"], "left")
    windows = F.sequence(F.shiftright("pos", bits), F.shiftright("end", bits))
    rows = own.where("end >= pos").select("ref", F.explode(windows).alias("_w"), "pos", "line_no", "mapq", "cigar", "seq", "qual", "reverse", "ref_seq")
    rows = rows.repartition("ref", "_w").sortWithinPartitions("ref", "_w", "pos", "line_no")
    return rows.mapInArrow(lambda it: _pile(it, bits), "ref string, pos long, base string, depth long, bases string, quals string, mapqs string")


def pileup_lines(piles: DataFrame, mapqs: bool = False) -> DataFrame:
    """Pileup text, of a line per position."""
    cols: list[Column] = [F.col("ref"), F.col("pos").cast("string"), F.col("base"), F.col("depth").cast("string"), F.col("bases"), F.col("quals"), F.col("mapqs") if mapqs else F.lit("")]
    return piles.select("ref", "pos", F.concat_ws("\t", *cols).alias("value"))

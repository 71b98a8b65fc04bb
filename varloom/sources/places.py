"""Lines of text files with their place, and what follows from it: true line numbers, FASTA records as pieces.

Splits of a file are read by any task, in any order, so a place is the file, the first byte of the split and a number that rises within
it. Scans along a file are two-level: each split by itself, and one row per split for what earlier ones carry over.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.operators.variants import _bytes

Paths = str | list[str]


def placed(spark: SparkSession, paths: Paths) -> DataFrame:
    """(file_no, file, split, row, value) of every line. Files of a list come in the list's order (file_no), those of a folder by name."""

    def one(path: str, n: int) -> DataFrame:
        lines = spark.read.text(path)
        place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
        return lines.select(F.lit(n).alias("file_no"), *place, F.monotonically_increasing_id().alias("row"), "value")

    return reduce(DataFrame.unionByName, [one(p, n) for n, p in enumerate([paths] if isinstance(paths, str) else paths)])


SPLIT = ["file_no", "file", "split"]


def numbered(spark: SparkSession, paths: Paths) -> DataFrame:
    """(line_no, value), line numbers from 1 on through the files in order. Within a split rows rise by one, so what is
    needed besides is a row per split: how many lines came before, and its first row."""
    lines = placed(spark, paths)
    splits = lines.groupBy(*SPLIT).agg(F.count(F.lit(1)).alias("_n"), F.min("row").alias("_first"))
    earlier = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    splits = splits.select(*SPLIT, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # told to every task, as lines that are dealt out by split meet in as few tasks as there are splits
    return lines.join(F.broadcast(splits), SPLIT).select((F.col("_before") + F.col("row") - F.col("_first") + 1).alias("line_no"), "value")


def merged_order(df: DataFrame, order: list[str], pos: str = "pos", bits: int = 14) -> DataFrame:
    """Rows of several sorted files with their place (merged_no, from 0) in the order that a merge gives; order: the columns, of which the
    first is the sequence's number and the second the position. Counted by windows of positions, so no task has all rows."""
    key = [F.col(order[0]).alias("_s"), F.shiftright(F.col(pos), bits).alias("_w")]
    rows = df.select("*", *key)
    n = rows.groupBy("_s", "_w").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("_s").orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("_s").agg(F.count(F.lit(1)).alias("_m"))
    per = per.select("_s", F.coalesce(F.sum("_m").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    n = n.join(per.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).withColumn("_before", F.col("_b") + F.coalesce(F.sum("_n").over(own), F.lit(0)))
    held = n.select(F.col("_s").alias("_t"), F.col("_w").alias("_v"), "_before")
    rank = F.row_number().over(Window.partitionBy("_s", "_w").orderBy(*order)) - 1
    joined = rows.withColumn("_r", rank).join(held, F.col("_s").eqNullSafe(F.col("_t")) & F.col("_w").eqNullSafe(F.col("_v")))
    return joined.select(*df.columns, (F.col("_before") + F.col("_r")).cast("long").alias("merged_no"))


#: Bytes of lines that go on as one stretch, before the last line.
STRETCH = 1 << 16


def _stretches(batches: Iterator[pa.RecordBatch], slim: bool) -> Iterator[pa.RecordBatch]:
    """Lines in order (file_no, file, split, row, id of a header, bases) as stretches of a record's lines within a split: (file_no, file, split,
    row, head: the header's row, id, at: the bases since the header or, without one, since the split began, n, bases). slim: without the bases."""
    key, head, name, since = None, None, None, 0
    for b in batches:
        if not b.num_rows:
            continue
        off, data = _bytes(b.column("bases"))
        upto = off
        if len(data) and data.max() > 127:  # characters, not bytes
            upto = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
        number, split, row = (b.column(c).to_numpy() for c in ("file_no", "split", "row"))
        file, ids = b.column("file"), b.column("id")
        at = np.arange(len(row))
        new, header = np.zeros(len(row), bool), ids.is_valid().to_numpy(zero_copy_only=False)
        new[0] = key != (number[0], file[0].as_py(), split[0])
        named = file.dictionary_encode().indices.to_numpy()
        new[1:] = (np.diff(number) != 0) | (np.diff(split) != 0) | (np.diff(named) != 0)
        if new[0]:
            head, name, since = None, None, 0
        begins = new | header
        begins[0] = True
        begins[1:] |= np.diff(off[:-1] // STRETCH) > 0
        s = np.flatnonzero(begins)
        last = lambda flags: np.maximum.accumulate(np.where(flags, at, -1))
        own, began = last(header), last(new | header)
        carried, known = began < 0, (own >= 0) & (own == began)
        begun = np.where(carried, -since, upto[np.maximum(began, 0)])
        places = [head if c else int(row[k]) if h else None for c, h, k in zip(carried[s].tolist(), known[s].tolist(), own[s].tolist(), strict=True)]
        names = [name if c else ids[k].as_py() if h else None for c, h, k in zip(carried[s].tolist(), known[s].tolist(), own[s].tolist(), strict=True)]
        ends = np.append(s[1:], len(row))
        out = [b.column(c).take(pa.array(s)) for c in ("file_no", "file", "split", "row")]
        out += [pa.array(places, pa.int64()), pa.array(names, pa.string()), pa.array(upto[s] - begun[s], pa.int64()), pa.array(upto[ends] - upto[s], pa.int64())]
        if not slim:
            out.append(pa.StringArray.from_buffers(len(s), pa.py_buffer(np.append(off[s], off[-1]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))))
        yield pa.RecordBatch.from_arrays(out, ["file_no", "file", "split", "row", "head", "id", "at", "n", *([] if slim else ["bases"])])
        key, head, name, since = (number[-1], file[-1].as_py(), split[-1]), places[-1], names[-1], int(upto[-1] - begun[-1])


def _scanned(spark: SparkSession, paths: Paths) -> DataFrame:
    """(file, head, id, at, n, bases) of stretches of lines: the record's header line (its place), its id, and the bases before and in the stretch.
    A line belongs to the last header before it, in its split or an earlier one. Lines of a split stream in order through its task, and a row
    per split tells what it carries over; lines are not dealt out."""
    is_head = F.col("value").startswith(">")
    lines = placed(spark, paths).select(*SPLIT, "row", F.when(is_head, F.regexp_extract("value", r"^>\s*(\S+)", 1)).alias("id"), F.when(is_head, "").otherwise(F.regexp_replace("value", r"\s+", "")).alias("bases"))
    schema = "file_no int, file string, split long, row long, head long, id string, at long, n long"
    rows = lines.mapInArrow(lambda it: _stretches(it, False), f"{schema}, bases string")
    # one row per split: its last header, and the bases since that or, without one, all of them
    slim = lines.mapInArrow(lambda it: _stretches(it, True), schema)
    splits = slim.groupBy(*SPLIT).agg(F.max(F.struct("row", "head", "id", (F.col("at") + F.col("n")).alias("upto"))).alias("e")).select(*SPLIT, "e.head", "e.id", "e.upto")
    over = Window.partitionBy("file_no", "file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_sum", F.coalesce(F.sum("upto").over(over), F.lit(0)))
    last = F.when(F.col("head").isNotNull(), F.struct("split", F.col("head").alias("row"), "id", F.col("_sum").alias("sum")))
    splits = splits.select(*SPLIT, F.max(last).over(over).alias("_h"), "_sum")
    rows = rows.join(F.broadcast(splits), SPLIT)
    here = F.col("head").isNotNull()
    rows = rows.where(F.when((F.col("n") > 0) & ~here & F.col("_h").isNull(), F.raise_error(F.lit("bases before a header")).cast("boolean")).otherwise(here | F.col("_h").isNotNull()))
    place = F.struct(F.when(here, F.col("split")).otherwise(F.col("_h.split")).alias("split"), F.when(here, F.col("head")).otherwise(F.col("_h.row")).alias("row"))
    at = F.when(here, F.col("at")).otherwise(F.col("at") + F.col("_sum") - F.col("_h.sum"))
    return rows.select("file_no", "file", place.alias("place"), F.when(here, F.col("id")).otherwise(F.col("_h.id")).alias("id"), at.alias("at"), "n", "bases")


RECORD = ["file_no", "file", "place", "id"]


def fasta_lengths(spark: SparkSession, paths: Paths) -> DataFrame:
    """Fa, id, len and n_len of every record, summed over its lines."""
    n_count = F.length("bases") - F.length(F.translate("bases", "Nn", ""))
    out = _scanned(spark, paths).groupBy(*RECORD).agg(F.sum("n").alias("len"), F.sum(n_count).cast("long").alias("n_len"))
    return out.select(F.col("file").alias("fa"), "id", "len", "n_len")


def fasta_pieces(spark: SparkSession, paths: Paths, size: int = 10_000, overlap: int = 600, only: list[str] | None = None, check: bool = False) -> DataFrame:
    """(id, chunk, start, seq): records as overlapping pieces, put together from their lines, so that no row holds more than a piece
    or a line. only: these ids (S06). check: letters that stand for no nucleotide are an error (S08). A line of a whole sequence is cut by bytes."""
    rows = _scanned(spark, paths).where("n > 0")
    rows = rows if only is None else rows.where(F.col("id").isin(*only))
    if check:
        from varloom.functions.scalars import is_nucleotides

        rows = rows.where(F.when(is_nucleotides("bases"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not nucleotides in "), "id")).cast("boolean")))
    first = F.greatest(F.lit(0), F.floor((F.col("at") - overlap) / size))
    chunks = F.sequence(first.cast("long"), F.floor((F.col("at") + F.col("n") - 1) / size).cast("long"))
    lo = lambda k: F.greatest(F.col("at"), k * size)
    hi = lambda k: F.least(F.col("at") + F.col("n"), k * size + size + overlap)
    part = lambda x, k: F.substring(x, (lo(k) - F.col("at") + 1).cast("int"), (hi(k) - lo(k)).cast("int")).cast("string")
    # the bytes are bound to x, else they would be made again for each piece
    cut = F.flatten(F.transform(F.array(F.col("bases").cast("binary")), lambda x: F.transform(chunks, lambda k: F.struct(k.alias("chunk"), lo(k).alias("lo"), part(x, k).alias("part")))))
    parts = rows.select(*RECORD, F.inline(cut))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lo", "part"))), lambda x: x["part"]), "")
    out = parts.groupBy(*RECORD, "chunk").agg(whole.alias("seq"))
    return out.select("id", F.col("chunk").cast("int").alias("chunk"), (F.col("chunk") * size + 1).alias("start"), "seq")

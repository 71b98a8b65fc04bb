"""Tables of intervals that a region query reads a part of.

Rows are clustered by a hierarchy of bins, each an eighth of the one above: an interval belongs to the smallest bin that holds it. Rows are dealt by
sequence, bin and start into files of about equal size, whatever number of sequences and bins there are, and sorted in them; a manifest says which file
holds how many rows of a bin, and from where to where. A region opens the files that can hold something over it only, and of these the row groups
whose starts and ends can meet it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.sources.shared import stored

#: Levels of the hierarchy, as the power of two of a bin's width and the number of its first bin.
LEVELS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1), (29, 0))


def tile_of(start: Column, end: Column, bits: int) -> Column:
    """The smallest bin, of those of 2**bits positions or more, that holds a 1-based closed interval."""
    out = None
    for width, first in LEVELS:
        if width >= bits:
            a, b = F.shiftright(start - 1, width), F.shiftright(end - 1, width)
            out = F.when(a == b, first + a) if out is None else out.when(a == b, first + a)
    return out.otherwise(0).cast("int")


def tiles_over(lo: int, hi: int, bits: int) -> list[int]:
    """The bins, of those of 2**bits positions or more, that an interval over [lo, hi] can belong to."""
    return sorted({first + at for width, first in LEVELS if width >= bits for at in range((lo - 1) >> width, min(hi - 1 >> width, (1 << (29 - width)) - 1) + 1)})


#: Rows of a file, about, and files at least.
FILE_ROWS, LEAST_FILES = 500_000, 128


def write_regions(df: DataFrame, path: str, ref: str = "ref", start: str = "start", end: str = "end", bits: int = 20, most_rows: int = FILE_ROWS) -> None:
    """The table, and beside it the manifest. A bin with many rows goes to several files, by start; positions are below 2**29."""
    rows = stored(df.withColumn("_tile", tile_of(F.col(start).cast("long"), F.col(end).cast("long"), bits)), "tiled")
    files = max(LEAST_FILES, -(-rows.count() // most_rows))
    dealt = rows.repartitionByRange(files, F.col(ref), F.col("_tile"), F.col(start), F.col(end)).sortWithinPartitions(ref, "_tile", start, end)
    dealt.write.mode("overwrite").parquet(f"{path}/rows")
    held = df.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    manifest = held.groupBy(ref, "_tile", F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min(start).alias("first"), F.max(end).alias("last"))
    manifest.withColumn("bits", F.lit(bits)).coalesce(1).sortWithinPartitions(ref, "_tile", "file").write.mode("overwrite").parquet(f"{path}/manifest")


def parse(region: str) -> tuple[str, int, int]:
    """chr, chr:a (on to its end) or chr:a-b, commas don't count."""
    found = re.fullmatch(r"(.+?)(?::([\d,]+)(?:-([\d,]+))?)?", region)
    number = lambda x, default: int(x.replace(",", "")) if x else default
    return found[1], max(1, number(found[2], 1)), number(found[3], 1 << 29)


def _manifest(spark: SparkSession, path: str, regions: list[str], ref: str) -> DataFrame:
    """The entries whose rows can lie over one of the regions."""
    hit = F.lit(False)
    for name, lo, hi in map(parse, regions):
        hit = hit | ((F.col(ref).cast("string") == name) & (F.col("first") <= hi) & (F.col("last") >= lo))
    return spark.read.parquet(f"{path}/manifest").where(hit)


def _rows(spark: SparkSession, path: str, entries: DataFrame) -> DataFrame:
    """The rows of the files that the manifest's entries name."""
    table = spark.read.parquet(f"{path}/rows")  # lists names; files are opened when rows are read
    names = [r[0] for r in entries.select("file").distinct().collect()]  # a name per FILE_ROWS rows of the regions
    return spark.read.schema(table.schema).parquet(*[f"{path}/rows/{n}" for n in names]) if names else table.where("false")


def _over(regions: list[str], ref: str, start: str, end: str, bits: int) -> Column:
    hit = F.lit(False)
    for name, lo, hi in map(parse, regions):
        tiles = tiles_over(lo, hi, bits)
        inside = F.col("_tile").between(tiles[0], tiles[-1]) if len(tiles) > 1000 else F.col("_tile").isin(tiles)
        hit = hit | ((F.col(ref).cast("string") == name) & inside & (F.col(start) <= hi) & (F.col(end) >= lo))
    return hit


def read_regions(spark: SparkSession, path: str, regions: list[str], ref: str = "ref", start: str = "start", end: str = "end", bits: int = 20) -> DataFrame:
    """The rows over any of the regions, each row once."""
    return _rows(spark, path, _manifest(spark, path, regions, ref)).where(_over(regions, ref, start, end, bits)).drop("_tile")


def count_region(spark: SparkSession, path: str, region: str, ref: str = "ref", start: str = "start", end: str = "end", bits: int = 20) -> DataFrame:
    """Rows over a region. Entries of the manifest that lie in it with all their rows are counted there, the files of the others are read."""
    _, lo, hi = parse(region)
    manifest = _manifest(spark, path, [region], ref)
    whole = (F.col("first") >= lo) & (F.col("last") <= hi)
    edge = manifest.where(~whole)
    rows = _rows(spark, path, edge).where(_over([region], ref, start, end, bits)).withColumn("file", F.col("_metadata.file_name"))
    keys = edge.select("_tile", "file")  # of one sequence: a row per bin and file at most
    read = rows.join(F.broadcast(keys), ["_tile", "file"], "left_semi").agg(F.count(F.lit(1)).alias("n"))
    return read.unionByName(manifest.where(whole).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))).agg(F.sum("n").alias("n"))

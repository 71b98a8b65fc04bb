"""Quality control and cohort reports: filters, near-duplicate sites, votes, spectra."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from varloom.operators.intervals import before, buckets
from varloom.operators.variants import by_key


def pad_small(start: Column, end: Column, least: int = 10, by: int = 5) -> tuple[Column, Column]:
    """Spans shorter than that grow on both sides; a start below 0 becomes 1."""
    small = end - start < least
    lo = F.when(small, start - by).otherwise(start)
    return F.when(lo < 0, 1).otherwise(lo), F.when(small, end + by).otherwise(end)


def bad_mark(nr: Column, inbreeding: Column) -> Column:
    """P38."""
    return F.when((nr > 0.5) | (inbreeding <= -0.7) | (inbreeding >= 0.7), -1).otherwise(1)


def filter_decision(mark: Column, vq: Column, threshold: float, old: Column) -> Column:
    """P39."""
    passed = vq >= threshold
    dup = F.when(old.isin(".", "PASS"), "DUPLIC").otherwise(F.concat(F.lit("DUPLIC;"), old))
    return F.when(mark == -1, "FALSE").when((mark == -2) & passed, dup).when(passed, "PASS").otherwise(f"q{threshold:g}")


def best_call(calls: DataFrame) -> DataFrame:
    """Per site the call of the least N ratio, then type, then size, then sample order; and how many samples have one."""
    rank = F.when(F.col("type").rlike("INS|DEL"), 0).when(F.col("type").contains("TRANS"), 1).when(F.col("type").contains("INV"), 2).otherwise(3)
    rest = F.struct(*[c for c in calls.columns if c != "site"])
    key = F.struct("nr", rank, "size", "sample_ord")
    return calls.groupBy("site").agg(F.min_by(rest, key).alias("r"), F.count(F.lit(1)).alias("samples")).select("site", "r.*", "samples")


def vote(calls: DataFrame, keys: list[str]) -> DataFrame:
    """The value of keys that most samples of a site have (the smallest on ties). Aggregations only."""
    n = calls.groupBy("site", *keys).agg(F.count(F.lit(1)).alias("votes"))
    return n.groupBy("site").agg(F.min_by(F.struct(*keys, "votes"), F.struct(-F.col("votes"), *keys)).alias("r")).select("site", "r.*")


def cluster_ids(df: DataFrame, slack: int = 20) -> DataFrame:
    """Independent clusters of sites of a sequence: nothing in one reaches within slack of another. A wider split than
    A28's chains, so each cluster can be settled by itself."""
    order = ["start", "end", "line_no"]
    rows = before(df, ["chrom"], "start", order, {"_reach": ("max", F.col("end"))})
    rows = rows.withColumn("_new", (F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + slack)).cast("long"))
    rows = before(rows, ["chrom"], "start", order, {"_before": ("sum", F.col("_new"))})
    return rows.withColumn("cluster", F.col("_before") + F.col("_new")).drop("_reach", "_new", "_before")


def marks_of(rows: list[tuple]) -> list[int]:
    """A28, one cluster: the mark of each row (start, end, nr, vq, mark, line_no); ties of start and line go by the other values.

    Marked sites (-1) take no part. Chains of sites within slack: a lower N ratio evicts the chain and its end is the
    new one's, an equal one joins, a higher one is dropped and reaches no further. Of a chain the first site of the
    highest quality wins (1). All others are -2, also those that the reference gives -1 for an N ratio over 0 or as
    evicted or dropped. Its overlap check is among sites of the highest quality and never marks the first, so it
    changes no mark here."""
    marks = [-1 if r[4] == -1 else -2 for r in rows]
    chain: list[int] = []

    def close() -> None:
        if chain:
            marks[max(chain, key=lambda i: rows[i][3])] = 1

    reach = None
    for i in sorted((i for i, r in enumerate(rows) if r[4] != -1), key=lambda i: (rows[i][0], rows[i][5], *rows[i][1:4])):
        start, end, nr = rows[i][:3]
        if reach is None or reach + 20 < start:
            close()
            chain, reach = [i], end
        elif nr < rows[chain[0]][2]:
            chain, reach = [i], end
        elif nr == rows[chain[0]][2]:
            chain.append(i)
            reach = max(reach, end)
    close()
    return marks


def settle(rows: list[tuple]) -> dict[int, int]:
    """marks_of() by line number, where those are unique."""
    return {r[5]: m for r, m in zip(rows, marks_of(rows), strict=True)}


def near_duplicates(sites: DataFrame) -> DataFrame:
    """Sites (chrom, start, end, nr, vq, mark, line_no) with final marks. The fold runs inside a cluster;
    a cluster of one site, which most are, needs none."""
    rows = cluster_ids(sites)
    n = rows.groupBy("chrom", "cluster").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.join(n, ["chrom", "cluster"])
    alone = rows.where("_n = 1").select("chrom", "line_no", F.when(F.col("mark") == -1, -1).otherwise(1).alias("final"))

    kinds = dict(sites.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (chrom, _), group in by_key(batches, 2):
            own = [r[2:] for r in group]
            out += [(chrom, r[5], final) for r, final in zip(own, marks_of(own), strict=True)]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)

    several = rows.where("_n > 1").select("chrom", "cluster", "start", "end", "nr", "vq", "mark", "line_no")
    schema = to_arrow_schema(sites.select("chrom", "line_no", F.lit(1).alias("final")).schema)
    names = schema.names
    several = several.repartition("chrom", "cluster").sortWithinPartitions("chrom", "cluster").mapInArrow(fold, f"chrom {kinds['chrom']}, line_no {kinds['line_no']}, final int")
    return alone.unionByName(several)


def filter_counts(df: DataFrame) -> DataFrame:
    """Count and share of each filter."""
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    n = df.groupBy("filter").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(total)).select("filter", "n", F.format_string("%.3f", F.col("n") / F.col("_t")).alias("ratio"))


def numeric_spectrum(calls: DataFrame) -> DataFrame:
    """Per sample and type, and per sample in all (without the reference): number, total, least, most and mean
    size; and the same over the population. One pass of grouping sets."""
    rows = calls.where("type != '9.REF'")
    sets = rows.groupingSets([["sample", "type"], ["sample"], ["type"], []], "sample", "type")
    out = sets.agg(F.count(F.lit(1)).alias("num"), F.sum("size").alias("len"), F.min("size").alias("min"), F.max("size").alias("max"), F.format_string("%.2f", F.avg("size")).alias("mean"))
    return out.withColumns({"sample": F.coalesce("sample", F.lit("~Population")), "type": F.coalesce("type", F.lit("0.Total"))})


def size_spectrum(calls: DataFrame, bin_of) -> DataFrame:
    """How many calls per sample, type and size bin, and over all types."""
    rows = calls.where("type not in ('9.REF', '4.SNP')").select("sample", "type", bin_of(F.col("size")).alias("bin"))
    sets = rows.groupingSets([["sample", "type", "bin"], ["sample", "bin"]], "sample", "type", "bin").agg(F.count(F.lit(1)).alias("num"))
    return sets.withColumn("type", F.coalesce("type", F.lit("0.ALLSV")))


def size_report(spectrum: DataFrame, bins: list[str]) -> DataFrame:
    """Bins as columns, 0 where there is none. The bins are given, so the plan needs no extra pass."""
    return spectrum.groupBy("sample", "type").pivot("bin", bins).agg(F.sum("num")).fillna(0)


def cumulative(df: DataFrame, value: str, descending: bool = False) -> DataFrame:
    """Each value with its count and the count of the values up to it (or from it on)."""
    n = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    key = buckets(n, value)
    rows = n.withColumn("_at", -key if descending else key).withColumn("_o", -F.col(value) if descending else F.col(value)).withColumn("_all", F.lit(0))
    return before(rows, ["_all"], "_at", ["_at", "_o"], {"_had": ("sum", F.col("n"))}, bits=0).select(value, "n", (F.col("_had") + F.col("n")).cast("long").alias("running"))


def merge_best(files: DataFrame, first: int = 0) -> DataFrame:
    """Lines of the first file with info and quality of the best file per site (the earlier file on ties)."""
    best = files.groupBy("chrom", "pos").agg(F.min_by(F.struct("qual", "info"), F.struct(-F.col("qual"), "file_no")).alias("b"))
    return files.where(F.col("file_no") == first).drop("qual", "info").join(best, ["chrom", "pos"]).select("*", "b.*").drop("b")


def concordance_error(gt: Column, ratio: Column) -> Column:
    """P47."""
    return F.when(gt == "1/1", ratio > 0.4).when(gt == "0/1", ratio < 0.2).otherwise(F.lit(False))


def allele_total(gt: Column) -> Column:
    """Sum of the alleles of a genotype."""
    return F.aggregate(F.split(gt, "[/|]"), F.lit(0), lambda s, x: s + F.coalesce(x.try_cast("int"), F.lit(0)))


def restore_order(df: DataFrame) -> DataFrame:
    """O06."""
    return df.orderBy("line_no")


def sample_cap(df: DataFrame, most: int, key: str, seed: int = 1) -> DataFrame:
    """At most so many rows, those of the least seeded hash. A count tells which share of the hashes can be among them (with
    room for six deviations), so tasks send about as many rows as are kept, however many tasks there are."""
    n = df.count()
    rows = df.withColumn("_x", F.xxhash64(F.col(key), F.lit(seed)))
    if n > 2 * most:
        share = (most + 6 * most**0.5 + 10) / n
        few = rows.where(F.col("_x") < int(-(2**63) + share * 2**64))
        if few.count() >= most:  # else many rows share a key's hash
            rows = few
    return rows.orderBy("_x", key).limit(most).drop("_x")


#: Parts that the rows of a key are ranked in before their first ones meet.
PARTS = 64


def rank_window(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key. Parts of a key keep their first n first, so no more than PARTS * n rows of it meet."""
    part = F.pmod(F.xxhash64(*([c for c in order if isinstance(c, str)] or keys)), F.lit(PARTS))
    first = lambda rows, by: rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
    return first(first(df.withColumn("_part", part), [*keys, "_part"]).drop("_part"), keys)

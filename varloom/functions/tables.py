"""Table functions for SQL: site_genotype and realign, over partitioned tables.

    SELECT * FROM site_genotype(TABLE(SELECT site, sample, rr, aa FROM evidence) PARTITION BY site ORDER BY sample)
    SELECT * FROM realign(TABLE(SELECT pair_id, a, b FROM pairs) PARTITION BY pmod(hash(pair_id), 64) ORDER BY (length(a), length(b)))

A site is a partition, as its samples are genotyped together; pairs may be dealt in any way, some thousands that come one after the other are
sorted by lengths and aligned together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from varloom.operators import align, genotype


def _columns(table: AnalyzeArgument, names: list[str]) -> dict[str, object]:
    """Types of the columns that a table argument must have."""
    if not table.isTable:
        raise ValueError("the argument must be a table")
    kinds = {f.name: f.dataType for f in table.dataType.fields}
    if lack := [n for n in names if n not in kinds]:
        raise ValueError(f"the table has no column {', '.join(lack)}")
    return kinds


class SiteGenotype:
    """M01 to M05 for SQL. Columns site, sample, rr and aa (reads for either allele); rows of a site must share a partition."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        kinds = _columns(table, ["site", "sample", "rr", "aa"])
        schema = StructType().add("site", kinds["site"]).add("sample", kinds["sample"])
        return AnalyzeResult(schema.add("gt", StringType()).add("gq", IntegerType()).add("pl", StringType()).add("converged", BooleanType()).add("informative", BooleanType()))

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def eval(self, row: Row) -> None:
        self.rows.append((row["site"], row["sample"], int(row["rr"]), int(row["aa"])))

    def terminate(self) -> Iterator[tuple]:
        own = sorted(self.rows, key=lambda r: (str(r[0]), r[1]))
        for site in dict.fromkeys(r[0] for r in own):
            rows = [r for r in own if r[0] == site]
            informative = np.array([r[2] + r[3] > 0 for r in rows])
            ratio = np.array([r[2] / (r[2] + r[3]) if r[2] + r[3] else 1.0 for r in rows])
            for r, ok, (gt, gq, pl, converged) in zip(rows, informative.tolist(), genotype.call_site(ratio, informative), strict=True):
                yield (site, r[1], gt, gq, pl, converged, True) if ok else (site, r[1], "./.", 0, ".", converged, False)  # P27


#: Pairs, and their bases, that are held to be aligned together.
MOST_HELD, MOST_BASES = 4_096, 4_000_000


class Realign:
    """G01 to G09 for SQL: gap excision of pairs (pair_id, a, b), as gap_excision gives it. options: a JSON text with match, mismatch, gap, extend
    and both."""

    @staticmethod
    def analyze(table: AnalyzeArgument, options: AnalyzeArgument | None = None) -> AnalyzeResult:
        kinds = _columns(table, ["pair_id", "a", "b"])
        schema = StructType().add("pair_id", kinds["pair_id"])
        for name in align.FIELDS:
            schema = schema.add(name, IntegerType())
        return AnalyzeResult(schema.add("strand", StringType()))

    def __init__(self) -> None:
        self.held: list[tuple] = []
        self.bases = 0
        self.options = "{}"

    def eval(self, row: Row, options: str = "{}") -> Iterator[tuple]:
        self.options = options or "{}"
        self.held.append((row["pair_id"], row["a"] or "", row["b"] or ""))
        self.bases += len(self.held[-1][1]) + len(self.held[-1][2])
        if len(self.held) == MOST_HELD or self.bases > MOST_BASES:
            yield from self._out()

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            yield from self._out()

    def _out(self) -> Iterator[tuple]:
        own = json.loads(self.options)
        both = bool(own.pop("both", False))
        fields, there, strand = align.excised_table([r[1] for r in self.held], [r[2] for r in self.held], align.Scores(**own), both)
        none = [None] * len(align.FIELDS)
        for (pair_id, _, _), on, side, *row in zip(self.held, there.tolist(), strand, *(fields[f].tolist() for f in align.FIELDS), strict=True):
            yield (pair_id, *(row if on else none), side)
        self.held, self.bases = [], 0


def register(spark: SparkSession) -> None:
    """site_genotype and realign for spark.sql."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("site_genotype", udtf(SiteGenotype))
    spark.udtf.register("realign", udtf(Realign))

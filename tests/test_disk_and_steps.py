"""Steps that need no row per base, and rows that need not be dealt out."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import __spark_entry__ as entry
from pyspark.sql import functions as F
from varloom.operators import variants
from varloom.plans import files
from varloom.sources import places

SF = "/root/testdata/sf0.001"


def test_detection_makes_no_row_per_column(spark, monkeypatch):
    def walked(*_):
        raise AssertionError("a row per column")

    monkeypatch.setattr(variants, "walk", walked)
    assert entry.queries()["V08_detect"](spark, SF).count() > 0


def test_stored_runs_are_those_of_the_columns(spark):
    rows = [("t1", 1, "q1", 1, "ACGTNAC-GT", "ACGANACGGT"), ("t1", 10, "q1", 11, "ACGT", "ACGT"), ("t2", 5, "q1", 3, "NNNN", "NNNN"), ("t1", 10, "q2", 11, "aCGT", "ACcT")]
    v = spark.createDataFrame(rows, "t_id string, t_start long, q_id string, q_start long, t_seq string, q_seq string")
    of = lambda df: sorted(map(tuple, df.select("t_id", "q_id", "t_start", "t_end", "q_start", "q_end").collect()))
    for kind, calls in (("same", variants.reference_calls), ("n", variants.n_calls)):
        assert of(variants.stored_runs(v, kind)) == of(calls(variants.walk(v, kind)))


def test_alignments_that_are_the_only_one_of_their_pair_are_not_dealt_out(spark):
    rows = [(n % 3, n if n < 90 else n % 2, 1 + n, 1, "ACGT", "ACNT") for n in range(100)] + [(None, None, 1, 1, "AC", "AC"), (None, None, 2, 2, "CA", "CA")]
    v = spark.createDataFrame(rows, "t_id long, q_id long, t_start long, q_start long, t_seq string, q_seq string")
    of = lambda df: Counter(map(tuple, df.collect()))
    only = v.where("q_id between 2 and 89")
    got = variants.called_runs(only, "same")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert of(got) == of(variants.reference_calls(variants.walk(only, "same")).select(*got.columns))
    whole = of(variants.called_runs(v, "same"))
    assert of(got) <= whole and whole[(None, None, 1, 3, 1, 3)] == 1
    there = v.where("q_id is not null")
    assert of(variants.called_runs(there, "same")) == of(variants.reference_calls(variants.walk(there, "same")).select(*got.columns))


def test_lines_are_not_dealt_out_to_be_numbered(spark, tmp_path):
    """The query's text is compressed, and its lines stay in the tasks that read them until they are joined by number."""
    lines = spark.range(0, 1000, 1, 5).select(F.col("id").cast("string").alias("value"))
    for compression in ("none", "gzip"):
        path = f"{tmp_path}/{compression}"
        lines.write.text(path, compression=compression)
        got = places.numbered(spark, path)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == [(n + 1, str(n)) for n in range(1000)]


def test_text_of_sites_is_stored_compressed(spark, monkeypatch):
    seen, as_file = [], files.as_file
    monkeypatch.setattr(files, "as_file", lambda *a: seen.append(as_file(*a)) or seen[-1])
    assert entry.queries()["K06_supported_vcf"](spark, SF).count() > 0
    assert seen and all(p.name.endswith(".gz") for path in seen for p in Path(path).glob("part-*"))

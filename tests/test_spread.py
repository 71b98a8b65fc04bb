"""Rows are spread over tasks, and results don't hang on their order."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F


@pytest.fixture
def plain_shuffles(spark):
    """Joins by shuffles, whose parts stay as they are."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_calls_that_expect_no_other_place_are_not_one_task(spark, plain_shuffles):
    from varloom.sources import writers

    place = {"t_id": F.col("id") % 50, "t_start": F.lit(1), "t_end": F.lit(9), "q_id": F.col("id"), "q_start": F.lit(1), "q_end": F.lit(9), "strand": F.lit("+"), "score": F.lit(5), "mismap": F.lit(0.1)}
    moved = {f"expected_{c}": F.when(F.col("id") % 100 == 0, v).cast("long") for c, v in (("id", F.col("id") % 50 + 1), ("start", F.lit(3)), ("end", F.lit(7)))}
    calls = spark.range(2000).withColumns(place | moved | {"family": F.lit("INS"), "type": F.lit("INS"), "realigned": F.lit(True)})
    lengths = spark.range(60).select("id", (F.col("id") + 100).alias("len"))
    rows = writers.call_lines(calls, lengths.where("id < 50"), spark.range(2000).withColumn("len", F.lit(7))).withColumn("task", F.spark_partition_id())
    assert rows.where("part = 1").count() == 2000 and rows.where("part = 2").count() == 20
    assert max(r["count"] for r in rows.groupBy("task").count().collect()) < 1500
    assert {r.value.split("\t")[4] for r in rows.where("part = 2").collect()} == {"101"}


def test_fasta_lines_stream_through_their_task(spark, tmp_path):
    import random
    import re

    from varloom.sources import places

    rng = random.Random(3)
    records = {f"r{i}": "".join(rng.choices("ACGTNé", k=rng.choice([0, 3, 70, 900]))) for i in range(40)}
    (tmp_path / "x.fa").write_text("".join(f">{k} x\n" + "".join(q[j : j + 11] + " \n" for j in range(0, len(q), 11)) for k, q in records.items()))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    out = places.fasta_lengths(spark, str(tmp_path / "x.fa"))
    try:
        assert {r.id: (r.len, r.n_len) for r in out.collect()} == {k: (len(q), q.count("N")) for k, q in records.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    plan = re.sub(r"#\d+L?", "", out._jdf.queryExecution().optimizedPlan().toString())
    assert "windowspecdefinition(file_no, file, split ASC" in plan and "windowspecdefinition(file_no, file, split, " not in plan


@pytest.mark.parametrize("kind", ["same", "n"])
def test_runs_of_alignments_are_those_of_their_columns(spark, kind):
    import random

    from varloom.operators import intervals, variants

    rng, rows = random.Random(9), []
    for n in range(300):
        size = rng.randint(1, 60)
        t, q = ("".join(rng.choices("AaCNn-", k=size)) for _ in range(2))
        # one target is long, of several windows; on the others alignments of a pair touch and overlap
        rows.append((n % 3, n % 7, rng.randint(1, 60_000) if n % 3 == 0 else rng.randint(1, 90), rng.randint(1, 90), t, q))
    v = spark.createDataFrame(rows, "t_id long, q_id long, t_start long, q_start long, t_seq string, q_seq string").repartition(5)
    schema = "t_id long, q_id long, t_start long, t_end long, q_start long, q_end long"
    want = intervals.merge_pairs(v.mapInArrow(lambda it: variants._kind_runs(it, kind), schema))
    apart = v.withColumn("q_id", F.monotonically_increasing_id())
    columns = (variants.reference_calls if kind == "same" else variants.n_calls)(variants.walk(apart, kind))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        for rows, same in ((v, want), (apart, columns)):
            got = variants.called_runs(rows, kind)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, same.select(*got.columns).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_clear_alleles_are_told_apart_in_the_task(spark):
    from varloom.functions import scalars as S
    from varloom.operators import variants

    t = "".join(a * 28 for a in "ACGTNWSKMYRVDBHacgtnwskmyrvdbh-")
    q = ("ACGTNWSKMYRVDBHacgtnwskmyrvd-") [:28] * 31
    v = spark.createDataFrame([(1, 1, 1, 1, t, q)], "t_id long, q_id long, t_start long, q_start long, t_seq string, q_seq string")
    alleles = [S.iupac_alt(F.upper(c)) for c in ("t_base", "q_base")]
    want = variants.walk(v).where(alleles[0] != alleles[1])
    assert variants.walk(v, "clear").collect() == want.collect()


def test_coverage_lines_deal_spans_out_once(spark):
    import random
    from collections import Counter

    from varloom.sources import writers

    rng, kinds = random.Random(2), [k for _, k in writers.COVERAGE]
    spans = [(rng.choice("xy"), rng.choice(kinds), s, s + rng.choice([0, 5, 40_000])) for s in (rng.randint(1, 60_000) for _ in range(25))]
    spans.append(("z", "no such class", 16_380, 16_390))
    v = spark.createDataFrame(spans, "ref string, class string, start long, end long")
    out = writers.coverage_lines(v, v.where("ref != 'z'").select("ref", "start", "end"))
    depth = Counter((r, p, k) for r, c, s, e in spans for p in range(s, e + 1) for k in ([c, "all"] if r != "z" else [c]))
    want = {(r, p): "\t".join(map(str, [r, p, *(depth[r, p, k] for k in ("all", *kinds))])) for r, p, _ in depth}
    assert {(r.ref, r.pos): r.value for r in out.collect()} == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate ") == 1


def test_blocks_are_matched_once(spark, tmp_path):
    from varloom.sources import readers

    (tmp_path / "x.maf").write_text("a  score=-7 mismap=1e-05\ns t  4 5 + 99 AC-GTA\ns q 6 5  - 50 ACGGT-\np  p q\nq x\n\n")
    rows = readers.read_maf(spark, str(tmp_path / "x.maf"))
    assert [tuple(r) for r in rows.collect()] == [("t", 5, 9, "q", 40, 44, "-", -7, 1e-05, "AC-GTA", "ACGGT-")]
    assert "regexp_extract" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_insert_sizes_of_equal_line_numbers_have_an_order(spark):
    from varloom.operators import reads

    v = spark.range(40).select(F.lit("g").alias("rg"), (F.col("id") % 10 * 10 + 10).cast("int").alias("insert_size"), F.lit(1).alias("line_no"))
    for up in (True, False):
        rows = v.orderBy("insert_size" if up else F.desc("insert_size")).coalesce(1)
        assert [tuple(r) for r in reads.insert_sizes(rows, 8).collect()] == [("g", 15, 5)]


@pytest.mark.parametrize("words", [False, True])
def test_anchors_are_found_once(spark, plain_shuffles, words):
    import re

    from varloom.llm import substring_dedup, suffix_dedup

    t = " ".join(f"w{i * 7919 % 1009}" for i in range(400))
    rows = [(1, t), (2, "x " + t[:900] + " y"), (3, "again and again " * 200), (4, None), (5, t), (6, "head " + "again and again " * 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = (substring_dedup.substring_dedup if words else suffix_dedup.suffix_dedup)(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapInArrow .*text#\d+\)#\d+, \[a#", plan)) == 1
    got = {r.doc_id: r for r in found.collect()}
    symbols = {d: (x or "").split() if words else x or "" for d, x in rows}
    seen, k = set(), 20 if words else 100
    for d, x in sorted(symbols.items()):
        gone = set()
        for i in range(len(x) - k + 1):
            w = tuple(x[i : i + k])
            gone |= set(range(i, i + k)) if w in seen else set()
            seen.add(w)
        assert got[d].n_removed == len(gone), d
        assert {i for s in got[d].spans for i in range(s.start, s.end)} == gone
    assert got[3].n_removed > 0 and got[6].n_removed > 0

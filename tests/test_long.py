"""Queries of very many alignments as scans, and the depth of a stream of reads."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from varloom.operators import variants
from varloom.plans.views import view

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("few", [False, True])
def test_long_queries_are_called_as_short_ones(spark, few, monkeypatch):
    from varloom.operators import long_queries

    monkeypatch.setattr(long_queries, "BITS", 6)
    v = view(spark, SF, "intervals").withColumn("t_id", F.format_string("t%d", F.col("t_id") % 3))
    if few:  # three queries, with places all over
        v = v.withColumns({"q_id": F.col("q_id") % 3, "t_start": F.expr("t_start * 131 % 10000"), "q_start": F.expr("(q_start * 7919 + line_no * 13) % 30000")})
        v = v.withColumns({"t_end": F.expr("t_start + line_no * 40"), "q_end": F.expr("q_start + 20")})
    else:
        v = v.where("t_start % 4 = 0")
    want = sorted(map(tuple, variants.structural_calls(v).collect()))
    assert sorted(map(tuple, variants.structural_calls(v, long_query=2).collect())) == want and len(want) > 100


def test_depth_of_a_stream_is_that_of_the_table(spark, tmp_path):
    from varloom.operators import intervals
    from varloom.streaming.coverage import stream_base_depth, use_store

    rng, rows = random.Random(4), []
    for ref in ("a", "b", "c"):
        at = 0
        for _ in range(400):
            at += rng.choice([0, 0, 3, 15, 400 if rng.random() < 0.02 else 1])
            start = max(1, at - rng.randint(0, 60))
            rows.append((ref, start, start + rng.choice([1, 30, 250])))
    use_store(spark)
    schema = "ref string, pos long, end long"
    for i in range(0, len(rows), 150):
        part = rows[i : i + 150] + ([(r, 10**7, None) for r in "abc"] if i + 150 >= len(rows) else [])
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stream_base_depth(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("ref", "pos", "depth").collect()))
    table = spark.createDataFrame(rows, schema)
    want = intervals.per_base(intervals.depth_runs(table, ["ref"], "pos", "end"), ["ref"])
    assert got == sorted(map(tuple, want.select("ref", "pos", "depth").collect()))


def test_late_reads_fail_the_stream(spark, tmp_path):
    from varloom.streaming.coverage import stream_base_depth, use_store

    use_store(spark)
    schema = "ref string, pos long, end long"
    for i, part in enumerate([[("a", 10, 20), ("a", 500, 510)], [("a", 399, 401)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / f"in{i}"))
    (tmp_path / "in").mkdir()
    for i in range(2):
        (f,) = (tmp_path / f"in{i}").glob("*.json")
        f.rename(tmp_path / "in" / f"{i}.json")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stream_base_depth(stream).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="late read"):
        q.awaitTermination(120)


def test_alignments_to_variants(spark):
    """What is found, put into the target, gives the query; and each variant is the planted one."""
    from varloom.operators import realign
    from varloom.sources.readers import sequence_chunks

    rng, targets, queries, blocks, planted = random.Random(8), {}, {}, [], {}
    for i in range(12):
        s = "".join(rng.choices("ACGT", k=400))
        at, gone, new = 150 + 5 * i, 20 * (i % 2), "" if i % 2 else "".join(rng.choices("ACGT", k=13))
        q = s[:at] + new + s[at + gone :]
        targets[f"t{i}"], queries[f"q{i}"] = s, q
        planted[f"t{i}"] = ("DEL", gone) if gone else ("INS", len(new))
        right = s[at + gone :]
        blocks += [(f"t{i}", 1, at, f"q{i}", 1, at, "+", 500, 1e-5, s[:at], s[:at]), (f"t{i}", at + gone + 1, 400, f"q{i}", at + len(new) + 1, len(q), "+", 400, 1e-4, right, right)]
    maf = spark.createDataFrame(blocks, "t_id string, t_start long, t_end long, q_id string, q_start long, q_end long, strand string, score long, mismap double, t_seq string, q_seq string")
    table = lambda x: spark.createDataFrame(list(x.items()), "id string, seq string")
    size = lambda x: table(x).select("id", F.length("seq").cast("long").alias("len"))
    rows = realign.from_alignments(maf, sequence_chunks(table(targets), 200, 250), sequence_chunks(table(queries), 200, 250), size(targets), size(queries), flank_size=100, size=200, overlap=250).collect()
    assert len(rows) == 12
    for r in rows:
        s = targets[r.t_id]
        assert s[: r.t_start - 1] + r.alt + s[r.t_start - 1 + len(r.ref) :] == queries[r.q_id]
        kind, n = planted[r.t_id]
        assert (r.type, abs(len(r.alt) - len(r.ref)), r.score, r.gt, r.filter) == (kind, n, 400, "1/1", ".")

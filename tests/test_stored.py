"""What several steps use is made once."""

from __future__ import annotations

import random

import __spark_entry__ as entry
from pyspark.sql import functions as F
from varloom.operators import align, recalibrate

SF = "/root/testdata/sf0.001"


def test_calls_are_aligned_once(spark):
    plan = entry.queries()["V07_realign"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in plan and "regexp_replace" not in plan


def test_recalibration_gives_a_row_for_each_row_of_a_site(spark):
    rows = spark.range(400).select((F.col("id") % 300).alias("site"), (F.col("id") % 3 > 0).alias("training"), *[(F.xxhash64("id", F.lit(k)) % 1000 / 100.0 + 30 * (F.col("id") % 3 == 0).cast("int")).alias(c) for k, c in enumerate("xy")])
    out = recalibrate.recalibrate(rows, ["x", "y"], starts=3)
    assert out.count() == 400 and "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_text_takes_the_best_scores_of_the_recurrence(monkeypatch):
    rng = random.Random(5)
    a = ["".join(rng.choices("ACGTN", k=rng.randint(60, 90))) for _ in range(30)]
    b = [s[:20] + s[35:] if n % 3 else s[:30] + "ACGTACGTTTGA" + s[30:] for n, s in enumerate(a)]
    sc = align.Scores(1, -1, -3, -1)
    swept = align.Swept(a, b, sc, True)
    found = align.excised(a, b, sc, True, True, True)
    for k, r in enumerate(found):
        f, g, *tops = swept.tables(k)
        assert (tops[0] == align._best_prefix(f[None])[0]).all() and (tops[1] == align._best_prefix(g[None])[0]).all()
        x, z = align.codes([a[k]])[0], align.codes([swept.aligned(k)])[0]
        i, j = align._where(f, int(swept.i[k]), int(swept.j[k]))
        assert r["columns"][0] == align.trace(f, x, z, i, j, sc, True)
        assert align.alternatives(f, g) == align.alternatives(f, g, tops=tuple(tops))

    def again(_):
        raise AssertionError("the best scores are made twice")

    monkeypatch.setattr(align, "_best_prefix", again)
    assert align.excised(a, b, sc, True, True, True) == found

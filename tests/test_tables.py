"""Table functions against the operators they stand for; breakpoints."""

from __future__ import annotations

import random

import pytest

from varloom.operators import align
from varloom.plans import queries as plans

SF = "/root/testdata/sf0.001"


def test_site_genotype_in_sql(spark):
    q = plans.queries()
    cols = ["site", "sample", "gt", "gq", "pl", "converged", "informative"]
    one, two = (sorted(tuple(r) for r in q[n](spark, SF).select(*cols).collect()) for n in ("M01_genotype", "M01_genotype_sql"))
    assert one == two and one


def test_realign_in_sql(spark):
    q = plans.queries()
    one, two = (sorted(map(str, (r.asDict() for r in q[n](spark, SF).collect()))) for n in ("G01_reads_of_1000", "G01_realign_sql"))
    assert one == two and one


def test_table_functions_name_what_lacks(spark):
    from varloom.functions import tables

    tables.register(spark)
    with pytest.raises(Exception, match="no column rr, aa"):
        spark.sql("SELECT * FROM site_genotype(TABLE(SELECT 1 AS site, 'a' AS sample))").collect()
    spark.createDataFrame([("x", "GTACCCACTACT", "GTAACT"), ("n", None, "ACGT")], "pair_id string, a string, b string").createOrReplaceTempView("some_pairs")
    rows = spark.sql("""SELECT * FROM realign(TABLE(some_pairs) WITH SINGLE PARTITION, '{"match": 1, "mismatch": -2, "gap": -2, "extend": -1, "both": true}') ORDER BY pair_id""").collect()
    assert [(r.pair_id, r.score) for r in rows] == [("n", None), ("x", 6)]


def plain_table(a: str, b: str, sc: align.Scores) -> list[list[int]]:
    """Local scores cell by cell, with affine gaps."""
    n, m = len(a), len(b)
    f = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best = f[i - 1][j - 1] + (sc.match if a[i - 1] == b[j - 1] else sc.mismatch)
            best = max([best, 0] + [f[i - k][j] + sc.gap + (k - 1) * sc.extend for k in range(1, i + 1)] + [f[i][j - k] + sc.gap + (k - 1) * sc.extend for k in range(1, j + 1)])
            f[i][j] = best
    return f


def test_all_breakpoints_have_the_best_score():
    sc, rng = align.Scores(1, -2, -2, -1), random.Random(5)
    several = 0
    for _ in range(60):
        a = "".join(rng.choices("ACG", k=rng.randint(3, 14)))
        cut = rng.randint(0, len(a))
        b = a[:cut] + "".join(rng.choices("ACG", k=rng.randint(0, 3))) + a[rng.randint(cut, len(a)) :]
        if not b:
            continue
        (r,) = align.excised([a], [b], sc, False, True)
        n, m = len(a), len(b)
        f, back = plain_table(a, b, sc), plain_table(a[::-1], b[::-1], sc)
        best = max(max(f[i][j] for i in range(p + 1) for j in range(q + 1)) + max(back[i][j] for i in range(n - p + 1) for j in range(m - q + 1)) for p in range(n + 1) for q in range(m + 1))
        if r is None:
            assert best == 0
            continue
        assert r["score"] == best and r["joins"]
        moves = set()
        for i, j, k, q in r["joins"]:
            left, right = f[i][j] if i else 0, back[n + 1 - k][m + 1 - q] if k <= n else 0
            assert left + right == best and i < k and j < q
            moves.add((k - i, q - j))
        assert len(moves) == len(r["joins"])
        several += len(moves) > 1
    assert several > 3
    (r,) = align.excised(["GTACCCACTACT"], ["GTAACT"], sc, False, True)
    assert r["joins"] == [(3, 3, 7, 4), (3, 3, 10, 4)]  # the two published regions


def test_bias_and_likelihoods_of_a_plain_twin():
    """M02 and M05, a sample and a component at a time."""
    import math

    import numpy as np

    from varloom.operators import genotype

    assert math.isclose(genotype.bias_of(np.array([0.1, 0.4, 0.9]), np.array([0.001, 0.5, 1.0])), (0.1 - 0.001) + 0.1 + (1.0 - 0.9))
    assert genotype.bias_of(np.array([0.0, 0.5, 1.1]), np.array([0.001, 0.5, 1.0])) < 0  # outer means that move outwards
    assert math.isclose(genotype.bias_of(np.array([0.0, 0.7]), np.array([0.001, 0.5])), 0.201)
    rng = random.Random(3)
    for k in (1, 2, 3):
        mean, var = [rng.random() for _ in range(k)], [rng.choice([1e-3, 0.002, 0.05]) for _ in range(k)]
        xs = [rng.random() for _ in range(50)] + [0.0, 1.0]
        got = genotype.phred_likelihoods(genotype._log_density(np.array(xs), np.array(mean), np.array(var)))
        for x, row in zip(xs, got.tolist(), strict=True):
            density = [math.exp(-0.5 * (math.log(2 * math.pi * v) + (x - m) ** 2 / v)) for m, v in zip(mean, var, strict=True)]
            total = sum(d / k for d in density)
            for d, p in zip(density, row, strict=True):
                post = d / k / total if total else 0.0
                if total > 1e-290 and 0 < post and d > 1e-290:
                    assert abs(p - int(-10 * math.log10(total * post * k) + 0.5)) <= 1  # a rounding apart at most
    # a posterior of zero counts as nearly one: the sample's likelihood over the weight
    assert genotype.phred_likelihoods(np.array([[-800.0, -1.0]])).tolist() == [[int(10 / math.log(10) + 0.5)] * 2]


def test_pairs_of_similar_lengths_are_aligned_together():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ACGTNa") for _ in range(rng.randint(0, 40))) for _ in range(240)]
    a, b = texts[:120], [x[: len(x) // 3] + y[: len(y) // 4] + x[len(x) // 2 :] for x, y in zip(texts[:120], texts[120:], strict=True)]
    b = [align.turned(s) if k % 3 == 0 else s for k, s in enumerate(b)]
    groups = list(align.similar(a, b))
    assert sorted(k for g in groups for k in g) == list(range(120)) and len(groups) < 60
    assert len(list(align.similar(["A" * (50 + k % 9) for k in range(900)], ["A" * (49 + k % 11) for k in range(900)]))) < 20
    for sc in (align.Scores(1, -2, -2, -1), align.Scores()):
        fields, there, strand = align.excised_table(a, b, sc, both=True)
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            one = align.excised([x], [y], sc, both=True, columns=True)[0]  # traced and reported by itself
            assert there[k] == (one is not None)
            if one:
                assert {f: int(fields[f][k]) for f in align.FIELDS} == {f: one[f] for f in align.FIELDS} and strand[k] == one["strand"]

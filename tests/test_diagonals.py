"""The recurrence by anti-diagonals, for the pairs of a group together."""

from __future__ import annotations

import random

import numpy as np
import pytest

from varloom.operators import align


def _pairs(letters: str, size: int, count: int) -> tuple[list[str], list[str]]:
    rng = random.Random(len(letters) * size)
    a = ["".join(rng.choices(letters, k=size - rng.randint(0, 4))) for _ in range(count)]
    return a, [s[: size // 3] + s[size // 2 :] if n % 2 else s[: size // 3] + "ACGTTTGAACG" + s[size // 3 :] for n, s in enumerate(a)]


@pytest.mark.parametrize("sc", [(1, -1, -10, -1), (1, -2, -2, -1), (1, -1, -1, -2), (1, 0, -1, -1), (70, -80, -90, -5)])
def test_tables_and_records_are_those_of_the_plain_recurrence(sc):
    sc = align.Scores(*sc)
    a, b = _pairs("ACGTN", 40, 9)
    x, y = align._lanes(a), align._lanes(b)
    records = align.Records()
    score, top = align.lane_tables(x, y, sc, records=records)
    want = align.tables(x.T, y.T, sc)
    best = align._best_prefix(want)
    assert (score == want.transpose(1, 2, 0)).all() and (top == best.transpose(1, 2, 0)).all()
    found = sorted(zip(records.lane.tolist(), records.row.tolist(), records.col.tolist(), records.value.tolist()))
    lane, row, col = np.nonzero((want == best) & (want > 0))
    assert found == sorted(zip(lane.tolist(), row.tolist(), col.tolist(), want[lane, row, col].tolist()))


def test_groups_with_too_many_records_do_without(monkeypatch):
    sc = align.Scores(1, -1, -3, -1)
    a, b = _pairs("AAAAC", 50, 12)
    kept = [align.excised(a, b, sc, True, True, columns) for columns in (False, True)]
    monkeypatch.setattr(align, "MOST_RECORDS", -10)
    assert not align.Swept(a, b, sc, True).records.whole
    assert [align.excised(a, b, sc, True, True, columns) for columns in (False, True)] == kept


def test_long_pairs_go_through_the_recurrence_together():
    a, b = ["A" * 1000] * 10, ["A" * 780] * 10
    assert [len(g) for g in align.similar(a, b)] == [10]

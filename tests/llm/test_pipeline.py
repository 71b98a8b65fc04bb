"""Every stage of the corpus pipeline against brute force on the smallest driver table."""

from __future__ import annotations

import collections
import re
from pathlib import Path

import pytest

from tests.llm.test_operators import SPACES, WORD, ascii_lower, edit_distance

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")


def base_failed(t: str) -> bool:
    w = re.findall(SPACES, t)
    windows = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
    n = collections.Counter(windows)
    again = {p for j, x in enumerate(windows) if n[x] > 1 for p in range(j, j + 5)}
    return len(w) < 10 or 100 * len(again) > 20 * len(w)


def without_lines(rows: list[tuple[int, str]]) -> dict[int, str]:
    seen: dict[int, list[tuple[str, collections.Counter]]] = collections.defaultdict(list)
    out = {}
    for i, t in rows:
        kept, gone = [], False
        for x in t.split("\n"):
            if len(x) >= 24:
                c = collections.Counter(x)
                near = any(x == y or sum(((c - d) + (d - c)).values()) <= 4 and edit_distance(x, y) <= 2 for k in range(-2, 3) for y, d in seen[len(x) + k])
                seen[len(x)].append((x, c))
                if near:
                    gone = True
                    continue
            kept.append(x)
        t = "\n".join(kept)
        if not gone or re.search(SPACES, t):
            out[i] = t
    return out


def representatives(rows: dict[int, str]) -> set[int]:
    sets = {}
    for i, t in rows.items():
        w = re.findall(SPACES, ascii_lower(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def find(i):
        return i if up[i] == i else find(up[i])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i for i in sets if find(i) == i}


def test_stages_match_brute_force(spark):
    import corpus_pipeline as pipeline
    from varloom.llm._common import written

    tokenizers = pytest.importorskip("tokenizers")
    names = pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = []
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        got.append(docs.collect())
        assert name == "bpe" or docs.columns == columns

    rows = [(i, t) for i, t in rows if not base_failed(t)]  # too few labels for a cutoff
    assert {r.doc_id for r in got[0]} == {i for i, _ in rows}
    texts = without_lines(rows)
    assert {r.doc_id: r.text for r in got[1]} == texts
    assert all(r.n_chars == len(r.text) for r in got[1] if r.text != dict(rows)[r.doc_id])
    keep = representatives(texts)
    assert {r.doc_id for r in got[2]} == keep
    windows = {tuple(w[i : i + 13]) for t in bench for w in [re.findall(WORD, ascii_lower(t))] for i in range(max(1, len(w) - 12)) if w}

    def dirty(t: str) -> bool:
        w = re.findall(WORD, ascii_lower(t))
        hit = {p for n in {len(x) for x in windows} for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in windows for p in range(s, s + n)}
        return bool(hit) and 20 * len(hit) >= len(w)

    keep = {i for i in keep if not dirty(texts[i])}
    assert {r.doc_id for r in got[3]} == keep
    own = tokenizers.Tokenizer.from_file(names.path("word_bpe_49k.json"))
    own.no_truncation()
    own.no_padding()
    assert {r.doc_id: (r.ids, r.n_tokens) for r in got[4]} == {i: ((x := own.encode(texts[i], add_special_tokens=False).ids), len(x)) for i in keep}


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, ties, columns with names the stages use, empty tables."""
    import corpus_pipeline as pipeline

    words = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    line = "a line that is long enough to be counted here " + " ".join(f"u{i}" for i in range(12))
    rows = [(None, words), (1, words + " end"), (2, other), (2, other), (3, None), (4, ""), (5, line + "\n" + " ".join(f"x{i}" for i in range(30))), (6, line + "\n" + " ".join(f"y{i}" for i in range(30))), (None, " ".join(f"z{i}" for i in range(30)))]
    names = ["_d", "_h", "_x", "_y", "_l", "_row", "_carried", "carried", "kept", "removed", "component", "n", "a.b"]
    docs = spark.createDataFrame([(i, t, "en" if k % 2 else None, None, len(t or ""), *[k] * len(names)) for k, (i, t) in enumerate(rows)], f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'`{n}` int' for n in names)}")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("a", " ".join(f"z{i}" for i in range(20))), (None, None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = [
        [r for r in rows if r[1]],
        [(i, t if i != 6 else t.split("\n")[1]) for i, t in rows],
        [r for r in rows if r[0] != 1],
        [r for r in rows if not (r[1] or "").startswith("z0")],
        rows,
    ]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    for (name, stage), kept in zip(pipeline.STAGES, want, strict=True):
        out = stage(spark, docs, str(tmp_path))
        if name == "bpe":
            assert sorted(out.columns) == ["doc_id", "ids", "n_tokens"] and out.count() == len(rows)
        else:
            assert out.columns == docs.columns, name
            got = out.collect()
            text = lambda t: t or "" if name == "line_dedup" else t  # noqa: E731, B023
            assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(((i, text(t)) for i, t in kept), key=key), name
            assert all(len({r[n] for n in names}) == 1 for r in got)  # nothing of the stage's own came out under their names
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_quality_stage_with_certified_cutoffs(spark, tmp_path):
    """Enough labels for a cutoff: what is over it goes too, by exact binomial tails of the labelled good documents."""
    import random
    from math import comb

    import corpus_pipeline as pipeline
    from varloom.llm.quality_rules import GRID

    rng = random.Random(31)
    rows, labels = [], []
    for i in range(3000):
        good = i % 3 > 0
        w = [f"w{rng.randrange(10_000)}" for _ in range(30)]
        for _ in range(rng.choice([0, 0, 1]) if good else rng.randrange(0, 60)):
            w[rng.randrange(30)] += "#"
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(good), 0))
    rows.append((5000, " ".join(f"x{i}##" for i in range(30)), "de", "s", 0))  # no labels in its language
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r.doc_id for r in pipeline.quality(spark, docs, str(tmp_path)).collect()}
    rate = {i: t.count("#") / len(t.replace(" ", "")) for i, t, *_ in rows}
    tests, share = sum(map(len, GRID.values())), 0.02 / len(GRID)  # one stratum has labelled good documents
    good = [rate[i] for i, y, _ in labels if y]
    cut = None
    for c in reversed(GRID["symbol_rate"]):
        k, n = sum(x > c for x in good), len(good)
        if k < n * share and sum(comb(n, j) * share**j * (1 - share) ** (n - j) for j in range(k + 1)) <= 0.05 / tests:
            cut = c
    assert cut is not None
    want = {i for i, *_ in rows if i == 5000 or rate[i] <= cut}
    assert kept == want and 50 < len(rows) - len(kept) < 1000

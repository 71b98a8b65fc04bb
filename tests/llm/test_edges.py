"""Edge cases of all ten operators, and plain twins of what SQL can't express."""

from __future__ import annotations

import random
import re

import pytest

from pyspark.sql import functions as F

from tests.llm.test_operators import SPACES, ascii_lower, removed_by_windows

#: Column names that the operators use inside; documents may have them too.
CLASHING = ["_d", "_h", "x", "n", "k", "i", "lang", "source", "found", "kept", "spans", "score", "held_out", "_y", "_carried", "component", "ids", "term", "words", "frequency"]


def operators() -> dict:
    from varloom.llm.bpe import bpe_decode, bpe_encode
    from varloom.llm.decontaminate import decontaminate
    from varloom.llm.line_dedup import line_dedup
    from varloom.llm.ngram_join import ngram_jaccard_join
    from varloom.llm.quality_classifier import quality_classifier
    from varloom.llm.quality_rules import quality_rules
    from varloom.llm.secret_scan import secret_scan
    from varloom.llm.substring_dedup import substring_dedup
    from varloom.llm.suffix_dedup import suffix_dedup
    from varloom.llm.toxicity import toxicity

    bench = lambda d: d.sparkSession.createDataFrame([("a", "one two three"), (None, "four five"), ("e", None)], "item_id string, text string")
    labels = lambda d: d.sparkSession.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return {
        "decontaminate": lambda d: decontaminate(d, bench(d)), "suffix_dedup": suffix_dedup, "quality_classifier": lambda d: quality_classifier(d, labels(d)),
        "quality_rules": lambda d: quality_rules(d, labels(d)), "secret_scan": secret_scan, "toxicity": lambda d: toxicity(d, labels(d)), "line_dedup": line_dedup,
        "substring_dedup": substring_dedup, "ngram_join": ngram_jaccard_join, "bpe": lambda d: bpe_decode(bpe_encode(d)),
    }


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(None, "one two three four five"), (None, None), (1, ""), (2, "one two three"), (2, "one two three"), (3, " \n\t"), (4, "a line that is long enough to count here\n" * 3), (5, "\x00\x1f é 漢 ퟿ 😀")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return d.withColumns({c: F.lit("en" if c == "lang" else "s") for c in CLASHING})


@pytest.mark.parametrize("name", ["decontaminate", "suffix_dedup", "quality_classifier", "quality_rules", "secret_scan", "toxicity", "line_dedup", "substring_dedup", "ngram_join", "bpe"])
def test_null_ids_repeated_rows_and_clashing_columns(odd, name):
    op = operators()[name]
    with_more = op(odd)
    keep = [c for c in with_more.columns if c not in CLASHING or name != "quality_rules"]
    more = sorted(map(str, with_more.select(*keep).collect()))
    plain = sorted(map(str, op(odd.select("doc_id", "text", "lang", "source")).select(*keep).collect()))
    assert more == plain and len(plain) == odd.count()
    assert len([r for r in plain if "doc_id=None" in r]) == 2
    assert len({r for r in plain if "doc_id=2," in r}) == 1 and len([r for r in plain if "doc_id=2," in r]) == 2
    assert op(odd.where("false")).count() == 0


def test_ngram_join_of_null_ids(odd):
    from varloom.llm.ngram_join import ngram_jaccard_join

    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_jaccard_join(odd).collect()}
    assert (None, 2, None) in got and (None, 0, None) in got and (2, 1, 2) in got


def test_texts_longer_than_a_chunk(spark):
    """A text of over a MiB with repeats inside and outside, some over the border between chunks."""
    from varloom.llm._common import CHUNK
    from varloom.llm.bpe import bpe_decode, bpe_encode
    from varloom.llm.decontaminate import decontaminate
    from varloom.llm.ngram_join import ngram_jaccard_join
    from varloom.llm.quality_rules import measured
    from varloom.llm.substring_dedup import substring_dedup
    from varloom.llm.suffix_dedup import suffix_dedup
    from varloom.llm.toxicity import Machine

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    words = [word() for _ in range(190_000)]
    shared = words[100:160]
    at = next(i for i in range(len(words)) if sum(len(w) + 1 for w in words[: 150_000 + i]) > CHUNK - 100) + 150_000
    words[at : at + 60] = shared
    long = " ".join(words)
    assert len(long) > CHUNK + 1000
    near = " ".join([*words[:-30], "another", "end"])
    rows = [(1, " ".join(shared)), (2, long), (3, near), (4, " ".join(words[-200:-100]))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(d).collect()}
    seen: set[bytes] = set()
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(w)
        assert got[i][:3] == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone)))), i
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(d).collect()} == {i: (n, m, h) for i, (n, m, _, h) in removed_by_windows(rows, 20, True).items()}
    joined = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard_join(d).collect()}
    sets = {i: len({tuple(w[j : j + 4]) for j in range(len(w) - 3)}) for i, t in rows for w in [re.findall(SPACES, ascii_lower(t))]}
    assert joined == {i: (n, 2 if i == 3 else i) for i, n in sets.items()}
    bench = spark.createDataFrame([("b", " ".join(words[at + 10 : at + 40]))], "item_id string, text string")
    assert {r.doc_id: (r.n_hit, r.item_ids) for r in decontaminate(d, bench).collect()} == {1: (30, ["b"]), 2: (60, ["b"]), 3: (60, ["b"]), 4: (0, [])}
    assert {r.doc_id: r.n_words for r in measured(d).collect()} == {i: len(t.split()) for i, t in rows}
    assert bpe_decode(bpe_encode(d)).where("size(ids) < 100").count() == 0
    assert Machine({"idiot": 5.0}).channels(long.replace("dice", "dire") + " idiot")[-1] == 5.0  # dice would report it


def plain_channels(tokens: list[str], weight: dict[str, float], reach: int = 3) -> list[float]:
    """Clause by clause, word by word: what each insult or threat is, from the words before it."""
    from varloom.llm import toxicity as op

    out = [0.0] * op.CHANNELS
    clauses: list[list[str]] = [[]]
    for t in tokens:
        clauses.append([]) if t in ".!?;\n" else clauses[-1].append(t)
    for c in clauses:
        best = dict.fromkeys(op.COUNTED, 0.0)
        for i, w in enumerate(c):
            w = w.lower()
            insult = weight.get(w, 0.0)
            if not insult and w not in op.THREAT:
                continue
            before = [x.lower() for x in c[:i]]
            marks = [x for x in before if not weight.get(x)]
            if any(x in op.REPORT for x in marks):
                z, v = op.QUOTED, insult or 1.0
            elif any(x in op.NEGATION and not weight.get(x) for x in before[-reach:]):
                z, v = op.DENIED, insult or 1.0
            elif any(x in op.TARGET for x in marks):
                z, v = (op.AIMED, insult) if insult else (op.THREATENED, 1.0)
            else:
                z, v = (op.INSULT, insult) if insult else (op.THREATEN, 0.25)
            best[z] = max(best[z], v)
        for k, z in enumerate(op.COUNTED):
            out[k] += best[z]
        out[-1] = max(out[-1], best[op.INSULT], best[op.AIMED])
    return out


def test_grammar_matches_plain_clauses():
    from varloom.llm import toxicity as op

    rng = random.Random(21)
    weight = {"idiot": 4.0, "moron": 2.5, "them": 1.5}
    machine = op.Machine(weight)
    words = ["idiot", "moron", "them", "you", "not", "never", "said", "kill", "hurt", "a", "house", "Green", ".", "!", "\n"]
    for _ in range(1500):
        tokens = rng.choices(words, k=rng.randint(0, 25))
        assert machine.channels(" ".join(tokens)) == pytest.approx(plain_channels(tokens, weight)), tokens


def test_composed_transducers_equal_a_chain_of_them():
    from varloom.llm import toxicity as op

    rng = random.Random(22)
    parts = [op.reported(), op.negated(), op.targeted(), op.threatening()]
    whole = op.grammar()
    assert len(whole) == 2 * 4 * 2  # target and threat transducers always stand in the same state
    for _ in range(500):
        states, q = [0] * len(parts), 0
        for x in rng.choices(op.SYMBOLS, k=20):
            q, z, w = whole[q][x]
            y, v = x, 1.0
            for k, part in enumerate(parts):
                states[k], y, one = part[states[k]][y]
                v *= one
            assert (z, w) == (y, v)


def test_boosted_trees_match_plain_loops():
    import numpy as np

    from varloom.llm.quality_classifier import fit

    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(120, 3)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(float)
    trees, depth, rate, bins = 4, 2, 0.3, 8
    forest = fit(x, y, trees=trees, depth=depth, rate=rate, bins=bins)
    p = y.mean()
    margin = np.full(len(y), np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(3)]
    total = margin.copy()
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-total))
        grad, hess = prob - y, prob * (1 - prob)
        groups = [np.arange(len(y))]
        for _ in range(depth):
            new = []
            for g in groups:
                best = None
                for j in range(3):
                    for c in edges[j]:
                        low, high = [i for i in g if x[i, j] <= c], [i for i in g if x[i, j] > c]
                        if min(sum(hess[low]), sum(hess[high])) < 1.0:
                            continue
                        gain = sum(grad[low]) ** 2 / (sum(hess[low]) + 1) + sum(grad[high]) ** 2 / (sum(hess[high]) + 1) - sum(grad[g]) ** 2 / (sum(hess[g]) + 1)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = gain, low, high
                new += [np.array(best[1], int), np.array(best[2], int)] if best else [g, np.zeros(0, int)]
            groups = new
        for g in groups:
            if len(g):
                total[g] += -rate * grad[g].sum() / (hess[g].sum() + 1)
    assert np.allclose(forest.margin(x), total)
    walked = []
    for row in x:  # the flattened arrays, one node at a time
        m = forest.base
        for t in range(trees):
            at = 0
            for _ in range(depth):
                at = 2 * at + 1 + int(row[forest.feature[t, at]] > forest.cut[t, at])
            m += forest.value[t, at - (2**depth - 1)]
        walked.append(m)
    assert np.allclose(forest.margin(x), walked)


@pytest.mark.parametrize("hubs", [10_000, 3])
def test_components(spark, monkeypatch, hubs):
    from varloom.llm import components as op

    monkeypatch.setattr(op, "MOST_HUBS", hubs)
    rng = random.Random(hubs)
    links = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (500, 100)]
    up = {x: x for pair in links for x in pair}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in op.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if x not in alone}

"""The corpus operators against brute force, on small tables with edge cases."""

from __future__ import annotations

import collections
import hashlib
import json
import random
import re

import pytest

from pyspark.sql import functions as F

SPACES = "[^\x20\x09-\x0d]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def ascii_lower(t: str) -> str:
    return re.sub("[A-Z]+", lambda m: m.group().lower(), t)


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def corpus() -> list[tuple[int | None, str | None]]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "ter", "ló", "st", "ou"]) for _ in range(rng.randint(1, 3)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = line(60)
    texts = [None, "", " \n\t", "word", "a a a a a a a a a a a a", "x" * 700, line(20) + "\n" + shared, shared + " " + line(9)]
    texts += [line(rng.randint(5, 120)) + "\n" + line(30) for _ in range(30)]
    texts += [texts[8], texts[8]]
    for k in range(12):  # near copies
        w = texts[9].split(" ")
        w[rng.randrange(len(w))] = f"edit{k % 5}"
        texts.append(" ".join(w))
    texts.append("\n".join(["one line that is rather long here", "one line that is rather lang here", "other", "one line that is rather long here"]))
    texts += [f"{shared}\n{shared}", ("ab " * 200).strip(), "İÄß Σ <|endoftext|> 漢字 😀"]
    return [(i * 5, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}", None if t is None else len(t), 1, 2) for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, a int, k int").repartition(3)


def removed_by_windows(corpus, k: int, words: bool) -> dict:
    seen: set = set()
    out = {}
    for i, t in sorted(corpus):
        b = (t or "").encode()
        s = b.split() if words else b
        gone = bytearray(len(s))
        for p in range(len(s) - k + 1):
            w = tuple(s[p : p + k])
            if w in seen:
                gone[p : p + k] = b"\1" * k
            seen.add(w)
        kept = [x for x, g in zip(s, gone, strict=True) if not g]
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(s), sum(gone), runs, sha(b" ".join(kept) if words else bytes(kept)))
    return out


@pytest.mark.parametrize("most_rows", [20_000, 1])
def test_suffix_dedup(docs, corpus, most_rows, monkeypatch):
    from varloom.llm import repeats
    from varloom.llm.suffix_dedup import suffix_dedup

    monkeypatch.setattr(repeats, "MOST_ROWS", most_rows)  # 1: everything the way of very frequent anchors
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(docs).collect()}
    assert got == removed_by_windows(corpus, 100, False)


@pytest.mark.parametrize("most_rows", [20_000, 1])
def test_substring_dedup(docs, corpus, most_rows, monkeypatch):
    from varloom.llm import repeats
    from varloom.llm.substring_dedup import substring_dedup

    monkeypatch.setattr(repeats, "MOST_ROWS", most_rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(docs).collect()}
    assert got == {i: (n, m, h) for i, (n, m, _, h) in removed_by_windows(corpus, 20, True).items()}


@pytest.mark.parametrize("n", [2, 5, 16, 17, 90])
def test_resolvers_find_every_repeated_window(n):
    from varloom.llm.substring_dedup import factor_spans
    from varloom.llm.suffix_dedup import group_spans

    rng, k = random.Random(n), 8

    def covered(spans) -> set:
        return {(i, p) for i, x in enumerate(spans) for a, b in x for p in range(-a, b)}

    for _ in range(60):
        side = lambda most: bytes(rng.choice(b"ab" if rng.random() < 0.9 else b"abc") for _ in range(rng.randint(0, most)))
        pairs = list(dict.fromkeys((side(5), b"xyz" + side(5)) for _ in range(n)))
        seen, want = set(), set()
        for i, (left, right) in enumerate(pairs):
            own = {(d, (left[len(left) - d :] + right)[:k]) for d in range(len(left) + 1) if d + len(right) >= k}
            want |= {(i, p) for d, _ in own & seen for p in range(-d, k - d)}
            seen |= own
        lefts, rights = zip(*pairs, strict=True)
        assert covered(group_spans([([b"x"], [b"y"]), (list(lefts), list(rights))], k)[1]) == want
        words = lambda xs: [[bytes([c]) for c in x] for x in xs]
        assert covered(factor_spans(words(lefts), words(rights), k)) == want


@pytest.mark.parametrize("k", [20, 263])
def test_substring_dedup_of_repetitive_texts(spark, k):
    from varloom.llm.substring_dedup import substring_dedup

    rows = []
    for n in (261, 262, 263, 264, 265):
        half = [f"w{n}x{i}" for i in range(n // 2)]
        rows += [(n, " ".join(half + half + ["end"] * (n % 2))), (n + 1000, "again " * n)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), k).collect()}
    assert got == {i: (n, m, h) for i, (n, m, _, h) in removed_by_windows(rows, k, True).items()}


def test_repeated_rows_are_one_document(docs):
    from varloom.llm.suffix_dedup import suffix_dedup

    once = {(r.doc_id, r.kept_sha256) for r in suffix_dedup(docs).collect()}
    twice = suffix_dedup(docs.union(docs)).collect()
    assert len(twice) == 2 * docs.count() and {(r.doc_id, r.kept_sha256) for r in twice} == once


def test_decontaminate(spark, docs, corpus):
    from varloom.llm.decontaminate import decontaminate

    own = [t for _, t in corpus if t]
    items = [("b2", " ".join(own[6].split()[3:25])), ("a1", "word"), ("c", own[9].upper()), ("d", None), ("e", ""), ("c", own[9].upper()), (None, own[10]), ("z", "never seen words at all")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    windows = collections.defaultdict(set)
    for item, t in items:
        w = re.findall(WORD, ascii_lower(t or ""))
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])] |= {item} - {None}
    want = {}
    for i, t in corpus:
        w = re.findall(WORD, ascii_lower(t or ""))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (x := tuple(w[p : p + n])) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[x]
        want[i] = (len(w), len(hit), sorted(found))
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontaminate(docs, bench).collect()}
    assert got == want and sum(bool(x[1]) for x in want.values()) > 3


def test_decontaminate_in_blocks_and_proximity(spark, docs, monkeypatch):
    from varloom.llm import decontaminate as op

    bench = docs.where("length(text) > 300").selectExpr("cast(doc_id as string) item_id", "text").limit(4)
    whole = sorted(map(str, op.decontaminate(docs, bench).select("doc_id", "n_hit", "item_ids").collect()))
    monkeypatch.setattr(op, "MOST_WINDOWS", 40)
    assert sorted(map(str, op.decontaminate(docs, bench).select("doc_id", "n_hit", "item_ids").collect())) == whole
    d = spark.createDataFrame([(1, "alpha zzz beta gamma"), (2, "gamma beta alpha"), (3, "alpha beta")], "doc_id long, text string")
    b = spark.createDataFrame([("i", "alpha beta gamma")], "item_id string, text string")
    assert {r["_d"] for r in op.positional_matches(d, b, 3, slop=1)[1].collect()} == {1, 2}
    assert not op.positional_matches(d, b, 3)[1].collect()


def test_proximity_matches(spark):
    from varloom.llm.decontaminate import positional_matches

    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 30))) for _ in range(60)]
    items = [("x", "a b b c"), ("y", "h g f")]
    got = {(r["_d"], r.item_id) for r in positional_matches(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), 13, slop=2)[1].collect()}
    want = set()
    for i, t in enumerate(texts):
        for k, x in items:
            need, w = collections.Counter(x.split()), t.split()
            if any(not need - collections.Counter(w[s : s + need.total() + 2]) for s in range(len(w))):
                want.add((i, k))
    assert got == want and 10 < len(want) < 110


def test_quality_rules_base(docs, corpus):
    from varloom.llm.quality_rules import measured

    got = {r.doc_id: r for r in measured(docs).collect()}
    for i, t in corpus:
        w = re.findall(SPACES, t or "")
        windows = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        n = collections.Counter(windows)
        again = {p for j, x in enumerate(windows) if n[x] > 1 for p in range(j, j + 5)}
        lines = [x for x in (t or "").split("\n") if re.search(SPACES, x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))


def test_certified_cutoffs(spark):
    from math import comb

    from varloom.llm.quality_rules import GRID, certified

    rng = random.Random(2)
    rows = [("en", rng.random() * 0.06, 0.0, 0.0, 0.0) for _ in range(4000)] + [("de", 0.01, 0.0, 0.0, 0.0) for _ in range(20)] + [(None, 0.0, 0.0, 0.0, 0.0)]
    got = {r["_stratum"]: r for r in certified(spark.createDataFrame(rows, f"lang string, {', '.join(f'{g} double' for g in GRID)}"), "lang", 0.2, 0.05).collect()}
    tests = 3 * sum(map(len, GRID.values()))

    def cut(n: int, rates: list[float], grid: list[float], p: float = 0.05):
        for c in grid:
            k = sum(x > c for x in rates)
            if k < n * p and sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) <= 0.05 / tests:
                return c
        return None

    en = [x[1] for x in rows if x[0] == "en"]
    assert got["en"].cut_symbol_rate == cut(len(en), en, GRID["symbol_rate"]) == 0.1
    assert got["de"].cut_symbol_rate is None and got[""].cut_symbol_rate is None  # too few labels


def test_secret_scan(spark):
    from varloom.llm.secret_scan import KINDS, secret_scan

    live = "Xk3Lm9Qw7Rt5Yz1Ab2Cd4Ef6"
    rows = [(i, f"pass word password = 'abcdefghijklmn' token:short{'é' * i} AKIA{'Z' * 14} deadbeefdeadbeef0", f"o{i}") for i in range(4)]
    rows += [(9, f"key {live} end", "o1"), (10, None, None), (11, "", "o1"), (12, "Token==abcdefghijkl Secret=password:abcdefghijklmnop", "o2"), (12, "Token==abcdefghijkl Secret=password:abcdefghijklmnop", "o2")]
    got = collections.defaultdict(list)
    for r in secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        got[r.doc_id].append(r.found)
    pattern = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t, _ in rows:
        want = [(m.start(), 0, m.end()) for m in pattern.finditer(t or "") if len(m[2]) >= 12]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 18]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 16]
        for found in got[i]:
            assert [(x.s, x.k, x.e) for x in found if x.k < 3] == sorted(want)
    assert not any(x.live for x in got[0][0] if x.k == 1)  # four owners: an example
    assert [(KINDS[x.k], x.v, x.live) for x in got[9][0]] == [("token", live, True)]
    assert len(got[12]) == 2


def test_secret_scan_of_many_matches_and_hot_values(spark, monkeypatch):
    from varloom.llm import secret_scan as op

    monkeypatch.setattr(op, "BLOCK", 3)
    monkeypatch.setattr(op, "MOST_HOT", 4)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice([" ", "é", "deadbeef" * 2 + "f" * rng.randint(0, 4) + " ", "zz AKIA" + "Q" * rng.randint(10, 16) + "! ", "0123456 "]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 40)) + ("cafebabecafebabe" if i % 2 else ""), f"o{i % 5}") for i in range(40)]
    got = {r.doc_id: r.found for r in op.secret_scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    owners = collections.defaultdict(set)
    want = {}
    for i, t, o in rows:
        found = [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]{16,}", t)]
        want[i] = sorted(found)
        for x in found:
            owners[x[3]].add(o)
    assert {i: [(x.s, x.k, x.e, x.v) for x in f] for i, f in got.items()} == want
    assert all(x.owners == len(owners[x.v]) and x.live == (len(owners[x.v]) <= 2) for f in got.values() for x in f)


def test_line_dedup(spark, docs, corpus):
    from varloom.llm.line_dedup import line_dedup

    got = {r.doc_id: (r.n_lines, r.removed, r.kept) for r in line_dedup(docs).collect()}
    seen: list[str] = []
    for i, t in sorted(corpus):
        own = (t or "").split("\n")
        gone = []
        for j, x in enumerate(own):
            if len(x) >= 24:
                if any(abs(len(x) - len(y)) <= 2 and (x == y or edit_distance(x, y) <= 2) for y in seen):
                    gone.append(j)
                seen.append(x)
        assert got[i] == (len(own) if t else 0, gone, "\n".join(x for j, x in enumerate(own) if j not in gone)), i


def test_banded_distance(spark):
    from varloom.llm.line_dedup import within

    rng = random.Random(3)
    rows = []
    for _ in range(400):
        a = [rng.choice("ab") for _ in range(rng.randint(6, 20))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            p = rng.randrange(len(b))
            b[p : p + 1] = rng.choice([[], [rng.choice("ab")], [b[p], rng.choice("ab")]]) if len(b) > 6 else [b[p], "a"]
        a, b = sorted(("".join(a), "".join(b)), key=len)
        if len(b) - len(a) <= 2:
            rows.append((a, b))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", *[within(F.col("a"), F.col("b"), k).alias(f"w{k}") for k in (2,)]).collect()
    assert len(got) > 200 and all(r.w2 == (edit_distance(r.a, r.b) <= 2) for r in got)


@pytest.mark.parametrize(("most_sets", "most_shingles", "frequent"), [(5000, 2_000_000, 64), (4, 2_000_000, 64), (5000, 400, 64), (5000, 2_000_000, 2)])
def test_ngram_join(docs, corpus, most_sets, most_shingles, frequent, monkeypatch):
    from varloom.llm import ngram_join as op

    monkeypatch.setattr(op, "FREQUENT", frequent)
    monkeypatch.setattr(op, "MOST_SETS", most_sets)
    monkeypatch.setattr(op, "MOST_SHINGLES", most_shingles)
    sets = {}
    for i, t in corpus:
        w = re.findall(SPACES, ascii_lower(t or ""))
        sets[i] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
    up = {i: i for i in sets}

    def find(i):
        return i if up[i] == i else find(up[i])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    want = {i: (len(s), find(i)) for i, s in sets.items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op.ngram_jaccard_join(docs).collect()} == want
    assert len({c for _, c in want.values()}) < len(want) - 5


@pytest.mark.parametrize("percent", [80, 85])
def test_ngram_keys_of_every_linkable_size(percent):
    import numpy as np

    from varloom.llm.ngram_join import group_keys, key_classes

    classes = [range(0)] + [key_classes(n, percent) for n in range(1, 3001)]
    for n in range(1, 3001):  # the larger set's own class is one that both give keys of
        assert all(classes[m][0] in classes[n] for m in range(n, min(3000, 100 * n // percent) + 1)), n
    rng = np.random.default_rng(3)
    for n in [*range(1, 120), 131, 251, 295, 347, 783, 1275, 1972, 2465]:
        m = 100 * n // percent
        x = rng.integers(1, 2**63, m).astype(np.uint64)
        assert np.intersect1d(group_keys(np.sort(x), percent)[0], group_keys(np.sort(x[:n]), percent)[0]).size, (n, m)


@pytest.mark.parametrize("n", [1, 2, 33, 700])
def test_count_vector_tree(n):
    import numpy as np

    from varloom.llm.ngram_join import LEAF, CountTree, points, rtree_links

    rng = np.random.default_rng(n)
    base = [rng.integers(0, 2**63, int(rng.integers(5, 60))).astype(np.uint64) for _ in range(max(1, n // 6))]
    sets = []
    for _ in range(n):
        x = base[rng.integers(len(base))].copy()
        x[: rng.integers(0, max(1, len(x) // 5))] = rng.integers(0, 2**63)
        sets.append(np.unique(x))
    up = list(range(n))

    def find(i):
        return i if up[i] == i else find(up[i])

    linked = set()
    for i in range(n):
        for j in range(i + 1, n):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                linked.add((i, j))
                x, y = sorted((find(i), find(j)))
                up[y] = x
    want, up = [find(i) for i in range(n)], list(range(n))
    for i, j in rtree_links(sets, 85, 100):
        x, y = sorted((find(i), find(j)))
        up[y] = x
    assert [find(i) for i in range(n)] == want
    tree = CountTree(points(sets), np.array([len(x) for x in sets]))
    leaf = {int(i): a for a in range(len(tree.levels[0][1])) for i in tree.leaf(a)}
    near = {tuple(x) for x in tree.near_leaves(85, 100).tolist()}
    assert all(tuple(sorted((leaf[i], leaf[j]))) in near for i, j in linked)  # no link is lost on the way down
    if n > 20 * LEAF:
        assert len(tree.levels) == 3 and len(near) < len(tree.levels[0][1]) ** 2 / 2


@pytest.mark.parametrize("percent", [80, 85])
def test_finer_vectors_rule_out_no_link(percent):
    import numpy as np

    from varloom.llm.ngram_join import may_be_linked, packed, unpacked

    rng = np.random.default_rng(percent)
    for _ in range(40):
        base = np.unique(rng.integers(0, 2**63, int(rng.integers(4, 3000))).astype(np.uint64))
        sets = []
        for _ in range(int(rng.integers(2, 50))):
            x = base[rng.random(len(base)) > rng.choice([0, 0.05, 0.1, 0.2])]
            more = rng.integers(0, 2**63, int(rng.integers(0, 1 + len(base) // 6))).astype(np.uint64)
            sets.append(np.unique(np.concatenate([x if len(x) else base, more])))
        size = np.array([len(x) for x in sets])
        vectors = [unpacked(packed(x, percent), len(x), percent) for x in sets]
        assert all(v.sum() == n for v, n in zip(vectors, size, strict=True))
        dims = min(map(len, vectors))
        point = np.stack([v.reshape(dims, -1).sum(1) for v in vectors])
        up = list(range(len(sets)))

        def find(i, up=up):
            return i if up[i] == i else find(up[i])

        for i, j in may_be_linked(point, size, percent, 100):
            up[find(i)] = find(j)
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= percent * (size[i] + size[j] - both):
                    assert find(i) == find(j)


def test_ngram_join_of_neighbouring_sizes(spark):
    from varloom.llm.ngram_join import ngram_jaccard_join

    rows = []
    for k, (n, m) in enumerate([(7, 8), (58, 68), (68, 80), (131, 154), (251, 295), (295, 347), (347, 408), (783, 921), (1275, 1500)] * 5):
        w = [f"w{k}x{i}" for i in range(m + 3)]  # m shingles of four words, of which the other has n
        rows += [(2 * k, " ".join(w[: n + 3])), (2 * k + 1, " ".join(w))]
    got = {r.doc_id: r.component_id for r in ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_bpe_round_trip(spark, docs, corpus):
    tokenizers = pytest.importorskip("tokenizers")
    names = pytest.importorskip("public_tokenizers")
    from varloom.llm.bpe import bpe_decode, bpe_encode

    path = names.path("word_bpe_49k.json")
    own = tokenizers.Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    got = {r.doc_id: (r.ids, r.decoded) for r in bpe_decode(bpe_encode(docs, path), path).collect()}
    for i, t in corpus:
        ids = own.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, own.decode(ids, skip_special_tokens=False)), i


def test_bpe_of_odd_texts(spark):
    """White space of every kind, marks to compose, special tokens, digits and long words, at a bound that forgets."""
    tokenizers = pytest.importorskip("tokenizers")
    names = pytest.importorskip("public_tokenizers")
    from varloom.llm import bpe

    rng = random.Random(11)
    parts = list(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0\u2003\u3000\u200b'.,!<>|0123") + ["the", "ing", "'s", "J\u030c", "a\u030a", "ΟΣ", "İ", "ß", "漢字", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "tokenizers", "QWERTY" * 30]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    own = tokenizers.Tokenizer.from_file(names.path("word_bpe_49k.json"))
    known = bpe.Known(json.loads(bpe.vocabulary()))
    for t in texts:
        pieces = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        got = dict(zip(dict.fromkeys(pieces), known.ids(list(dict.fromkeys(pieces))), strict=True))
        assert [i for x in pieces for i in got[x]] == own.encode(t, add_special_tokens=False).ids, t
    for a, b in zip(rng.choices(sorted(known.bpe.vocab), k=3000), rng.choices(sorted(known.bpe.vocab), k=3000), strict=True):
        if not a.endswith(known.bpe.end) and known.bpe.alone(a) and known.bpe.alone(b):
            assert known.bpe.agree(a, b) == (known.bpe.merge([*known.bpe.symbols(a), *known.bpe.symbols(b)]) == [a, b]), (a, b)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.ids for r in bpe.bpe_encode(rows).collect()} == {i: own.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert bpe.bpe_decode(bpe.bpe_encode(rows.where("false"))).count() == 0


def test_classifiers_on_planted_classes(spark):
    from varloom.llm.quality_classifier import quality_classifier
    from varloom.llm.toxicity import toxicity

    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(["house", "river", "stone", "walks", "green", "over"]) for _ in range(40)]
        if bad := i % 4 == 0:
            w[3::5] = ["###"] * len(w[3::5])
        if toxic := i % 5 == 0:
            w[rng.randrange(40)] = "grobla" + rng.choice(["n", "x", "y"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(1000, None), (1001, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    q = {r.doc_id: r for r in quality_classifier(d, y).collect()}
    t = {r.doc_id: r for r in toxicity(d, y).collect()}
    assert len(q) == len(t) == 602 and all(0 <= r.score <= 1 for r in (*q.values(), *t.values()))
    held = [x for x in labels if q[x[0]].held_out]
    assert 60 < len(held) < 180
    assert sum((q[i].score >= 0.3) == a for i, a, _ in held) > 0.95 * len(held)
    assert sum((t[i].score >= 0.5) == b for i, _, b in held) > 0.95 * len(held)


def test_empty_tables(spark, docs):
    from varloom.llm.decontaminate import decontaminate
    from varloom.llm.line_dedup import line_dedup
    from varloom.llm.ngram_join import ngram_jaccard_join
    from varloom.llm.quality_classifier import quality_classifier
    from varloom.llm.quality_rules import quality_rules
    from varloom.llm.secret_scan import secret_scan
    from varloom.llm.substring_dedup import substring_dedup
    from varloom.llm.suffix_dedup import suffix_dedup
    from varloom.llm.toxicity import toxicity

    none = docs.where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id string, text string")
    for out in (suffix_dedup(none), substring_dedup(none), line_dedup(none), ngram_jaccard_join(none), decontaminate(none, bench), quality_rules(none, labels), secret_scan(none), quality_classifier(none, labels), toxicity(none, labels)):
        assert out.count() == 0
    assert decontaminate(docs, bench).count() == quality_rules(docs, labels).count() == toxicity(docs, labels).count() == quality_classifier(docs, labels).count() == docs.count()


def thue_morse(n: int, a: str = "a", b: str = "b") -> str:
    """A text of n letters on which polynomials modulo powers of two agree with its mirror image."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_polynomials_take_for_one(spark):
    """Two different words of 1024 letters have nothing in common, alone or inside a text."""
    from varloom.llm.ngram_join import ngram_jaccard_join
    from varloom.llm.substring_dedup import substring_dedup
    from varloom.llm.suffix_dedup import suffix_dedup

    one, two = thue_morse(1024), thue_morse(1024, "b", "a")
    d = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in ngram_jaccard_join(d).collect()) == [(1, 1), (2, 2)]
    words = [f"w{i % 7}" for i in range(299)] + [one] + [f"w{i % 7}" for i in range(19)] + [two]
    text = " ".join(words)
    corpus = [(5, text)]
    d = spark.createDataFrame(corpus, "doc_id long, text string")
    (r,) = substring_dedup(d).collect()
    n_removed = removed_by_windows(corpus, 20, True)[5]
    assert (r.n_words, r.n_removed) == (n_removed[0], n_removed[1])
    for t in (thue_morse(6000), "x" * 50 + one + "y" * 60 + two + one):
        (r,) = suffix_dedup(spark.createDataFrame([(5, t)], "doc_id long, text string")).collect()
        assert (r.n_bytes, r.n_removed) == removed_by_windows([(5, t)], 100, False)[5][:2]


@pytest.mark.parametrize("k", [3, 20])
def test_first_windows_whatever_the_hash(k):
    """firsts() is right though most windows share a hash."""
    import numpy as np

    from varloom.llm.repeats import firsts

    rng = np.random.default_rng(k)
    symbols = np.concatenate([rng.integers(0, 3, 300), np.tile(rng.integers(0, 3, 9), 60)])
    n = len(symbols) - k + 1
    own = [symbols[i : i + k].tobytes() for i in range(n)]
    want = [own.index(x) == i for i, x in enumerate(own)]
    for bits in (1, 4, 64):
        x = np.array([hash(w) % 2**bits for w in own], np.uint64)
        assert firsts(np.zeros(n, np.uint64), lambda x=x: x, lambda: symbols, k).tolist() == want


def test_word_hashes_are_those_of_the_words():
    import numpy as np

    from varloom.llm._common import word_bounds, word_hashes

    rng = random.Random(9)
    words = [bytes(rng.choice(b"abc\x00\xc3") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 300]))) for _ in range(3000)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = word_bounds(data, np.zeros(1, np.int64))
    h = word_hashes(data, starts, ends).tolist()
    seen: dict = {}
    assert all(seen.setdefault(w, x) == x for w, x in zip(words, h, strict=True)) and len(set(h)) == len(set(words))
    assert len({w: 1 for w in words}) < len(words)


def test_bpe_in_one_pass(docs):
    from varloom.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip

    assert sorted(map(str, bpe_round_trip(docs).collect())) == sorted(map(str, bpe_decode(bpe_encode(docs)).collect()))

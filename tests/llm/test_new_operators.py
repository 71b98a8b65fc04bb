"""Operators 11 to 13 against plain versions of their contracts."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SPACES = "[^\x20\x09-\x0d]+"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# --- periodic runs


def plain_runs(w: list, times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """Every stretch, period by period."""
    ids = np.array([{x: i for i, x in enumerate(w)}[x] for x in w], np.int64)
    found: dict[tuple[int, int], int] = {}
    for p in range(1, len(w) // times + 1):
        same = np.concatenate([[0], (ids[:-p] == ids[p:]).astype(int), [0]])
        edges = np.flatnonzero(np.diff(same))
        for s, e in zip(edges[::2].tolist(), (edges[1::2] + p).tolist(), strict=True):
            if e - s >= max(least, times * p):
                found.setdefault((s, e), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def planted(doc_id, text):
    w = re.findall(SPACES, text or "")
    n = len(w)
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_op11_is_its_contract(spark):
    from varloom.llm.queries import op11_periodic_runs

    rows = {r.doc_id: r for r in op11_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    n_long = 0
    for d in docs:
        w = planted(d.doc_id, d.text)
        runs, r = plain_runs(w), rows[d.doc_id]
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{p}\n" for s, n, p in runs))
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in gone))
        if runs:
            top = max(itertools.product(runs, [0]), key=lambda x: (x[0][1] / x[0][2], -x[0][0], -x[0][2]))[0]
            assert (r.start, r.length, r.period, r.exponent_milli) == (*top, 1000 * top[1] // top[2])
            n_long += top[2] > 1
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
    assert n_long > 5


@pytest.mark.parametrize("prime", [2, 5, 2**31 - 1])
@pytest.mark.parametrize("pairs", [7, 1 << 20])
def test_runs_of_a_batch_with_colliding_hashes(monkeypatch, prime, pairs):
    from varloom.llm import periodic_runs as P

    monkeypatch.setattr(P, "PRIME", np.uint64(prime))
    monkeypatch.setattr(P, "MOST_PAIRS", pairs)
    rng = random.Random(prime + pairs)
    for _ in range(60):
        docs = []
        for _ in range(rng.randint(1, 6)):
            w: list[int] = []
            for _ in range(rng.randint(0, 5)):
                w += ([rng.randint(0, 2) for _ in range(rng.randint(1, 6))] * rng.randint(1, 8))[: rng.randint(0, 40)]
            docs.append(w)
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        times = rng.choice([2, 3, 4])
        found = P.runs_of(P.Words(np.array([x for d in docs for x in d], np.int64)), first, times, 6) if first[-1] else [[]] * len(docs)
        assert [[(int(s - f), int(e - s), p) for s, e, p in g] for g, f in zip(found, first, strict=False)] == [plain_runs(d, times) for d in docs]


def test_periodic_runs_edges(spark):
    from varloom.llm.periodic_runs import periodic_runs

    long = " ".join(["x y z"] * 100_000)
    rows = [(None, "a a a a a a"), (1, None), (2, ""), (3, " \n\t "), (4, " a\tb a b\n\na b a b "), (4, " a\tb a b\n\na b a b "), (5, long), (6, "a a a a a"), (7, "é\x1fé " * 7), (8, "a\x85a " * 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit(1), "n_words": F.lit("x"), "collapsed": F.lit(None)})
    out = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(d).collect()]
    assert sorted(out, key=str) == sorted(
        [(None, 6, [(0, 6, 1)], "a"), (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 8, [(0, 8, 2)], "a b"), (4, 8, [(0, 8, 2)], "a b"), (5, 300_000, [(0, 300_000, 3)], "x y z"),
         (6, 5, [], "a a a a a"), (7, 7, [(0, 7, 1)], "é\x1fé"), (8, 6, [(0, 6, 1)], "a\x85a")], key=str)
    assert periodic_runs(d.where("false")).count() == 0


# --- packing


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def plain_bfd(lengths: list[int], capacity: int) -> int:
    """Sequences that best-fit decreasing opens, a piece at a time."""
    rooms: list[int] = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(rooms, n)
        bisect.insort(rooms, (capacity if i == len(rooms) else rooms.pop(i)) - n)
    return len(rooms)


def check_packing(rows: list, capacity: int) -> None:
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity
    assert len(bins) == plain_bfd([r.length for r in rows], capacity)


def check_pieces(rows: list, docs: list, tokenizer, capacity: int) -> None:
    own: dict = {}
    for r in rows:
        own.setdefault(r.doc_id, []).append(r)
    for doc_id, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        got = sorted(own[doc_id], key=lambda r: r.piece)
        sizes = [r.length for r in got]
        assert [r.piece for r in got] == list(range(len(got))) and sum(sizes) == len(ids)
        assert all(n == capacity for n in sizes[1:]) and 0 < sizes[0] <= capacity
        for r in got:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        assert [r.start for r in got] == [0, *itertools.accumulate(sizes)][:-1]


def test_op12_is_its_contract(spark, tokenizer):
    from varloom.llm.queries import op12_best_fit_packing

    rows = op12_best_fit_packing(spark, SF).collect()
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_pieces(rows, docs, tokenizer, 1024)
    check_packing(rows, 1024)


def test_plan_is_best_fit_decreasing():
    from varloom.llm.best_fit_packing import plan

    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([5, 17, 64, 100])
        counts = {n: rng.randint(1, rng.choice([1, 5, 40])) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 20)))}
        steps = plan(counts, capacity)
        used = {s.sequence + j // s.each for s, after in zip(steps, [*steps[1:], None], strict=True) for j in range((after.rank if after and after.length == s.length else counts[s.length]) - s.rank)}
        assert len(used) == plain_bfd([n for n, c in counts.items() for _ in range(c)], capacity)
    assert len(plan({n: 10**9 // n for n in range(1, 1025)}, 1024)) < 10_000  # the documents' number is no matter


def test_packing_edges(spark, tokenizer, monkeypatch):
    from varloom.llm import best_fit_packing as P

    monkeypatch.setattr(P, "BLOCK", 4)
    texts = [None, "", "one two", "one two", "don't <|endoftext|>stop", " " * 300_000, "\n\n  x  \t y", "é漢😀" * 9, "word " * 3000, "x" * 5000] + ["same text here"] * 40
    docs = [(i if i else None, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"length": F.lit(1), "piece": F.lit("x"), "_rank": F.lit(1), "ids": F.lit(1)}).repartition(3)
    cut = P.pieces(d, 100, with_ids=True)
    packed = P.best_fit_packing(cut, 100)
    rows = packed.collect()
    check_pieces(rows, docs, tokenizer, 100)
    check_packing(rows, 100)
    whole = P.sequences(packed).collect()
    assert sum(s.n_tokens for s in whole) == sum(r.length for r in rows) and max(s.n_tokens for s in whole) <= 100
    at = {(r.sequence_id, r.offset): r.ids for r in rows}
    assert all(s.ids[o : o + len(at[s.sequence_id, o])] == at[s.sequence_id, o] for s in whole for o in s.offsets)
    twice = P.best_fit_packing(P.pieces(d.unionAll(d).select("doc_id", "text"), 100), 100).collect()  # repeated rows each have a place
    assert len(twice) == 2 * len(rows)
    check_packing(twice, 100)
    assert P.best_fit_packing(P.pieces(d.where("false"), 100), 100).count() == 0


def test_encoder_gives_the_library_s_ids(tokenizer):
    import public_tokenizers

    from varloom.llm.best_fit_packing import Encoder

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        e = Encoder(f.read())
    assert e.fast
    rng = random.Random(4)
    alphabet = ["a", "'s", " ", "  ", "\n", "\t", "é", "1", "٣", "!", "漢", "😀", " ", "　", "\x00", "'LL", "the", "́", "<|endoftext|>", " ", "ǅ"]
    for _ in range(500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert e.ids(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


# --- conversations


def damage(rows: list) -> dict:
    """Each conversation's (turn, role, text) after damage."""
    s = lambda x: " " if x is None else str(x)
    out: dict = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        way = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        role = "user" if way == 4 else role
        own += [(turn, role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(turns: list) -> tuple[dict, list]:
    seen, kinds = set(), []
    for _, role, text in turns:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    known = [t for t, _, _ in turns if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:], strict=False)]
    counts = {k: kinds.count(k) for k in ("blank", "duplicate", "truncated")}
    counts |= {"gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0, "illegal": sum(x not in ("su", "ua", "au") for x in pairs)}
    return counts, kinds


def plain_repair(turns: list, kinds: list) -> tuple[int, str, str]:
    """Turn by turn, the cheapest edits (the least audit of them) for each shape of the roles so far."""
    shape = lambda r: r if r in ("", "s") else r[-1]
    ok = lambda r: re.fullmatch("s?(ua)*u?", r) is not None
    best: dict[str, tuple[int, str, list, str]] = {"": (0, "", [], "")}

    def less(table: dict, roles: str, way: tuple) -> None:
        k = shape(roles)
        if k not in table or way[:2] < table[k][:2]:
            table[k] = (*way[:3], roles)

    def inserted(table: dict) -> dict:
        for _ in range(3):
            for cost, audit, out, roles in list(table.values()):
                for role in ("user", "assistant"):
                    if ok(roles + role[0]):
                        less(table, roles + role[0], (cost + 2, audit + "I", [*out, f"{role}:"], ""))
        return table

    for (_, role, text), kind in zip(turns, kinds, strict=True):
        table: dict = {}
        for cost, audit, out, roles in inserted(best).values():
            less(table, roles, (cost + 3, audit + "D", out, ""))
            if kind in ("blank", "duplicate"):
                continue
            more = int(kind == "truncated")
            if role[:1] in ("s", "u", "a") and ok(roles + role[:1]):
                less(table, roles + role[:1], (cost + more, audit + "K", [*out, f"{role}:{text}"], ""))
            for new in ("user", "assistant"):
                if ok(roles + new[0]):
                    less(table, roles + new[0], (cost + 2 + more, audit + "R", [*out, f"{new}:{text}"], ""))
        best = table
    cost, audit, out, _ = min((x for x in inserted(best).values() if re.fullmatch("(s?(ua)+)?", x[3])), key=lambda x: x[:2])
    return cost, audit, "\n".join(out)


def check_repairs(found: list, rows: list) -> None:
    plain = damage(rows)
    assert len(found) == len(plain)
    for r in found:
        turns = plain[r.conv_id]
        counts, kinds = faults(turns)
        assert {k: r[k] for k in counts} == counts, r
        cost, audit, text = plain_repair(turns, kinds)
        assert (r.cost, r.audit, r.repaired_sha256) == (cost, audit, sha(text)), (r, cost, audit)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op13_is_its_contract(spark, sf):
    from varloom.llm.queries import op13_conversation_repair

    d = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check_repairs(op13_conversation_repair(spark, d).collect(), rows)


@pytest.mark.parametrize("block", [1, 3, 512])
def test_conversations_with_odd_rows(spark, monkeypatch, block):
    from varloom.llm import conversation_repair as C
    from varloom.llm.queries import damaged

    monkeypatch.setattr(C, "BLOCK", block)
    rng = random.Random(7)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "s", None]
    texts = ["Yes.", "No!", "why", "", " \n", "A longer one? ", None, "é。", "Yes.\x1f"]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(500)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"there": F.lit("x"), "n": F.lit(2), "audit": F.lit(0)}).repartition(3)
    dam = damaged(d)
    # the task's copy of the module has its own BLOCK, so the fold is called here
    if block != 512:
        k = 5
        own = [r for r in C._own(dam, "there").where("conv_id = 5").sort(*C.ORDER).collect()]
        counts, ways = C.Counts(), {C.START: C.Way(0, "", hashlib.sha256(), True)}
        for turns, last in C._blocks((tuple(r) for r in own), counts):
            ways = C.forward(ways, turns, C.ACCEPTING if last else None)
        (way,) = ways.values()
        turns = damage(rows)[k]
        assert (way.cost, way.audit, way.text.hexdigest()) == (lambda x: (x[0], x[1], sha(x[2])))(plain_repair(turns, faults(turns)[1]))
        return
    found = C.conversation_repair(dam, "there")
    check_repairs(found.collect(), rows)
    turns = C.repaired_turns(dam, found, "there").collect()
    own: dict = {}
    for r in sorted(turns, key=lambda r: (str(r.conv_id), r.position)):
        own.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(sha("\n".join(own.get(r.conv_id, []))) == r.repaired_sha256 for r in found.collect())
    assert C.conversation_repair(dam.where("false"), "there").count() == 0
    assert C.conversation_repair(d).count() == found.count()


def test_a_very_long_conversation():
    """One of 20,000 turns goes through in blocks."""
    from varloom.llm import conversation_repair as C

    turns = [(0, True, i, ["user", "assistant", "assistant"][i % 3], f"Turn {i}.") for i in range(20_001)]
    counts, ways = C.Counts(), {C.START: C.Way(0, "", hashlib.sha256(), True)}
    for block, last in C._blocks(iter(turns), counts):
        assert len(block) <= C.BLOCK
        ways = C.forward(ways, block, C.ACCEPTING if last else None)
    (way,) = ways.values()
    assert way.cost == 2 * 6667 and way.audit.startswith("KKIK") and counts.illegal == 6667

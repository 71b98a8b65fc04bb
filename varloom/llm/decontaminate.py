"""Operator 1, benchmark decontamination: exact phrase and proximity matches by a positional inverted index.

Method: a positional inverted index of the training documents over the terms of the test windows is
stored as a table, dealt out by document: (document, words, term numbers, positions), in the order
of the terms, so one posting list per term. Term frequencies are counted off the index. Each window
takes its terms from the rarest to the most frequent: the posting list of the first gives possible
starts (position less offset), and each further list, shifted by its own offset, is intersected
with what is left, by binary search in the ordered postings of a run of documents. Windows are so
found where their documents are: nothing is shuffled by term, so neither a frequent term nor a
window in a third of all documents meets in a task. Proximity matches (all terms of a window within window +
slop words, any order) start from the same list of the rarest term.

The windows go to all tasks, so their number is checked: more than MOST_WINDOWS of them (a hash of
the window deals them out, so one huge item is cut too) are looked up in several passes.

Nulls and texts without words have no windows and no hits. The words of an item without an id are
hits like others, but there is no id to list. Every row of documents gives one row; of several
passes, rows with the same id and text are one document, and a null id counts as the smallest.
Repeated items count once. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm._common import chunks, keyed, text_buffers, with_id, written

#: Different windows that one pass looks up at most (about 60 bytes each in a task).
MOST_WINDOWS = 500_000
#: A-Z in lower case; the bytes that part words ([\x00-\x2F\x3A-\x60\x7B-\x7F], after that) as spaces.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def _windows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for item, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            w = [x.decode() for x in terms_of(t)]
            rows += [(item, w[i : i + n]) for i in range(max(1, len(w) - n + 1)) if w]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], ["item_id", "terms"])


INDEX = "_d long, _h long, n_words long, terms array<int>, positions array<int>"


def _index(batches: Iterator[pa.RecordBatch], number: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """The posting lists of each document, one after the other in the order of their terms' numbers."""
    for b in batches:
        off, data = text_buffers(b.column("text"))
        for i, j in chunks(off):
            ns, terms, positions = [], [], []
            for r in range(i, j):
                t = data[off[r] : off[r + 1]].tobytes().translate(_TABLE).split()
                x = np.fromiter(map(number.get, t, repeat(-1)), np.int32, len(t))
                p = np.flatnonzero(x >= 0)
                p = p[np.argsort(x[p], kind="stable")]
                ns.append(len(t))
                terms.append(x[p])
                positions.append(p.astype(np.int32))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in terms])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (terms, positions)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).slice(i, j - i) for c in ("_d", "_h")), pa.array(ns, pa.int64()), *lists], ["_d", "_h", "n_words", "terms", "positions"])


def _counts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(term, n): the lengths of the posting lists, summed up within the task."""
    n = np.zeros(size, np.int64)
    for b in batches:
        n += np.bincount(b.column("terms").flatten().to_numpy(), minlength=size)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["term", "n"])


class Tests:
    """Test windows in arrays. term, offset: of each window the terms from the rarest on and their places in it (-1 beyond
    its end); first: the windows that term t leads are first[t] to first[t + 1]."""

    def __init__(self, windows: list[list[int]], items: list[list[str]], frequency: np.ndarray, width: int) -> None:
        # a window with a term that no document has can't occur
        there = [i for i, w in enumerate(windows) if all(frequency[x] > 0 for x in w)]
        order = {i: sorted(range(len(windows[i])), key=lambda o, w=windows[i]: (frequency[w[o]], w[o], o)) for i in there}
        there.sort(key=lambda i: windows[i][order[i][0]])
        self.term = np.full((len(there), width), -1, np.int32)
        self.offset = np.zeros((len(there), width), np.int32)
        for k, i in enumerate(there):
            self.term[k, : len(order[i])] = [windows[i][o] for o in order[i]]
            self.offset[k, : len(order[i])] = order[i]
        self.size = (self.term >= 0).sum(1)
        self.items = [sorted(items[i]) or [None] for i in there]
        self.first = np.searchsorted(self.term[:, 0], np.arange(len(frequency) + 1)) if there else np.zeros(len(frequency) + 1, np.int64)

    def starts(self, terms: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) for each posting (in order of terms) of a window's rarest term."""
        lo, n = self.first[terms], self.first[terms + 1] - self.first[terms]
        ends = np.cumsum(n)
        w = np.repeat(lo - (ends - n), n) + np.arange(int(n.sum()))
        return w, np.repeat(at, n) - self.offset[w, 0]


def phrases(tests: Tests, terms: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of all exact matches: offset-adjusted lists intersected from the rarest term on.
    terms, at: postings in order; positions are below span."""
    lists = terms.astype(np.int64) * span + at
    w, s = tests.starts(terms, at)
    for r in range(1, tests.term.shape[1]):
        if not len(w):
            break
        t = tests.term[w, r].astype(np.int64)
        want = t * span + s + tests.offset[w, r]
        i = np.searchsorted(lists, want)
        ok = (t < 0) | (i < len(lists)) & (lists[np.minimum(i, len(lists) - 1)] == want)
        w, s = w[ok], s[ok]
    return w, s


def near(tests: Tests, terms: np.ndarray, at: np.ndarray, slop: int) -> list[tuple[int, int, int]]:
    """(window, s, e) within one document: for each posting of a window's rarest term, the first words [s, e) over it that hold
    as many postings of every term as the window does."""
    out = []
    length = int(at.max(initial=-1)) + 1
    for w, p in zip(*tests.starts(terms, at), strict=True):
        p += tests.offset[w, 0]
        need = np.unique(tests.term[w, : tests.size[w]], return_counts=True)
        lists = [at[np.searchsorted(terms, t) : np.searchsorted(terms, t, side="right")] for t in need[0]]
        size = int(tests.size[w]) + slop
        for s in range(max(0, p - size + 1), p + 1):
            if all(np.searchsorted(x, s + size) - np.searchsorted(x, s) >= n for x, n in zip(lists, need[1], strict=True)):
                out.append((int(w), s, min(length, s + size)))
                break
    return out


def _matches(batches: Iterator[pa.RecordBatch], tests: Tests, slop: int | None) -> Iterator[pa.RecordBatch]:
    """found: (item_id, s, e) of each match, per document."""
    kind = pa.list_(pa.struct([("item_id", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))
    for b in batches:
        terms, positions = b.column("terms"), b.column("positions")
        n = b.column("n_words").to_numpy()
        off = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())])
        t, p = terms.flatten().to_numpy(), positions.flatten().to_numpy().astype(np.int64)
        found: list[list[dict]] = [[] for _ in range(b.num_rows)]
        for i, j in chunks(off, 200_000):
            if slop is None:
                # a run of documents as one text, with room between them so that no match crosses a border
                room = tests.term.shape[1]
                base = np.cumsum(n[i:j] + 2 * room) - n[i:j] - room
                own, at = t[off[i] : off[j]], p[off[i] : off[j]] + np.repeat(base, np.diff(off[i : j + 1]))
                order = np.argsort(own, kind="stable")
                w, s = phrases(tests, own[order], at[order], int(base[-1] + n[j - 1] + 2 * room))
                row = np.searchsorted(base, s, side="right") - 1
                hits = zip(w.tolist(), (s - base[row]).tolist(), (s - base[row] + tests.size[w]).tolist(), (row + i).tolist(), strict=True)
            else:
                hits = ((*x, r) for r in range(i, j) for x in near(tests, t[off[r] : off[r + 1]], p[off[r] : off[r + 1]], slop))
            for w, s, e, r in hits:
                found[r] += [{"item_id": x, "s": s, "e": e} for x in tests.items[w]]
        yield pa.RecordBatch.from_arrays([b.column("_d"), b.column("_h"), b.column("n_words"), pa.array(found, kind)], ["_d", "_h", "n_words", "found"])


def matched(docs: DataFrame, benchmark: DataFrame, window: int = 13, slop: int | None = None) -> DataFrame:
    """_d, _h, n_words and found (item_id, s, e of the words [s, e) of each match) of every row."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    windows = items.mapInArrow(lambda it: _windows(it, window), "item_id string, terms array<string>")
    windows = written(windows.groupBy("terms").agg(F.collect_set("item_id").alias("items")), "windows")
    blocks = max(1, -(-windows.count() // MOST_WINDOWS))
    t = keyed(docs)
    kind = "_d long, _h long, n_words long, found array<struct<item_id:string,s:int,e:int>>"
    parts = []
    for k in range(blocks):
        own = windows.where(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == k).collect()  # about MOST_WINDOWS at most
        words = sorted(set(chain.from_iterable(r.terms for r in own)))
        number = {x: i for i, x in enumerate(words)}
        as_bytes = {x.encode(): i for x, i in number.items()}
        index = written(t.mapInArrow(lambda it, v=as_bytes: _index(it, v), INDEX), "postings")
        frequency = np.zeros(len(words), np.int64)
        for r in index.mapInArrow(lambda it, n=len(words): _counts(it, n), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row per test term
            frequency[r.term] = r.n
        tests = Tests([[number[x] for x in r.terms] for r in own], [r["items"] for r in own], frequency, window)
        parts.append(index.mapInArrow(lambda it, x=tests: _matches(it, x, slop), kind))
    if blocks == 1:
        return parts[0]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.unionByName(x)
    rows = written(rows, "matches")
    found = rows.where("size(found) > 0").groupBy("_d", "_h").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    return t.select("_d", "_h").join(rows.groupBy("_d", "_h").agg(F.first("n_words").alias("n_words")), ["_d", "_h"]).join(found, ["_d", "_h"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<item_id:string,s:int,e:int>>")))


def positional_matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, slop: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(base, hits): _d, _h, n_words of every row; _d, _h, item_id, s, e (words [s, e)) of every match.
    slop: proximity matches within window + slop words instead of exact phrases."""
    rows = written(matched(docs, benchmark, window, slop), "matches")
    return rows.select("_d", "_h", "n_words"), rows.select("_d", "_h", F.inline("found"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """decontaminate() by the documents' keys _d and _h."""
    rows = matched(docs, benchmark, window)
    ids = F.filter(F.transform("found", lambda x: x["item_id"]), lambda x: x.isNotNull())
    rows = rows.withColumns({"item_ids": F.array_sort(F.array_distinct(ids)), "hits": F.array_sort(F.array_distinct(F.transform("found", lambda x: F.struct(x["s"], x["e"]))))})
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end")),
        lambda a: a["n"],
    )
    return rows.select("_d", "_h", "n_words", covered.cast("long").alias("n_hit"), "item_ids", "hits")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_hit, the item_ids found and the hit word spans of every row."""
    return with_id(contamination(docs, benchmark, window))

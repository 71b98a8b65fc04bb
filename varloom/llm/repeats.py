"""Windows of k consecutive symbols that also start earlier in the corpus; shared by operators 2 and 8.

A sparse suffix index: of all positions only content-chosen anchors are indexed (in each window,
the m-grams of the smallest hash), so every window holds an anchor and equal windows hold it at
the same offset. Only anchors met twice or more are looked at again:

* up to MOST_ROWS occurrences (some MB): they meet in one group, each with the symbols on either
  side, and the operator's resolver (a suffix sort, a parse against the earlier ones) finds what repeats,
  whatever the group's size;
* more (a passage in a third of all documents): each window over the anchor is keyed by a 128-bit
  digest and an aggregation with map-side combine finds its first start; no group meets in a task but the anchor's places,
  without text, where they are counted (a window, which spills).

Both ways are exact, whatever the group's size, the second as far as 128-bit digests (xxh3) of different windows differ. Later copies of a whole text are settled up front
by one aggregation over digests. Windows that repeat within their own document (periodic text has an
anchor per period) are settled by the task that looks for anchors, and only the first ones are indexed. Work
per document is bounded by its own length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm._common import CHUNK, chunks, keyed, powers, prefix_sums, slice_hash, sliding, text_buffers, word_bounds, word_hashes, word_numbers

#: Occurrences of an anchor that meet in one group; an exact way takes the anchors with more.
MOST_ROWS = 20_000

#: Of groups, each the contexts left and right of an anchor in corpus order, and the window's length: for each occurrence of each group,
#: how far left and right of the anchor each span reaches that earlier ones cover.
Resolver = Callable[[list[tuple[list, list]], int], list[list[list[tuple[int, int]]]]]
#: Contexts that are resolved at once, or one group's.
MOST_CONTEXTS = 4000


def _anchors(g: np.ndarray, k: int, m: int, first: np.ndarray | None) -> np.ndarray:
    """Positions whose m-gram hash is the least in some window of k symbols (of those marked in first).
    g: hashes of all m-grams of one text."""
    w = k - m + 1
    low = sliding(np.minimum, g, w)
    if first is not None:
        low[~first] = 0
    pad = np.zeros(w - 1, np.uint64)
    high = sliding(np.maximum, np.concatenate([pad, low, pad]), w)
    return np.flatnonzero(high == g)


def firsts(g: np.ndarray, windows: Callable[[], np.ndarray], symbols: Callable[[], np.ndarray], k: int) -> np.ndarray | None:
    """Which windows of k symbols start first in their text; None where a sample of its m-grams hardly repeats. A window whose hash
    came before is verified on the symbols (bytes, or exact numbers of words) of the first window with that hash."""
    if len(g) < 256:
        return None
    sample = g[(g & np.uint64(31)) == 0]
    if len(sample) * 128 >= len(g) and len(np.unique(sample)) >= 0.8 * len(sample):
        return None
    x, symbols = windows(), symbols()
    _, at, which = np.unique(x, return_index=True, return_inverse=True)
    first = at[which]
    again = np.flatnonzero(first != np.arange(len(x)))
    same = np.ones(len(again), bool)
    for i in range(k):
        same &= symbols[again + i] == symbols[first[again] + i]
    out = np.ones(len(x), bool)
    out[again] = ~same
    for h in np.unique(x[again[~same]]):  # one hash of different windows: told apart by the symbols themselves
        seen: set[bytes] = set()
        for i in np.flatnonzero(x == h).tolist():
            own = symbols[i : i + k].tobytes()
            out[i] = own not in seen
            seen.add(own)
    return out


def _word_sums(x: np.ndarray) -> np.ndarray:
    c = np.empty(len(x) + 1, np.uint64)
    c[0] = 0
    np.cumsum(x * powers(len(x) + 1)[1][: len(x)], out=c[1:])
    return c


def word_grams(x: np.ndarray, m: int) -> np.ndarray:
    """Hashes of all runs of m words. x: hashes of the words."""
    if len(x) < m:
        return x[:0]
    c = _word_sums(x)
    at = np.arange(len(x) - m + 1)
    return slice_hash(c, at, at + m)


def _repeats(first: np.ndarray | None, k: int, at: int, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, p) of the runs of windows that are not first in their text, which begins so many symbols before the windows do. A row
    stands for symbols -1 - p up to the lower half of a; the upper half is the text's hash, so that rows are dealt out."""
    gone = np.flatnonzero(np.diff(np.concatenate([[0], (~first).astype(np.int8), [0]]))) if first is not None else np.zeros(0, np.int64)
    return np.uint64((h & 0xFFFFFFFF) << 32) | (gone[1::2] + at + k - 1).astype(np.uint64), -1 - (gone[::2] + at)


def byte_anchors(batches: Iterator[pa.RecordBatch], k: int, m: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        off, data = text_buffers(b.column(2))
        d, h = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for i, j in chunks(off):
            for lo in range(int(off[i]), int(off[j]), CHUNK) if j == i + 1 else (int(off[i]),):
                hi = min(int(off[j]), lo + CHUNK + k - 1) if j == i + 1 else int(off[j])
                if hi - lo < k:
                    continue
                c = prefix_sums(data[lo:hi])
                at = np.arange(hi - lo - m + 1)
                g = slice_hash(c, at, at + m)
                for r in range(i, j):
                    s, e = max(int(off[r]), lo) - lo, min(int(off[r + 1]), hi) - lo
                    if e - s >= k:
                        w = np.arange(s, e - k + 1)
                        first = firsts(g[s : e - m + 1], lambda c=c, w=w: slice_hash(c, w, w + k), lambda s=lo + s, e=lo + e: data[s:e], k)
                        p = _anchors(g[s : e - m + 1], k, m, first) + s
                        x, q = _repeats(first, k, s + lo - int(off[r]), int(h[r]))
                        out.append((np.concatenate([g[p], x]), np.full(len(p) + len(q), r), np.concatenate([p + lo - off[r], q])))
                        held += len(p) + len(q)
            if held > 100_000 or j == len(off) - 1:
                if out:
                    a, r, p = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield _rows(a, d[r], h[r], p)
                out, held = [], 0


def word_anchors(batches: Iterator[pa.RecordBatch], k: int, m: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        off, data = text_buffers(b.column(2))
        d, h = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        for i, j in chunks(off):
            part = data[off[i] : off[j]]
            starts, ends, first = word_bounds(part, off[i : j + 1] - off[i])
            if not len(starts):
                continue
            x = word_hashes(part, starts, ends)
            g = word_grams(x, m)
            out = []
            for r in range(i, j):
                s, e = int(first[r - i]), int(first[r - i + 1])
                if e - s >= k:
                    before = firsts(g[s : e - m + 1], lambda s=s, e=e: word_grams(x[s:e], k), lambda r=r: word_numbers(split_words(data[off[r] : off[r + 1]].tobytes())), k)
                    p = _anchors(g[s : e - m + 1], k, m, before)
                    a, q = _repeats(before, k, 0, int(h[r]))
                    out.append((np.concatenate([g[p + s], a]), np.full(len(p) + len(q), r), np.concatenate([p, q])))
            if out:
                a, r, p = (np.concatenate(v) for v in zip(*out, strict=True))
                yield _rows(a, d[r], h[r], p)


def _rows(a: np.ndarray, d: np.ndarray, h: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(d), pa.array(h), pa.array(p.astype(np.int32))], ["a", "_d", "_h", "p"])


def split_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+; bytes.split() drops exactly these bytes."""
    return text.split()


def _contexts(batches: Iterator[pa.RecordBatch], k: int, m: int, words: bool) -> Iterator[pa.RecordBatch]:
    """For each repeated anchor of a document: the symbols before and after it that a window over it can reach."""
    for b in batches:
        rows: list[tuple] = []
        texts = b.column(2).cast(pa.binary() if pa.types.is_string(b.column(2).type) else pa.large_binary())
        for d, h, t, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, b.column(3), strict=True):
            t = t.as_py()
            t = split_words(t) if words else t
            for x in at.as_py():
                p = x["p"]
                left, right = t[max(0, p - (k - m)) : p], t[p : p + k]
                rows.append((x["a"], d, h, p, b" ".join(left) if words else left, b" ".join(right) if words else right))
            if len(rows) > 20_000:
                yield _pack(rows)
                rows = []
        if rows:
            yield _pack(rows)


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["a", "_d", "_h", "p", "l", "r"])


def _windows(batches: Iterator[pa.RecordBatch], k: int, m: int, words: bool) -> Iterator[pa.RecordBatch]:
    """Every window over a very frequent anchor, by its digest."""
    schema = pa.schema([("w", pa.binary()), ("_d", pa.int64()), ("_h", pa.int64()), ("s", pa.int32())])
    for b in batches:
        rows: list[tuple] = []
        texts = b.column(2).cast(pa.binary() if pa.types.is_string(b.column(2).type) else pa.large_binary())
        for d, h, t, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, b.column(3), strict=True):
            t = t.as_py()
            t = split_words(t) if words else t
            p = np.unique(np.array([x["p"] for x in at.as_py()], np.int64))
            s = np.unique((p[:, None] - np.arange(k - m + 1)[None, :]).ravel())
            for q in s[(s >= 0) & (s + k <= len(t))].tolist():
                w = t[q : q + k]
                rows.append((xxhash.xxh3_128_digest(b" ".join(w) if words else w), d, h, q))
            if len(rows) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _resolve(batches: Iterator[pa.RecordBatch], k: int, words: bool, resolver: Resolver) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor, document and position; groups may straddle batches."""
    schema = pa.schema([("_d", pa.int64()), ("_h", pa.int64()), ("s", pa.int32()), ("e", pa.int32())])

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    out: list[tuple] = []
    waiting: list[list[tuple]] = []

    def resolve() -> None:
        groups = [([x[3] for x in own], [x[4] for x in own]) for own in waiting]
        for own, found in zip(waiting, resolver(groups, k), strict=True):
            for (d, h, p, _, _), spans in zip(own, found, strict=True):
                out.extend((d, h, p - x, p + y) for x, y in spans)
        waiting.clear()

    held = 0
    for _, group in groupby(rows(), key=itemgetter(0)):
        seen: dict[tuple[bytes, bytes], int] = {}
        own: list[tuple] = []
        for _, d, h, p, left, right in group:
            first = seen.setdefault((left, right), len(own))
            if words:
                left, right = left.split(), right.split()
            if first < len(own):  # the same on both sides as an earlier one: every window over it repeats
                if len(left) + len(right) >= k and own[first][:3] != (d, h, p):
                    out.append((d, h, p - len(left), p + len(right)))
                continue
            own.append((d, h, p, left, right))
        if len(own) > 1:
            waiting.append(own)
            held += len(own)
        if held > MOST_CONTEXTS:
            resolve()
            held = 0
        if len(out) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
    resolve()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def merged(spans: list) -> list[tuple[int, int]]:
    """Union of intervals, as maximal runs."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def repeated_spans(docs: DataFrame, k: int, m: int, words: bool, resolver: Resolver, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_d, _h, text, copy, spans array<struct<s,e>>) of every row: what windows of k symbols that also
    start earlier cover. copy: the whole text has an earlier copy."""
    t = keyed(docs, id_col, text_col)
    digests = t.select("_d", "_h", F.sha2("text", 256).alias("x"))
    firsts = digests.groupBy("x").agg(F.min(F.struct("_d", "_h")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("x", F.col("f._d").alias("fd"), F.col("f._h").alias("fh"))
    copies = digests.join(firsts, "x").where("_d > fd or (_d = fd and _h > fh)").select("_d", "_h").distinct().withColumn("copy", F.lit(True))
    own = t.join(copies, ["_d", "_h"], "left_anti")

    rows = "a long, _d long, _h long, p int"
    find = word_anchors if words else byte_anchors
    # Anchors are found, dealt out and counted once: lists, by document, hold those met again (with their number) and the windows that
    # repeat within the document, and all that follows reads them.
    anchors = own.mapInArrow(lambda it: find(it, k, m), rows).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("a")))
    lists = anchors.where("n > 1 or p < 0").groupBy("_d", "_h").agg(F.collect_list(F.struct("a", "p", "n")).alias("at"))

    def at_docs(which: Callable) -> DataFrame:
        return t.join(lists.select("_d", "_h", F.filter("at", which).alias("at")).where(F.size("at") > 0), ["_d", "_h"])

    few = at_docs(lambda x: (x["p"] >= 0) & (x["n"] <= MOST_ROWS)).mapInArrow(lambda it: _contexts(it, k, m, words), rows + ", l binary, r binary")
    near = few.repartition("a").sortWithinPartitions("a", "_d", "_h", "p").mapInArrow(lambda it: _resolve(it, k, words, resolver), "_d long, _h long, s int, e int")
    many = at_docs(lambda x: (x["p"] >= 0) & (x["n"] > MOST_ROWS)).mapInArrow(lambda it: _windows(it, k, m, words), "w binary, _d long, _h long, s int")
    first = many.groupBy("w").agg(F.min(F.struct("_d", "_h", "s")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("w", "f")
    far = many.join(first, "w").where(F.struct("_d", "_h", "s") != F.col("f")).select("_d", "_h", "s", (F.col("s") + k).alias("e"))
    within = lists.select("_d", "_h", F.explode(F.filter("at", lambda x: x["p"] < 0)).alias("x")).select("_d", "_h", (-1 - F.col("x.p")).alias("s"), F.col("x.a").bitwiseAND(0xFFFFFFFF).cast("int").alias("e"))
    spans = near.unionByName(far).unionByName(within).groupBy("_d", "_h").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return t.join(spans, ["_d", "_h"], "left").join(copies, ["_d", "_h"], "left")

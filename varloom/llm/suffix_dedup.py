"""Operator 2, suffix-array dedup: exact repeated byte strings, removed after their first start.

Method: hash-compared suffix sort. The suffixes at the anchors (varloom.llm.repeats) of a group are
sorted by a mergesort (Python's sort is one) whose comparison finds the common extension of two
suffixes by binary search over prefix polynomial hashes, so it takes a logarithmic number of steps.
Neighbours in the order give the common extensions of all suffixes: those of a group agree on so many bytes or more
between two places where the extension falls below that. Extensions to the left are compared by the prefix hashes
of the reversed bytes. Every match found by a hash is verified on the bytes; only
copies of whole texts (SHA-256) and windows over very frequent anchors (128-bit xxh3) are told by their digests alone.

Nulls and empty texts: nothing to remove. Ties and repeated rows: rows with the same id and text
are one document and get the same result; a null id counts as the smallest. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from varloom.llm._common import powers, prefix_sums, with_id
from varloom.llm.repeats import merged, repeated_spans


def prefix_hashes(parts: list[bytes]) -> list[memoryview]:
    """The polynomial hashes of all prefixes of each string, the empty one first; of all strings at once."""
    n = np.fromiter(map(len, parts), np.int64, len(parts))
    c = prefix_sums(np.frombuffer(b"".join(parts), np.uint8))
    own = np.repeat(np.arange(len(parts)), n + 1)
    at = np.arange(len(own)) - own  # where each prefix ends
    out = memoryview(powers(len(c))[0][at] * (c[at] - c[np.cumsum(n) - n][own]))  # most are never looked at
    ends = np.cumsum(n + 1).tolist()
    return [out[e - k - 1 : e] for e, k in zip(ends, n.tolist(), strict=True)]


def common_extension(x: bytes, y: bytes, hx: memoryview, hy: memoryview) -> int:
    """Length of the longest common prefix, by binary search over prefix hashes; verified on the bytes."""
    lo, hi = 0, min(len(x), len(y))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if hx[mid] == hy[mid]:
            lo = mid
        else:
            hi = mid - 1
    while x[:lo] != y[:lo]:  # two prefixes of one hash: the extension is shorter
        lo = next(i for i in range(lo) if x[i] != y[i])
    return lo


#: Up to so many suffixes, extensions are read off pair by pair; beyond, off runs of the order. Both give the same spans.
FEW = 16


def group_spans(groups: list[tuple[list[bytes], list[bytes]]], k: int) -> list[list[list[tuple[int, int]]]]:
    """suffix_spans() of each group; the prefix hashes of all groups are taken at once."""
    lefts = [x[::-1] for own, _ in groups for x in own]
    hashes = prefix_hashes([*lefts, *(x for _, own in groups for x in own)])
    out, at = [], 0
    for _, rights in groups:
        n = len(rights)
        out.append(suffix_spans(lefts[at : at + n], rights, hashes[at : at + n], hashes[len(lefts) + at : len(lefts) + at + n], k))
        at += n
    return out


def suffix_spans(back: list[bytes], rights: list[bytes], hl: list[memoryview], hr: list[memoryview], k: int) -> list[list[tuple[int, int]]]:
    """For each occurrence of an anchor, in corpus order: how far left and right of it matches of k
    or more bytes with earlier occurrences reach. back: the bytes to the left, turned round; hl, hr: prefix hashes."""
    n = len(rights)

    def compare(i: int, j: int) -> int:
        e = common_extension(rights[i], rights[j], hr[i], hr[j])
        return (rights[i][e : e + 1] > rights[j][e : e + 1]) - (rights[i][e : e + 1] < rights[j][e : e + 1])

    order = sorted(range(n), key=cmp_to_key(compare))
    lcp = [common_extension(rights[i], rights[j], hr[i], hr[j]) for i, j in zip(order, order[1:], strict=False)]
    if n > FEW:
        return _runs(order, lcp, back, rights, hl, k)
    found: list[set[tuple[int, int]]] = [set() for _ in range(n)]
    for a in range(n):
        reach = 1 << 30
        for b in range(a + 1, n):  # the common extension of two suffixes is the least between them in the order
            reach = min(reach, lcp[b - 1])
            i, j = order[a], order[b]
            if reach + min(len(back[i]), len(back[j])) < k:
                continue
            left = common_extension(back[i], back[j], hl[i], hl[j])
            if left + reach >= k:
                found[max(i, j)].add((left, reach))
    return [sorted(x) for x in found]


def _runs(order: list[int], lcp: list[int], back: list[bytes], rights: list[bytes], hl: list[memoryview], k: int) -> list[list[tuple[int, int]]]:
    """The same spans for many suffixes, in time linear in them: for each number of bytes to the left, those of a run that agree
    on the rest of the window, told apart by the hash of the bytes to the left."""
    n = len(order)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    run = [0] * n
    for d in range(max(map(len, back)) + 1):
        need, now = k - d, 0
        for r, i in enumerate(order):
            if r and lcp[r - 1] < need:
                now += 1
            run[i] = now
        firsts: dict[tuple[int, int], list[int]] = {}
        for i in range(n):
            if len(back[i]) < d or len(rights[i]) < need:
                continue
            same = firsts.setdefault((run[i], hl[i][d]), [])
            if not any(back[i][:d] == back[j][:d] for j in same):  # the first, or one hash of two strings
                same.append(i)
            elif (own := found[i]) and own[-1][0] == d - 1:  # one more to the left
                own[-1] = d, own[-1][1]
            else:
                own.append((d, need))
    return found


def _finish(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for d, h, t, spans, copy in zip(*(b.column(c).to_pylist() for c in ("_d", "_h", "text", "spans", "copy")), strict=True):
            t = t.encode()
            runs = [(0, len(t))] if copy and len(t) >= k else merged([(x["s"], x["e"]) for x in spans or ()])
            kept, at = hashlib.sha256(), 0
            for s, e in runs:
                kept.update(t[at:s])
                at = e
            kept.update(t[at:])
            out.append((d, h, len(t), sum(e - s for s, e in runs), len(runs), kept.hexdigest(), [{"start": s, "end": e} for s, e in runs]))
        if out:
            kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), kinds, strict=True)], ["_d", "_h", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def suffix_dedup(docs: DataFrame, min_bytes: int = 100, anchor_bytes: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans of every row."""
    k, m = min_bytes, min(anchor_bytes, min_bytes)
    found = repeated_spans(docs, k, m, False, group_spans, id_col, text_col)
    spans = "array<struct<start:int,end:int>>"
    return with_id(found.mapInArrow(lambda it: _finish(it, k), f"_d long, _h long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {spans}"))

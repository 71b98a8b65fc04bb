"""Operator 8, substring dedup: repeated word sequences, removed after their first start.

Method: relative Lempel-Ziv parsing. The reference is cut into blocks, the words around each content-chosen anchor
(varloom.llm.repeats) that stands in the corpus twice or more, and dealt out by anchor. Blocks of
an anchor are taken in corpus order: each is parsed greedily, from its left end, against the index of
every block before it (their windows of k words over the anchor), and then indexed itself. A window
that the index has is grown along the reference block to the longest common factor; the parse goes
on at the factor's boundary, with the first window that reaches beyond it, and a window that is
not there moves it on by a word. So windows that straddle two factors are looked up too, and factors,
all of k words or more, are the duplicate spans. Every window of k words holds an anchor, so
the blocks' factors together are those of the whole document. Work is linear in the blocks.

Nulls and empty texts have no words. Rows with the same id and text are one document and get the
same result; a null id counts as the smallest. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from varloom.llm._common import with_id
from varloom.llm.repeats import merged, repeated_spans, split_words


def group_factors(groups: list[tuple[list, list]], k: int) -> list[list[list[tuple[int, int]]]]:
    return [factor_spans(lefts, rights, k) for lefts, rights in groups]


def factor_spans(lefts: list[list[bytes]], rights: list[list[bytes]], k: int) -> list[list[tuple[int, int]]]:
    """Parses each block (the words left and right of an anchor), in corpus order, against those before it: its
    factors of k or more words, as words left and right of the anchor's start."""
    index: dict[tuple, int] = {}
    blocks = [left + right for left, right in zip(lefts, rights, strict=True)]
    out: list[list[tuple[int, int]]] = []
    for i, block in enumerate(blocks):
        own: list[tuple[int, int]] = []
        at, boundary = len(lefts[i]), 0
        for s in range(min(at, len(block) - k) + 1):
            if s + k <= boundary:  # inside the last factor, so the index has it
                continue
            j = index.setdefault((at - s, *block[s : s + k]), i)
            if j == i:
                continue
            shift, e = len(lefts[j]) - at, s + k
            most = min(len(block), len(blocks[j]) - shift)
            while e < most and block[e] == blocks[j][e + shift]:
                e += 1
            own.append((at - s, e - at))
            boundary = e
        out.append(own)
    return out


def _finish(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for d, h, t, spans, copy in zip(*(b.column(c).to_pylist() for c in ("_d", "_h", "text", "spans", "copy")), strict=True):
            t = t.encode()
            w = split_words(t)
            runs = [(0, len(w))] if copy and len(w) >= k else merged([(x["s"], x["e"]) for x in spans or ()])
            kept, at = [], 0
            for s, e in runs:
                kept += w[at:s]
                at = e
            kept += w[at:]
            out.append((d, h, len(w), sum(e - s for s, e in runs), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"start": s, "end": e} for s, e in runs]))
        if out:
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*out, strict=True), kinds, strict=True)], ["_d", "_h", "n_words", "n_removed", "kept_sha256", "spans"])


def substring_dedup(docs: DataFrame, min_words: int = 20, anchor_words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed word spans of every row."""
    k, m = min_words, min(anchor_words, min_words)
    found = repeated_spans(docs, k, m, True, group_factors, id_col, text_col)
    spans = "array<struct<start:int,end:int>>"
    return with_id(found.mapInArrow(lambda it: _finish(it, k), f"_d long, _h long, n_words long, n_removed long, kept_sha256 string, spans {spans}"))

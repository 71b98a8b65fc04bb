"""Operator 11, periodic run detection: stretches of words that repeat with a short period, and the text without the repeats.

Method: a harmonic grid. A run of period p and at least four periods holds two neighbours x and x + p for some x among
0, 3p, 6p, ... of its document, so these points of all periods up to a quarter of the words, about n log n / 3 in all, are
all that has to be looked at. The longest common extensions of x and x + p to both sides are found for all pairs
(period, grid point) of a batch at once, by binary search over prefix hashes of the word numbers, in numpy. Word numbers are exact (Arrow's
dictionary of the batch); the hash is a polynomial modulo the prime 2**31 - 1. A hash can only overstate an extension, so no run is lost,
and each is verified on the words. A run is found again by the multiples of its period; of equal stretches the smallest
period stays.

Documents are judged one by one in the task that reads them: no shuffle. Pairs are taken in blocks of MOST_PAIRS, so memory
follows a document's own length, not its periods. Nulls and empty texts have no words and no runs. Every row gives one row, so ties
and repeated rows give equal ones; a null id stays null; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm._common import chunks, mix, split_words, text_buffers

PRIME = np.uint64(2**31 - 1)
#: Base of the polynomial hash.
BASE = 1_103_515_245
#: Pairs (period, grid point) looked at together.
MOST_PAIRS = 1 << 20


def powers(n: int) -> np.ndarray:
    """BASE**i modulo PRIME for i < n, by doubling."""
    out = np.ones(n, np.uint64)
    size, step = 1, BASE % int(PRIME)
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * np.uint64(step) % PRIME
        size, step = size + more, step * step % int(PRIME)
    return out


class Words:
    """Prefix hashes over the word numbers of a batch."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.numbers = numbers
        self.power = powers(len(numbers) + 1)
        self.sums = np.zeros(len(numbers) + 1, np.uint64)
        np.cumsum(mix(numbers.astype(np.uint64) + np.uint64(1)) % PRIME * self.power[:-1] % PRIME, out=self.sums[1:])
        self.sums %= PRIME

    def same(self, x: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from x on hash like those from x + p on."""
        c = self.sums
        left = (c[x + n] + PRIME - c[x]) % PRIME * self.power[p] % PRIME
        return left == (c[x + p + n] + PRIME - c[x + p]) % PRIME

    def extension(self, x: np.ndarray, p: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from x on (back: before x) agree with those p words further, at most so many; for all pairs at once."""
        lo, hi = np.zeros(len(x), np.int64), most.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_] + 1) >> 1
            ok = self.same(x[open_] - mid if back else x[open_], p[open_], mid)
            lo[open_[ok]] = mid[ok]
            hi[open_[~ok]] = mid[~ok] - 1
        return lo

    def agree(self, start: int, end: int, p: int) -> bool:
        return bool(np.array_equal(self.numbers[start : end - p], self.numbers[start + p : end]))


def candidates(words: Words, first: np.ndarray, times: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, start, end, period) of what the hashes take for runs. first: each document's first word, and the number of words."""
    n = np.diff(first)
    most = np.where(n >= least, n // times, 0)
    doc = np.repeat(np.arange(len(n)), most)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(most) - most, most) + 1
    step = (times - 1) * period
    points = -((period - n[doc]) // step)  # grid points x with x + period inside the document
    ends = np.cumsum(points)
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_PAIRS, side="right")))
        row = np.repeat(np.arange(at, to), points[at:to])
        k = np.arange(len(row)) - np.repeat(np.cumsum(points[at:to]) - points[at:to], points[at:to])
        x = first[doc[row]] + step[row] * k
        hit = words.numbers[x] == words.numbers[x + period[row]]
        row, x = row[hit], x[hit]
        p, s, e = period[row], first[doc[row]], first[doc[row] + 1]
        start, end = x - words.extension(x, p, x - s, True), x + p + words.extension(x, p, e - x - p, False)
        long = np.flatnonzero(end - start >= np.maximum(least, times * p))
        order = long[np.lexsort((end[long], start[long], row[long]))]
        same = (np.diff(row[order]) == 0) & (np.diff(start[order]) == 0) & (np.diff(end[order]) == 0)
        order = order[np.concatenate([[True], ~same])] if len(order) else order  # once, though several grid points find it
        yield doc[row[order]], start[order], end[order], p[order]
        at = to


def runs_of(words: Words, first: np.ndarray, times: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Each document's runs (start, end, period) by start, then period; word numbers of the batch."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in first[1:]]
    parts = list(candidates(words, first, times, least))
    if not parts:
        return out
    doc, start, end, period = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((period, end, start))
    known: dict[tuple[int, int], int] = {}
    again: list[tuple[int, int, int, int]] = []
    for d, s, e, p in zip(*(x[order].tolist() for x in (doc, start, end, period)), strict=True):
        q = known.get((s, e))
        if q and p % q == 0:  # a multiple of the period of a verified run
            continue
        if not words.agree(s, e, p):
            again.append((d, s, e, p))
        elif not q:
            known[s, e] = p
            out[d].append((s, e, p))
    for d, s, e, p in again:  # one hash of different words: the stretches of that period, word by word
        lo, hi = int(first[d]), int(first[d + 1])
        same = np.concatenate([[0], (words.numbers[lo : hi - p] == words.numbers[lo + p : hi]).astype(np.int8), [0]])
        edges = np.flatnonzero(np.diff(same))
        for a, b in zip((edges[::2] + lo).tolist(), (edges[1::2] + lo + p).tolist(), strict=True):
            if a < e and b > s and b - a >= max(least, times * p) and (known.get((a, b)) or p + 1) > p:
                if (a, b) in known:
                    out[d].remove((a, b, known[a, b]))
                known[a, b] = p
                out[d].append((a, b, p))
    for x in out:
        x.sort(key=lambda r: (r[0], r[2]))
    return out


def _periods(batches: Iterator[pa.RecordBatch], times: int, least: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for b in batches:
        texts = pc.fill_null(b.column(1), "")
        for i, j in chunks(text_buffers(texts)[0]):
            flat, first = split_words(texts.slice(i, j - i))
            numbers = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
            found = runs_of(Words(numbers), first, times, least) if len(flat) else [[]] * (j - i)
            kept = np.ones(len(flat), bool)
            for runs in found:
                for s, e, p in runs:
                    kept[s + p : e] = False
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)])[first].astype(np.int32)), flat.filter(pa.array(kept)).cast(pa.string()))
            runs = [[{"start": s - f, "length": e - s, "period": p} for s, e, p in x] for x, f in zip(found, first.tolist(), strict=False)]
            cols = [b.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.array(runs, kind), pc.binary_join(rest, " ")]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, times: int = 4, least: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the text without what runs repeat, of every row.

    A run: a stretch of words with smallest period p, of at least `times` (2 or more) periods and `least` words, that cannot be extended. Its
    first period stays in `collapsed`, unless another run repeats that."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(lambda it: _periods(it, times, least), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")

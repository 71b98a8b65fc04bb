"""Gap-excision alignment of two sequences that share flanks (published in Bioinformatics 2011;27:595-603)
and plain local alignment, one pair per row. Pairs are dealt over tasks by a hash; within a task they are
sorted by size, and pairs of similar lengths go through the recurrence together, a row of all their matrices at a time, and are traced
back together, a step at a time.

Both flanks are scored by local alignment matrices, one from the start and one from the end. The
excised region is where the best prefix of one joins the best suffix of the other, for two regions:
score = max over i1 < i2, j1 < j2 of F[i1, j1] + R[i2, j2].
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CODE = np.zeros(256, np.int8)
for _i, _b in enumerate("ACGT", 1):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i
_CODE[ord("U")] = _CODE[ord("u")] = 4
#: Base codes as bytes; what does not score never equals what does not score in the other table.
_PLAIN = tuple(bytes(c or other for c in _CODE.tolist()) for other in (8, 9))
_TURN = str.maketrans("ACGTUacgtu", "TGCAAtgcaa")


@dataclass(frozen=True)
class Scores:
    """Gap is the cost of a gap's first base, extend of each further one."""

    match: int = 1
    mismatch: int = -1
    gap: int = -10
    extend: int = -1


def turned(s: str) -> str:
    return s.translate(_TURN)[::-1]


def codes(strings: list[str]) -> np.ndarray:
    """Strings of one length as rows of base codes."""
    return _CODE[np.frombuffer("".join(strings).encode("ascii", "replace"), np.uint8)].reshape(len(strings), -1)


def tables(x: np.ndarray, y: np.ndarray, sc: Scores) -> np.ndarray:
    """Per pair (rows of codes) the local alignment scores F[i, j] of what ends at a[:i], b[:j]. A row of all tables at a
    time; gaps along the row by a running maximum. The way back is read off the scores."""
    (pairs, n), m = x.shape, y.shape[1]
    score = np.zeros((pairs, n + 1, m + 1), np.int32)
    against = np.stack([np.where((c > 0) & (y > 0), np.where(y == c, sc.match, sc.mismatch), 0) for c in range(5)]).astype(np.int32)
    number, steps = np.arange(pairs), np.arange(m, dtype=np.int32) * sc.extend
    up = np.full((pairs, m + 1), -(10**8), np.int32)
    best, opened, left = np.zeros_like(up), np.empty_like(up), np.empty((pairs, m), np.int32)
    for i in range(1, n + 1):
        before = score[:, i - 1]
        up += sc.extend
        np.add(before, sc.gap, out=opened)
        np.maximum(up, opened, out=up)
        np.add(before[:, :-1], against[x[:, i - 1], number], out=best[:, 1:])
        np.maximum(best, up, out=best)
        np.maximum(best, 0, out=best)
        best[:, 0] = 0
        np.subtract(best[:, :-1], steps, out=left)
        np.maximum.accumulate(left, 1, out=left)
        left += steps
        left += sc.gap
        np.maximum(best[:, 1:], left, out=score[:, i, 1:])
    return score


def trace(score: np.ndarray, x: np.ndarray, y: np.ndarray, i: int, j: int, sc: Scores, gaps_first: bool = False, top: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Aligned columns (1-based positions, 0 for a gap) that end at i, j, from left to right; a column before a gap up (in b),
    that before one to the left; gaps_first: the column last of them, so gaps stand as near to i, j as they can. x, y: the pair's codes.
    top: the best score at or before each cell, by which cells that no gap can lead to are told without looking for one."""
    out = []
    bound = top is not None and sc.extend <= 0
    a, b = x.tolist(), y.tolist()
    while i and j and (here := int(score[i, j])) > 0:
        c, d = a[i - 1], b[j - 1]
        column = score[i - 1, j - 1] + ((sc.match if c == d else sc.mismatch) if c and d else 0) == here
        if column and not gaps_first:
            out.append((i, j))
            i, j = i - 1, j - 1
            continue
        if column and bound and top[i - 1, j] + sc.gap < here and top[i, j - 1] + sc.gap < here:
            out.append((i, j))
            i, j = i - 1, j - 1
            continue
        ups = np.flatnonzero(score[:i, j][::-1] + (sc.gap + np.arange(i) * sc.extend) == here)
        if len(ups):
            k = int(ups[0]) + 1
            out += [(i - q, 0) for q in range(k)]
            i -= k
            continue
        lefts = np.flatnonzero(score[i, :j][::-1] + (sc.gap + np.arange(j) * sc.extend) == here)
        if len(lefts):
            k = int(lefts[0]) + 1
            out += [(0, j - q) for q in range(k)]
            j -= k
        else:
            out.append((i, j))
            i, j = i - 1, j - 1
    return out[::-1]


def _best_prefix(f: np.ndarray) -> np.ndarray:
    """The best score at or before each cell, per pair."""
    out = np.maximum.accumulate(f, 1)
    return np.maximum.accumulate(out, 2, out=out)


#: Breakpoints looked for from either side.
MOST_BREAKPOINTS = 50


def alternatives(f: np.ndarray, r: np.ndarray, most: int = MOST_BREAKPOINTS, tops: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int, int]]:
    """The joins of the best score, as the left fragment's last places and the right one's first, of a and b: up to so many by left ends
    from the start on, then as many by right starts from the end on. A join whose two sides are as far apart as those of an earlier one is
    that one moved along a homology, and dropped. r: scores of the sequences read backwards. tops: the best score at or before each cell of either."""
    f, r = (t.astype(np.int32) for t in (f, r))
    tops = tuple(t.astype(np.int32) for t in tops or (_best_prefix(f[None])[0], _best_prefix(r[None])[0]))
    sides = []
    for score, top in zip((f, r), tops, strict=True):
        i, j = np.nonzero((score == top) & (score > 0))
        here = score[i, j]
        sides.append((i, j, here, (here > top[i - 1, j]) & (here > top[i, j - 1])))
    return _alternatives(sides, tops, int((tops[0] + tops[1][::-1, ::-1]).max()), most)


def _alternatives(sides: list[tuple[np.ndarray, ...]], tops: tuple[np.ndarray, np.ndarray], best: int, most: int = MOST_BREAKPOINTS) -> list[tuple[int, int, int, int]]:
    """alternatives() by either side's cells above 0 that have the best score at or before them: row, col, score and whether it raises that."""
    n, m = tops[0].shape[0] - 1, tops[0].shape[1] - 1
    out: list[tuple[int, int, int, int]] = []
    moves: set[tuple[int, int]] = set()

    def search(one: int) -> Iterator[tuple[int, int, int, int]]:
        """Where side `one` ends, and how many last places of a and b the part of the other takes; ends are cells that raise the best score so far."""
        if best <= 0:
            return
        (row, col, value, raises), (o_row, o_col, o_value, _), other_top = sides[one], sides[1 - one], tops[1 - one]
        i, j, here = (np.concatenate([[0], v[raises]]).astype(np.int64) for v in (row, col, value))
        keep = here + other_top[n - i, m - j].astype(np.int64) == best
        i, j = i[keep], j[keep]
        order = np.lexsort((i, j))  # along a, then b
        for i, j in zip(i[order].tolist(), j[order].tolist(), strict=True):
            p, q = n - i, m - j
            if (want := other_top[p, q]) > 0:  # the last cell of that score
                on = np.flatnonzero((o_value == want) & (o_row <= p) & (o_col <= q))
                on = on[np.lexsort((o_row[on], -o_row[on] - o_col[on]))[0]]
                p, q = int(o_row[on]), int(o_col[on])
            yield i, j, p, q

    def add(joins: Iterator[tuple[int, int, int, int]]) -> None:
        added = 0
        for i, j, k, q in joins:
            i, j = (0, 0) if 0 in (i, j) else (i, j)
            k, q = (n + 1, m + 1) if k == n + 1 or q == m + 1 else (k, q)
            if (move := (k - i, q - j)) not in moves:
                moves.add(move)
                out.append((i, j, k, q))
                if (added := added + 1) == most:
                    return

    add((i, j, n + 1 - k, m + 1 - q) for i, j, k, q in search(0))
    add((k, q, n + 1 - i, m + 1 - j) for i, j, k, q in search(1))
    return out


def _where(f: np.ndarray, i: int, j: int, top: np.ndarray | None = None) -> tuple[int, int]:
    """The last cell up to (i, j) that has the best score up to there. top: the best score at or before each cell."""
    part = f[: i + 1, : j + 1]
    rows, cols = np.divmod(np.flatnonzero(part == (part.max() if top is None else top[i, j])), j + 1)
    k = (rows + cols).argmax()
    return int(rows[k]), int(cols[k])


def identity(columns: list[tuple[int, int]], a: str, b: str) -> tuple[int, int, int]:
    """(columns, identical, per cent)."""
    u, v = (x.encode("ascii", "replace").translate(t) for x, t in ((a, _PLAIN[0]), (b, _PLAIN[1])))
    same = sum(1 for i, j in columns if i and j and u[i - 1] == v[j - 1])
    return len(columns), same, int(100 * same / len(columns) + 0.5) if columns else 0


def _same(a: str, i: int, j: int) -> bool:
    return _CODE[ord(a[i])] == _CODE[ord(a[j])] > 0


def homology_at(a: str, i: int, j: int) -> tuple[int, int]:
    """How many bases on that a breakpoint pair may move to the left and to the right: equal bases before and from places
    i < j (from 0) on."""
    back = ahead = 0
    if i < j:
        while back < i and _same(a, i - 1 - back, j - 1 - back):
            back += 1
        while j + ahead < len(a) and _same(a, i + ahead, j + ahead):
            ahead += 1
    return back, ahead


def homology_of(x: str, y: str) -> int:
    """The longest end of x that y begins with (scored bases only)."""
    return _longest(*(s.encode("ascii", "replace").translate(t) for s, t in ((x, _PLAIN[0]), (y, _PLAIN[1]))))


def excised_range(left_end: int, right_start: int, mode: str = "indel") -> tuple[int, int]:
    """First and last excised place between a fragment's end and the next one's start."""
    return {"indel": (left_end + 1, right_start - 1), "tdup": (right_start, left_end), "invl": (left_end + 1, right_start), "invr": (left_end, right_start - 1)}[mode]


def breakpoints(a: str, left_end: int, right_start: int) -> dict:
    """G07, G08, indel mode: homology at, outside and inside the breakpoints of one sequence, and the hulls of where its
    first and its last excised place may lie (0, 0 without homology)."""
    found = homologies(a, left_end, right_start)
    out = {k: found[k][0] for k in found} | {"start_lo": 0, "start_hi": 0, "end_lo": 0, "end_hi": 0}
    spans = [v[1:] for v in found.values() if v[0]]
    if spans:
        lo1, hi1, lo2, hi2 = zip(*spans, strict=True)
        out |= {"start_lo": min(lo1), "start_hi": max(hi1), "end_lo": min(lo2), "end_hi": max(hi2)}
    return out


def homologies(a: str, left_end: int, right_start: int) -> dict[str, tuple[int, ...]]:
    """At, outside and inside the breakpoints: how many bases agree, and the first and last place of either run of them."""
    s, e = excised_range(left_end, right_start)
    out: dict[str, tuple[int, ...]] = {"at": (0,), "outside": (0,), "inside": (0,)}
    if s - 1 < right_start - 1:
        back, ahead = homology_at(a, s - 1, right_start - 1)
        if back + ahead:
            out["at"] = back + ahead, s - back, s + ahead - 1, right_start - back, right_start + ahead - 1
    if left_end < right_start and (n := homology_of(a[:left_end], a[right_start - 1 :])):
        out["outside"] = n, left_end - n + 1, left_end, right_start, right_start + n - 1
    if s < e:
        half = (e - s + 1) // 2
        if n := homology_of(a[e - half : e], a[s - 1 : s - 1 + half]):
            out["inside"] = n, s, s + n - 1, e - n + 1, e
    return out


def excise(a: str, b: str, sc: Scores) -> dict | None:
    """excised() of one pair."""
    return excised([a], [b], sc)[0]


def report(left: list, right: list, a: str, b: str, score: int, breaks: bool = True) -> dict:
    ends = lambda cols, k: ([c[k] for c in cols if c[k]] or [0])
    out = {"score": score, "strand": "+"}
    for name, cols in (("left", left), ("right", right)):
        for k, s in enumerate("ab"):
            out[f"{name}_{s}_start"], out[f"{name}_{s}_end"] = ends(cols, k)[0], ends(cols, k)[-1]
        out[f"{name}_len"], out[f"{name}_same"], out[f"{name}_pct"] = identity(cols, a, b)
    out["aligned"], out["same"], out["pct"] = identity([*left, *right], a, b)
    for s, x in (("a", a), ("b", b)):
        found = breakpoints(x, out[f"left_{s}_end"], out[f"right_{s}_start"]) if left and right and breaks else {}
        out |= {f"{s}_{k}": found.get(k, 0) for k in BREAKS}
    return out


def excise_turned(a: str, b: str, sc: Scores, mode: str) -> dict | None:
    """Inversions (one fragment on the other strand of a) and tandem duplications (the right fragment
    begins before the left one ends), as joins of a prefix of b with its suffix: score = max over j of the best
    fragment ending at or before j and the best one starting after it."""
    if not a or not b:
        return None
    found = []
    for first, second in {"tdup": [(a, a)], "inv": [(a, turned(a)), (turned(a), a)], "invl": [(a, turned(a))], "invr": [(turned(a), a)]}[mode]:
        x, z, y = (codes([v])[0] for v in (first, second, b))
        f, r = tables(np.stack([x, z[::-1]]), np.stack([y, y[::-1]]), sc)
        f_best, r_best = np.maximum.accumulate(f.max(0)), np.maximum.accumulate(r.max(0))[::-1]
        total = f_best + r_best
        j = int(total.argmax())
        fj = int(np.flatnonzero(f.max(0)[: j + 1] == f_best[j])[-1])
        rj = int(np.flatnonzero(r.max(0)[: len(b) - j + 1] == r_best[j])[-1])
        left = trace(f, x, y, int(f[:, fj].argmax()), fj, sc)
        right = [(len(a) + 1 - p if p else 0, len(b) + 1 - q if q else 0) for p, q in reversed(trace(r, z[::-1], y[::-1], int(r[:, rj].argmax()), rj, sc))]
        one = report(left, right, first, b, int(total[j]), False)
        ln, ls, _ = identity(left, first, b)
        rn, rs, _ = identity(right, second, b)
        one |= {"left_same": ls, "right_same": rs, "same": ls + rs, "aligned": ln + rn, "pct": int(100 * (ls + rs) / max(1, ln + rn) + 0.5)}
        for name, s in (("left", first), ("right", second)):  # coordinates on the strand that was given
            if s != a:
                for e in ("start", "end"):
                    if p := one[f"{name}_a_{e}"]:
                        one[f"{name}_a_{e}"] = len(a) + 1 - p
        found.append(one)
    return max(found, key=lambda x: x["score"])


BREAKS = ["at", "outside", "inside", "start_lo", "start_hi", "end_lo", "end_hi"]
FIELDS = ["score", *(f"{n}_{s}_{e}" for n in ("left", "right") for s in "ab" for e in ("start", "end")), *(f"{n}_{x}" for n in ("left", "right") for x in ("len", "same", "pct")), "aligned", "same", "pct", *(f"{s}_{k}" for s in "ab" for k in BREAKS)]
RESULT = ", ".join(f"{f} int" for f in FIELDS) + ", strand string"


#: Cells of the matrices of pairs that go through the recurrence together, at most (or one pair's), those of a step, which should stay in the
#: cache, and how much of them may be padding.
LANE_CELLS, STEP_CELLS, PADDING = 16_000_000, 40_000, 0.25
#: Lanes from which on steps of all of them take less time than each by itself, and the columns of a step.
LEAST_LANES, COLUMNS = 8, 16


def similar(a: list[str], b: list[str], tables: int = 2) -> Iterator[list[int]]:
    """Numbers of the pairs in groups of similar lengths, bounded by LANE_CELLS and STEP_CELLS for so many tables a pair."""
    order = sorted(range(len(a)), key=lambda i: (int(12 * log2(len(a[i]) + 8)), len(b[i])))
    held: list[int] = []
    n = m = own = 0
    for i in order:
        p, q = len(a[i]), len(b[i])
        cells, wide, high = own + (p + 1) * (q + 1), max(n, p), max(m, q)
        padded = (len(held) + 1) * (wide + 1) * (high + 1)
        step = (len(held) + 1) * tables * (min(wide, high) + 1)
        if held and (padded * tables > LANE_CELLS or step > STEP_CELLS or padded > (1 + PADDING) * cells):
            yield held
            held, cells, wide, high = [], (p + 1) * (q + 1), p, q
        held.append(i)
        n, m, own = wide, high, cells
    if held:
        yield held


def _lanes(strings: list[str]) -> np.ndarray:
    """Base codes, a column for each string; shorter ones end in places that do not score. Such places raise no score and come last, so the first
    best cell, and all before it, are as without them; read backwards they come first and score 0."""
    size = max(map(len, strings))
    return np.ascontiguousarray(codes([s.ljust(size) for s in strings]).T)


_SPACE: dict[str, np.ndarray] = {}
#: Bytes of such an array that are kept; of larger ones only what is written to takes memory.
MOST_SPACE = 1 << 28


def _space(name: str, shape: tuple[int, ...], kind: type) -> np.ndarray:
    """An array over memory that the next call of that name takes again: fresh pages for each group cost more than the recurrence."""
    size = int(np.prod(shape)) * np.dtype(kind).itemsize
    if size > MOST_SPACE:
        return np.empty(shape, kind)
    if name not in _SPACE or _SPACE[name].nbytes < size:
        _SPACE[name] = np.empty(size, np.uint8)
    return _SPACE[name][:size].view(kind).reshape(shape)


class Records:
    """Cells whose score is the best at or before them, and above 0, of all lanes: row, col, lane, value and whether they raise it. `whole` is False
    where a group has so many (repeats of one base) that they are not kept."""

    def __init__(self) -> None:
        self.held: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.count, self.whole = 0, True

    def add(self, diagonal: int, first: int, at: np.ndarray, value: np.ndarray, before: np.ndarray, most: int) -> None:
        self.count += len(at)
        if self.count > most:
            self.held, self.whole = [], False
        if self.whole:
            self.held.append((diagonal, first, at, value, value > before))

    def close(self, lanes: int, turned: bool) -> None:
        """To arrays. turned: the diagonals went along the second sequence."""
        sizes = [len(h[2]) for h in self.held]
        at, value, self.raises = (np.concatenate([h[k] for h in self.held]) if self.held else np.zeros(0, bool) for k in (2, 3, 4))
        diagonal, first = (np.repeat(np.array([h[k] for h in self.held], np.int32), sizes) for k in (0, 1))
        own, self.lane = np.divmod(at.astype(np.int32), np.int32(lanes))
        own += first
        self.row, self.col = (diagonal - own, own) if turned else (own, diagonal - own)
        self.value, self.held, self.lanes, self.edges = value.astype(np.int32), [], lanes, None

    def of(self, lane: int) -> np.ndarray:
        """Numbers of a lane's records."""
        if self.edges is None:
            self.order = np.argsort(self.lane, kind="stable")
            self.edges = np.searchsorted(self.lane[self.order], np.arange(self.lanes + 1)).tolist()
        return self.order[self.edges[lane] : self.edges[lane + 1]]


#: Records of a group that are kept, as a part of its cells.
MOST_RECORDS = 0.125


def lane_tables(x: np.ndarray, y: np.ndarray, sc: Scores, tops: bool = True, records: Records | None = None) -> tuple[np.ndarray, np.ndarray]:
    """tables() with the pairs along the last axis, and the best score at or before each cell (G02). Cells of one anti-diagonal don't hang on each
    other, so an anti-diagonal of all pairs' tables is a step, along the shorter sequence; it is stored as a row, and what is given back are views by place. records: filled."""
    turned = len(x) > len(y)
    u, v = (y, x) if turned else (x, y)
    (n, lanes), m = u.shape, v.shape[0]
    # scores lie between 0 and the best one, and what a step takes off them is taken off once
    most, off = max(sc.match, sc.mismatch, 0) * n + max(sc.gap, sc.extend, 0) * (n + m), abs(sc.match) + abs(sc.mismatch) + abs(sc.gap) + abs(sc.extend)
    kind = next(t for t, bound in ((np.int8, 60), (np.int16, 15_000), (np.int32, 10**9)) if max(most, off) <= bound)
    small = kind if off > 60 else np.int8
    score = _space("score", (n + m + 1, n + 1, lanes), kind)
    top = _space("top", (n + m + 1, n + 1, lanes), kind) if tops else score
    for t in (score, top):
        t[: m + 1, 0] = 0
        t[np.arange(n + 1), np.arange(n + 1)] = 0
    v = v[::-1]
    # what does not score is like nothing; a pair of bases costs the mismatch, which the gain takes back
    u_code, v_code = np.where(u > 0, u, 8).astype(np.int8), np.where(v > 0, v, 9).astype(np.int8)
    u_cost, v_cost = ((t > 0) * small(sc.mismatch) for t in (u, v))
    both = np.maximum if sc.mismatch <= 0 else np.minimum
    gain, gap, extend = small(sc.match - sc.mismatch), kind(sc.gap), kind(sc.extend)
    least = kind(sc.gap - abs(sc.extend))  # less than any gap that has just been opened
    # gaps in v by the place in v, from its end on; gaps in u by the place in u
    over_u, over_v = np.full((m + 1, lanes), least, kind), np.full((n + 1, lanes), least, kind)
    opened, run, like, add, cost = np.empty((n + 1, lanes), kind), np.empty((n + 1, lanes), kind), np.empty((n, lanes), bool), np.empty((n, lanes), small), np.empty((n, lanes), small)
    wide, none = np.empty((n, lanes), kind), np.zeros((n, lanes), kind)
    # a gap along y is opened from cells that no such gap leads to; where opening costs no less than going on, that is all the same
    alike = sc.gap <= sc.extend
    plain = None if alike else np.zeros((n + m + 1, n + 1, lanes), kind)
    most_records = int(MOST_RECORDS * (n + 1) * (m + 1) * lanes) + 1_000
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        if lo > hi:
            continue
        k, p, q = hi - lo + 1, m - d + lo, m - d + hi + 1
        before = opened[: k + 1]
        np.add(score[d - 1, lo - 1 : hi + 1], gap, out=before)
        one, two = over_u[p:q], over_v[lo : hi + 1]
        one += extend
        two += extend
        if alike:
            np.maximum(one, before[:-1], out=one)
            np.maximum(two, before[1:], out=two)
        else:
            fresh = plain[d - 1, lo - 1 : hi + 1] + gap
            np.maximum(one, (fresh if turned else before)[:-1], out=one)
            np.maximum(two, (before if turned else fresh)[1:], out=two)
        alikes, gains = like[:k], add[:k]
        np.equal(u_code[lo - 1 : hi], v_code[p:q], out=alikes)
        np.multiply(alikes.view(np.int8), gain, out=gains)
        gains += both(u_cost[lo - 1 : hi], v_cost[p:q], out=cost[:k])
        here = score[d, lo : hi + 1]
        wide[:k] = gains
        np.add(score[d - 2, lo - 1 : hi], wide[:k], out=here)
        if not alike:
            plain[d, lo : hi + 1] = np.maximum(np.maximum(here, two if turned else one), none[:k])
        np.maximum(here, one, out=here)
        np.maximum(here, two, out=here)
        np.maximum(here, none[:k], out=here)
        if tops:
            best = run[:k]
            np.maximum(top[d - 1, lo - 1 : hi], top[d - 1, lo : hi + 1], out=best)
            np.maximum(here, best, out=top[d, lo : hi + 1])
            if records is not None and records.whole:
                at = np.greater_equal(here, best, out=alikes).reshape(-1).nonzero()[0]
                if len(at):
                    value = here.reshape(-1)[at]
                    if not value.all():
                        at, value = at[value > 0], value[value > 0]
                    records.add(d, lo, at, value, best.reshape(-1)[at], most_records)
    if records is not None:
        records.close(lanes, turned)
    a, b = (n + 2, n + 1) if not turned else (n + 1, n + 2)
    size = score.itemsize * lanes
    return tuple(np.lib.stride_tricks.as_strided(t, (len(x) + 1, len(y) + 1, lanes), (a * size, b * size, t.itemsize)) for t in (score, top))


def _last_best(score: np.ndarray, value: np.ndarray, lane: np.ndarray, i: np.ndarray, j: np.ndarray, records: Records) -> tuple[np.ndarray, np.ndarray]:
    """_where() of lanes: the last cell up to (i, j) that has the value, which is the best one there; (i, j) where that is 0 or less."""
    n, lanes = score.shape[0] - 1, score.shape[2]
    want, i_at, j_at = np.full(lanes, -1), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    want[lane], i_at[lane], j_at[lane] = np.where(value > 0, value, -1), i, j
    if records.whole:
        row, col, on = records.row, records.col, records.lane
        keep = (records.value == want[on]) & (row <= i_at[on]) & (col <= j_at[on])
    else:
        row, col, on = np.nonzero(score == want.astype(score.dtype))
        keep = (row <= i_at[on]) & (col <= j_at[on])
    row, col, on = row[keep], col[keep], on[keep]
    key = np.full(lanes, -1)
    np.maximum.at(key, on, (row + col) * (n + 1) + n - row)
    key = key[lane]
    total, row = np.divmod(key, n + 1)
    row = n - row
    return np.where(key < 0, i, row), np.where(key < 0, j, total - row)


def lane_traces(score: np.ndarray, x: np.ndarray, y: np.ndarray, lane: np.ndarray, i: np.ndarray, j: np.ndarray, sc: Scores, ops: bool = False) -> dict[str, np.ndarray]:
    """trace() of many lanes, a step of all of them at a time: columns, identical ones, the first and last places (0 without), and on demand the
    columns' kinds from the right to the left."""
    if len(lane) < LEAST_LANES:
        rows = []
        for o, p, q in zip(lane.tolist(), i.tolist(), j.tolist(), strict=True):
            cols = trace(score[:, :, o], x[:, o], y[:, o], p, q, sc)
            firsts, seconds = [c for c, _ in cols if c] or [0], [d for _, d in cols if d] or [0]
            same = sum(1 for c, d in cols if c and d and x[c - 1, o] == y[d - 1, o] > 0)
            rows.append((len(cols), same, firsts[0], firsts[-1], seconds[0], seconds[-1], [77 if c and d else 68 if c else 73 for c, d in reversed(cols)]))
        out = {k: np.array([r[n] for r in rows], np.int64) for n, k in enumerate(("len", "same", "a_start", "a_end", "b_start", "b_end"))}
        return out | ({"ops": [np.array(r[6], np.uint8) for r in rows]} if ops else {})
    wide, lanes = score.shape[1], score.shape[2]
    down, along = score.strides[0] // score.itemsize, score.strides[1] // score.itemsize
    flat = np.lib.stride_tricks.as_strided(score, ((score.shape[0] - 1) * down + (wide - 1) * along + lanes,), (score.itemsize,))
    xs, ys = x.reshape(-1), y.reshape(-1)
    i, j, lane = i.astype(np.int64), j.astype(np.int64), lane.astype(np.int64)
    out = {k: np.zeros(len(lane), np.int64) for k in ("len", "same", "a_start", "a_end", "b_start", "b_end")}
    text = np.zeros((len(lane), score.shape[0] + wide), np.uint8) if ops else None

    def took(at: np.ndarray, s: str, p: np.ndarray, last: np.ndarray) -> None:
        out[f"{s}_end"][at] = np.where(out[f"{s}_end"][at] == 0, p, out[f"{s}_end"][at])
        out[f"{s}_start"][at] = last

    def jump(at: np.ndarray, k: np.ndarray, op: str) -> None:
        if text is not None:
            for row, begin, n in zip(at.tolist(), out["len"][at].tolist(), k.tolist()):
                text[row, begin : begin + n] = ord(op)
        out["len"][at] += k

    back, ahead = np.arange(COLUMNS), np.arange(COLUMNS + 1) * (down + along)
    live = np.flatnonzero((i > 0) & (j > 0))
    while len(live):
        p, q, o = i[live], j[live], lane[live]
        at = p * down + q * along + o
        room = np.minimum(p, q)[:, None]
        inside = back < room
        cells = flat[np.maximum(at[:, None] - ahead, 0)]
        c, d = (np.where(inside, v[np.maximum((r[:, None] - 1 - back) * lanes + o[:, None], 0)], 0) for v, r in ((xs, p), (ys, q)))
        same = (c == d) & (c > 0)
        step = np.where(same, sc.match, np.where((c > 0) & (d > 0), sc.mismatch, 0))
        on = inside & (cells[:, :-1] > 0)
        column = on & (cells[:, 1:] + step == cells[:, :-1])
        n = np.where(column.all(1), COLUMNS, column.argmin(1))
        # where a cell has a score, but no column leads to it
        odd = np.flatnonzero((n == 0) & on[:, 0])
        for s in "ab":  # up (in b) first, then to the left; the nearest place
            if not len(odd):
                break
            end, stride = ((p if s == "a" else q)[odd], down if s == "a" else along)
            k = np.arange(1, int(end.max()) + 1)
            near = k <= end[:, None]
            fits = (flat[np.where(near, at[odd][:, None] - k * stride, 0)].astype(np.int64) + (sc.gap + (k - 1) * sc.extend) == cells[odd, :1]) & near
            has = fits.any(1)
            hit, far = odd[has], fits[has].argmax(1) + 1
            took(live[hit], s, end[has], end[has] - far + 1)
            jump(live[hit], far, "D" if s == "a" else "I")
            (i if s == "a" else j)[live[hit]] -= far
            odd = odd[~has]
        n[odd] = 1
        own = np.flatnonzero(n)
        at_own, far = live[own], n[own]
        took(at_own, "a", p[own], p[own] - far + 1)
        took(at_own, "b", q[own], q[own] - far + 1)
        jump(at_own, far, "M")
        out["same"][at_own] += (same[own] & (back < far[:, None])).sum(1)
        i[at_own] -= far
        j[at_own] -= far
        over = (n == 0) & ~on[:, 0]
        live = live[~over & (i[live] > 0) & (j[live] > 0)]
    if text is not None:
        out["ops"] = text
    return out


def _longest(u: bytes, v: bytes) -> int:
    """The longest end of u that v begins with: by the places in u where v's first four begin, then shorter ends."""
    most = min(len(u), len(v))
    seed, at = v[:4], len(u) - most
    while most > 3 and (at := u.find(seed, at)) >= 0:
        if v.startswith(u[at:]):
            return len(u) - at
        at += 1
    return next((n for n in range(min(most, 3), 0, -1) if u.endswith(v[:n])), 0)


def _breaks(u: bytes, v: bytes, left_end: int, right_start: int) -> tuple[int, ...]:
    """breakpoints() of a sequence as plain bytes of either kind, in the order of BREAKS."""
    at = outside = inside = 0
    lo1, hi1, lo2, hi2 = [], [], [], []
    s, e, size = left_end + 1, right_start - 1, len(u)
    if left_end < e:
        back = ahead = 0
        while back < left_end and u[left_end - 1 - back] == v[e - 1 - back]:
            back += 1
        while e + ahead < size and u[left_end + ahead] == v[e + ahead]:
            ahead += 1
        if at := back + ahead:
            lo1.append(s - back), hi1.append(s + ahead - 1), lo2.append(right_start - back), hi2.append(right_start + ahead - 1)
    if left_end < right_start and (outside := _longest(u[:left_end], v[e:])):
        lo1.append(left_end - outside + 1), hi1.append(left_end), lo2.append(right_start), hi2.append(right_start + outside - 1)
    if s < e:
        half = (e - s + 1) // 2
        if inside := _longest(u[e - half : e], v[s - 1 : s - 1 + half]):
            lo1.append(s), hi1.append(s + inside - 1), lo2.append(e - inside + 1), hi2.append(e)
    return (at, outside, inside, min(lo1), max(hi1), min(lo2), max(hi2)) if lo1 else (0,) * 7


class Swept:
    """Pairs of similar lengths, none of them empty, after the recurrence: the best score, its strand and first place of each, and all tables."""

    def __init__(self, a: list[str], b: list[str], sc: Scores, both: bool = False) -> None:
        self.a, self.b, self.sc, k = a, b, sc, len(a)
        self.turned = [turned(s) for s in b] if both else []
        x, given = _lanes(a), [_lanes(s) for s in ([b, self.turned] if both else [b])]
        # the tables of both directions and strands go through the recurrence together
        self.x = np.concatenate([v for _ in given for v in (x, x[::-1])], 1)
        self.y = np.concatenate([v for y in given for v in (y, y[::-1])], 1)
        self.records = Records()
        self.score, self.top = lane_tables(self.x, self.y, sc, records=self.records)
        n, m = x.shape[0], given[0].shape[0]
        self.best, self.i, self.j, self.minus = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k, bool)
        self.n, self.m = n, m
        for strand, (best, i, j) in enumerate(self._first_joins(len(given))):
            own = np.flatnonzero(best > self.best)
            self.best[own], self.i[own], self.j[own], self.minus[own] = best[own], i[own], j[own], strand == 1
        self.f = np.arange(k) + np.where(self.minus, 2 * k, 0)  # the lane; the one backwards is k lanes on

    def _first_joins(self, strands: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per strand and pair the best score of two fragments and the first place where it is had. There the left one raises the best score so far,
        as otherwise the place before would do, or it is empty and the place is the start."""
        k, n, m, all_ = len(self.a), self.n, self.m, self.records
        for strand in range(strands):
            first, lane = 2 * strand * k, np.arange(k)
            if not all_.whole:
                f, r = (self.top[:, :, first + d * k : first + (d + 1) * k] for d in (0, 1))
                f, r = (t.astype(np.int32) for t in (f, r))
                rows = np.stack([(f[i] + r[n - i, ::-1]).max(0) for i in range(n + 1)])
                i, cells = rows.argmax(0), np.arange(m + 1)
                yield rows[i, lane], i, (f[i[:, None], cells, lane[:, None]] + r[n - i[:, None], m - cells, lane[:, None]]).argmax(1)
                continue
            up = np.flatnonzero(all_.raises & (all_.lane >= first) & (all_.lane < first + k))
            row, col, on = (np.concatenate([np.zeros(k, np.int64), v]) for v in (all_.row[up], all_.col[up], all_.lane[up] - first))
            on[:k] = lane
            total = np.concatenate([np.zeros(k, np.int64), all_.value[up]]) + self.top[n - row, m - col, on + first + k]
            place = row.astype(np.int64) * (m + 1) + col
            key = np.zeros(k, np.int64)
            size = (n + 1) * (m + 1)
            np.maximum.at(key, on, total * size + size - 1 - place)
            best, place = np.divmod(key, size)
            i, j = np.divmod(size - 1 - place, m + 1)
            yield best, i, j

    def aligned(self, k: int) -> str:
        """The second sequence as it was aligned."""
        return self.turned[k] if self.minus[k] else self.b[k]

    def tables(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores of a pair from either end, and the best ones at or before each cell, without padding."""
        f, p, q = int(self.f[k]), self.n - len(self.a[k]), self.m - len(self.b[k])
        one, other = (slice(len(self.a[k]) + 1), slice(len(self.b[k]) + 1), f), (slice(p, None), slice(q, None), f + len(self.a))
        return tuple(v[s] for v in (self.score, self.top) for s in (one, other))

    def joins(self, k: int) -> list[tuple[int, int, int, int]]:
        """alternatives() of a pair."""
        f, r, *tops = self.tables(k)
        if not self.records.whole:
            return alternatives(*(np.ascontiguousarray(t) for t in (f, r)), tops=tuple(np.ascontiguousarray(t) for t in tops))
        p, q, all_ = self.n - len(self.a[k]), self.m - len(self.b[k]), self.records
        sides = []
        for d, (up, left) in enumerate(((0, 0), (p, q))):
            own = all_.of(int(self.f[k]) + d * len(self.a))
            row, col = all_.row[own] - up, all_.col[own] - left
            there = (row <= len(self.a[k])) & (col <= len(self.b[k]))
            sides.append((row[there], col[there], all_.value[own][there], all_.raises[own][there]))
        return _alternatives(sides, tops, int(self.best[k]))

    def ends(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lanes and last cells of the left fragments, then of the right ones, which are read backwards."""
        lanes = np.concatenate([self.f, self.f + len(self.a)])
        i, j = np.concatenate([self.i, self.n - self.i]), np.concatenate([self.j, self.m - self.j])
        return lanes, *_last_best(self.score, self.top[i, j, lanes].astype(np.int64), lanes, i, j, self.records)

    def fields(self) -> dict[str, np.ndarray]:
        """FIELDS of all pairs (where best is above 0)."""
        k, sc = len(self.a), self.sc
        lanes, i, j = self.ends()
        t = lane_traces(self.score, self.x, self.y, lanes, i, j, sc)
        left, right = ({c: v[d * k : (d + 1) * k] for c, v in t.items()} for d in (0, 1))
        per_cent = lambda same, of: (100 * same / np.maximum(of, 1) + 0.5).astype(np.int64) * (of > 0)
        out = {"score": self.best}
        for s, size in (("a", self.n), ("b", self.m)):
            out[f"left_{s}_start"], out[f"left_{s}_end"] = left[f"{s}_start"], left[f"{s}_end"]
            back = lambda v, size=size: np.where(v > 0, size + 1 - v, 0)
            out[f"right_{s}_start"], out[f"right_{s}_end"] = back(right[f"{s}_end"]), back(right[f"{s}_start"])
        for name, side in (("left", left), ("right", right)):
            out |= {f"{name}_len": side["len"], f"{name}_same": side["same"], f"{name}_pct": per_cent(side["same"], side["len"])}
        out["aligned"], out["same"] = left["len"] + right["len"], left["same"] + right["same"]
        out["pct"] = per_cent(out["same"], out["aligned"])
        two = ((left["len"] > 0) & (right["len"] > 0)).tolist()
        for s in "ab":
            ends, starts = out[f"left_{s}_end"].tolist(), out[f"right_{s}_start"].tolist()
            plain = [(self.a[n] if s == "a" else self.aligned(n)).encode("ascii", "replace") if on else b"" for n, on in enumerate(two)]
            found = np.array([_breaks(p.translate(_PLAIN[0]), p.translate(_PLAIN[1]), e, at) if on else (0,) * 7 for p, on, e, at in zip(plain, two, ends, starts, strict=True)]).reshape(k, 7)
            out |= {f"{s}_{c}": found[:, n] for n, c in enumerate(BREAKS)}
        sizes = np.array([len(s) for s in self.b])
        for e in ("left_b_start", "left_b_end", "right_b_start", "right_b_end", "b_start_lo", "b_start_hi", "b_end_lo", "b_end_hi"):
            out[e] = np.where(self.minus & (out[e] > 0), sizes + 1 - out[e], out[e])
        return out


def excised(a: list[str], b: list[str], sc: Scores, both: bool = False, joins: bool = False, columns: bool = False) -> list[dict | None]:
    """G03 to G09, indel mode, of pairs of similar lengths: the two fragments around one excised region, or
    None without a common base. both: on both strands of b the better one, the given strand on ties. joins: with all breakpoints of
    the best score (alternatives). columns: with the fragments' columns and b as it was aligned."""
    out: list[dict | None] = [None] * len(a)
    there = [k for k in range(len(a)) if a[k] and b[k]]
    if not there:
        return out
    swept = Swept([a[k] for k in there], [b[k] for k in there], sc, both)
    fields = None if columns else {c: v.tolist() for c, v in swept.fields().items()}
    _, *ends = swept.ends() if columns else (None,)
    for k in np.flatnonzero(swept.best).tolist():
        strand, one, s = "-" if swept.minus[k] else "+", swept.a[k], swept.aligned(k)
        n, m = len(one), len(s)
        f, r, *tops = swept.tables(k) if columns else (None, None)
        if fields is None:
            x, z = codes([one])[0], codes([s])[0]
            (i, i_back), (j, j_back) = ([int(v[k]), int(v[k + len(there)])] for v in ends)
            left = trace(f, x, z, i, j, sc, True, tops[0])
            # the shorter of a group are padded where they end, so backwards at the start
            right = trace(r, x[::-1], z[::-1], i_back - (swept.n - n), j_back - (swept.m - m), sc, True, tops[1])
            right = [(n + 1 - p if p else 0, m + 1 - q if q else 0) for p, q in reversed(right)]
            got = report(left, right, one, s, int(swept.best[k])) | {"strand": strand, "columns": (left, right), "b": s}
            if strand == "-":
                for e in ("left_b_start", "left_b_end", "right_b_start", "right_b_end", "b_start_lo", "b_start_hi", "b_end_lo", "b_end_hi"):
                    if got[e]:
                        got[e] = m + 1 - got[e]
        else:
            got = {c: v[k] for c, v in fields.items()} | {"strand": strand}
        if joins:
            turn = (lambda p, m=m: m + 1 - p if 0 < p <= m else p) if strand == "-" else (lambda p: p)
            got["joins"] = [(i, turn(j), k2, turn(q)) for i, j, k2, q in swept.joins(k)]
        out[there[k]] = got
    return out


def excised_table(a: list[str], b: list[str], sc: Scores, both: bool = False) -> tuple[dict[str, np.ndarray], np.ndarray, list[str | None]]:
    """gap_excision() of any pairs: FIELDS, which pairs have them, and the strands."""
    fields, there = {c: np.zeros(len(a), np.int32) for c in FIELDS}, np.zeros(len(a), bool)
    strand: list[str | None] = [None] * len(a)
    whole = [k for k in range(len(a)) if a[k] and b[k]]
    x, y = [a[k] for k in whole], [b[k] for k in whole]
    for group in similar(x, y, 4 if both else 2):
        swept = Swept([x[k] for k in group], [y[k] for k in group], sc, both)
        found = np.flatnonzero(swept.best)
        at = np.array([whole[k] for k in group])[found]
        there[at] = True
        for c, v in swept.fields().items():
            fields[c][at] = v[found]
        for k, minus in zip(at.tolist(), swept.minus[found].tolist(), strict=True):
            strand[k] = "-" if minus else "+"
    return fields, there, strand



def align_pair(a: str | None, b: str | None, sc: Scores, mode: str = "indel", both: bool = False) -> dict | None:
    """On both strands the better one, the given strand on ties."""
    if mode == "indel":
        return excised([a or ""], [b or ""], sc, both)[0]
    best = excise_turned(a or "", b or "", sc, mode)
    if both and (other := excise_turned(a or "", turned(b or ""), sc, mode)) and (best is None or other["score"] > best["score"]):
        n = len(b)
        for f in ("left_b_start", "left_b_end", "right_b_start", "right_b_end"):
            if other[f]:
                other[f] = n + 1 - other[f]
        best = other | {"strand": "-"}
    return best


def _dealt(pairs: DataFrame, most_gb: float, tasks: int | None) -> DataFrame:
    """Pairs (pair_id, a, b) without a where they are over the memory guard; dealt by a hash, pairs of one size side by side."""
    cost = F.length("a").cast("long") * F.length("b")
    rows = pairs.select("pair_id", F.when(5.0 * cost / 1e9 + 0.5 <= most_gb, F.col("a")).alias("a"), "b")
    tasks = tasks or rows.sparkSession.sparkContext.defaultParallelism * 4
    return rows.repartition(tasks, F.xxhash64("pair_id")).sortWithinPartitions(F.length("a"), F.length("b"))


def gap_excision(pairs: DataFrame, sc: Scores | None = None, mode: str = "indel", both: bool = False, tasks: int | None = None, most_gb: float = 10.0) -> DataFrame:
    """G01 to G11, with the first best breakpoint (gap_breakpoints has all): pairs (pair_id, a, b) with the fragments found, in indel mode
    also homology and hulls of the breakpoints on either sequence; pairs over the memory guard (P12) have none."""
    sc = sc or Scores()
    kind = dict(pairs.dtypes)["pair_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            a, b = ([x or "" for x in t[c]] for c in "ab")
            if mode == "indel":
                fields, there, strand = excised_table(a, b, sc, both)
                out = pd.DataFrame({f: pd.arrays.IntegerArray(fields[f], ~there) for f in FIELDS})
                out["strand"] = strand
            else:
                found = [align_pair(p, q, sc, mode, both) for p, q in zip(a, b, strict=True)]
                out = pd.DataFrame({f: pd.array([None if r is None else int(r[f]) for r in found], dtype="Int32") for f in FIELDS})
                out["strand"] = [None if r is None else r["strand"] for r in found]
            out.insert(0, "pair_id", t["pair_id"].to_numpy())
            yield out

    return _dealt(pairs, most_gb, tasks).mapInPandas(run, f"pair_id {kind}, {RESULT}")


def gap_breakpoints(pairs: DataFrame, sc: Scores | None = None, both: bool = False, tasks: int | None = None, most_gb: float = 10.0) -> DataFrame:
    """G03, indel mode: all breakpoints of the best score, a row each (n from 0, alternatives() says which): the left fragment's last places
    in either sequence and the right one's first, on the strand that was given; 0 and one beyond the end where there is no fragment."""
    sc = sc or Scores()
    kind = dict(pairs.dtypes)["pair_id"]
    names = ["left_a", "left_b", "right_a", "right_b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            a, b = ([x or "" for x in t[c]] for c in "ab")
            rows = []
            for own in similar(a, b, 4 if both else 2):
                for i, r in zip(own, excised([a[i] for i in own], [b[i] for i in own], sc, both, True), strict=True):
                    rows += [(t["pair_id"].iloc[i], r["strand"], r["score"], n, *join) for n, join in enumerate(r["joins"])] if r else []
            yield pd.DataFrame(rows, columns=["pair_id", "strand", "score", "n", *names])

    return _dealt(pairs, most_gb, tasks).mapInPandas(run, f"pair_id {kind}, strand string, score int, n int, {', '.join(f'{n} int' for n in names)}")


def local_alignment(a: str, b: str, sc: Scores) -> dict:
    """local_alignments() of one pair."""
    return local_alignments([a], [b], sc)[0]


def local_alignments(a: list[str], b: list[str], sc: Scores) -> list[dict]:
    """G13 of pairs of similar lengths: score, second best elsewhere, begin, end and CIGAR of the best local
    alignment."""
    x, y, k = _lanes(a), _lanes(b), np.arange(len(a))
    score, _ = lane_tables(x, y, sc, False)
    n, m = (np.array([len(s) for s in v]) for v in (a, b))
    real = (np.arange(score.shape[1])[:, None] <= m).astype(score.dtype)
    rows = np.stack([(row * real).max(0) for row in score])
    rows *= np.arange(len(rows))[:, None] <= n
    i = rows.argmax(0)
    j = (score[i, :, k] * real.T).argmax(1)
    second = np.where(np.abs(np.arange(len(rows))[:, None] - i) > np.maximum(1, m // 2), rows, 0).max(0)
    t = lane_traces(score, x, y, k, i, j, sc, ops=True)
    cigars = ["".join(f"{len(list(g))}{o}" for o, g in groupby(ops[:size][::-1].tobytes().decode())) for ops, size in zip(t["ops"], t["len"].tolist(), strict=True)]
    first = {s: np.where(t["len"] > 0, t[f"{s}_start"], 0) for s in "ab"}
    names = ["score", "second", "a_start", "a_end", "b_start", "b_end"]
    values = [v.tolist() for v in (rows[i, k], second, first["a"], i, first["b"], j)]
    return [dict(zip(names, row, strict=True)) | {"cigar": c} for *row, c in zip(*values, cigars, strict=True)]


def smith_waterman(pairs: DataFrame, sc: Scores | None = None, tasks: int | None = None, most_gb: float = 10.0) -> DataFrame:
    """G13 for a table of pairs (pair_id, a, b); pairs over the memory guard are aligned as empty."""
    sc = sc or Scores(2, -2, -3, -1)
    kind = dict(pairs.dtypes)["pair_id"]
    names = ["score", "second", "a_start", "a_end", "b_start", "b_end", "cigar"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            a, b = ([x or "" for x in t[c]] for c in "ab")
            found: list[dict] = [{}] * len(a)
            for own in similar(a, b, 1):
                for i, r in zip(own, local_alignments([a[i] for i in own], [b[i] for i in own], sc), strict=True):
                    found[i] = r
            out = pd.DataFrame(found, columns=names)
            out.insert(0, "pair_id", t["pair_id"].to_numpy())
            yield out

    return _dealt(pairs, most_gb, tasks).mapInPandas(run, f"pair_id {kind}, score int, second int, a_start int, a_end int, b_start int, b_end int, cigar string")

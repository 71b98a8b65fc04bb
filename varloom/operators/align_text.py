"""Alignments as text (K05): scores, regions, homology around the breakpoints and the fragments' columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from varloom.operators import align

# Fixed values of the format: columns of a line, and places before them.
WIDTH, MARGIN = 60, 9


def _rows(cols: list[tuple[int, int]], a: str, b: str) -> tuple[str, str, str]:
    """Both gapped rows, and the marks between them."""
    one = "".join([a[i - 1] if i else "-" for i, _ in cols])
    two = "".join([b[j - 1] if j else "-" for _, j in cols])
    u, v = (x.encode("ascii", "replace").translate(t) for x, t in zip((one, two), align._PLAIN, strict=True))
    return one, "".join([" " if x == "-" or y == "-" else "|" if p == q else "." for x, y, p, q in zip(one, two, u, v, strict=True)]), two


def fragment(cols: list[tuple[int, int]], a: str, b: str, place: Callable[[int], int]) -> str:
    """A fragment in lines of WIDTH columns. place: of a base of b, as it is to be told."""
    rows = _rows(cols, a, b)
    out = []
    for k in range(0, len(cols), WIDTH):
        part, texts = cols[k : k + WIDTH], [r[k : k + WIDTH] for r in rows]
        told = [[i for i, _ in part if i], [place(j) for _, j in part if j]]
        line = lambda text, at: f"{at[0]:>{MARGIN}} {text} {at[-1]}" if at else " " * (MARGIN + 1) + text
        out.append("\n".join([line(texts[0], told[0]), " " * (MARGIN + 1) + texts[1], line(texts[2], told[1])]))
    return "\n\n".join(out)


def _region(lo: int, hi: int, other_lo: int, other_hi: int) -> str:
    """[lo,hi], as wide as the numbers of the other sequence."""
    return f"[{lo:>{max(len(str(lo)), len(str(other_lo)))}},{hi:>{max(len(str(hi)), len(str(other_hi)))}}]"


def text_of(a: str, r: dict) -> str:
    """The text of a pair's result (excised with columns and joins)."""
    b, parts = r["b"], [c for c in r["columns"] if c]
    m = len(b)
    place = (lambda p: m + 1 - p) if r["strand"] == "-" else (lambda p: p)
    counts = [align.identity(c, a, b) for c in parts]
    gaps = sum(1 for c in parts for i, j in c if not (i and j))
    share = lambda n, of: int(100 * n / of + 0.5) if of else 0
    n, same = sum(x[0] for x in counts), sum(x[1] for x in counts)
    each = " =>" + "".join(f" {x[1]:>9} ({x[2]:>3}%)" for x in counts) if len(parts) > 1 else ""
    out = [f"Score:   {r['score']:>9}", f"Aligned: {n:>9}        nucs", f"Identic: {same:>9} ({share(same, n):>3}%) nucs{each}", f"Gaps:    {gaps:>9} ({share(gaps, n):>3}%) nucs", ""]
    ends = [([i for i, _ in c if i], [place(j) for _, j in c if j]) for c in parts]
    regions = [[_region(x[0], x[-1], y[0], y[-1]) for x, y in ends], [_region(y[0], y[-1], x[0], x[-1]) for x, y in ends]]
    out += ["Alignment:", *(f" {name} seq =>  {' EXCISED REGION '.join(row)}" for name, row in zip(("first ", "second"), regions, strict=True)), ""]
    if len(parts) == 2:
        (x1, y1), (x2, y2) = ([i for i, _ in c if i] for c in parts), ([j for _, j in c if j] for c in parts)
        sides = [("first ", a, x1[-1], y1[0], lambda p: p), ("second", b, x2[-1], y2[0], place)]

        def excised(joins: list[tuple[int, int]]) -> list[str]:
            lines = []
            for (name, _, _, _, told), (left, right) in zip(sides, joins, strict=True):
                lo, hi = align.excised_range(left, right)
                lines.append(f" {name} seq => {hi - lo + 1:>9} nucs" + (f" [{told(lo)},{told(hi)}]" if hi >= lo else ""))
            return lines

        own = [(left, right) for _, _, left, right, _ in sides]
        out += ["EXCISED REGION(S):", *excised(own)]
        back = (lambda p: m + 1 - p if 0 < p <= m else p) if r["strand"] == "-" else (lambda p: p)
        others = [[(i, k), (back(j), back(q))] for i, j, k, q in r["joins"]]
        others = [x for x in others if [y[1] - y[0] for y in x] != [right - left for left, right in own] and x[0][0] and x[0][1] <= len(a)]
        if others:
            out += [f"ALTERNATIVE REGION(S): {len(others)}", *excised(others[-1])]
        out.append("")
        alike = [align.homologies(seq, left, right) for _, seq, left, right, _ in sides]
        for key in ("at", "outside", "inside"):
            out.append(f"Identity {key} breakpoints: ")
            for (name, _, _, _, told), own in zip(sides, alike, strict=True):
                h = own[key]
                runs = f" [{told(h[1])},{told(h[2])}] to [{told(h[3])},{told(h[4])}]" if h[0] else ""
                out.append(f" {name} seq => {h[0]:>9} nucs{runs}")
        out.append("")
    return "\n".join(out) + "\n" + "\n\nEXCISED REGION\n\n".join(fragment(c, a, b, place) for c in parts) + "\n"


def alignment_text(pairs: DataFrame, sc: align.Scores | None = None, both: bool = False, tasks: int | None = None, most_gb: float = 10.0) -> DataFrame:
    """pair_id and the text of each pair's alignment around one excised region (null where nothing aligns)."""
    sc = sc or align.Scores()
    kind = dict(pairs.dtypes)["pair_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            a, b = ([x or "" for x in t[c]] for c in "ab")
            texts: list[str | None] = [None] * len(a)
            for own in align.similar(a, b, 4 if both else 2):
                for i, r in zip(own, align.excised([a[i] for i in own], [b[i] for i in own], sc, both, True, True), strict=True):
                    texts[i] = text_of(a[i], r) if r else None
            yield pd.DataFrame({"pair_id": t["pair_id"].to_numpy(), "value": texts})

    return align._dealt(pairs, most_gb, tasks).mapInPandas(run, f"pair_id {kind}, value string")

"""Operator 9, n-gram Jaccard join: documents whose shingle sets overlap, and their components.

Method: count-vector R-tree. A set's shingles are hashed into DIMS groups, and the group counts are
its point. Points are packed into an R-tree: leaves of LEAF points, inner nodes of FAN nodes each, all with the maxima and
the size range of what is below; the overlap of two sets is at most the sum over the groups of the smaller counts. The
tree is joined with itself from the root down: pairs of nodes whose bound is too low are dropped with all below them, then
pairs of points, and the others are verified
on the sets. Links inside what is already joined need no verification, as only components count.

Where to look: by the same grouping. Two sets linked at threshold t differ in at most d shingles,
so of d + 1 groups at least one has equal contents. Each set emits a key per group (groups are as
many as its size class needs; a set has keys for the class of every larger size it can link with;
small sets with many empty groups emit prefixes too). The sets of a key are bounded against each other by an R-tree over finer
count vectors (a group per two or three shingles), so that what only shares a passage goes its own way; components of what may
be linked are cells, which hold near copies. Every
cell is joined by an R-tree of its own. Cells of more than MOST_SETS or MOST_SHINGLES are cut into blocks, and each
pair of blocks is one group: exact, whatever the size. Nothing is sampled or dropped.

Equal sets are joined by an aggregation over digests before that. Nulls and texts without words
have empty sets and link with nothing. Rows with one id and text are one document; a null id counts
as the smallest, and is the (null) component_id of what it is linked with. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm._common import chunks, keyed, mix, text_buffers, with_id, word_bounds, word_hashes, written
from varloom.llm.components import components

#: Groups of a count vector, points of a leaf, nodes of an inner node; sets, and shingles of 8 bytes, in a block of a cell.
DIMS, LEAF, FAN, MOST_SETS, MOST_SHINGLES = 32, 32, 8, 5000, 2_000_000


def shingle_sets(col, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of an Arrow column."""
    off, data = text_buffers(col)
    for i, j in chunks(off):
        part = data[off[i] : off[j]]
        part = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint8)
        starts, ends, first = word_bounds(part, off[i : j + 1] - off[i])
        x = word_hashes(part, starts, ends)
        for r in range(j - i):
            s, e = int(first[r]), int(first[r + 1])
            if s == e:
                yield np.zeros(0, np.uint64)
                continue
            m = min(n, e - s)
            g = x[s : e - m + 1]
            for q in range(1, m):
                g = mix(g + np.uint64(q)) + x[s + q : e - m + 1 + q]
            yield np.unique(mix(g + np.uint64(m)))


#: A size class spans a factor of t ** -SPAN.
SPAN = 1


def size_class(n: float, t: float) -> int:
    """Linked sets differ in size by a factor of 1 / t at most."""
    return int(np.floor(np.log(n) / (-SPAN * np.log(t)) + 1e-9))


def key_classes(n: int, percent: int) -> range:
    """Classes of all sizes that a set linked to one of n shingles, and no smaller, can have; so of two linked sets the
    larger one's own class is among those of both."""
    t = percent / 100
    return range(size_class(n, t), size_class(100 * n // percent, t) + 1)


def class_groups(c: int, t: float) -> tuple[int, int]:
    """(groups, spare) of a class: as many groups as two linked sets can differ in shingles, the larger being of
    this class, one more, and one for each of `spare` groups that may be empty."""
    top = np.ceil(t ** (-SPAN * (c + 1.0))) + 1
    least = int((1 - t) / (1 + t) * 2 * top) + 1
    spare = 4 + least // 5
    return least + spare, spare


def group_keys(x: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A key per filled group, of the set's own class and of each one of which a larger set can be linked;
    with each key its class and how many more groups the set can do without (256 * class + that; -1 for none)."""
    t = percent / 100
    keys, marks = [], []
    for k in key_classes(len(x), percent):
        g, spare = class_groups(k, t)
        at = (mix(x + np.uint64(k + 1)) % np.uint64(g)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        filled = np.bincount(at, minlength=g)
        ids = np.flatnonzero(filled)
        total = np.add.reduceat(mix(x ^ np.uint64(0x5851F42D4C957F2D))[order], np.cumsum(filled)[ids] - filled[ids])
        keys.append(mix(mix(total + filled[ids].astype(np.uint64)) + ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)))
        left = spare - (g - len(ids))
        marks.append(np.full(len(ids), 256 * k + min(left, 255) if left >= 0 else -1))
        if left < 0:  # of two such sets the groups that agree may all be empty
            keys.append(prefix_keys(x, t))
            marks.append(np.full(len(keys[-1]), -1))
    return np.concatenate(keys), np.concatenate(marks)


def prefix_keys(x: np.ndarray, t: float) -> np.ndarray:
    """For small sets: of the first (1 - t) n + 1 shingles in hash order, linked sets have one in common."""
    p = len(x) - int(np.ceil(t * len(x) - 1e-9)) + 1
    return mix(x[:p] + np.uint64(0xABCDEF))


def points(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([counts(x, DIMS) for x in sets], np.int32).reshape(-1, DIMS)


def counts(x: np.ndarray, dims: int) -> np.ndarray:
    """How many hashes fall into each of so many groups (a power of two), by their first bits."""
    return np.bincount((x >> np.uint64(65 - dims.bit_length())).astype(np.int64), minlength=dims).astype(np.int32)


def fine_dims(n: int, percent: int) -> int:
    """Groups of the count vectors that a set of n shingles is bounded with, as many for all that it can be linked with or a
    power of two fewer: two or three shingles each."""
    top = (percent / 100) ** -(key_classes(n, percent)[-1] + 1)
    return 1 << int(np.clip(np.ceil(np.log2(max(top, 1) / 3)), 5, 14))


def packed(x: np.ndarray, percent: int) -> bytes:
    """The finer count vector of a set, in as few bytes as its largest count needs."""
    v = counts(x, fine_dims(len(x), percent))
    return v.astype(np.uint8 if v.max() < 256 else np.uint16 if v.max() < 65536 else np.int32).tobytes()


def unpacked(v: bytes, n: int, percent: int) -> np.ndarray:
    return np.frombuffer(v, {1: np.uint8, 2: np.uint16, 4: np.int32}[len(v) // fine_dims(n, percent)]).astype(np.int32)


class CountTree:
    """R-tree over count vectors: levels of nodes, leaves first, each with the maxima per group and the size range below."""

    def __init__(self, point: np.ndarray, size: np.ndarray) -> None:
        self.point, self.size = point, size
        self.order = np.lexsort((*(point[:, c] for c in range(3, -1, -1)), size))
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        high, small, large, width = point[self.order], size[self.order], size[self.order], LEAF
        while True:
            at = np.arange(0, len(small), width)
            high, small, large = np.maximum.reduceat(high, at), np.minimum.reduceat(small, at), np.maximum.reduceat(large, at)
            self.levels.append((high, small, large))
            if len(at) == 1:
                break
            width = FAN

    def near_leaves(self, num: int, den: int) -> np.ndarray:
        """Pairs (a <= b) of leaves that may hold linked points, by a descent from the pair of roots."""
        pairs = np.zeros((1, 2), np.int64)
        grid = np.stack(np.meshgrid(np.arange(FAN), np.arange(FAN), indexing="ij"), -1).reshape(-1, 2)
        for level in range(len(self.levels) - 1, -1, -1):
            high, small, large = self.levels[level]
            if level < len(self.levels) - 1:
                pairs = (pairs[:, None, :] * FAN + grid).reshape(-1, 2)
                pairs = pairs[(pairs[:, 1] < len(small)) & (pairs[:, 0] <= pairs[:, 1])]
            kept = []
            for i in range(0, len(pairs), 4096):
                a, b = pairs[i : i + 4096].T
                # |A n B| (den + num) >= num (|A| + |B|), and the overlap is at most the summed minima
                bound = np.minimum(high[a], high[b]).sum(1)
                kept.append(pairs[i : i + 4096][(bound * (den + num) >= num * (small[a] + small[b])) & (large[a] * den >= num * small[b])])
            pairs = np.concatenate(kept)
        return pairs

    def leaf(self, a: int) -> np.ndarray:
        return self.order[a * LEAF : (a + 1) * LEAF]


def rtree_links(sets: list[np.ndarray], t_num: int, t_den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links: intersection * t_den >= t_num * union. Leaves whose points are all joined already are
    passed over, so a cell of near copies takes one look per pair of leaves."""
    point, size = points(sets), np.array([len(x) for x in sets])
    tree, joined, out = CountTree(point, size), np.arange(len(sets)), []
    for a, b in tree.near_leaves(t_num, t_den).tolist():
        p, q = tree.leaf(a), tree.leaf(b)
        apart = joined[p][:, None] != joined[q]
        if not apart.any():
            continue
        bound = np.minimum(point[p][:, None, :], point[q][None, :, :]).sum(2)
        ok = apart & (bound * (t_den + t_num) >= t_num * (size[p][:, None] + size[q]))
        if a == b:
            ok = np.triu(ok, 1)
        for i, j in zip(*np.nonzero(ok), strict=True):
            x, y = p[i], q[j]
            if joined[x] == joined[y]:
                continue
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if both * (t_den + t_num) >= t_num * (len(sets[x]) + len(sets[y])):
                lo, hi = sorted((joined[x], joined[y]))
                joined[joined == hi] = lo
                out.append((int(x), int(y)))
    return out


def may_be_linked(point: np.ndarray, size: np.ndarray, t_num: int, t_den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that their count vectors don't rule out."""
    if len(size) == 2:
        return [(0, 1)] if np.minimum(point[0], point[1]).sum() * (t_den + t_num) >= t_num * size.sum() else []
    tree, joined, out = CountTree(point, size), np.arange(len(size)), []
    for a, b in tree.near_leaves(t_num, t_den).tolist():
        p, q = tree.leaf(a), tree.leaf(b)
        for i in range(len(p)):
            j = q[i + 1 :] if a == b else q
            j = j[joined[j] != joined[p[i]]]
            if not len(j):
                continue
            bound = np.minimum(point[p[i]], point[j]).sum(1)
            for y in j[bound * (t_den + t_num) >= t_num * (size[p[i]] + size[j])]:
                if joined[p[i]] != joined[y]:
                    lo, hi = sorted((joined[p[i]], joined[y]))
                    joined[joined == hi] = lo
                    out.append((int(p[i]), int(y)))
    return out


def _sketch(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(_d, _h, n, x, y, v): size, digest and count vector of each set."""
    for b in batches:
        rows, vectors = [], []
        for s in shingle_sets(b.column(2), n):
            rows.append((len(s), *digest(s)))
            vectors.append(packed(s, percent) if len(s) else b"")
        k, x, y = (np.array(c, np.uint64) for c in zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(k.astype(np.int64)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(vectors, pa.binary())], ["_d", "_h", "n", "x", "y", "v"])


def digest(s: np.ndarray) -> tuple[int, int]:
    return int(np.add.reduce(mix(s))), int(np.bitwise_xor.reduce(mix(s + np.uint64(77))))


def _keys(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(k, _d, mark). Of equal sets, which are linked already, a task emits one only."""
    seen: set[tuple[int, int, int]] = set()
    for b in batches:
        d = b.column(0).to_numpy(zero_copy_only=False)
        out, held = [], 0
        for r, s in enumerate(shingle_sets(b.column(2), n), 1):
            if len(s) and (x := (len(s), *digest(s))) not in seen:
                seen.add(x)
                out.append((*group_keys(s, percent), r - 1))
                held += len(out[-1][0])
            if out and (held > 200_000 or r == b.num_rows):
                at = np.repeat([i for _, _, i in out], [len(k) for k, _, _ in out])
                k, m = (np.concatenate([x[c] for x in out]) for c in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(d[at]), pa.array(m.astype(np.int32))], ["k", "_d", "mark"])
                out, held = [], 0


#: Sets under a key from which on it counts as frequent.
FREQUENT = 64


def _met(batches: Iterator[pa.RecordBatch], frequent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key and document. (k, a, b): b null: document a of the bucket k, a name for the documents that a key
    has, so that buckets of the same documents are one; else a row of a frequent key, b its mark."""
    held = [np.zeros(0, np.int64)] * 3
    going = False  # whether the key that is held has given rows as a frequent one

    def rows(k, d, m, going):
        once = np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])
        k, d, m = k[once], d[once], m[once]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        often = size[group] >= frequent
        if going:
            often |= group == 0
        near = ~often & (size[group] > 1)
        name = mix(np.add.reduceat(mix(d.view(np.uint64)), first) + size.astype(np.uint64)).view(np.int64)[group]
        both = np.unique(np.stack([name[near], d[near]], 1), axis=0)
        marks = pa.concat_arrays([pa.nulls(len(both), pa.int64()), pa.array(m[often])])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([both[:, 0], k[often]])), pa.array(np.concatenate([both[:, 1], d[often]])), marks], ["k", "a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        k, d, m = (np.concatenate([h, b.column(c).to_numpy(zero_copy_only=False).astype(np.int64)]) for c, h in enumerate(held))
        cut = int(np.searchsorted(k, k[-1], side="left"))  # the last key may go on
        if cut:
            yield rows(k[:cut], d[:cut], m[:cut], going)
            going = False
        elif len(k) > 1_000_000:
            yield rows(k, d, m, True)
            cut, going = len(k), True
            held = [k[-1:][:0], d[:0], m[:0]]
            continue
        held = [k[cut:], d[cut:], m[cut:]]
    if len(held[0]):
        yield rows(*held, going)


def _bounded(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket: (k, a, n, v). (a, b): documents of a bucket that may be linked, as a forest."""
    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    out: list[tuple[int, int]] = []
    for _, group in groupby(rows(), key=itemgetter(0)):
        _, a, n, v = zip(*group, strict=True)
        if len(a) < 2:
            continue
        vectors = [unpacked(x, k, percent) for x, k in zip(v, n, strict=True)]
        dims = min(map(len, vectors))
        point = np.stack([x.reshape(dims, -1).sum(1) for x in vectors])
        out += [(a[i], a[j]) for i, j in may_be_linked(point, np.array(n), percent, 100) if a[i] != a[j]]
        if len(out) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*set(out), strict=True)], ["a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*set(out), strict=True)], ["a", "b"])


def candidate_links(t: DataFrame, sketch: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): sets that share a key and may be linked, as forests. Keys of FREQUENT or more sets (what a passage in
    many documents leaves alone in a group) are left out for sets that can do without: linked sets agree in one group
    more than are spare, so if for either the empty and frequent groups are no more than the spare ones, the two
    share another key. Those that can't do without are joined to the first one of the key."""
    keys = t.mapInArrow(lambda it: _keys(it, n, percent), "k long, _d long, mark int")
    met = written(keys.repartition("k").sortWithinPartitions("k", "_d").mapInArrow(lambda it, often=FREQUENT: _met(it, often), "k long, a long, b long"), "met")
    buckets = met.where("b is null").select("k", "a").distinct()
    bounds = buckets.join(sketch.select(F.col("_d").alias("a"), "n", "v").hint("merge"), "a").select("k", "a", "n", "v")
    near = bounds.repartition("k").sortWithinPartitions("k").mapInArrow(lambda it: _bounded(it, percent), "a long, b long")
    often = met.where("b is not null").distinct()
    need = often.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("b < 0 or n > pmod(b, 256)").select("a", "b")
    kept = often.join(need, ["a", "b"]).select("k", "a")
    hubs = kept.groupBy("k").agg(F.min("a").alias("hub"))
    more = kept.join(hubs, "k").where("a != hub").select("a", F.col("hub").alias("b")).distinct()
    return near.union(more)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(cell, part, side, _d, set as bytes); a set of a cut cell goes to each pair of its block."""
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("_d", "cell", "blocks")]
        rows = []
        for d, cell, blocks, s in zip(*cols, shingle_sets(b.column(b.schema.get_field_index("text")), n), strict=True):
            own = d * 0x9E3779B1 % (1 << 61) % blocks
            rows += [(cell, min(own, o) * blocks + max(own, o), own, d, s.tobytes()) for o in range(blocks)]
            if len(rows) > 2000:
                yield _set_batch(rows)
                rows = []
        if rows:
            yield _set_batch(rows)


def _set_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["cell", "part", "side", "_d", "s"])


def _join(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    out: list[tuple[int, int]] = []
    for _, group in groupby(rows(), key=itemgetter(0, 1)):
        own = [(x[3], np.frombuffer(x[4], np.uint64)) for x in group]
        out += [(own[i][0], own[j][0]) for i, j in rtree_links([s for _, s in own], num, den)]
        if len(out) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])


def ngram_components(docs: DataFrame, shingle: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_d, _h, n_shingles and component (the smallest _d reachable over links) of every row."""
    t = keyed(docs, id_col, text_col)
    sketch = written(t.mapInArrow(lambda it: _sketch(it, shingle, percent), "_d long, _h long, n long, x long, y long, v binary"), "sketch")
    # one node per document id and set; ids are unique unless a table repeats an id with another text
    same = sketch.where("n > 0").groupBy("n", "x", "y").agg(F.min("_d").alias("node"))
    copies = sketch.where("n > 0").join(same, ["n", "x", "y"]).where("_d != node").select(F.col("_d").alias("a"), F.col("node").alias("b"))
    near = candidate_links(t, sketch, shingle, percent)
    cells = components(near)
    cells = cells.select(F.col("node").alias("_d"), F.col("component").alias("cell"))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / MOST_SETS, F.sum("n") / MOST_SHINGLES)).cast("int")
    cells = cells.join(cells.join(sketch, "_d").groupBy("cell").agg(blocks.alias("blocks")), "cell")
    held = t.join(cells.hint("merge"), "_d").mapInArrow(lambda it: _sets(it, shingle), "cell long, part int, side int, _d long, s binary")
    links = held.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(lambda it: _join(it, percent, 100), "a long, b long")
    found = components(links.union(copies))
    out = sketch.drop("v").join(found, sketch["_d"] == found["node"], "left")
    return out.select("_d", "_h", F.col("n").alias("n_shingles"), F.coalesce("component", "_d").alias("component"))


def ngram_jaccard_join(docs: DataFrame, shingle: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links) of every row.

    Documents link when 100 * intersection >= percent * union of their sets of distinct
    shingle-word sequences, in lower case. Fewer words than that make one sequence.
    """
    own = F.col("component")
    return with_id(ngram_components(docs, shingle, percent, id_col, text_col).select("_d", "_h", "n_shingles", F.when(own != F.lit(-(2**63)), own).alias("component_id")))

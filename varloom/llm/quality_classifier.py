"""Operator 3, quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are DataFrame functions of the text alone, over all documents. The trees are fitted
on the driver to a bounded sample of labelled rows (max_rows, by a hash of the id) outside the held
out fold, on binned features: for each node, gradients and hessians are summed per bin and the best
cut is read off the cumulative sums. The trees are flattened into arrays (feature, cut, children,
value), which tasks walk for all rows and trees at once, a level at a time.

Null and empty texts have statistics of 0 and are scored like any text. No labels: every score is
0.5; one class: its share. Rows are scored one by one, so repeated rows get equal scores; a row
whose id is null is not held out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm._common import written
from varloom.llm.quality_rules import let, measured
from varloom.operators.qc import sample_cap

#: Labelled rows that the trees are fitted to, at most.
MAX_ROWS = 20_000
STATISTICS = [
    "log_words", "mean_word", "symbol_rate", "repeat_rate", "dup_line_rate", "upper_rate", "digit_rate", "stop_rate",
    "distinct_rate", "line_words", "bang_rate", "pipe_rate", "letter_rate", "comma_rate",
]


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out and the statistics of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    length = F.greatest(F.length(text), F.lit(1))
    # one pass leaves the marks, which are few; they are counted by kind in what is left
    kinds = {"digit_rate": "0123456789", "stop_rate": ".", "bang_rate": "!?", "pipe_rate": "|", "comma_rate": ",;:"}
    marks = let(F.regexp_replace(text, "[^0-9.!?|,;:]+", ""), lambda m: F.struct(*[(F.length(m) - F.length(F.translate(m, c, ""))).alias(k) for k, c in kinds.items()]))
    plain = F.length(F.regexp_replace(text, "[^a-z\\x20\\x09-\\x0D]+", "")) / length
    own = measured(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    words = F.greatest(F.col("n_words"), F.lit(1))
    distinct = let(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: F.size(F.array_distinct(w)) / F.size(w))
    return own.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.log1p("n_words").alias("log_words"),
        (F.col("word_chars") / words).alias("mean_word"),
        "symbol_rate", "repeat_rate", "dup_line_rate", "upper_rate",
        marks.alias("_marks"), length.alias("_length"),
        distinct.alias("distinct_rate"),
        (F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1))).alias("line_words"),
        plain.alias("letter_rate"),
    ).select("doc_id", "held_out", *[(F.col(f"_marks.{c}") / F.col("_length") if c in kinds else F.col(c)).alias(c) for c in STATISTICS])


class Forest:
    """Flattened trees: node i of tree t cuts feature[t, i] at cut[t, i], to 2i + 1 (at most) or 2i + 2."""

    def __init__(self, base: float, depth: int) -> None:
        self.base, self.depth = base, depth
        self.feature = np.zeros((0, 2**depth - 1), np.int32)
        self.cut = np.zeros((0, 2**depth - 1))
        self.value = np.zeros((0, 2**depth))

    def margin(self, x: np.ndarray) -> np.ndarray:
        n, t = len(x), len(self.feature)
        at = np.zeros((n, t), np.int64)
        trees = np.arange(t)
        for _ in range(self.depth):
            over = np.take_along_axis(x, self.feature[trees, at], 1) > self.cut[trees, at]
            at = 2 * at + 1 + over
        return self.base + self.value[trees, at - (2**self.depth - 1)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 1.0) -> Forest:
    """Logistic loss; every level of a tree is cut at once from histograms over (node, feature, bin)."""
    if not len(y):
        return Forest(0.0, depth)
    p = min(max(float(y.mean()), 1e-6), 1 - 1e-6)
    forest = Forest(float(np.log(p / (1 - p))), depth)
    if y.min() == y.max():
        return forest
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    code = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], 1)
    margin = np.full(n, forest.base)
    offset = np.arange(m) * bins
    feature, cut, value = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = prob - y, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        own_f, own_c = np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            slot = ((node - first)[:, None] * (m * bins) + offset + code).ravel()
            g, h = (np.bincount(slot, np.repeat(v, m), width * m * bins).reshape(width, m, bins).cumsum(2) for v in (grad, hess))
            tg, th = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + 1) + (tg - g) ** 2 / (th - h + 1) - tg**2 / (th + 1)
            gain[(h < least) | (th - h < least)] = -np.inf
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    own_f[first + k], own_c[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), own_f[node]] > own_c[node])
        leaf = node - (2**depth - 1)
        v = -rate * np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, hess, 2**depth) + 1)
        margin += v[leaf]
        feature.append(own_f)
        cut.append(own_c)
        value.append(v)
    forest.feature, forest.cut, forest.value = np.array(feature), np.array(cut), np.array(value)
    return forest


def _score(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in STATISTICS], 1).astype(float)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(forest.score(np.nan_to_num(x)))], ["doc_id", "held_out", "score"])


def train(rows: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Forest:
    """Trees from at most max_rows labelled rows outside the held out fold."""
    marked = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("_y"))
    own = rows.where(~F.col("held_out")).join(marked, "doc_id")
    own = sample_cap(own, max_rows, "doc_id").select("_y", *STATISTICS).toPandas()
    return fit(np.nan_to_num(own[STATISTICS].to_numpy(float)), own["_y"].to_numpy(float))


def quality_classifier(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out and score (higher: label 1 likelier) of every row."""
    rows = written(statistics(docs, id_col, text_col), "statistics")
    forest = train(rows, labels, max_rows=max_rows)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _score(it, forest), f"doc_id {kind}, held_out boolean, score double")


def is_held_out(doc_id: object) -> bool:
    """The same fold in plain Python, for tests."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0

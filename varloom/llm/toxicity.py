"""Operator 6, toxicity by a weighted finite-state grammar of clauses.

Method: small transducers over the classes of words, each a table (state, symbol) -> (next state,
symbol written, weight): reported speech and negation rewrite what they reach to `quoted` and
`denied`, the target transducer rewrites insults after a target to `aimed`, the threat transducer
threats after a target to `threatened` and weighs others down. The insult transducer reads words and writes
`insult` with the word's learned weight. They are composed into one table (`compose`: each reads
what the one before writes, weights are multiplied), which every text runs through once. A clause
ends at . ! ? ; or a line end, where all transducers return to their first state; on each channel (a marked
symbol) the best path of the clause counts. Nothing is scored word by word: what is summed are the matched
clauses' channels.

The insult lexicon (words, and stems of STEMS letters) and the weights of the channels are learned
from a bounded sample of labelled rows (max_rows, by a hash of the id) outside the held out fold:
counts by aggregations, the channels by logistic regression. The lexicon holds every entry that stands the
test; what bounds it is the sample.

Null and empty texts match nothing and get the score of the intercept; without labels it is 0.5,
with labels of one class near its share. Rows are scored one by one, so repeated rows get equal
scores; a null id is not held out. Ties between entries don't matter, as none are cut. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.quality_classifier import held_out
from varloom.operators.qc import sample_cap

#: Labelled rows that are learned from, at most.
MAX_ROWS = 12_000
#: Letters of the stems in the lexicon.
STEMS = (4, 5, 6, 7, 8)
#: Fixed word lists of the small transducers.
THREAT = "kill hurt destroy beat burn shoot stab attack matar golpear quemar töten schlagen brennen tuer frapper brûler".split()
TARGET = "you your yours youre he she they him them tú usted ustedes du dich dir ihr sie toi vous tu lui eux".split()
NEGATION = "not never no isn't nor nunca nicht kein keine nie pas jamais".split()
REPORT = "said says saying quoted quote reported wrote claims dijo dice escribió sagte sagt schrieb berichtet dit écrit rapporté".split()

_TOKENS = re.compile(r"[^\W\d_]+|[.!?;\n]").findall
_END = frozenset(".!?;\n")
#: Words that a negation reaches.
REACH = 3

#: What the transducers read and write: classes of words, then the channels.
SYMBOLS = OTHER, INSULT, THREATEN, AT, NOT, SAID, END, AIMED, DENIED, QUOTED, THREATENED = range(11)
#: Symbols whose best path of a clause counts, in the order of the sums; the last sum is the text's best insult.
COUNTED = (INSULT, AIMED, DENIED, QUOTED, THREATENED, THREATEN)
CHANNELS = len(COUNTED) + 1

#: By state: of each symbol the next state, the symbol written and its weight.
Transducer = list[list[tuple[int, int, float]]]


def transducer(states: int, step: Callable[[int, int], tuple[int, int, float]]) -> Transducer:
    """A full table from step(state, symbol); the end of a clause leads back to state 0."""
    return [[step(q, x) if x != END else (0, END, 1.0) for x in SYMBOLS] for q in range(states)]


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The transducer that feeds what a writes to b; its states are the pairs that can be reached."""
    number, out = {(0, 0): 0}, []
    todo = [(0, 0)]
    for p, q in todo:  # grows
        row = []
        for x in SYMBOLS:
            n, y, v = a[p][x]
            m, z, w = b[q][y]
            if (n, m) not in number:
                number[n, m] = len(number)
                todo.append((n, m))
            row.append((number[n, m], z, v * w))
        out.append(row)
    return out


def reported() -> Transducer:
    return transducer(2, lambda q, x: (1 if x == SAID else q, QUOTED if q and x in (INSULT, THREATEN) else x, 1.0))


def negated(reach: int = REACH) -> Transducer:
    """State: words that the last negation still reaches."""
    return transducer(reach + 1, lambda q, x: (reach if x == NOT else max(0, q - 1), DENIED if q and x in (INSULT, THREATEN) else x, 1.0))


def targeted() -> Transducer:
    return transducer(2, lambda q, x: (1 if x == AT else q, AIMED if q and x == INSULT else x, 1.0))


def threatening() -> Transducer:
    return transducer(2, lambda q, x: (1 if x == AT else q, THREATENED if q and x == THREATEN else x, 0.25 if x == THREATEN and not q else 1.0))


def grammar() -> Transducer:
    return compose(compose(compose(reported(), negated()), targeted()), threatening())


def features_of(word: str) -> list[str]:
    """Lexicon entries that may hold of a word: itself, and its stems."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


class InsultReader(dict):
    """The first transducer, of one state: word -> (symbol, weight), None for other words; filled as words come, up to a bound."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon
        self.fixed = {w: (k, 1.0) for k, ws in ((THREATEN, THREAT), (AT, TARGET), (NOT, NEGATION), (SAID, REPORT)) for w in ws}
        self.fixed |= {w: (END, 1.0) for w in _END}

    def __missing__(self, word: str):
        if len(self) > 400_000:
            self.clear()
        weight = max((self.lexicon.get(f, 0.0) for f in features_of(word)), default=0.0)
        self[word] = c = (INSULT, weight) if weight else self.fixed.get(word)
        return c


class Machine:
    """The composed grammar, ready to run."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.read = InsultReader(lexicon)
        self.table = grammar()
        # where a run of other words leads; from REACH of them on, nothing changes any more
        self.after = [list(range(len(self.table)))]
        for _ in range(REACH):
            self.after.append([self.table[q][OTHER][0] for q in self.after[-1]])

    def channels(self, text: str | None) -> list[float]:
        """Sums over clauses of the best path per counted symbol, and the best insult of all."""
        out, best = [0.0] * CHANNELS, dict.fromkeys(COUNTED, 0.0)
        table, after = self.table, self.after
        q, last, found = 0, -1, False
        for i, c in enumerate(map(self.read.__getitem__, _TOKENS((text or "").lower()))):
            if c is None:
                continue
            x, weight = c
            q = after[min(i - last - 1, REACH)][q]
            last = i
            q, z, w = table[q][x]
            if z in best:
                best[z] = max(best[z], weight * w)
                found = True
            elif z == END and found:
                self._close(out, best)
                found = False
        if found:
            self._close(out, best)
        return out

    def _close(self, out: list[float], best: dict[int, float]) -> None:
        for k, z in enumerate(COUNTED):
            out[k] += best[z]
        out[-1] = max(out[-1], best[INSULT], best[AIMED])
        best.update(dict.fromkeys(COUNTED, 0.0))


def _vector(x: np.ndarray) -> np.ndarray:
    return np.log1p(x)


def _entries(batches: Iterator[pa.RecordBatch], only: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """(entry, toxic documents, other documents) counted within the task."""
    seen: tuple[Counter, Counter] = Counter(), Counter()
    for b in batches:
        for t, y in zip(b.column("text").to_pylist(), b.column("_y").to_pylist(), strict=True):
            words = {w for w in _TOKENS((t or "").lower()) if w not in _END}
            own = {f for w in words for f in features_of(w)}
            seen[0 if y else 1].update(own if only is None else own & only)
    names = list(seen[0].keys() | seen[1].keys())
    for i in range(0, len(names), 50_000):
        part = names[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([c[f] for f in part], pa.int64()) for c in seen)], ["entry", "t", "c"])


def _channels(batches: Iterator[pa.RecordBatch], lexicon: dict[str, float]) -> Iterator[pa.RecordBatch]:
    machine = Machine(lexicon)
    for b in batches:
        rows = [machine.channels(t) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("_y"), pa.array(rows, pa.list_(pa.float64()))], ["_y", "x"])


def _score(batches: Iterator[pa.RecordBatch], lexicon: dict[str, float], weights: list[float]) -> Iterator[pa.RecordBatch]:
    machine, w = Machine(lexicon), np.array(weights)
    for b in batches:
        x = np.array([machine.channels(t) for t in b.column("text").to_pylist()]).reshape(-1, CHANNELS)
        margin = w[0] + _vector(x) @ w[1:]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(1 / (1 + np.exp(-np.clip(margin, -30, 30))))], ["doc_id", "held_out", "score"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton's method; intercept first."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    if not len(y):
        return w
    penalty = ridge * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + penalty, a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> tuple[dict[str, float], list[float]]:
    """The insult lexicon and the channels' weights. docs: doc_id, text, held_out."""
    marked = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    ids = docs.where(~F.col("held_out")).select("doc_id").join(marked, "doc_id")
    ids = sample_cap(ids, max_rows, "doc_id")
    own = docs.join(F.broadcast(ids), "doc_id").select("text", "_y")  # at most max_rows ids
    total = {r["_y"]: r["count"] for r in own.groupBy("_y").count().collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    if not toxic or not clean:
        return {}, [float(np.log((toxic + 0.5) / (clean + 0.5))), *[0.0] * CHANNELS]
    kind = "entry string, t long, c long"
    seen = own.where("_y = 1").mapInArrow(lambda it: _entries(it, None), kind).groupBy("entry").agg(F.sum("t").alias("t"))
    least = max(4, toxic // 200)
    names = frozenset(r.entry for r in seen.where(F.col("t") >= least).toLocalIterator())
    counts = own.mapInArrow(lambda it: _entries(it, names), kind).groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    weight = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (clean + 1.0))
    # the same with either count two deviations towards the other class, so that chance makes no entry
    t, c = F.col("t") - 2 * F.sqrt("t"), F.col("c") + 2 * F.sqrt(F.col("c") + 1) + 1
    cautious = F.log(F.greatest(t, F.lit(0.1)) / (toxic + 1.0)) - F.log(c / (clean + 1.0))
    top = counts.select("entry", weight.alias("w"), cautious.alias("least")).where("w > 3 and least > 0.6").collect()
    lexicon = {r.entry: float(r.w) for r in top}
    rows = own.mapInArrow(lambda it: _channels(it, lexicon), "_y int, x array<double>").collect()  # at most max_rows
    x, y = np.array([r.x for r in rows]), np.array([r["_y"] for r in rows], float)
    return lexicon, logistic(_vector(x), y).tolist()


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out and score (higher: label 1 likelier) of every row."""
    own = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    lexicon, weights = train(own, labels, max_rows=max_rows)
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(lambda it: _score(it, lexicon, weights), f"doc_id {kind}, held_out boolean, score double")

"""Operator 10, BPE encoding and decoding with a public vocabulary, by a prefix-sharing trie.

Method: the distinct words of a batch are put in order, which is the depth-first order of their
trie; the states of a word's prefix are those of the word before it as far as the two agree. The
state of a prefix is the last token of its encoding, which is the one token that ends there and
goes with the last token of what precedes it (two tokens go together when merging their
concatenation gives them back, which taking back the merges at their border tells). A shared
prefix is so encoded once. Python sees each distinct piece of a batch once: Arrow splits the texts and numbers
the pieces, numpy puts their ids in the texts' order. Pieces are remembered within a task, at most
MOST_WORDS of them.

The vocabulary file (a few MB, of a fixed size) is read by the driver and sent to the tasks.
Nulls and empty texts give no tokens and an empty text. Every row gives one row; extra columns are
ignored. Very long texts need memory in proportion to their own length.
"""

from __future__ import annotations

import gc
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm._common import chunks, text_buffers

#: Words that a task remembers.
MOST_WORDS = 200_000
#: Pairs of tokens that a task remembers.
MOST_PAIRS = 300_000
#: Bytes of text that share a trie, or one text.
SHARED = 4 << 20


def byte_alphabet() -> list[str]:
    """The printable character for each byte: itself where it is visible, else the next after U+00FF."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class TrieEncoder:
    """Encodes words that end in a marker. vocab: token to id; merges: pairs, first ones first."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.rank = {tuple(x) if isinstance(x, list) else tuple(x.split(" ")): i for i, x in enumerate(model["merges"])}
        self.halves = {a + b: (a, b) for a, b in self.rank}
        self.made = {a + b: i for (a, b), i in self.rank.items()}
        if len(self.halves) < len(self.rank):
            raise ValueError("two merges give the same token")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.alphabet = byte_alphabet()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # lengths of the tokens that end in some three characters, without and with the end marker
        lengths: tuple[dict[str, set[int]], dict[str, set[int]]] = ({}, {})
        for t in self.vocab:
            last = bool(self.end) and t.endswith(self.end) and t != self.end
            t = t[: -len(self.end)] if last else t
            if len(t) > 2:
                lengths[last].setdefault(t[-3:], set()).add(len(t))
        self.lengths = tuple({k: (*sorted(v, reverse=True), 2, 1) for k, v in x.items()} for x in lengths)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.found: dict[str, tuple[int, ...]] = {}

    def merge(self, x: list[str]) -> list[str]:
        """Plain BPE of a few symbols."""
        x = list(x)
        while len(x) > 1:
            r, i = min((self.rank.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(x, x[1:], strict=False)))
            if r == 1 << 30:
                break
            x[i : i + 2] = [x[i] + x[i + 1]]
        return x

    def symbols(self, t: str) -> list[str]:
        if self.end and t.endswith(self.end) and t != self.end:
            t = t[: -len(self.end)]
            return [*t[:-1], t[-1] + self.end]
        return list(t)

    def alone(self, t: str) -> bool:
        """Whether t is the encoding of itself."""
        if (ok := self.whole.get(t)) is None:
            ok = self.whole[t] = self.merge(self.symbols(t)) == [t]
        return ok

    def agree(self, a: str, b: str) -> bool:
        """Whether b can follow a; both are encodings of themselves. Merges next to the border are taken back, the
        latest first: none of the pairs that stood there may have merged before what was taken back did."""
        limit, rank, made, halves = 1 << 30, self.rank, self.made, self.halves
        while rank.get((a, b), limit) >= limit:
            x, y = made.get(a, -1), made.get(b, -1)
            if x < 0 and y < 0:
                return True
            if x > y:
                limit, a = x, halves[a][1]
            else:  # of equal merges the left one came first
                limit, b = y + 1, halves[b][0]
        return False

    def follows(self, a: str, b: str) -> bool:
        """agree(), remembered; a empty: whether b can stand first."""
        if len(self.pairs) > MOST_PAIRS:
            self.pairs.clear()
        ok = self.pairs[a, b] = self.alone(b) and (not a or self.agree(a, b))
        return ok

    def learn(self, words: set[str]) -> None:
        """Encodes words over the byte alphabet, by a depth-first walk over their trie."""
        before, states = "", [""]
        end, vocab, pairs, follows = self.end, self.vocab, self.pairs, self.follows
        inner, final = self.lengths
        for w in sorted(words):
            n, size = 0, len(w)
            most = min(len(before), size - 1, len(states) - 1)
            while n < most and before[n] == w[n]:
                n += 1
            del states[n + 1 :]
            for i in range(n + 1, size + 1):  # the last token of the encoding of w[:i]
                tail, lengths = (end, final) if i == size else ("", inner)
                for k in lengths.get(w[i - 3 : i], (2, 1)) if i > 2 else (2, 1):
                    if k <= i and (t := w[i - k : i] + tail) in vocab:
                        ok = pairs.get((states[i - k], t))
                        if ok or ok is None and follows(states[i - k], t):
                            break
                else:  # only a single symbol is left
                    if (t := w[i - 1] + tail) not in vocab:
                        raise ValueError(f"no token ends {w[:i]!r}")
                if i < size:
                    states.append(t)
            out, i = [vocab[t]], size - len(t) + len(end)
            while i:
                t = states[i]
                out.append(vocab[t])
                i -= len(t)
            out.reverse()
            self.found[w] = tuple(out)
            before = w

    def normal(self, x: str) -> list[str]:
        """The words of a piece of text without white space, over the byte alphabet."""
        if x.isascii():  # normal as it stands, and its own alphabet
            x = x.lower()
            if x.isalpha():
                return [x]
            if x[-1:] in ".," and x[:-1].isalpha():
                return [x[:-1], x[-1]]
        x = unicodedata.normalize("NFC", x)
        x = x.lower() if "Σ" not in x else "".join(map(str.lower, x))
        return ["".join([self.alphabet[c] for c in w.encode()]) for w in self.words(x)]

    def pieces(self, x: str) -> list[int | str]:
        """A piece without ASCII white space as special ids and words."""
        if "<" in x and self.specials and len(parts := self.specials.split(x)) > 1:
            return [y for p in parts for y in ([self.special[p]] if p in self.special else self.normal(p))]
        return list(self.normal(x))


class Known:
    """Token ids of pieces of text, by halves: what is not asked for again goes after MOST_WORDS / 2 others."""

    def __init__(self, spec: dict) -> None:
        self.bpe = TrieEncoder(spec)
        self.now: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def ids(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """Of distinct pieces."""
        bpe, now, old = self.bpe, self.now, self.old
        split: dict[str, list[int | str]] = {}
        out = []
        for x in pieces:
            if (t := now.get(x)) is None:
                if (t := old.get(x)) is not None:
                    now[x] = t
                else:
                    split[x] = bpe.pieces(x)
            out.append(t)
        found = bpe.found
        bpe.learn({w for p in split.values() for w in p if w.__class__ is str} - found.keys())
        for x, p in split.items():
            if len(p) == 1 and p[0].__class__ is str:
                now[x] = found[p[0]]
            elif len(p) == 2 and p[0].__class__ is p[1].__class__ is str:
                now[x] = found[p[0]] + found[p[1]]
            else:
                now[x] = tuple(chain.from_iterable(found[w] if w.__class__ is str else (w,) for w in p))
        if split:
            out = [now[x] if t is None else t for x, t in zip(pieces, out, strict=True)]
        if len(now) > MOST_WORDS // 2:
            self.old, self.now = now, {}
        if len(found) > MOST_WORDS // 2:
            found.clear()
        return out


#: A worker keeps the last encoder, with what it has learned, for its next tasks.
_KEPT: dict[str, Known] = {}


def _encode(batches: Iterator[pa.RecordBatch], spec: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    if spec not in _KEPT:
        _KEPT.clear()
        _KEPT[spec] = Known(json.loads(spec))
    known = _KEPT[spec]
    gc.freeze()  # what is remembered has no cycles; collecting garbage would walk through it again and again
    for b in batches:
        texts = pc.fill_null(b.column("text"), "")
        for lo, hi in chunks(text_buffers(texts)[0], SHARED):
            split = pc.ascii_split_whitespace(texts.slice(lo, hi - lo))
            pieces = split.flatten().dictionary_encode()
            tokens = known.ids(pieces.dictionary.to_pylist())
            size = np.fromiter(map(len, tokens), np.int64, len(tokens))
            flat = np.fromiter(chain.from_iterable(tokens), np.int32, int(size.sum()))
            at = pieces.indices.to_numpy()
            # ids of piece i stand in flat from start[i] on
            start, n = (np.cumsum(size) - size)[at], size[at]
            ends = np.cumsum(n)
            ids = flat[np.repeat(start - (ends - n), n) + np.arange(int(n.sum()))]
            edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))
            part = b.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), lists], [*keep, "ids"])


def _decode(batches: Iterator[pa.RecordBatch], spec: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    parsed = json.loads(spec)
    names = {i: t for t, i in parsed["model"]["vocab"].items()} | {x["id"]: x["content"] for x in parsed["added_tokens"]}
    table = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.string())
    for b in batches:
        for lo in range(0, b.num_rows, 1000):
            part = b.slice(lo, 1000)
            ids = part.column("ids")
            ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(ids), 0)).to_numpy()
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), table.take(ids.flatten()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids, pc.binary_join(tokens, " ")], [*keep, "ids", "decoded"])


def vocabulary(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the token ids of every row. path: the vocabulary file."""
    spec = vocabulary(path)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(lambda it: _encode(it, spec, ["doc_id"]), f"doc_id {kind}, ids array<int>")


def bpe_round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bpe_decode(bpe_encode()) in one pass: a Python worker per task instead of two, and the ids don't go through the JVM between."""
    spec = vocabulary(path)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(lambda it: _decode(_encode(it, spec, ["doc_id"]), spec, ["doc_id"]), f"doc_id {kind}, ids array<int>, decoded string")


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the decoded text: the tokens with a space between them, specials kept."""
    spec = vocabulary(path)
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decode(it, spec, ["doc_id"]), f"doc_id {kind}, ids array<int>, decoded string")

"""Operator 12, best-fit packing: token sequences of a fixed capacity, filled with whole documents where they fit.

Method: best-fit decreasing with a segment tree over remaining capacities. Documents are taken by falling length and each goes to the
tightest open sequence that has room, which the tree finds in logarithmic time. Lengths are whole numbers up to the capacity, so documents of
one length are alike and a count per length is all that the packing depends on: equal documents go one after the other to equal sequences, and a
range of them is placed by one step of the tree. The plan of all steps, at most a few per pair of lengths however many documents there are
(`plan`), is made once; the documents then get their places as tasks: a document's rank among those of its length, from counts per
block of rows, says which step placed it and where. So the packing of the whole corpus is one, not one per partition.

Longer documents are cut into pieces of the capacity, of which the first may be shorter. Nulls are empty texts, which are a piece of the
end token alone; repeated rows and ties are packed row by row; a null id stays null; extra columns are ignored. Very long texts need memory in
proportion to their own length. The vocabulary file (a few MB, of a fixed size) is read by the driver and sent to the tasks.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varloom.llm._common import chunks, text_buffers, written
from varloom.llm.bpe import byte_alphabet, vocabulary

#: The pattern by which byte-level BPE splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of the written table that are ranked together, on average.
BLOCK = 1 << 17
#: Documents of one length are told apart by a rank below this.
MOST_RANK = 1 << 40


class Encoder:
    """Token ids of a text as the tokenizers library gives them. Plain byte-level BPE, whose ids follow its merges, goes by tiktoken, which gives
    the same ids several times as fast; texts with added tokens, or on which its pattern gives up, go by the library itself."""

    def __init__(self, spec: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        parsed = json.loads(spec)
        self.added = [x["content"] for x in parsed["added_tokens"]]
        self.fast = self._tiktoken(parsed)

    def _tiktoken(self, spec: dict):
        import tiktoken

        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and spec["normalizer"] is None
        odd = [model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")]
        if model["type"] != "BPE" or not plain or any(odd):
            return None
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        own = {t: i for t, i in model["vocab"].items() if t not in self.added}
        made = ["".join(x if isinstance(x, list) else x.split(" ")) for x in model["merges"]]
        if any(own.get(t) != len(byte) + i for i, t in enumerate(made)) or len(own) != len(byte) + len(made):
            return None
        ranks = {bytes(byte[c] for c in t): i for t, i in own.items()}
        return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast and not any(x in text for x in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its pattern gives up on very long white space
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


#: A worker keeps the last encoder for its next tasks.
_KEPT: dict[str, Encoder] = {}


def _cut(batches: Iterator[pa.RecordBatch], spec: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    if spec not in _KEPT:
        _KEPT.clear()
        _KEPT[spec] = Encoder(spec)
    encoder, end = _KEPT[spec], np.array([end_id], "<u4")
    kinds = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})
    for b in batches:
        for lo, hi in chunks(text_buffers(b.column(1))[0]) if b.num_rows else ():
            row, cols = [], {k: [] for k in kinds}
            for r, text in enumerate(b.column(1).slice(lo, hi - lo).to_pylist(), lo):
                ids = np.concatenate([encoder.ids(text or "").astype("<u4", copy=False), end])
                edges = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                for i, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
                    row.append(r)
                    for k, v in zip(kinds, (i, s, e - s, zlib.crc32(ids[s:e].tobytes()), ids[s:e].astype(np.int32)), strict=False):
                        cols[k].append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(v, kinds[k]) for k, v in cols.items())], ["doc_id", *kinds])


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece: a document's tokens and the end token, cut from the
    end into pieces of the capacity. path: the vocabulary file of the tokenizers library."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    spec = vocabulary(path)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    ids = ", ids array<int>" if with_ids else ""
    return own.mapInArrow(lambda it: _cut(it, spec, capacity, end_id, with_ids), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{ids}")


class Room:
    """A segment tree over remaining capacities: how many ranges of open sequences have each."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.tree[at] += n
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity of an open sequence that is at least so large."""
        at = least + self.size
        while not self.tree[at]:
            while at & 1:  # the last one of its parent
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.tree[2 * at] else 2 * at + 1
        return at - self.size


class Step(NamedTuple):
    """Pieces of one length, from a rank on, go to sequences from `sequence` on, `each` of them in one, from `offset` on."""

    length: int
    rank: int
    sequence: int
    each: int
    offset: int


def plan(counts: dict[int, int], capacity: int) -> list[Step]:
    """Best-fit decreasing of so many pieces of each length. A length splits at most one range of equal open sequences into three and
    opens one new, so there are at most 3 * capacity ranges and 3 * capacity**2 steps, whatever the counts."""
    room, ranges, steps, opened = Room(capacity), {}, [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            ranges.setdefault(left, []).append((first, n))
            room.add(left, 1)

    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            left = room.tightest(length)
            if left is None:
                left, many = capacity, -(-(n - rank) // (capacity // length))
                put(left, opened, many)
                opened += many
            first, many = ranges[left].pop()
            room.add(left, -1)
            each = left // length
            placed = min(n - rank, many * each)
            full, rest = divmod(placed, each)
            steps.append(Step(length, rank, first, each, capacity - left))
            put(left - each * length, first, full)
            put(left - rest * length, first + full, int(rest > 0))
            put(left, first + full + (rest > 0), many - full - (rest > 0))
            rank += placed
    return steps


def _place(batches: Iterator[pa.RecordBatch], steps: np.ndarray) -> Iterator[pa.RecordBatch]:
    """steps: the plan's rows, by length and rank. The last column of a batch is the rank."""
    key = steps[:, 0] * MOST_RANK + steps[:, 1]
    for b in batches:
        length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
        s = steps[np.searchsorted(key, length * MOST_RANK + rank, side="right") - 1]
        j = rank - s[:, 1]
        more = [pa.array(s[:, 2] + j // s[:, 3]), pa.array(s[:, 4] + j % s[:, 3] * length)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], [*b.schema.names[:-1], "sequence_id", "offset"])


def best_fit_packing(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """The rows of `cut`, whose column length (long) is at most the capacity, with the sequence and the place there of each. The rows are written
    first, as ranks are counted over them; what goes to the driver is a count per length."""
    rows = written(cut, "pieces").select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_file", "_row"), F.lit(rows.count() // BLOCK + 1)))
    key = ["length", "_block"]
    blocks = written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "blocks")
    counts = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = np.array(sorted(plan(counts, capacity)) or np.zeros((0, 5)), np.int64)
    earlier = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(*key, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(*key).orderBy("_file", "_row")) - 1
    ranked = rows.join(before, key).select(*cut.columns, rank.alias("_rank"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(lambda it: _place(it, steps), f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids and the documents' starts there, of packed pieces with ids. A sequence has at most its capacity of tokens."""
    own = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    s = packed.groupBy("sequence_id").agg(own.alias("own"))
    ids = F.flatten(F.col("own.ids"))
    return s.select("sequence_id", F.size(ids).cast("long").alias("n_tokens"), ids.alias("ids"), F.col("own.offset").alias("offsets"), F.col("own.doc_id").alias("doc_ids"))

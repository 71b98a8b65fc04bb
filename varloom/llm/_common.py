"""Helpers shared by the corpus operators: row keys, checkpoint folder, hashing of Arrow text."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the polynomial hashes, taken modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(BASE, -1, 1 << 64)
#: Of the hashes of words, and bytes beyond which a word is hashed by itself.
SEED, LONG = 0x5DEECE66D, 64
#: Bytes that numpy works on at a time.
CHUNK = 1 << 20

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Only where driver and executors are one process may it be
    unset; a folder of our own serves then."""
    if d := spark.conf.get("spark.checkpoint.dir", None):
        return d
    if not re.match(r"local(\[[^\]-]*\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="varloom-", dir="/tmp")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: list[str] | None = None) -> DataFrame:
    """(_d, _h, text): a null id counts as the smallest, a null text as empty. _h (32 bits) tells apart
    different texts under one id; equal rows share a key and so a result."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    return docs.select(d.alias("_d"), F.shiftright(F.xxhash64(text), 32).alias("_h"), text.alias("text"), *(more or []))


def row_of(names: list[str]):
    """A struct of columns of any name."""
    return F.struct(*[F.col("`" + n.replace("`", "``") + "`") for n in names])


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the documents (rows of one id and text) whose keys are in gone (_d, _h); columns of any name stay as they are.
    The keys are written first, so that Spark knows their size and sends them to the documents where they are few."""
    gone = written(gone.select("_d", "_h").distinct(), "gone")
    rows = keyed(docs.select("doc_id", "text", row_of(docs.columns).alias("_row")), more=["_row"])
    return rows.join(gone, ["_d", "_h"], "left_anti").select("_row.*")


def with_id(df: DataFrame) -> DataFrame:
    """doc_id back from _d."""
    d = F.when(F.col("_d") != F.lit(-(2**63)), F.col("_d"))
    return df.select(d.alias("doc_id"), *[c for c in df.columns if c not in ("_d", "_h")])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    size = max(CHUNK + 4096, n)
    if size not in _POWERS:
        _POWERS.clear()
        one = np.ones(1, np.uint64)
        up = np.multiply.accumulate(np.concatenate([one, np.full(size, BASE, np.uint64)]))
        down = np.multiply.accumulate(np.concatenate([one, np.full(size, _INV, np.uint64)]))
        _POWERS[size] = up, down
    return _POWERS[size]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """C with C[e] - C[s] = sum of (byte + 1) * BASE**-j over s <= j < e."""
    c = np.empty(len(data) + 1, np.uint64)
    c[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data) + 1)[1][: len(data)], out=c[1:])
    return c


def slice_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each [start, end), the same wherever the bytes stand."""
    return mix(powers(len(c))[0][end] * (c[end] - c[start]))


def sliding(f: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """f over each w neighbours, by doubling."""
    k = 1
    while k * 2 <= w:
        x = f(x[: len(x) - k], x[k:])
        k *= 2
    return f(x[: len(x) - (w - k)], x[w - k :]) if k < w else x


def text_buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow string column, without copies."""
    big = str(col.type).startswith("large")
    off = np.frombuffer(col.buffers()[1], np.int64 if big else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return off, data


def chunks(off: np.ndarray, most: int = CHUNK):
    """(first row, last row + 1) of runs of rows of at most so many bytes, or one row."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, j
        i = j


def is_space(b: np.ndarray) -> np.ndarray:
    """The bytes of [\\x20\\x09-\\x0D]."""
    return (b == 32) | ((b >= 9) & (b <= 13))


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of [^\\x20\\x09-\\x0D]+ in data, and each document's first word
    number (one more at the end). off: where documents start in data."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~is_space(data)
    first = np.zeros(n + 1, bool)
    first[off] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | first))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | first))
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes at a time go through a mixing function, all words at once; long ones by xxhash64."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    n = ends - starts
    h = mix(n.astype(np.uint64) + np.uint64(SEED))
    for at in range(0, min(int(n.max(initial=0)), LONG), 8):
        rows = np.flatnonzero(n > at) if at else slice(None)
        left = n[rows] - at
        block = eight[starts[rows] + at] & (np.uint64(2**64 - 1) >> (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64)))
        h[rows] = mix(h[rows] ^ block) + block
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), SEED)
    return h


def word_numbers(words: list[bytes]) -> np.ndarray:
    """The number of each word among the different ones: equal words have equal numbers, and no others."""
    return pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of an Arrow array of strings, and the first word of each text, with the number of words at the end."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # white space at either end leaves empty strings
    size = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[size]

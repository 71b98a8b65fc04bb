"""BAM as a Spark data source, read in splits and written block by block in tasks.

A BAM file is a chain of BGZF blocks (gzip members of up to 64 KiB that state their own size), and records may straddle them. A split is a
range of the file's bytes: its first block is found by the block's header, its first record by a chain of records that are sound one after
the other, and it reads the records that begin in its blocks, whatever block they end in. So any number of tasks reads one file. Where splits
are many more than the tasks that can run, neighbours go to one task, as one longer range.

Records are made and taken apart in columns, a batch at a time: numpy places the bytes of all records of a batch at once.

Files are reached through pyarrow.fs: local paths, file:, hdfs:, s3: and gs: locations.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# Fixed values of the format.
OPS, LETTERS = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
MAGIC, BLOCK_HEAD = b"BAM\1", struct.Struct("<4BI2BH2BHH")
FIXED = struct.Struct("<iiBBHHHiiii")
NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
MOST_BLOCK = 1 << 16
#: FIXED by name; with the record's size before it.
HEAD = np.dtype([(n, t) for n, t in zip("ref pos l_name mapq bin n_cigar flag l_seq mate mate_pos size".split(), "<i4 <i4 u1 u1 <u2 <u2 <u2 <i4 <i4 <i4 <i4".split(), strict=True)])
SIZED = np.dtype([("record", "<i4"), *((n, HEAD[n]) for n in HEAD.names)])
#: Bytes of a file that are read at once, and of records that are taken apart at once.
AHEAD, HELD = 1 << 18, 1 << 20
#: Bytes of a file that a task reads at most because of many splits.
MOST_RANGE = 32 << 20

COLUMNS = "offset long, name string, flag int, ref string, pos long, mapq int, cigar array<struct<op:string,len:int>>, mate_ref string, mate_pos long, insert_size int, seq string, qual string, tags map<string,string>"
ARROW = pa.schema([
    ("offset", pa.int64()), ("name", pa.string()), ("flag", pa.int32()), ("ref", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))),
    ("mate_ref", pa.string()), ("mate_pos", pa.int64()), ("insert_size", pa.int32()), ("seq", pa.string()), ("qual", pa.string()), ("tags", pa.map_(pa.string(), pa.string())),
])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


def block_size(head: bytes) -> int | None:
    """Bytes of the BGZF block that begins so; None where none does."""
    if len(head) < BLOCK_HEAD.size:
        return None
    a, b, c, d, _, _, _, extra, s1, s2, length, size = BLOCK_HEAD.unpack_from(head)
    return size + 1 if (a, b, c, d, s1, s2, length) == (31, 139, 8, 4, 66, 67, 2) and extra >= 6 else None


class Blocks:
    """Blocks of a file from a place on: (place, contents)."""

    def __init__(self, file) -> None:
        self.file, self.size = file, file.size()
        self.window, self.begin = b"", 0

    def read(self, n: int, place: int) -> bytes:
        """n bytes from a place on, or those up to the file's end."""
        if not self.begin <= place <= place + n <= self.begin + len(self.window):
            self.window, self.begin = self.file.read_at(min(max(n, AHEAD), self.size - place), place), place
        return self.window[place - self.begin : place - self.begin + n]

    def at(self, place: int) -> tuple[int, bytes] | None:
        """Place of the next block, and contents; None at the file's end or where no block is."""
        head = self.read(BLOCK_HEAD.size, place) if place + BLOCK_HEAD.size <= self.size else b""
        n = block_size(head)
        if n is None or place + n > self.size:
            return None
        raw = self.read(n, place)
        extra = struct.unpack_from("<H", raw, 10)[0]
        data = zlib.decompress(raw[12 + extra : -8], -15)
        crc, length = struct.unpack("<II", raw[-8:])
        if len(data) != length or zlib.crc32(data) != crc:
            raise ValueError(f"damaged block at {place}")
        return place + n, data

    def first(self, place: int) -> int | None:
        """Place of the first block at or after a place: a header whose block is sound and followed by another one or the end."""
        raw = self.file.read_at(min(2 * MOST_BLOCK, self.size - place), place)
        i = raw.find(b"\x1f\x8b\x08\x04")
        while i >= 0:
            try:
                if (found := self.at(place + i)) and (found[0] == self.size or block_size(self.file.read_at(min(BLOCK_HEAD.size, self.size - found[0]), found[0]))):
                    return place + i
            except (ValueError, zlib.error):
                pass
            i = raw.find(b"\x1f\x8b\x08\x04", i + 1)
        return None


class Stream:
    """Contents of the blocks from a place on as one text, with the place of each byte's block."""

    def __init__(self, blocks: Blocks, place: int) -> None:
        self.blocks, self.next = blocks, place
        self.data, self.at = b"", 0
        self.starts: list[tuple[int, int]] = []  # of each block held: where it begins in data, and its place

    def have(self, n: int) -> bool:
        """Whether n more bytes are there; reads blocks until they are."""
        if len(self.data) - self.at >= n:
            return True
        dropped = max((s for s, _ in self.starts if s <= self.at), default=0)  # the block that is being read stays
        parts, length = [self.data[dropped:]], len(self.data) - dropped
        self.starts = [(s - dropped, p) for s, p in self.starts if s >= dropped]
        self.at -= dropped
        while length - self.at < n and (found := self.blocks.at(self.next)):
            self.starts.append((length, self.next))
            self.next = found[0]
            parts.append(found[1])
            length += len(found[1])
        self.data = b"".join(parts)
        return length - self.at >= n

    def fill(self, end: int) -> None:
        """Has some blocks at hand, of those before a place of the file."""
        while self.next < end and len(self.data) - self.at < HELD and self.have(min(HELD, len(self.data) - self.at + MOST_BLOCK)):
            pass

    def whole(self) -> list[int]:
        """Where the whole records that are held begin, and where the last of them ends."""
        data, at, n, size_at = self.data, self.at, len(self.data), struct.Struct("<i").unpack_from
        out = [at]
        while at + 4 <= n:
            (size,) = size_at(data, at)
            if size < FIXED.size:
                raise ValueError("damaged record")
            at += 4 + size
            if at > n:
                break
            out.append(at)
        return out

    def place(self) -> tuple[int, int]:
        """Place of the block in which the next byte is, and the byte's offset there."""
        s, p = max(x for x in self.starts if x[0] <= self.at)
        return p, self.at - s

    def take(self, n: int) -> bytes:
        if not self.have(n):
            raise ValueError("the file ends inside a record")
        self.at += n
        return self.data[self.at - n : self.at]


def read_header(blocks: Blocks) -> tuple[str, list[tuple[str, int]], Stream]:
    """Header text, sequences (name, length), and the stream at the first record."""
    s = Stream(blocks, 0)
    if s.take(4) != MAGIC:
        raise ValueError("not a BAM file")
    text = s.take(struct.unpack("<i", s.take(4))[0]).rstrip(b"\0").decode()
    refs = []
    for _ in range(struct.unpack("<i", s.take(4))[0]):
        name = s.take(struct.unpack("<i", s.take(4))[0])[:-1].decode()
        refs.append((name, struct.unpack("<i", s.take(4))[0]))
    return text, refs, s


#: Bytes that a record may have for its place to be found from the middle of a file.
MOST_RECORD = 64 << 20


def sound(data: bytes, at: int, refs: list[tuple[str, int]], records: int = 8) -> bool | int:
    """Whether records follow one another from a place on, as far as data goes or so many of them. Where not even one is whole: how many
    bytes from the place on it takes to tell."""
    first, seen = at, 0
    while seen < records and len(data) - at >= 4 + FIXED.size:
        (size,) = struct.unpack_from("<i", data, at)
        ref, pos, mate, mate_pos, l_name, _, _, n_cigar, flag, l_seq = _heads(data, at + 4)
        ok = MOST_RECORD >= size >= FIXED.size and l_name > 0 and l_seq >= 0 and size >= FIXED.size + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
        ok = ok and all(-1 <= r < len(refs) and -1 <= p <= (refs[r][1] if r >= 0 else 0) for r, p in ((ref, pos), (mate, mate_pos))) and flag < 1 << 12
        name = data[at + 4 + FIXED.size :][:l_name] if ok else b""
        if not ok or len(name) == l_name and (name[-1] != 0 or not all(33 <= c <= 126 for c in name[:-1])):
            return False
        cigar = data[at + 4 + FIXED.size + l_name :][: 4 * n_cigar]
        if any(c & 15 >= len(OPS) for c in cigar[::4]):
            return False
        if at + 4 + size > len(data):
            return seen > 0 or at + 4 + size - first
        at, seen = at + 4 + size, seen + 1
    return seen > 0


def _heads(data: bytes, at: int) -> tuple:
    ref, pos, l_name, mapq, bin_, n_cigar, flag, l_seq, mate, mate_pos = struct.unpack_from("<iiBBHHHiii", data, at)
    return ref, pos, mate, mate_pos, l_name, mapq, bin_, n_cigar, flag, l_seq


def _tags(raw: bytes) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in NUMBERS:
            n = struct.calcsize(NUMBERS[kind])
            value = struct.unpack_from(NUMBERS[kind], raw, at)[0]
            yield name, f"{value:g}" if kind == "f" else str(value)
            at += n
        elif kind == "A":
            yield name, chr(raw[at])
            at += 1
        elif kind in "ZH":
            end = raw.index(0, at)
            yield name, raw[at:end].decode()
            at = end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            step = struct.calcsize(NUMBERS[sub])
            values = [struct.unpack_from(NUMBERS[sub], raw, at + 5 + i * step)[0] for i in range(n)]
            yield name, ",".join([sub, *(f"{v:g}" if sub == "f" else str(v) for v in values)])
            at += 5 + n * step
        else:
            raise ValueError(f"no kind of tag: {kind}")


_LETTERS = np.frombuffer(LETTERS.encode(), np.uint8)
_QUALS = np.minimum(np.arange(256) + 33, 126).astype(np.uint8)


def _spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range of n places, one range after the other."""
    before = np.cumsum(n) - n
    return np.repeat(start - before, n) + np.arange(int(n.sum()))


def _strings(n: np.ndarray, fill: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For strings of n bytes: offsets, where each begins, and the bytes to be filled in."""
    off = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=off[1:])
    return off, off[:-1], np.full(off[-1], fill, np.uint8)


def _as_strings(off: np.ndarray, data: np.ndarray) -> pa.Array:
    out = pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data))
    out.validate(full=True)
    return out


def decode(data: bytes, starts: np.ndarray, ends: np.ndarray, refs: list[tuple[str, int]], offsets: np.ndarray) -> pa.RecordBatch:
    """Rows of COLUMNS from records, each without its size, that stand in data so."""
    raw = np.frombuffer(data, np.uint8)
    head = raw[starts[:, None] + np.arange(HEAD.itemsize)].view(HEAD)[:, 0]
    l_name, n_cigar, l_seq = (head[c].astype(np.int64) for c in ("l_name", "n_cigar", "l_seq"))
    names = starts + HEAD.itemsize
    cigars = names + l_name
    seqs = cigars + 4 * n_cigar
    quals = seqs + (l_seq + 1) // 2
    tags = quals + l_seq
    if (l_seq < 0).any() or (l_name < 1).any() or (tags > ends).any():
        raise ValueError("damaged record")

    name_off, _, _ = _strings(l_name - 1)
    parts = np.ascontiguousarray(raw[_spans(cigars, 4 * n_cigar)]).view("<u4")
    ops = pa.DictionaryArray.from_arrays(pa.array((parts & 15).astype(np.int32)), pa.array(list(OPS)))
    cigar_off, _, _ = _strings(n_cigar)
    kind = ARROW.field("cigar").type
    cigar = pa.ListArray.from_arrays(pa.array(cigar_off.astype(np.int32)), pa.StructArray.from_arrays([ops.cast(pa.string()), pa.array((parts >> 4).astype(np.int32))], fields=list(kind.value_type)), type=kind)

    seq_off, begin, bases = _strings(np.maximum(l_seq, 1), ord("*"))
    within = _spans(np.zeros_like(l_seq), l_seq)
    pair = raw[np.repeat(seqs, l_seq) + within // 2]
    bases[_spans(begin, l_seq)] = _LETTERS[np.where(within % 2 == 0, pair >> 4, pair & 15)]
    given = np.where((l_seq > 0) & (raw[np.minimum(quals, len(raw) - 1)] != 255), l_seq, 0)
    qual_off, begin, marks = _strings(np.maximum(given, 1), ord("*"))
    marks[_spans(begin, given)] = _QUALS[raw[_spans(quals, given)]]

    ref_names = pa.array([*(n for n, _ in refs), "*"], pa.string())
    name_of = lambda r: ref_names.take(pa.array(np.where(r >= 0, r, len(refs))))
    columns = [
        pa.array(offsets), _as_strings(name_off, raw[_spans(names, l_name - 1)]), pa.array(head["flag"].astype(np.int32)), name_of(head["ref"]), pa.array(head["pos"].astype(np.int64) + 1), pa.array(head["mapq"].astype(np.int32)),
        cigar, name_of(head["mate"]), pa.array(head["mate_pos"].astype(np.int64) + 1), pa.array(head["size"].astype(np.int32)), _as_strings(seq_off, bases), _as_strings(qual_off, marks), _tag_maps(data, raw, tags, ends),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW)


def _tag_maps(data: bytes, raw: np.ndarray, at: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The tags between two places each, as maps: the first ones of all records at once, then the second ones, and so on."""
    zeros = np.flatnonzero(raw == 0)
    rows, now = np.flatnonzero(at < ends), at.copy()
    none = np.zeros(0, np.int64)
    found: list[tuple] = [(none, none, none, none, none)]  # rows, tags' places, those of texts and their bytes (0: a number), numbers
    while len(rows):
        a = now[rows]
        if (a + 4 > ends[rows]).any():
            raise ValueError("damaged record")
        kinds, value, size = raw[a + 2], a + 3, np.zeros(len(a), np.int64)
        number, length = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        for kind in np.unique(kinds).tolist():
            own = np.flatnonzero(kinds == kind)
            if chr(kind) in "ZH":
                i = np.searchsorted(zeros, value[own])
                if (i == len(zeros)).any():
                    raise ValueError("damaged record")
                length[own] = zeros[i] - value[own]
                size[own] = length[own] + 1
            elif chr(kind) == "A":
                length[own] = size[own] = 1
            elif chr(kind) in NUMBERS and chr(kind) != "f":
                size[own] = n = struct.calcsize(NUMBERS[chr(kind)])
                if (value[own] + n > ends[rows[own]]).any():
                    raise ValueError("damaged record")
                number[own] = raw[value[own][:, None] + np.arange(n)].view(np.dtype("<" + {"b": "i", "h": "i", "i": "i", "B": "u", "H": "u", "I": "u"}[NUMBERS[chr(kind)][1]] + str(n)))[:, 0]
                length[own] = -1
            else:  # fractions and arrays
                return pa.array([list(_tags(data[s:e])) for s, e in zip(at.tolist(), ends.tolist(), strict=True)], ARROW.field("tags").type)
        found.append((rows, a, np.where(length < 0, 0, value), length, number))
        now[rows] = value + size
        if (now[rows] > ends[rows]).any():
            raise ValueError("damaged record")
        rows = rows[now[rows] < ends[rows]]
    rows, a, value, length, number = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(rows, kind="stable")
    a, value, length, number = a[order], value[order], length[order], number[order]
    digits = pa.array(number[length < 0]).cast(pa.string())
    n = length.copy()
    n[length < 0] = pc.binary_length(digits).to_numpy(zero_copy_only=False)
    off, begin, texts = _strings(n)
    texts[_spans(begin, np.maximum(length, 0))] = raw[_spans(value, np.maximum(length, 0))]
    texts[_spans(begin[length < 0], n[length < 0])] = _text(digits)[2]
    keys = raw[a[:, None] + np.arange(2)].ravel()
    map_off, _, _ = _strings(np.bincount(rows, minlength=len(at)))
    return pa.MapArray.from_arrays(pa.array(map_off.astype(np.int32)), _as_strings(np.arange(len(a) + 1) * 2, keys), _as_strings(off, texts))


def _text(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each string of a column begins in its bytes, how many it has, and the bytes of all of them and no others."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if len(column) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return off[:-1] - off[:1], np.diff(off), data


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


def records(path: str, start: int, end: int) -> Iterator[pa.RecordBatch]:
    """Rows of the records that begin in blocks whose place is in a range of the file's bytes."""
    system, name = opened(path)
    with system.open_input_file(name) as f:
        blocks = Blocks(f)
        _, refs, stream = read_header(blocks)
        if start > 0:
            place = blocks.first(start)
            if place is None or place >= end:
                return
            header_end = stream.place() if stream.have(1) else (blocks.size, 0)
            if (place, 0) > header_end:
                stream = Stream(blocks, place)
                while stream.have(4 + FIXED.size):  # a byte further until a chain of records begins
                    stream.have(4 * MOST_BLOCK)
                    found = sound(stream.data, stream.at, refs)
                    if found is not True and found and stream.have(found + 4 * MOST_BLOCK) | stream.have(found):
                        found = sound(stream.data, stream.at, refs)
                    if found is True:
                        break
                    stream.at += 1
        while stream.have(4) and stream.place()[0] < end:
            stream.fill(end)
            ends = stream.whole()
            if len(ends) == 1:  # the record is longer than what is held
                size = 4 + struct.unpack_from("<i", stream.data, stream.at)[0]
                if not stream.have(size):
                    raise ValueError("the file ends inside a record")
                ends = [stream.at, stream.at + size]
            at = np.array(ends)
            begin, place = (np.array(x) for x in zip(*stream.starts, strict=True))
            block = np.searchsorted(begin, at[:-1], "right") - 1
            n = int(np.searchsorted(place[block], end))
            if n:
                yield decode(stream.data, at[:n] + 4, at[1 : n + 1], refs, place[block[:n]] << 16 | (at[:n] - begin[block[:n]]))
            if n < len(block):
                return
            stream.at = ends[-1]


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.split, self.tasks = options["path"], int(options.get("splitbytes", 32 << 20)), int(options.get("tasks", 0))

    def partitions(self) -> list[Split]:
        """A split each, or several neighbours where splits are more than the tasks asked for."""
        system, name = opened(self.path)
        info = system.get_file_info(name)
        prefix = self.path[: len(self.path) - len(name)] if self.path.endswith(name) else ""
        files = [info] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(name)) if x.is_file and x.path.endswith(".bam")]
        most = min(MOST_RANGE, sum(x.size for x in files) // self.tasks) if self.tasks else 0
        step = self.split * max(1, most // self.split)
        return [Split(prefix + x.path, at, min(at + step, x.size)) for x in sorted(files, key=lambda x: x.path) for at in range(0, x.size, step)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        yield from records(partition.path, partition.start, partition.end)


# --- writing


def region_bin(start: int, end: int) -> int:
    """The format's bin of [start, end), from 0."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return first + (start >> shift)
    return 0


def region_bins(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """region_bin() of each range."""
    end, out = end - 1, np.zeros_like(start)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = np.where(start >> shift == end >> shift, first + (start >> shift), out)
    return out


def encode(r, number: dict[str, int]) -> bytes:
    """A record with its size. r: a row with the columns of COLUMNS but offset; tags whose value is a whole number become numbers, if named AS or NM."""
    name = r.name.encode() + b"\0"
    cigar = [(x["len"] << 4) | OPS.index(x["op"]) for x in r.cigar or []]
    on_ref = sum(x["len"] for x in r.cigar or [] if x["op"] in "MDN=X")
    seq = "" if r.seq in (None, "*") else r.seq
    codes = [LETTERS.find(c) if c in LETTERS else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    qual = bytes([255] * len(seq)) if r.qual in (None, "*") else bytes(ord(c) - 33 for c in r.qual)
    tags = b"".join(k.encode() + (b"i" + struct.pack("<i", int(v)) if k in ("AS", "NM") else b"Z" + v.encode() + b"\0") for k, v in sorted((r.tags or {}).items()))
    start = r.pos - 1
    fixed = FIXED.pack(number.get(r.ref, -1), start, len(name), r.mapq, region_bin(max(start, 0), max(start, 0) + max(on_ref, 1)), len(cigar), r.flag, len(seq), number.get(r.mate_ref, -1), r.mate_pos - 1, r.insert_size)
    body = fixed + name + struct.pack(f"<{len(cigar)}I", *cigar) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


_CODES = np.full(256, 15, np.uint8)
_CODES[[ord(c) for c in LETTERS + LETTERS.lower()]] = [*range(16)] * 2


class Odd(ValueError):
    """A batch that is to be made record by record, which also says what is wrong with one."""


def encode_batch(b: pa.RecordBatch, number: dict[str, int]) -> bytes:
    """encode() of all rows."""
    try:
        return _encoded(b, number)
    except (Odd, pa.ArrowInvalid):
        rows = (Row(**(x | {"tags": dict(x["tags"] or ())})) for x in b.to_pylist())
        return b"".join(encode(r, number) for r in rows)


def _encoded(b: pa.RecordBatch, number: dict[str, int]) -> bytes:
    column = {f.name: b.column(f.name) for f in b.schema}
    if any(column[c].null_count for c in ("name", "flag", "pos", "mapq", "mate_pos", "insert_size")):
        raise Odd
    at_name, l_name, names = _text(column["name"])
    at_seq, l_seq, seq = _text(pc.replace_with_mask(column["seq"], pc.fill_null(pc.equal(column["seq"], "*"), True), pa.scalar("", column["seq"].type)))
    no_qual = pc.fill_null(pc.equal(column["qual"], "*"), True)
    _, l_qual, qual = _text(pc.replace_with_mask(column["qual"], no_qual, pa.scalar("", column["qual"].type)))
    if max(seq.max(initial=0), qual.max(initial=0)) > 127 or qual.min(initial=33) < 33:
        raise Odd

    n_cigar = pc.fill_null(pc.list_value_length(column["cigar"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    parts = pc.list_flatten(column["cigar"])
    op, size = pc.index_in(pc.struct_field(parts, "op"), pa.array(list(OPS))), pc.struct_field(parts, "len")
    if op.null_count or size.null_count:
        raise Odd
    op, size = op.to_numpy(zero_copy_only=False).astype(np.int64), size.to_numpy(zero_copy_only=False).astype(np.int64)
    on_ref = np.concatenate([[0], np.cumsum(np.where(np.isin(op, [OPS.index(c) for c in "MDN=X"]), size, 0))])
    off_cigar = np.concatenate([[0], np.cumsum(n_cigar)])
    on_ref = on_ref[off_cigar[1:]] - on_ref[off_cigar[:-1]]

    own, tag, tag_size, texts, text_size = _tag_bytes(column["tags"])
    l_tags = np.bincount(own, tag_size, len(b)).astype(np.int64)

    whole = lambda c: column[c].to_numpy(zero_copy_only=False).astype(np.int64)
    place = lambda c: np.array([*number.values(), -1])[pc.fill_null(pc.index_in(column[c], pa.array(list(number), pa.string())), len(number)).to_numpy(zero_copy_only=False)]
    start = whole("pos") - 1
    first = np.maximum(start, 0)
    length = HEAD.itemsize + l_name + 1 + 4 * n_cigar + (l_seq + 1) // 2 + np.where(no_qual, l_seq, l_qual) + l_tags
    fields = [length, place("ref"), start, l_name + 1, whole("mapq"), region_bins(first, first + np.maximum(on_ref, 1)), n_cigar, whole("flag"), l_seq, place("mate_ref"), whole("mate_pos") - 1, whole("insert_size")]
    head = np.zeros(len(b), SIZED)
    for c, x in zip(SIZED.names, fields, strict=True):
        head[c] = x
        if (head[c] != x).any():
            raise Odd
    if ((size < 0) | (size >= 1 << 28)).any():
        raise Odd

    at = np.cumsum(length + 4) - length - 4
    out = np.zeros(int((length + 4).sum()), np.uint8)
    out[at[:, None] + np.arange(SIZED.itemsize)] = head.view(np.uint8).reshape(len(b), SIZED.itemsize)
    at = at + SIZED.itemsize
    out[_spans(at, l_name)] = names
    at = at + l_name + 1
    out[_spans(at, 4 * n_cigar)] = (size << 4 | op).astype("<u4").view(np.uint8)
    at = at + 4 * n_cigar
    within, to = _spans(np.zeros_like(l_seq), l_seq), np.repeat(at, l_seq)
    codes, to, even = _CODES[seq], to + within // 2, within % 2 == 0
    out[to[even]] = codes[even] << 4
    out[to[~even]] |= codes[~even]
    at = at + (l_seq + 1) // 2
    out[_spans(at, np.where(no_qual, l_seq, 0))] = 255
    out[_spans(at, l_qual)] = qual - 33
    at = at + np.where(no_qual, l_seq, l_qual)
    at = at[own] + np.cumsum(tag_size) - tag_size - (np.cumsum(l_tags) - l_tags)[own]
    out[at[:, None] + np.arange(3)] = tag
    out[_spans(at + 3, text_size)] = texts
    return out.tobytes()


def _tag_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tags of all rows in the order of rows and names: their rows, names and kinds, bytes in a record; the values' bytes and how many each has."""
    off = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.where(column.is_null(), 0, np.diff(off))
    own, pick = np.repeat(np.arange(len(n)), n), pa.array(_spans(off[:-1], n))
    keys, values = column.keys.take(pick), column.items.take(pick)
    _, key_size, key = _text(keys)
    if values.null_count or (key_size != 2).any():
        raise Odd
    key = key.reshape(len(keys), 2)
    order = np.lexsort((key[:, 1], key[:, 0], own))
    key, values = key[order], values.take(pa.array(order))
    whole = ((key == (65, 83)) | (key == (78, 77))).all(1)  # AS and NM
    tag = np.concatenate([key, np.where(whole, ord("i"), ord("Z")).astype(np.uint8)[:, None]], 1)
    numbers = values.filter(pa.array(whole)).cast(pa.int32()).to_numpy(zero_copy_only=False)
    _, size, text = _text(pc.replace_with_mask(values, pa.array(whole), pa.scalar("", values.type)))
    tag_size = 3 + np.where(whole, 4, size + 1)
    _, begin, texts = _strings(np.where(whole, 4, size + 1))
    texts[_spans(begin, size)] = text
    texts[_spans(begin[whole], np.full(len(numbers), 4))] = numbers.astype("<i4").view(np.uint8)
    return own, tag, tag_size, texts, tag_size - 3


def block(data: bytes) -> bytes:
    """A BGZF block of at most 64 KiB."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    raw = z.compress(data) + z.flush()
    size = BLOCK_HEAD.size + len(raw) + 8
    if size > MOST_BLOCK:
        raise ValueError("a block does not compress; use smaller ones")
    return BLOCK_HEAD.pack(31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, size - 1) + raw + struct.pack("<II", zlib.crc32(data), len(data))


@dataclass
class Part(WriterCommitMessage):
    name: str | None


class BamWriter(DataSourceArrowWriter):
    """A file per task, put in place once all tasks are done; tasks that run twice leave nothing behind."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.refs, self.text = options["path"], json.loads(options["references"]), options.get("header", "")
        self.block, self.overwrite, self.job = min(int(options.get("blockbytes", 0xFF00)), 0xFF00), overwrite, uuid.uuid4().hex

    def _temporary(self) -> tuple[fs.FileSystem, str, str]:
        system, name = opened(self.path)
        return system, name, f"{name}/_temporary-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        system, _, temporary = self._temporary()
        head = self.text.encode()
        buffer = bytearray(MAGIC + struct.pack("<i", len(head)) + head + struct.pack("<i", len(self.refs)))
        for name, length in self.refs:
            buffer += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
        number = {n: i for i, (n, _) in enumerate(self.refs)}
        name, file = f"part-{uuid.uuid4().hex}.bam", None
        try:
            for b in batches:
                if not len(b):
                    continue
                if file is None:
                    system.create_dir(temporary, recursive=True)
                    file = system.open_output_stream(f"{temporary}/{name}")
                buffer += encode_batch(b, number)
                while len(buffer) >= self.block:
                    file.write(block(bytes(buffer[: self.block])))
                    del buffer[: self.block]
            if file is None:
                return Part(None)
            if buffer:
                file.write(block(bytes(buffer)))
            file.write(END_OF_FILE)
        finally:
            if file:
                file.close()
        return Part(name)

    def commit(self, messages: list[Part | None]) -> None:
        system, name, temporary = self._temporary()
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(name, allow_not_found=True)):
                if x.is_file and x.path.endswith(".bam"):
                    system.delete_file(x.path)
        for i, m in enumerate(m for m in messages if m and m.name):
            system.move(f"{temporary}/{m.name}", f"{name}/part-{i:05d}-{self.job}.bam")
        if system.get_file_info(temporary).type != fs.FileType.NotFound:
            system.delete_dir(temporary)

    def abort(self, messages: list) -> None:
        system, _, temporary = self._temporary()
        if system.get_file_info(temporary).type != fs.FileType.NotFound:
            system.delete_dir(temporary)


class Bam(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> BamReader:
        return BamReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> BamWriter:
        return BamWriter({k.lower(): v for k, v in self.options.items()}, overwrite)


def read_bam(spark: SparkSession, path: str, split_bytes: int = 32 << 20) -> DataFrame:
    """Reads of a BAM file or a folder of them, as read_sam gives them; offset rises with a file's records (their block's place and the byte in it)."""
    spark.dataSource.register(Bam)
    return spark.read.format("bam").option("splitBytes", split_bytes).option("tasks", 4 * spark.sparkContext.defaultParallelism).load(path)


def write_bam(df: DataFrame, path: str, references: list[tuple[str, int]], header: str = "", block_bytes: int = 0xFF00) -> None:
    """A folder of BAM files, one per task, of reads with the columns of read_bam. references: the sequences' names and lengths."""
    df.sparkSession.dataSource.register(Bam)
    own = df.select("name", "flag", "ref", "pos", "mapq", "cigar", "mate_ref", "mate_pos", "insert_size", "seq", "qual", "tags")
    own.write.format("bam").option("references", json.dumps(references)).option("header", header).option("blockBytes", block_bytes).mode("append").save(path)

"""Operator 13, conversation structure repair: the cheapest edits that make a conversation's roles (system)? (user assistant)+, or nothing.

Method: Dijkstra on the implicit lattice of (turns read, grammar state). The states are start, after the system turn, after a user turn and after an
assistant turn; edges keep, rerole or delete the next turn or insert an empty one. The queue's key is (cost, audit), where the audit is the
initials of the edits so far (Delete, Insert, Keep, Rerole), and the search ends at the first accepting end node that is taken from it. Edges only
lengthen the key, and of two ways to one node neither's audit begins with the other at equal cost (only insertions would lie between, and
they cost), so the node's first key is its least, whatever follows.

Turns of a conversation are dealt to one task and stream through it in order, in blocks of BLOCK turns: the block's lattice is searched from each
state that can be reached, and only the best key per state, with the running hash of the text repaired that way, goes on to the next block. So a
conversation with a third of all rows needs no more memory than a block, its audit and 16 bytes per turn to know repeated ones by; that one task reads it is due
to the hash of its whole text, which is one pass by nature.

Nulls count as one space, in any column; a null conversation id is a conversation of its own and stays null. Rows are taken by turn (null first),
then role and text, so ties and repeated rows have a fixed order; a repeated turn is a duplicate. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby, islice
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns whose lattice is searched at once.
BLOCK = 512
#: What edits cost, and what a truncated turn adds that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the grammar: before all, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
#: The role that a state can be followed by, besides system at the start, and the state after it.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: White space, as `[\x20\x09-\x0D]`.
SPACE = " \t\n\v\f\r"


class Turn(NamedTuple):
    role: str
    text: str
    must_go: bool
    truncated: bool


def edges(turn: Turn | None, state: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, edit, state after it, turns read) from a node. turn: the next one, None at the end."""
    role, after = NEXT[state]
    yield INSERT, "I", after, 0
    if turn is None:
        return
    yield DELETE, "D", state, 1
    if turn.must_go:
        return
    more = TRUNCATED if turn.truncated else 0
    yield REROLE + more, "R", after, 1
    if turn.role[:1] == role[0]:
        yield more, "K", after, 1
    elif turn.role[:1] == "s" and state == START:
        yield more, "K", SYSTEM, 1


def cheapest(turns: list[Turn], start: int, accepting: tuple[int, ...] | None = None) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) from a state to each end state. accepting: stop at the first of these."""
    queue, done, found = [(0, "", 0, start)], set(), {}
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(turns):
            found[state] = cost, audit
            if accepting and state in accepting or len(found) == len(NEXT):
                break
        for more, edit, after, read in edges(turns[i] if i < len(turns) else None, state):
            if (i + read, after) not in done:
                heapq.heappush(queue, (cost + more, audit + edit, i + read, after))
    return found


def repaired(turns: list[Turn], state: int, audit: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that the edits leave or make, from a state on."""
    rest = iter(turns)
    for edit in audit:
        role, after = NEXT[state]
        if edit == "I":
            yield edit, role, ""
        else:
            turn = next(rest)
            if edit == "D":
                continue
            if edit == "K":
                role, after = turn.role, SYSTEM if state == START and turn.role[:1] == "s" else after
            yield edit, role, turn.text
        state = after


class Way(NamedTuple):
    """The best way to a state: its key and the hash of the text repaired so far."""

    cost: int
    audit: str
    text: object
    empty: bool

    def along(self, turns: list[Turn], state: int, cost: int, audit: str) -> Way:
        text, empty = self.text.copy(), self.empty
        for _, role, words in repaired(turns, state, audit):
            text.update(f"{'' if empty else chr(10)}{role}:{words}".encode())
            empty = False
        return Way(self.cost + cost, self.audit + audit, text, empty)


def forward(ways: dict[int, Way], turns: list[Turn], accepting: tuple[int, ...] | None) -> dict[int, Way]:
    """The best ways through one more block. accepting: of the last block, only the best way to one of these is asked for."""
    best: dict[int, tuple[int, str, int, int, str]] = {}
    for state, way in ways.items():
        for after, (cost, audit) in cheapest(turns, state, accepting).items():
            key = way.cost + cost, way.audit + audit, state, cost, audit
            if after not in best or key[:2] < best[after][:2]:
                best[after] = key
    if accepting:
        best = dict([min(((s, k) for s, k in best.items() if s in accepting), key=lambda x: x[1][:2])])
    return {s: ways[state].along(turns, state, cost, audit) for s, (_, _, state, cost, audit) in best.items()}


class Counts:
    """Faults of a conversation's turns, one by one."""

    def __init__(self) -> None:
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.last = self.before = None
        self.distinct = 0
        self.seen: set[bytes] = set()

    def read(self, turn: int | None, role: str, text: str) -> Turn:
        if turn is not None and turn != self.last:
            self.least, self.last = turn if self.least is None else self.least, turn
            self.distinct += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        words = text.rstrip(SPACE)
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        blank, duplicate = not words, key in self.seen
        truncated = not blank and not duplicate and words[-1] not in ".!?"
        self.seen.add(key)
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += truncated
        return Turn(role, text, blank or duplicate, truncated)

    @property
    def gaps(self) -> int:
        return self.last - self.least + 1 - self.distinct if self.distinct else 0


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _blocks(rows: Iterator[tuple], counts: Counts) -> Iterator[tuple[list[Turn], bool]]:
    """Blocks of the turns that are there, and whether a block is the last; one block at least."""
    turns = (counts.read(turn, role, text) for _, there, turn, role, text in rows if there)
    block = list(islice(turns, BLOCK))
    while True:
        more = list(islice(turns, BLOCK)) if len(block) == BLOCK else []
        yield block, not more
        if not more:
            return
        block = more


def _repair(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (conversation, whether a turn is there, turn, role, text) come sorted."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    fields = [("conv_id", kind), *((n, pa.int64()) for n in names), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    out: list[tuple] = []
    for conv, rows in groupby(_turns(batches), key=itemgetter(0)):
        counts, ways = Counts(), {START: Way(0, "", hashlib.sha256(), True)}
        for turns, last in _blocks(rows, counts):
            ways = forward(ways, turns, ACCEPTING if last else None)
        (way,) = ways.values()
        out.append((conv, counts.gaps, counts.blank, counts.duplicate, counts.truncated, counts.illegal, way.cost, way.audit, way.text.hexdigest()))
        if len(out) == 5000:
            yield _pack(out, fields)
            out = []
    if out:
        yield _pack(out, fields)


def _pack(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _write(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """As _repair, with the audit as the text of a first row; the repaired turns come out, as they are read."""
    fields = [("conv_id", kind), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
    out: list[tuple] = []
    for conv, rows in groupby(_turns(batches), key=itemgetter(0)):
        audit = next(rows)[4]
        turns = (Turn(role, text, False, False) for _, there, _, role, text in rows if there)
        for i, turn in enumerate(repaired(turns, START, audit)):
            out.append((conv, i, *turn))
            if len(out) == 5000:
                yield _pack(out, fields)
                out = []
    if out:
        yield _pack(out, fields)


def or_space(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(" "))


def _own(rows: DataFrame, there: str | None) -> DataFrame:
    here = F.coalesce(F.col(there), F.lit(False)) if there else F.lit(True)
    return rows.select("conv_id", here.alias("there"), F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"))


def _arrow(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["conv_id"].dataType)


ORDER = ["conv_id", "there", "turn", "role", "text"]


def conversation_repair(rows: DataFrame, there: str | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation of rows (conv_id, turn, role, text).

    there: a boolean column that is false on rows which only say that the conversation exists."""
    own = _own(rows, there)
    kind, arrow = own.schema["conv_id"].dataType.simpleString(), _arrow(own)
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return own.repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(lambda it: _repair(it, arrow), schema)


def repaired_turns(rows: DataFrame, repairs: DataFrame, there: str | None = None) -> DataFrame:
    """conv_id, position (from 0), edit, role and text of the turns of repaired conversations. repairs: conversation_repair() of the rows, written."""
    own = _own(rows, there).where("there").withColumn("there", F.lit(True))
    audits = repairs.select("conv_id", F.lit(False).alias("there"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    kind, arrow = own.schema["conv_id"].dataType.simpleString(), _arrow(own)
    schema = f"conv_id {kind}, position long, edit string, role string, text string"
    return own.unionByName(audits).repartition("conv_id").sortWithinPartitions(*ORDER).mapInArrow(lambda it: _write(it, arrow), schema)

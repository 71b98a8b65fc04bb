"""Depth of a stream of reads that come about in order of position: what the forward sweep of a batch does, with a
watermark instead of an abort on late reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def stream_depth(reads: DataFrame, window: int = 100, late: int = 100) -> DataFrame:
    """reads: ref, pos, end, at (event time, one second a position). Bases covered per window of positions, complete
    once the stream is `late` positions further; state is kept for open windows only."""
    seconds = lambda n: f"{n} seconds"
    parts = F.explode(F.sequence(F.floor(F.col("pos") / window), F.floor(F.col("end") / window)))
    rows = reads.withWatermark("at", seconds(late)).withColumn("w", parts)
    inside = F.least("end", (F.col("w") + 1) * window - 1) - F.greatest("pos", F.col("w") * window) + 1
    return rows.groupBy(F.window("at", seconds(window)), "ref", "w").agg(F.sum(inside).alias("bases"), F.count(F.lit(1)).alias("reads")).select("ref", F.col("w").alias("window"), "bases", "reads")


def event_counts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and values per event type and window of event time."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


#: How far a read may begin before one that came before it (fixed value of the forward sweep).
LATE = 100
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OpenReads(StatefulProcessor):
    """Per sequence: the reads that reach a position not yet given out, and up to where positions are."""

    def __init__(self, late: int = LATE) -> None:
        self.late = late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reads = handle.getListState("reads", "start long, end long")
        self.given = handle.getValueState("given", "upto long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))
        upto = int(self.given.get()[0]) if self.given.exists() else None
        if upto is not None and int(new["pos"].min()) < upto:
            raise ValueError(f"late read: {key[0]}:{int(new['pos'].min())}, positions before {upto} were given out")
        covering = new.dropna(subset=["end"])
        held = [(int(a), int(b)) for a, b in self.reads.get()] if self.reads.exists() else []
        held += list(zip(covering["pos"].astype("int64").tolist(), covering["end"].astype("int64").tolist(), strict=True))
        to = max(int(new["pos"].max()) - self.late, upto or -(2**62))
        yield from self._depth(key[0], held, upto, to)
        if still := [(a, b) for a, b in held if b >= to]:
            self.reads.put(still)
        else:
            self.reads.clear()
        self.given.update((to,))

    def _depth(self, ref: str, held: list[tuple[int, int]], lo: int | None, to: int) -> Iterator[pd.DataFrame]:
        """Depths of the covered positions in [lo, to)."""
        if not held:
            return
        starts, ends = (np.array(x, np.int64) for x in zip(*held, strict=True))
        if lo is not None:
            starts = np.maximum(starts, lo)
        ends = np.minimum(ends, to - 1)
        on = starts <= ends
        edges, change = np.concatenate([starts[on], ends[on] + 1]), np.repeat([1, -1], on.sum())
        if not len(edges):
            return
        at, which = np.unique(edges, return_inverse=True)
        depth = np.cumsum(np.bincount(which, weights=change).astype(np.int64))
        n = np.where(depth[:-1] > 0, np.diff(at), 0)
        pos = np.repeat(at[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for i in range(0, len(pos), 100_000):
            yield pd.DataFrame({"ref": ref, "pos": pos[i : i + 100_000], "depth": np.repeat(depth[:-1], n)[i : i + 100_000]})


def stream_base_depth(reads: DataFrame, late: int = LATE) -> DataFrame:
    """A09 of a stream: reads (ref, pos, end) that come about in order of position; ref, pos and depth of each covered position, given out once a read
    begins more than `late` after it, and exactly once. A read that begins before what was given out fails the query, as it would have
    changed that. A row without an end only says how far the stream is; one at the end of each sequence gives out the rest. The state is the open reads.
    Needs the RocksDB state store (use_store)."""
    return reads.select("ref", F.col("pos").cast("long").alias("pos"), F.col("end").cast("long").alias("end")).groupBy("ref").transformWithStateInPandas(OpenReads(late), "ref string, pos long, depth long", "Append", "None")


def use_store(spark) -> None:
    """Sets the state store that transformWithState needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

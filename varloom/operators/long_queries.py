"""The adjacency machine (V01 to V05, V08) on queries of very many alignments, as joins and scans.

What the machine remembers before an alignment is the one before it, or the two before it: a state of two values. So an alignment is a map from state
to state, known from itself and the two before it, and the state at each place follows from the last alignment whose map
forgets the state and how many since then exchange the two. Ranks and scans are two-level, by windows of positions, so one query with a
third of all rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.operators.intervals import before
from varloom.operators.variants import CALL_COLUMNS, EVIDENCE, inverted, simultaneous, translocated

#: Fields of an alignment, besides its query.
FIELDS = ["t_id", "t_start", "t_end", "q_start", "q_end", "strand", "score", "mismap"]
BITS = 14


def row_numbers(df: DataFrame, key: str, windows: dict[str, Column], order: list[str], out: str) -> DataFrame:
    """Row numbers from 1 within a key, in order; windows: columns that the order begins with, made coarse. A task has a window."""
    rows = df.withColumns({f"_{k}": v for k, v in windows.items()})
    w = [f"_{k}" for k in windows]
    n = rows.groupBy(key, *w).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy(*w).rowsBetween(Window.unboundedPreceding, -1)
    n = n.select(key, *w, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(key, *w).orderBy(*order))
    return rows.withColumn("_own", own).join(n, [key, *w]).withColumn(out, F.col("_before") + F.col("_own")).drop("_own", "_before", *w)


def _near(x: Column, y: Column) -> Column:
    return F.abs(x["ord"] - y["ord"]) == 1


def _record(kind: Column, t_id: Column, places: list[Column], score: Column, mismap: Column, expected: list[Column] | None = None) -> Column:
    expected = expected or [F.lit(None).cast(k) for k in ("string", "long", "long")]
    own = [t_id, *places, score, mismap, *expected]
    return F.struct(kind.alias("kind"), *[v.alias(c) for v, c in zip(own, [*CALL_COLUMNS[2:], *EVIDENCE], strict=True)])


def _call(kind: Column, x: Column, expected: list[Column] | None = None) -> Column:
    return _record(kind, x["t_id"], [x[c] for c in CALL_COLUMNS[3:]], x["score"], x["mismap"], expected)


def _between(x: Column, y: Column) -> list[Column]:
    """First and last place of the target between two alignments."""
    first, second = F.when(x["t_start"] <= y["t_start"], x["t_end"]).otherwise(y["t_end"]), F.greatest(x["t_start"], y["t_start"])
    return [F.least(first, second), F.greatest(first, second)]


def _gap(x: Column, y: Column) -> Column:
    """P10: the gap between two alignments and its kind."""
    over = lambda s: F.least(x[f"{s}_end"], y[f"{s}_end"]) >= F.greatest(x[f"{s}_start"], y[f"{s}_start"])
    kind = F.when(over("t") & over("q"), "gap-X1").when(over("q"), "gap-X2").when(over("t"), "gap-1").otherwise("gap-2")
    ends = [*_between(x, y), F.least(x["q_end"], y["q_start"]), F.greatest(x["q_end"], y["q_start"])]
    return _record(kind, x["t_id"], ends, F.least(x["score"], y["score"]), F.least(x["mismap"], y["mismap"]))


def calls(alignments: DataFrame) -> DataFrame:
    """The calls of queries with two alignments or more."""
    rows = row_numbers(alignments, "q_id", {"w": F.shiftright("q_start", BITS)}, ["q_start", "t_id", "t_start", "t_end", "q_end", "strand"], "i")
    rows = row_numbers(rows, "q_id", {"t": F.col("t_id"), "w": F.shiftright("t_start", BITS)}, ["t_id", "t_start", "q_start", "t_end", "q_end", "strand"], "k")
    last = rows.groupBy("q_id", "q_start").agg(F.max("k").alias("ord"))
    rows = rows.join(last, ["q_id", "q_start"]).select("q_id", "i", F.struct(*FIELDS, "ord").alias("c"))
    n = rows.groupBy("q_id").agg(F.max("i").alias("n"))
    back = lambda k, name: rows.select("q_id", (F.col("i") + k).alias("i"), F.col("c").alias(name))
    rows = rows.join(n, "q_id").where("n > 1").join(back(1, "b"), ["q_id", "i"], "left").join(back(2, "a"), ["q_id", "i"], "left")

    a, b, c = F.col("a"), F.col("b"), F.col("c")
    gap = _near(c, b) & simultaneous(b, c)
    # what happens at an alignment where one is remembered, and where two are
    one = F.when(gap, "gap").otherwise("")
    two = (
        F.when(_near(c, a), F.when(translocated(a, b, c), "trans").when(gap, "gap").otherwise(""))
        .when(_near(b, a) & _near(c, b), F.when(inverted(a, b, c), "inv").when(simultaneous(b, c), "gap").otherwise("")).when(_near(b, a), "just").otherwise("complex")
    )
    rows = rows.withColumns({"one": one, "two": F.when(F.col("i") > 2, two).otherwise(one)})
    after = lambda act: F.when(F.col(act).isin("gap", "trans", "inv"), 1).otherwise(2)
    rows = rows.withColumns({"s1": F.when(F.col("i") == 1, 1).otherwise(after("one")), "s2": F.when(F.col("i") == 1, 1).otherwise(after("two"))})
    rows = before(rows, ["q_id"], "i", ["i"], {"turns": ("sum", F.when(F.col("s1") > F.col("s2"), 1).otherwise(0))})
    known = F.when(F.col("s1") == F.col("s2"), F.struct("i", F.col("s1").alias("state"), "turns"))
    rows = before(rows, ["q_id"], "i", ["i"], {"fixed": ("max", known)}).where("i > 1")
    state = F.when((F.col("turns") - F.col("fixed.turns")) % 2 == 1, 3 - F.col("fixed.state")).otherwise(F.col("fixed.state"))
    rows = rows.withColumn("state", state).withColumns({"act": F.when(F.col("state") == 1, F.col("one")).otherwise(F.col("two")), "end": F.when(F.col("state") == 1, F.col("s1")).otherwise(F.col("s2"))})

    act = F.col("act")
    moved = F.concat(F.lit("TRANS-"), F.when(b["t_id"] == a["t_id"], "INTRA").otherwise("INTER"), F.when(b["strand"] == a["strand"], "1").otherwise("2"))
    own = (
        F.when(act == "gap", F.array(_gap(b, c))).when(act == "trans", F.array(_call(moved, b, [a["t_id"], *_between(a, c)]))).when(act == "inv", F.array(_call(F.lit("INV"), b)))
        .when(act == "just", F.array(_call(F.lit("Nos-JustNo"), a))).when(act == "complex", F.array(_call(F.lit("Nos-Complex"), a)))
    )
    left = F.when(b["t_id"] == c["t_id"], "Nos-Strand").otherwise("Nos-Complex")
    held = (F.col("i") == F.col("n")) & (F.col("end") == 2)
    rest = F.when(held & simultaneous(b, c), F.array(_gap(b, c))).when(held, F.array(_call(left, b), _call(left, c)))
    kinds = ["kind:string", "t_id:string", *(f"{x}:bigint" for x in CALL_COLUMNS[3:]), *(f"{x}:{k}" for x, k in EVIDENCE.items())]
    none = F.array().cast(f"array<struct<{','.join(kinds)}>>".replace(":long", ":bigint"))
    return rows.select("q_id", F.inline(F.concat(F.coalesce(own, none), F.coalesce(rest, none)))).select(*CALL_COLUMNS, *EVIDENCE)

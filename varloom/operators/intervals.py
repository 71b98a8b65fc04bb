"""Operators on 1-based closed intervals: merge, cover, gap, complement, depth and range joins.

Scans along a sequence are cut into windows of 2**BITS positions, so that one long sequence (or
one with a third of all rows) is not one task: each window is scanned by itself, and what earlier
windows carry over comes from a scan over one row per window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 14


def window_of(pos: str | Column, bits: int = BITS) -> Column:
    return F.shiftright(F.col(pos) if isinstance(pos, str) else pos, bits)


def before(df: DataFrame, keys: list[str], start: str, order: list[str], out: dict[str, tuple[str, Column]], bits: int = BITS) -> DataFrame:
    """df with running aggregates over all rows of the same keys that come earlier in order (which
    begins with start). out: name -> ('max' or 'sum', value)."""
    fold = {"max": F.max, "sum": F.sum}
    rows = df.withColumn("_w", window_of(start, bits))
    per = rows.groupBy(*keys, "_w").agg(*[fold[k](v).alias(f"_{n}") for n, (k, v) in out.items()])
    sofar = Window.partitionBy(*keys).orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*keys, "_w", *[fold[k](f"_{n}").over(sofar).alias(f"_{n}") for n, (k, _) in out.items()])
    own = Window.partitionBy(*keys, "_w").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = {"max": lambda a, b: F.greatest(a, b), "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}
    done = rows.join(carried, [*keys, "_w"]).withColumns({n: both[k](F.col(f"_{n}"), fold[k](v).over(own)) for n, (k, v) in out.items()})
    return done.drop("_w", *[f"_{n}" for n in out])


def merge(df: DataFrame, keys: list[str], start: str, end: str, delta: int = 0) -> DataFrame:
    """Runs of intervals, each beginning at most delta after what came before ends:
    keys, start, end, n."""
    order = [start, end]
    rows = before(df, keys, start, order, {"_reach": ("max", F.col(end))})
    rows = rows.withColumn("_new", (F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + delta)).cast("long"))
    rows = before(rows, keys, start, order, {"_island": ("sum", F.col("_new"))})
    return rows.withColumn("_island", F.col("_island") + F.col("_new")).groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")


def merge_pairs(df: DataFrame, delta: int = 1) -> DataFrame:
    """A03 on both axes: runs of (t_id, q_id) rows that go on on target and query at once."""
    keys, order = ["t_id", "q_id"], ["t_start", "t_end", "q_start", "q_end"]
    rows = before(df, keys, "t_start", order, {"_t": ("max", F.col("t_end")), "_q": ("max", F.col("q_end"))})
    on = (F.col("t_start") <= F.col("_t") + delta) & (F.col("q_start") <= F.col("_q") + delta)
    rows = before(rows.withColumn("_new", F.when(on, 0).otherwise(1).cast("long")), keys, "t_start", order, {"_had": ("sum", F.col("_new"))})
    rows = rows.withColumn("_island", F.col("_had") + F.col("_new"))
    return rows.groupBy(*keys, "_island").agg(*[f(c).alias(c) for c, f in (("t_start", F.min), ("t_end", F.max), ("q_start", F.min), ("q_end", F.max))]).drop("_island")


def buckets(df: DataFrame, value: str, most: int = 256) -> Column:
    """Number of the bucket of a value, in order: cut at quantiles of df, so that a scan over all values is as many tasks. The
    cuts, at most so many numbers, come to the driver."""
    cuts = sorted(set(df.approxQuantile(value, [i / most for i in range(1, most)], 1 / (4 * most))))
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(value))) if cuts else F.lit(0)


def hulls(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """F16: first start and last end of each key's intervals."""
    return df.groupBy(*keys).agg(F.min(start).alias("first"), F.max(end).alias("second"))


def covered_length(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Length of the union of the intervals of each key."""
    rows = before(df, keys, start, [start, end], {"_reach": ("max", F.col(end))})
    grown = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start) - 1, F.coalesce("_reach", F.col(start) - 1)))
    return rows.groupBy(*keys).agg(F.sum(grown).cast("long").alias("covered"))


def furthest(df: DataFrame, key: str = "t_id") -> DataFrame:
    """Each row with the earlier row that reaches furthest (the first of them on ties)."""
    reach = F.struct(F.col("t_end").alias("end"), (-F.col("t_start")).alias("start"), F.col("q_id").alias("q_id"))
    return before(df, [key], "t_start", ["t_start", "t_end", "q_id"], {"prev": ("max", reach)})


def scaffold_gaps(df: DataFrame) -> DataFrame:
    """Where a query starts after another one: the gap up to it, or how far they overlap."""
    rows = furthest(df).where(F.col("prev.q_id").isNotNull() & (F.col("q_id") != F.col("prev.q_id")) & (F.col("t_end") > F.col("prev.end")))
    size = F.col("t_start") - 1 - F.col("prev.end")
    return rows.select("t_id", F.col("prev.q_id").alias("left_id"), F.col("q_id").alias("right_id"), (F.col("prev.end") + 1).alias("gap_start"), (F.col("t_start") - 1).alias("gap_end"), size.alias("length"), F.when(size > 0, "InterGap").otherwise("Overlap").alias("type"))


def complement(df: DataFrame, lengths: DataFrame, key: str = "t_id") -> DataFrame:
    """What no interval covers, of the sequences that have any: leading, inner and trailing."""
    runs = merge(df.select(key, "t_start", "t_end"), [key], "t_start", "t_end", 1)
    inner = before(runs, [key], "t_start", ["t_start"], {"_prev": ("max", F.col("t_end"))})
    inner = inner.select(key, (F.coalesce("_prev", F.lit(0)) + 1).alias("start"), (F.col("t_start") - 1).alias("end"))
    tail = runs.groupBy(key).agg(F.max("t_end").alias("last")).join(lengths, key).select(key, (F.col("last") + 1).alias("start"), F.col("len").alias("end"))
    return inner.unionByName(tail).where("start <= end").withColumn("length", F.col("end") - F.col("start") + 1)


def clip_regions(df: DataFrame, lengths: DataFrame) -> DataFrame:
    """The unaligned ends of each query."""
    hull = df.groupBy("q_id").agg(F.min("q_start").alias("lo"), F.max("q_end").alias("hi")).join(lengths, "q_id")
    ends = F.array(F.struct(F.lit("head").alias("side"), F.lit(1).cast("long").alias("start"), (F.col("lo") - 1).cast("long").alias("end")), F.struct(F.lit("tail").alias("side"), (F.col("hi") + 1).cast("long").alias("start"), F.col("len").cast("long").alias("end")))
    return hull.select("q_id", F.inline(ends)).where("start <= end")


def depth_runs(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Depth as runs [start, end] of equal coverage; +1 and -1 events, one row per boundary."""
    events = df.select(*keys, F.explode(F.array(F.struct(F.col(start).alias("pos"), F.lit(1).alias("d")), F.struct((F.col(end) + 1).alias("pos"), F.lit(-1).alias("d")))).alias("e"))
    steps = events.groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d")).where("d != 0")
    rows = before(steps, keys, "pos", ["pos"], {"_had": ("sum", F.col("d"))}).withColumn("depth", F.col("_had") + F.col("d"))
    nxt = before(rows.withColumn("_back", -F.col("pos")), keys, "_back", ["_back"], {"_next": ("max", F.col("_back"))})
    return nxt.where("depth > 0").select(*keys, F.col("pos").alias("start"), (-F.col("_next") - 1).alias("end"), "depth")


def per_base(runs: DataFrame, keys: list[str]) -> DataFrame:
    """A row per position of the runs."""
    return runs.select(*keys, F.explode(F.sequence("start", "end")).alias("pos"), "depth")


def interval_join(a: DataFrame, b: DataFrame, key: str, a_range: tuple[str, str], b_range: tuple[str, str], bits: int = BITS, how: str = "inner") -> DataFrame:
    """Pairs of a and b of one key that overlap, as an equi-join on windows; a pair that
    shares several windows is kept in the first one only. how: inner, left_semi or left_anti."""
    (s, e), (bs, be) = a_range, b_range
    name = lambda c: f"{c}_b"
    right = b.select(*[F.col(c).alias(name(c)) for c in b.columns]).withColumn("_w", F.explode(F.sequence(window_of(name(bs), bits), window_of(name(be), bits))))
    left = a.withColumn("_w", F.explode(F.sequence(window_of(s, bits), window_of(e, bits))))
    hit = (left[key] == right[name(key)]) & (left["_w"] == right["_w"]) & (left[s] <= right[name(be)]) & (left[e] >= right[name(bs)])
    if how == "inner":
        return left.join(right, hit & (left["_w"] == F.greatest(window_of(left[s], bits), window_of(right[name(bs)], bits)))).drop(left["_w"]).drop(right["_w"])
    rows = a.withColumn("_row", F.struct(*a.columns))
    left = rows.withColumn("_w", F.explode(F.sequence(window_of(s, bits), window_of(e, bits))))
    hit = (left[key] == right[name(key)]) & (left["_w"] == right["_w"]) & (left[s] <= right[name(be)]) & (left[e] >= right[name(bs)])
    met = left.join(right, hit, "left_semi").select("_row").distinct()
    return rows.join(met, "_row", how).select(*a.columns)


def contained(a: DataFrame, b: DataFrame, key: str = "t_id", other: str = "q_id") -> DataFrame:
    """Rows of a that lie inside a row of b with the same key and another query."""
    pairs = interval_join(a, b, key, ("t_start", "t_end"), ("t_start", "t_end"))
    inside = (F.col("t_start_b") <= F.col("t_start")) & (F.col("t_end") <= F.col("t_end_b")) & (F.col(other) != F.col(f"{other}_b"))
    return pairs.where(inside).select(*a.columns).distinct()


def points_in(points: DataFrame, df: DataFrame, key: str, pos: str, start: str, end: str, bits: int = BITS) -> DataFrame:
    """(point, interval) pairs."""
    right = df.withColumn("_w", F.explode(F.sequence(window_of(start, bits), window_of(end, bits)))).withColumnRenamed(key, "_key")
    left = points.withColumn("_w", window_of(pos, bits))
    return left.join(right, (left[key] == right["_key"]) & (left["_w"] == right["_w"]) & left[pos].between(right[start], right[end])).drop("_w", "_key")


def first_at_or_after(points: DataFrame, rows: DataFrame, key: str, pos: str, at: str, value: str) -> DataFrame:
    """For each point the first row of its key at or after it (the smallest value on ties)."""
    a = points.select(key, F.col(pos).alias("_p"), F.lit(1).alias("_kind"), F.lit(None).cast("struct<p:bigint,v:bigint>").alias("_hit"))
    b = rows.select(key, F.col(at).alias("_p"), F.lit(0).alias("_kind"), F.struct((-F.col(at)).cast("long").alias("p"), (-F.col(value)).cast("long").alias("v")).alias("_hit"))
    both = a.unionByName(b).withColumn("_back", -F.col("_p"))
    done = before(both, [key], "_back", ["_back", "_kind", F.col("_hit.v")], {"_best": ("max", F.col("_hit"))})
    return done.where("_kind = 1").select(key, F.col("_p").alias(pos), (-F.col("_best.p")).alias(at), (-F.col("_best.v")).alias(value))


def neighbours(points: DataFrame, key: str, pos: str, d: int) -> DataFrame:
    """Of each point, how many points lie within d, itself included. Each window of positions
    also gets the points within d of its edges, so a window is a task of its own."""
    size = max(1 << BITS, 4 * d)
    own = F.floor(F.col(pos) / size)
    near = F.array_distinct(F.array(own, F.floor((F.col(pos) - d) / size), F.floor((F.col(pos) + d) / size)))
    rows = points.withColumn("_own", own).withColumn("_w", F.explode(near))
    w = Window.partitionBy(key, "_w").orderBy(F.col(pos).cast("long")).rangeBetween(-d, d)
    return rows.withColumn("n", F.count(F.lit(1)).over(w)).where("_w = _own").drop("_w", "_own")


def spectrum(counted: DataFrame) -> DataFrame:
    """How many points have so many neighbours."""
    return counted.groupBy("n").agg(F.count(F.lit(1)).alias("sites"))


def assert_sorted(df: DataFrame, keys: list[str], line: str, order: list[str]) -> DataFrame:
    """Df as it is; reading a row that is out of order within its keys fails. line: numbers of the lines."""
    rows = before(df, keys, line, [line], {"_most": ("max", F.struct(*order))})
    ok = F.col("_most").isNull() | (F.struct(*order) >= F.col("_most"))
    return rows.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not sorted at line "), F.col(line).cast("string"))).cast("boolean"))).drop("_most")

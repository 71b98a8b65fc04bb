"""Operator 7, line dedup by a segment-partition edit join; DataFrame functions only.

A line is removed when an equal line, or one within `edits` edits (insertions, deletions,
substitutions of code points), starts earlier in the corpus (smaller id, or same document, smaller
line number). Lines shorter than `least` code points are kept as they are.

Method: of `edits` + 1 segments of a line, one survives `edits` edits. Every line is indexed under
(its length, segment number, segment); a line as long or up to `edits` longer probes with the
substrings that a common segment could be: per segment only the starts that leave enough edits for
either side. Equal keys are candidates if letter counts allow for it, and a banded bit-parallel edit distance (one word of
2 * edits + 1 bits slides along the diagonal) verifies them. Keys are hashed; what they hold is only
the hash of the line, so a frequent line costs one row per key after the distinct.

Equal lines go by an aggregation with map-side combine over a 128-bit key, and verdicts go back to the lines by a join that
deals a frequent line over many tasks, so a line in a third of all documents meets no single task. The texts of candidates are looked up by a broadcast of their
hashes where these are few (MOST_SENT, checked), by a shuffle otherwise.

Null and empty texts have no lines of that length and stay as they are (null as empty). A null id
counts as the smallest; rows with the same id and text are one document and get the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm._common import keyed, row_of, with_id, written
from varloom.llm.quality_rules import let

#: Hashes of candidate lines that may be sent to all tasks (16 bytes each).
MOST_SENT = 500_000
#: Hot lines are fewer than this, and dealt over so many tasks each.
MOST_HOT, SALTS = 10_000, 64


def key_rows(lines: DataFrame, edits: int) -> DataFrame:
    """(x, k, own): the keys that a line is found under (own) or probes with. lines: x, line, n.

    A row per key with one short expression for all of them, which the JVM compiles; bytes stand for
    code points where a line has one each, as these are found without a walk through the line."""
    parts = edits + 1
    probes = []
    for less in range(parts):  # the other line has so many code points less
        for j in range(parts):
            for shift in range(max(-j, less - (edits - j)), min(j, less + (edits - j)) + 1):
                probes.append(F.struct(F.lit(less).alias("less"), F.lit(j).alias("j"), F.lit(shift).alias("shift")))
    plain = F.when(F.octet_length("line") == F.col("n"), F.col("line").cast("binary"))
    rows = lines.withColumn("bytes", plain).select("x", "line", "bytes", "n", F.inline(F.array(*probes)))
    m, j = F.col("n") - F.col("less"), F.col("j")
    size, longer = F.expr(f"cast((n - less) div {parts} as int)"), F.lit(parts) - F.expr(f"(n - less) % {parts}")  # the last segments are one longer
    start = (j * size + F.greatest(F.lit(0), j - longer) + 1 + F.col("shift")).cast("int")
    size = (size + F.when(j >= longer, 1).otherwise(0)).cast("int")
    k = F.when(F.col("bytes").isNotNull(), F.xxhash64(m, j, F.substr("bytes", start, size))).otherwise(F.xxhash64(m, j, F.substr("line", start, size)))
    return rows.select("x", k.alias("k"), ((F.col("less") == 0) & (F.col("shift") == 0)).alias("own"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, by doubling steps downwards."""
    def of(x: Column) -> Column:
        steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
        most = F.least(F.length(x["a"]), F.length(x["b"]))
        return let(most, lambda m: F.aggregate(F.filter(steps, lambda k: k <= m), F.lit(0), lambda n, k: F.when((n + k <= m) & (F.substr(x["a"], n + 1, k) == F.substr(x["b"], n + 1, k)), n + k).otherwise(n)))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of a and b is at most edits; their lengths differ by no more than that.

    Banded bit-parallel: bit r of a column's word stands for the row r - edits below the diagonal;
    VP and VN hold where the distance goes up and down from the row above. The distance is followed
    along the lowest diagonal of the band to the last row of a, then along that row.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1

    def distance(x: Column, y: Column) -> Column:
        n, m = F.size(x), F.size(y)
        flip = lambda v: F.lit(full).bitwiseXOR(v)

        def step(s: Column, i: Column) -> Column:
            c = F.get(y, i)
            hits = None
            for r in range(width):
                bit = F.when((i + r - edits >= 0) & (F.get(x, i + r - edits) == c), F.lit(1 << r)).otherwise(F.lit(0))
                hits = bit if hits is None else hits + bit
            return let(hits, lambda pm: let(
                (((pm.bitwiseAND(s["vp"]) + s["vp"]).bitwiseAND(full)).bitwiseXOR(s["vp"])).bitwiseOR(pm).bitwiseOR(s["vn"]),
                lambda d0: let(
                    F.struct(
                        s["vn"].bitwiseOR(flip(d0.bitwiseOR(s["vp"]))).alias("hp"),
                        d0.bitwiseAND(s["vp"]).alias("hn"),
                        F.shiftright(d0, 1).alias("x"),
                        d0.alias("d0"),
                    ),
                    lambda h: F.struct(
                        h["hn"].bitwiseOR(flip(h["x"].bitwiseOR(h["hp"]))).alias("vp"),
                        h["x"].bitwiseAND(h["hp"]).alias("vn"),
                        (s["d"] + F.when(i < n - edits, F.when(h["d0"].bitwiseAND(1 << (width - 1)) != 0, 0).otherwise(1)).otherwise(
                            # the last row of a is i - (n - edits) + 1 rows above the top bit
                            let(F.least(F.lit(width - 2), F.lit(width - 2) - (i - (n - edits))), lambda q: F.when(F.getbit(h["hp"], q) != 0, 1).when(F.getbit(h["hn"], q) != 0, -1).otherwise(0))
                        )).alias("d"),
                    ),
                ),
            ))

        start = F.struct(F.lit(full & (full << edits)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"))
        return F.aggregate(F.sequence(F.lit(0), m - 1), start, step, lambda s: s["d"])

    # what both begin and end with does not count, but for a band's width of it
    p = F.greatest(F.lit(0), common_prefix(a, b) - (edits + 1))
    ahead = let(p, lambda n: F.struct(F.substr(a, n + 1).alias("a"), F.substr(b, n + 1).alias("b")))

    def both(x: Column) -> Column:
        q = F.greatest(F.lit(0), common_prefix(F.reverse(x["a"]), F.reverse(x["b"])) - (edits + 1))
        cut = let(q, lambda n: F.struct(F.left(x["a"], F.length(x["a"]) - n).alias("a"), F.left(x["b"], F.length(x["b"]) - n).alias("b")))
        return let(cut, lambda y: let(F.split(y["a"], ""), lambda c: let(F.split(y["b"], ""), lambda d: distance(c, d))))

    return let(ahead, both) <= edits


#: Letters that are counted one by one; an edit changes the counts by two at most. Fixed.
COUNTED = "etanoirshldu cm"


def shared_keys(lines: DataFrame, edits: int) -> DataFrame:
    """(k, x, own): the keys that different lines share, and the hashes of those lines. lines: x, line, n."""
    rows = key_rows(lines, edits)
    # most keys belong to one line: the least and the largest hash, combined on the map side, tell which don't
    shared = rows.groupBy("k").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("own").alias("own"))
    shared = written(shared.where("lo != hi and own").select("k"), "shared")
    few = shared.count() <= MOST_SENT
    return written(rows.join(F.broadcast(shared) if few else shared, "k", "left_semi").distinct(), "met")


def near_pairs(met: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """(a, b): hashes of different lines that share a key and whose letter counts are near enough; b is as long
    as a or longer. The counts are compared inside the join, so what many long lines share makes no rows."""
    counts = [(F.length("line") - F.length(F.translate("line", c, ""))).alias(f"c{i}") for i, c in enumerate(COUNTED)]
    light = texts.groupBy("x").agg(F.first("line").alias("line")).select("x", *counts)
    side = lambda rows, s: rows.join(light, "x").select("k", F.col("x").alias(s), *[F.col(f"c{i}").alias(f"{s}{i}") for i in range(len(COUNTED))])
    apart = sum((F.abs(F.col(f"a{i}") - F.col(f"b{i}")) for i in range(1, len(COUNTED))), F.abs(F.col("a0") - F.col("b0")))
    a, b = side(met.where("own"), "a"), side(met, "b")
    return a.join(b, (a["k"] == b["k"]) & (F.col("a") != F.col("b")) & (apart <= 2 * edits)).select("a", "b").distinct()


def line_dedup(docs: DataFrame, edits: int = 2, least: int = 24, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_lines, removed (line numbers from 0) and the kept text of every row; the columns to carry along in `carried`."""
    t = keyed(docs, id_col, text_col)
    lines = t.select("_d", "_h", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("n", F.length("line")).where(F.col("n") >= max(least, 2 * edits + 2))
    ids = lines.withColumns({"x": F.xxhash64("line"), "y": F.xxhash64(F.lit("y"), "line")})
    first = ids.groupBy("x", "y").agg(F.min(F.struct("_d", "_h", "i")).alias("first"), F.count(F.lit(1)).alias("uses"))

    met = shared_keys(ids.select("x", "line", "n"), edits)
    wanted = met.select("x").distinct()
    few = wanted.count() <= MOST_SENT
    texts = ids.join(F.broadcast(wanted) if few else wanted, "x", "left_semi")
    texts = written(texts.groupBy("x", "y", "line").agg(F.min(F.struct("_d", "_h", "i")).alias("first")), "lines")
    pairs = near_pairs(met, texts, edits)
    side = lambda s: texts.select(*[F.col(c).alias(f"{c}{s}") for c in ("x", "y", "line", "first")])
    both = pairs.join(side("1"), F.col("a") == F.col("x1")).join(side("2"), F.col("b") == F.col("x2"))
    near = both.where(within(F.col("line1"), F.col("line2"), edits))
    later = F.col("first1") > F.col("first2")
    gone = near.select(F.when(later, F.col("x1")).otherwise(F.col("x2")).alias("x"), F.when(later, F.col("y1")).otherwise(F.col("y2")).alias("y")).distinct()

    judged = first.join(gone.withColumn("gone", F.lit(True)), ["x", "y"], "left").where("uses > 1 or gone").select("x", "y", "first", "uses", F.coalesce("gone", F.lit(False)).alias("gone"))
    judged = written(judged, "judged")
    # a line with more than one in MOST_HOT of the uses is dealt over SALTS tasks; there are fewer than MOST_HOT of them
    hot = F.col("uses") * MOST_HOT > (judged.agg(F.sum("uses")).first()[0] or 0)
    named = judged.where(hot).select("x", "y", F.lit(True).alias("hot"))
    salted = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0)))).drop("uses")
    uses = ids.select("x", "y", "_d", "_h", "i").join(F.broadcast(named), ["x", "y"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("_d", "i"), F.lit(SALTS))).otherwise(0).cast("int"))
    out = uses.drop("hot").join(salted, ["x", "y", "salt"]).where(F.col("gone") | (F.struct("_d", "_h", "i") != F.col("first")))
    removed = out.groupBy("_d", "_h").agg(F.array_sort(F.collect_set("i")).alias("removed"))
    rows = keyed(docs.select(id_col, text_col, row_of(carry).alias("_carried")), id_col, text_col, ["_carried"]).withColumnRenamed("_carried", "carried") if carry else t
    full = rows.join(removed, ["_d", "_h"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    at = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("removed"))
    kept = let(F.split("text", "\n"), lambda x: F.array_join(F.transform(at(x), lambda i: F.get(x, i)), "\n"))
    n = F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(F.lit(0)).cast("long")
    return with_id(full.select("_d", "_h", n.alias("n_lines"), "removed", F.when(F.size("removed") > 0, kept).otherwise(F.col("text")).alias("kept"), *["carried"] * bool(carry)))

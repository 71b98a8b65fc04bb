"""Operator 4, quality rules with risk-controlled thresholds; DataFrame functions only.

Base rules and four rates are computed per document by array functions, without a shuffle. Then,
for each stratum and rate, the labelled documents (a holdout: nothing is fitted to them but these
cutoffs) tell which cutoff is safe: of a fixed grid, a cutoff is certified when the exact binomial
tail says that a false rejection rate of alpha / rates or more would show as few false rejections
as were seen with probability at most delta / tests (Bonferroni over strata, rates and grid). The
strictest certified cutoff is used, so with probability 1 - delta no stratum loses more than a
share alpha of its good documents to the cutoffs. Too few labels certify nothing, and nothing but
the base rules rejects.

Null and empty texts have no words and fail the base rule. A null stratum is one of its own. Rows
are judged one by one, so repeated rows get equal results. A clashing column is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cutoffs to choose from, per rate; a document is rejected when its rate is over the cutoff.
GRID = {
    "symbol_rate": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5],
    "repeat_rate": [0.02, 0.05, 0.1, 0.15],
    "dup_line_rate": [0.05, 0.1, 0.2, 0.35, 0.5],
    "upper_rate": [0.2, 0.35, 0.5, 0.7],
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, n: int = 5) -> Column:
    """Words inside windows of n words found twice or more. Windows are compared by hashes of their words' hashes;
    only in a text where hashes agree are they put in order and the words themselves compared."""

    def covered(w: Column, hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), (i + 1).alias("i"))))
        same = lambda x, b: F.coalesce((x["h"] == b["h"]) & (F.slice(w, x["i"], n) == F.slice(w, b["i"], n)), F.lit(False))

        def starts(s: Column) -> Column:
            before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), s)
            marked = F.zip_with(s, before, lambda x, b: F.struct(x["i"].alias("i"), same(x, b).alias("again")))
            both = let(marked, lambda m: F.zip_with(m, F.slice(m, 2, F.size(m) - 1), lambda x, y: F.struct(x["i"].alias("i"), (x["again"] | F.coalesce(y["again"], F.lit(False))).alias("again"))))
            return F.array_sort(F.transform(F.filter(both, lambda x: x["again"] & x["i"].isNotNull()), lambda x: x["i"]))

        return F.aggregate(
            let(order, starts),
            F.struct(F.lit(-n).alias("last"), F.lit(0).alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(n), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    def of(w: Column) -> Column:
        single = F.transform(w, lambda x: F.xxhash64(x))
        windows = let(single, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])))
        found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(w, h)).otherwise(F.lit(0)))
        return F.when(F.size(w) <= n, F.lit(0)).otherwise(found)

    return let(words, of)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the rates."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    long = lambda c: c.cast("long")
    out = docs.withColumns({
        "n_words": long(F.size(words)),
        "word_chars": long(F.length(F.array_join(words, ""))),
        "n_symbols": long(F.regexp_count(text, F.lit("[#*$%&|<>]"))),
        "n_lines": let(lines, lambda x: long(F.size(x))),
        "n_dup_lines": let(lines, lambda x: long(F.size(x) - F.size(F.array_distinct(x)))),
        "n_repeat_words": long(repeat_words(words)),
        "n_upper": long(F.regexp_count(text, F.lit("[A-Z]"))),
    })
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.withColumns({
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "symbol_rate": rate("n_symbols", "word_chars"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "upper_rate": rate("n_upper", "word_chars"),
    })


def log_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), summed term by term in logarithms."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))

    def step(a: Column, j: Column) -> Column:
        term = a["t"] + F.log((n - j + 1) / j) + odds
        top = F.greatest(a["s"], term)
        return F.struct(term.alias("t"), (top + F.log(F.exp(a["s"] - top) + F.exp(term - top))).alias("s"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.struct(first.alias("t"), first.alias("s")), step, lambda a: a["s"])


def certified(labelled: DataFrame, stratum: str, alpha: float, delta: float) -> DataFrame:
    """(_stratum, cut_<rate>...): the strictest certified cutoff of each rate, null for none.
    labelled: the rates of documents labelled good that pass the base rules. One aggregation with map-side combine."""
    share = alpha / len(GRID)
    counts = [F.count(F.lit(1)).alias("n")]
    counts += [F.count_if(F.col(r) > c).alias(f"{r}_{i}") for r, grid in GRID.items() for i, c in enumerate(grid)]
    per = labelled.groupBy(F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum")).agg(*counts)
    tests = per.agg(F.count(F.lit(1)).alias("strata")).select((F.col("strata") * sum(map(len, GRID.values()))).alias("tests"))
    per = per.join(F.broadcast(tests))  # one row
    limit = F.log(F.lit(delta) / F.col("tests"))

    def cut(r: str) -> Column:
        safe = [
            F.when((F.col(f"{r}_{i}") < F.col("n") * share) & (log_tail(F.col("n"), F.col(f"{r}_{i}"), share) <= limit), F.lit(c))
            for i, c in enumerate(GRID[r])
        ]
        return F.coalesce(*safe).alias(f"cut_{r}")  # the grid ascends

    return per.select("_stratum", *[cut(r) for r in GRID])


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05, stratum: str = "lang", features: DataFrame | None = None) -> DataFrame:
    """docs with the measures, base_failed and kept. labels: doc_id, quality (1: good).
    features: the measured rows of docs if they have been written, with doc_id and the stratum."""
    rows = measured(docs) if features is None else features
    good = labels.where("quality = 1").select("doc_id").distinct()
    light = rows.where(~F.col("base_failed")).select("doc_id", stratum, *GRID)
    cuts = certified(light.join(good, "doc_id", "left_semi"), stratum, alpha, delta)
    out = rows.withColumn("_stratum", F.coalesce(F.col(stratum).cast("string"), F.lit(""))).join(cuts, "_stratum", "left")
    over = [F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False)) for r in GRID]
    rejected = over[0] | over[1] | over[2] | over[3]
    return out.withColumn("kept", ~F.col("base_failed") & ~rejected).drop("_stratum")

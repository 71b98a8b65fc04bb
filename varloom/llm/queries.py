"""Queries of the corpus operators: each over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.decontaminate import decontaminate

    d = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return d.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("spans")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.quality_classifier import quality_classifier

    d = quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return d.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm._common import written
    from varloom.llm.quality_rules import GRID, measured, quality_rules

    docs = _table(spark, sf_dir, "documents")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = written(measured(docs.select("doc_id", "lang", "text")).select("doc_id", "lang", *counts, "base_failed", *GRID), "measures")
    return quality_rules(docs, _table(spark, sf_dir, "labels"), features=rows).select("doc_id", *counts, "base_failed", "kept")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.secret_scan import KINDS, secret_scan

    d = secret_scan(_table(spark, sf_dir, "documents"))
    kinds = F.array(*map(F.lit, KINDS))
    base = F.filter("found", lambda x: x["k"] < 3)
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"], x["e"])), ",")
    n = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long")
    return d.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.toxicity import toxicity

    d = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return d.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.line_dedup import line_dedup

    d = line_dedup(_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.substring_dedup import substring_dedup

    return substring_dedup(_table(spark, sf_dir, "documents")).drop("spans")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.bpe import bpe_round_trip

    d = bpe_round_trip(_table(spark, sf_dir, "documents"))
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """Every tenth document by crc32 of its id has its words from some word on replaced by repeats of the first of them."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.expr("h div 10"), F.size("w").cast("long")
    d = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    a = g % n
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    a, n = a.cast("int"), n.cast("int")
    period = F.flatten(F.array_repeat(F.slice("w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    new = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), a), period), F.lit(1), n), " ")
    return d.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.size("w") > 0), new).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.periodic_runs import periodic_runs

    d = periodic_runs(planted_periods(_table(spark, sf_dir, "documents")))
    # of runs by start and period the first one of the greatest length / period, without rounding
    better = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.when(F.size("runs") > 0, F.aggregate("runs", F.col("runs")[0], better)).otherwise(none)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return d.withColumn("b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "b.start", "b.length", "b.period", F.expr("b.length * 1000 div b.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.best_fit_packing import best_fit_packing, pieces

    return best_fit_packing(pieces(_table(spark, sf_dir, "documents")))


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns dropped, emptied, cut, repeated or given to the user, by crc32 of their place; `there` is false where one is dropped."""
    from varloom.llm.conversation_repair import or_space

    way = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace(or_space("text"), "[.!?]", "")).otherwise(or_space("text"))
    role = F.when(way == 4, "user").otherwise(or_space("role"))
    d = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (way != 0).alias("there"), F.when(way == 3, 2).otherwise(1).alias("times"))
    return d.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from varloom.llm.conversation_repair import conversation_repair

    return conversation_repair(damaged(_table(spark, sf_dir, "conversations")), "there")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where SQL can express an operator; the others are tested against brute force."""
    from varloom.llm.oracle import SQL

    return dict(SQL)

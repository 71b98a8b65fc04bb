"""Corpus pipeline: quality rules, line dedup, near duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm._common import row_of, without, written
from varloom.llm.bpe import bpe_encode
from varloom.llm.decontaminate import contamination
from varloom.llm.line_dedup import line_dedup
from varloom.llm.ngram_join import ngram_components
from varloom.llm.quality_rules import GRID, measured, quality_rules

#: No SQL: banded edit distances, components and BPE; tested against brute force instead.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The measures are taken once and written; as the verdict depends on text
    and language only, what is rejected leaves by an anti join on their hashes.

    Null and empty texts have no words, so they go. A null language is a stratum of its own, a null id has no label. Rows
    are judged one by one: repeated rows and ties stay or go together. Columns of any name pass."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = {"_x": F.xxhash64(text), "_y": F.hash(text), "_l": F.coalesce(F.col("lang").cast("string"), F.lit(""))}
    rows = measured(docs.select("doc_id", "lang", "text")).withColumns(keys)
    rows = written(rows.select("doc_id", "lang", *keys, "base_failed", *GRID), "measures")
    gone = written(quality_rules(docs, labels, features=rows).where(~F.col("kept")).select(*keys).distinct(), "rejected")
    whole = docs.select(row_of(docs.columns).alias("_row"), *[v.alias(k) for k, v in keys.items()])
    return whole.join(gone, list(keys), "left_anti").select("_row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one repeats; those left without a word go.

    Earlier is by id (null first), hash of the text and line number, so there are no ties; repeated rows are one document
    and lose the same lines. A document that loses none stays as it is, if its text is null or empty too. Columns of any name pass."""
    done = line_dedup(docs, carry=[c for c in docs.columns if c not in ("doc_id", "text")])
    done = done.where("size(removed) = 0 or kept rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    out = {"text": F.col("kept"), "n_chars": F.when(F.size("removed") > 0, F.length("kept")).otherwise(F.col("carried.n_chars")).cast(docs.schema["n_chars"].dataType)}
    return done.select(*[(F.col("doc_id") if c == "doc_id" else out[c] if c in out else F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group whose sets of five-word shingles agree by 0.8 or more.

    Null and empty texts link with nothing and stay. A null id is the smallest; repeated rows are one document and stay or go
    together, as do different texts under the smallest id of a group. Columns of any name pass."""
    gone = ngram_components(docs, shingle=5, percent=80).where("_d != component")
    return without(docs, gone)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages are less than a twentieth.

    Null and empty texts hold none and stay. Documents are judged one by one, those without an id too; repeated rows stay or
    go together. Columns of any name pass."""
    hits = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, hits.where("n_hit > 0 and 20 * n_hit >= n_words"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of every row; null and empty texts have none. Other columns go."""
    return bpe_encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("ngram_join", near_duplicates), ("decontaminate", clean), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

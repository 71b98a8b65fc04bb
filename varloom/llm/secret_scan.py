"""Operator 5, secret scan with corpus-wide ownership frequency; DataFrame functions only.

Candidates of each kind are found per document with regular expressions; where they stand follows
from the lengths of the pieces between them. Candidate values are then counted over the corpus: by
distinct repositories (documents here) and distinct owners (sources). A value of many owners is a
widely copied example; one that few owners have, in however many repositories, is a live-looking credential of
theirs. The base kinds are always reported, with that verdict; the further kind `token` (long values that mix
cases and digits) adds spans only for owner-specific values.

Counting takes two aggregations with map-side combine. Verdicts go back to the spans by a join on the value; values with
more than one in MOST_HOT of all spans, which are fewer than MOST_HOT, are sent to all tasks instead, so a value in a third of
all documents meets in no task. Null texts are empty; a null owner is one owner. Rows with the same id, owner
and text are one repository and get the same result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.llm._common import written
from varloom.llm.quality_rules import let

#: Kinds, in the order of ties. Fixed patterns.
ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"
TOKEN = "[A-Za-z0-9+/_-]{24,}"
KINDS = ["assign", "access", "hex", "token"]


#: A value with more than one in so many of all spans is hot; there are fewer such values than this.
MOST_HOT = 10_000
#: Matches of a text that are placed one after the other; blocks of them are then moved to where they begin.
BLOCK = 512


def spans(text: Column, pattern: str, kind: int, least: int, group: int = 0) -> Column:
    """array<struct<s, k, e, v>> of the matches whose group has `least` characters; positions in code points."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)  # one more than matches
    rows = F.zip_with(F.arrays_zip(matches.alias("m"), values.alias("v")), F.slice(between, F.lit(1), F.size(matches)), lambda x, y: F.struct(F.length(x["m"]).alias("n"), x["v"].alias("v"), F.length(y).alias("gap")))
    empty = F.array().cast("array<struct<s:int,k:int,e:int,v:string>>")

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["gap"]
        row = F.struct(s.alias("s"), F.lit(kind).alias("k"), (s + x["n"]).alias("e"), x["v"].alias("v"))
        return F.struct((s + x["n"]).alias("at"), F.when(F.length(x["v"]) >= least, F.concat(a["out"], F.array(row))).otherwise(a["out"]).alias("out"))

    def placed(all_rows: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_rows) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_rows, b * BLOCK + 1, F.lit(BLOCK)))
        done = F.transform(blocks, lambda block: F.aggregate(block, F.struct(F.lit(0).alias("at"), empty.alias("out")), step))
        return let(done, moved)

    def moved(done: Column) -> Column:
        begin = F.aggregate(done, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["at"] + x["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(done, begin, lambda x, at: F.transform(x["out"], lambda y: F.struct((y["s"] + at).alias("s"), y["k"].alias("k"), (y["e"] + at).alias("e"), y["v"].alias("v")))))

    # most texts have none, and then the pattern is run once
    return F.when(text.rlike(pattern), let(rows, placed)).otherwise(empty)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", most_owners: int = 2) -> DataFrame:
    """doc_id and `found`: array of (s, k, e, v, owners, repositories, live) of every row, by start and kind.
    live: the value has at most most_owners owners."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = F.concat(spans(text, ASSIGN, 0, 12, 2), spans(text, ACCESS, 1, 18), spans(text, HEX, 2, 16))
    mixed = F.filter(spans(text, TOKEN, 3, 24), lambda x: x["v"].rlike("[a-z]") & x["v"].rlike("[A-Z]") & x["v"].rlike("[0-9]"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.xxhash64(text).alias("h"), F.array_sort(F.concat(base, mixed)).alias("found"))
    rows = written(rows, "candidates")

    one = rows.select("doc_id", "h", "owner", F.explode("found").alias("x")).select("doc_id", "h", "owner", "x", F.sha2("x.v", 256).alias("v"))
    uses = one.select("v", "owner", "doc_id").distinct().groupBy("v", "owner").agg(F.count(F.lit(1)).alias("n"))
    frequency = written(uses.groupBy("v").agg(F.sum("n").alias("repositories"), F.count(F.lit(1)).alias("owners")), "frequency")
    total = rows.agg(F.sum(F.size("found"))).first()[0] or 0
    hot = F.col("repositories") * MOST_HOT > total
    common = one.join(F.broadcast(frequency.where(hot)), "v")  # fewer than MOST_HOT values
    rare = one.join(F.broadcast(frequency.where(hot).select("v")), "v", "left_anti").join(frequency.where(~hot), "v")
    judged = common.unionByName(rare).withColumn("live", F.col("owners") <= most_owners).where("x.k < 3 or live")
    per = judged.groupBy("doc_id", "h", "owner").agg(F.array_sort(F.collect_set(F.struct("x.s", "x.k", "x.e", "x.v", "owners", "repositories", "live"))).alias("found"))
    hit = rows.where(F.size("found") > 0).select("doc_id", "h", "owner")
    same = (hit["doc_id"].eqNullSafe(per["doc_id"])) & (hit["h"] == per["h"]) & (hit["owner"] == per["owner"])
    kind = "array<struct<s:int,k:int,e:int,v:string,owners:bigint,repositories:bigint,live:boolean>>"
    full = hit.join(per, same, "left").select(hit["doc_id"], F.coalesce(per["found"], F.array().cast(kind)).alias("found"))
    none = rows.where(F.size("found") == 0).select("doc_id", F.array().cast(kind).alias("found"))
    return full.unionByName(none)

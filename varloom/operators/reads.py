"""Read alignments: flags, CIGAR folds, classes, statistics and a property filter."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.operators.qc import rank_window

# Flag bits and the operations that move along the reference or the query. Fixed values.
FLAGS = {"paired": 1, "proper": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "first": 64, "second": 128, "secondary": 256, "failed": 512, "duplicate": 1024}
ON_REF, ON_QUERY = "MDN=X", "MIS=X"


def flag(name: str, col: str = "flag") -> Column:
    """P54."""
    return F.col(col).bitwiseAND(F.lit(FLAGS[name])) != 0


def set_flag(name: str, on: bool, col: str = "flag") -> Column:
    """P54."""
    return F.col(col).bitwiseOR(F.lit(FLAGS[name])) if on else F.col(col).bitwiseAND(F.lit(~FLAGS[name]))


def parse_cigar(text: Column) -> Column:
    """array<struct<op, len>>."""
    return F.transform(F.regexp_extract_all(text, F.lit("\\d+[MIDNSHPX=]"), F.lit(0)), lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.regexp_extract(x, "\\d+", 0).cast("int").alias("len")))


def _length(cigar: Column, ops: str) -> Column:
    return F.aggregate(cigar, F.lit(0), lambda s, x: s + F.when(x["op"].isin(*ops), x["len"]).otherwise(0))


def alignment_end(pos: Column, cigar: Column) -> Column:
    """Last reference position."""
    return pos + _length(cigar, ON_REF) - 1


def indel_spans(pos: Column, cigar: Column) -> Column:
    """The deleted bases, and the base before each insertion."""
    kind = "array<struct<start:bigint,end:bigint>>"
    return F.aggregate(
        cigar,
        F.struct(pos.cast("long").alias("at"), F.array().cast(kind).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.when(x["op"].isin(*ON_REF), x["len"]).otherwise(0)).cast("long").alias("at"),
            F.when(x["op"] == "D", F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + x["len"] - 1).cast("long").alias("end")))))
            .when(x["op"] == "I", F.concat(a["out"], F.array(F.struct((a["at"] - 1).cast("long").alias("start"), (a["at"] - 1).cast("long").alias("end")))))
            .otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )


def clip_edges(pos: Column, cigar: Column) -> tuple[Column, Column]:
    """The base before a clipped start, the base after a clipped end."""
    return F.when(F.get(cigar, 0)["op"] == "S", pos - 1), F.when(F.element_at(cigar, -1)["op"] == "S", alignment_end(pos, cigar) + 1)


def query_position(pos: Column, cigar: Column, at: Column) -> Column:
    """Place in the read (from 0) of a reference position; null where it has none."""
    return F.aggregate(
        cigar,
        F.struct(pos.cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.lit(None).cast("long").alias("hit")),
        lambda a, x: F.struct(
            (a["r"] + F.when(x["op"].isin(*ON_REF, "P"), x["len"]).otherwise(0)).cast("long").alias("r"),
            (a["q"] + F.when(x["op"].isin(*ON_QUERY), x["len"]).otherwise(0)).cast("long").alias("q"),
            F.when(a["hit"].isNull() & x["op"].isin("M", "=", "X") & (at >= a["r"]) & (at < a["r"] + x["len"]), a["q"] + at - a["r"]).otherwise(a["hit"]).alias("hit"),
        ),
        lambda a: a["hit"],
    )


def usable(df: DataFrame, least: int = 30) -> DataFrame:
    """Mapped, no duplicates, of that mapping quality; the tags AS and RG must be there."""
    df = df.where(~flag("unmapped") & ~flag("duplicate") & (F.col("mapq") >= least))
    return df.where(F.coalesce(F.assert_true(F.col("tags").getItem("AS").isNotNull() & F.col("tags").getItem("RG").isNotNull(), "reads need the tags AS and RG").isNull(), F.lit(True)))


def orientation(df: DataFrame) -> Column:
    """P41."""
    forward = F.when(flag("reverse"), F.col("mate_pos")).otherwise(F.col("pos"))
    backward = F.when(flag("reverse"), F.col("pos")).otherwise(F.col("mate_pos"))
    return (
        F.when(~flag("paired") | flag("mate_unmapped"), "UNPAIRED").when(F.col("ref") != F.col("mate_ref"), "DIFF_CHROM").when(flag("reverse") == flag("mate_reverse"), "SAME")
        .when(forward <= backward, "INNER").otherwise("OUTTER")
    )


def depth_spans(df: DataFrame, low: int, high: int, least_score: int = 90) -> DataFrame:
    """(ref, class, start, end) that each read adds to: seven classes. low, high: insert sizes that are right."""
    cigar, pos = F.col("cigar"), F.col("pos")
    whole = F.array(F.struct(pos.cast("long").alias("start"), alignment_end(pos, cigar).cast("long").alias("end")))
    kind = orientation(df)
    size = F.abs("insert_size")
    good = (kind == "INNER") & size.between(low, high)
    indels = F.exists(cigar, lambda x: x["op"].isin("I", "D"))
    name = (
        F.when(good & (F.col("score") < least_score), "pLowAlignScore").when(good & indels, "crossSignal").when(good, "properPair").when(kind == "INNER", "badInserSizePair")
        .when(kind.isin("SAME", "OUTTER"), "wrongOrientation").otherwise("single")
    )
    rows = df.select("ref", name.alias("class"), F.when(name == "crossSignal", indel_spans(pos, cigar)).otherwise(whole).alias("spans"), *[e.alias(f"_e{i}") for i, e in enumerate(clip_edges(pos, cigar))])
    edges = rows.select("ref", F.lit("clipAlign").alias("class"), F.explode(F.array_compact(F.array("_e0", "_e1"))).alias("start"))
    return rows.select("ref", "class", F.inline("spans")).unionByName(edges.select("ref", "class", F.col("start").cast("long").alias("start"), F.col("start").cast("long").alias("end")))


def insert_sizes(df: DataFrame, n: int) -> DataFrame:
    """Ceil of mean and of population deviation about it, of the first n pairs of each read group; of pairs of one line number the
    smaller ones come first, so that the result doesn't hang on the order of the rows."""
    rows = rank_window(df.where("insert_size > 0"), ["rg"], ["line_no", "insert_size"], n)
    mean = rows.groupBy("rg").agg(F.ceil(F.avg("insert_size")).alias("mean"))
    return rows.join(mean, "rg").groupBy("rg", "mean").agg(F.ceil(F.sqrt(F.avg((F.col("insert_size") - F.col("mean")) ** 2))).alias("sd"))


def flag_statistics(df: DataFrame) -> DataFrame:
    """One aggregation."""
    n = lambda c: F.count_if(c)
    first = flag("paired") & flag("first") & ~flag("unmapped") & ~flag("mate_unmapped")
    size = F.when(first & (F.col("ref") == F.col("mate_ref")), F.abs("insert_size"))
    both = flag("paired") & ~flag("unmapped") & ~flag("mate_unmapped")
    return df.agg(
        F.count(F.lit(1)).alias("total"), n(~flag("unmapped")).alias("mapped"), n(~flag("reverse")).alias("forward"), n(flag("reverse")).alias("reverse"), n(flag("failed")).alias("failed"),
        n(flag("duplicate")).alias("duplicates"), n(flag("paired")).alias("paired"), n(flag("paired") & flag("proper")).alias("proper"), n(both).alias("both_mapped"),
        n(flag("paired") & flag("first")).alias("read1"), n(flag("paired") & flag("second")).alias("read2"), n(flag("paired") & ~flag("unmapped") & flag("mate_unmapped")).alias("singletons"),
        F.avg(size).alias("mean_insert"), F.median(size).alias("median_insert"),
    )


def model_statistics(df: DataFrame, share: float = 0.0027) -> DataFrame:
    """Per read group and orientation model: number, rank, and the fragment length quantiles by truncated index.
    Lengths are counted first, so a group is as many rows as it has lengths."""
    n = df.groupBy("rg", "model", F.abs("insert_size").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("rg", "model").orderBy("size")
    rows = n.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("rg", "model")))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("total") * q), F.col("size")))
    out = rows.groupBy("rg", "model", "total").agg(at(share / 2).alias("low"), at(0.5).alias("median"), at(1 - share / 2).alias("high"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("rg").orderBy(F.desc("total"), "model")))


def allele_support(reads: DataFrame) -> DataFrame:
    """Per site the reads that match the reference only, the alternative only, both, or neither; reads: site,
    ref_bad and alt_bad (mismatches against either)."""
    r, a = F.col("ref_bad") == 0, F.col("alt_bad") == 0
    return reads.groupBy("site").agg(F.count_if(r & ~a).alias("ref"), F.count_if(~r & a).alias("alt"), F.count_if(r & a).alias("both"), F.count_if(~r & ~a).alias("neither"))


def revert(df: DataFrame) -> DataFrame:
    """Original qualities back, duplicate flag off."""
    return df.withColumns({"qual": F.coalesce(F.col("tags").getItem("OQ"), F.col("qual")), "flag": set_flag("duplicate", False)})


def edit_tag(df: DataFrame, name: str, value: Column | None) -> DataFrame:
    """Add, replace or (None) remove a tag."""
    rest = F.map_filter("tags", lambda k, v: k != name)
    return df.withColumn("tags", rest if value is None else F.map_concat(rest, F.create_map(F.lit(name), value)))


#: Properties of the filter and the columns they stand for.
PROPERTIES = {"name": "name", "mapQuality": "mapq", "position": "pos", "matePosition": "mate_pos", "insertSize": "insert_size", "reference": "ref", "mateReference": "mate_ref", "queryBases": "seq", "alignmentFlag": "flag"}
FLAG_PROPERTIES = {"isDuplicate": "duplicate", "isFailedQC": "failed", "isFirstMate": "first", "isSecondMate": "second", "isPaired": "paired", "isProperPair": "proper", "isReverseStrand": "reverse", "isMateReverseStrand": "mate_reverse", "isMapped": "unmapped", "isMateMapped": "mate_unmapped", "isPrimaryAlignment": "secondary"}


def property_filter(rules: dict[str, str], any_of: bool = False) -> Column:
    """Predicates {property: value}; a value may begin with !, <, <=, >, >= and begin or end with *."""
    out = None
    for name, value in rules.items():
        value = str(value)
        if name in FLAG_PROPERTIES:
            want = value.lower() == "true"
            inverse = FLAG_PROPERTIES[name] in ("unmapped", "mate_unmapped", "secondary")
            p = flag(FLAG_PROPERTIES[name]) if want != inverse else ~flag(FLAG_PROPERTIES[name])
        else:
            tag = name.partition(":")
            col = F.col("tags").getItem(tag[2]) if tag[0] == "tag" else F.length("seq") if name == "length" else F.col(PROPERTIES[name])
            sign, body = re.match(r"(<=|>=|<|>|!)?(.*)$", value, re.S).groups()
            lead, trail = body.startswith("*"), body.endswith("*") and len(body) > 1
            text = body.strip("*")
            if lead and trail:
                p = col.contains(text)
            elif lead:
                p = col.endswith(text)
            elif trail:
                p = col.startswith(text)
            else:
                v = F.lit(float(text)) if re.fullmatch(r"-?\d+(\.\d+)?", text) and tag[0] != "tag" and name not in ("name", "reference", "mateReference") else F.lit(text)
                p = {"<": col < v, "<=": col <= v, ">": col > v, ">=": col >= v}.get(sign, col == v)
            p = ~p if sign == "!" else p
        out = p if out is None else out | p if any_of else out & p
    return F.lit(True) if out is None else out


def compound_filter(filters: dict[str, dict[str, str]], rule: str | None = None) -> Column:
    """Named sets of predicates, put together by a rule of names, !, &, | and brackets (! binds before &, & before |; double quotes
    around it don't count). Without a rule a read passes if any of the sets does."""
    sets = {name: property_filter(f) for name, f in filters.items()}
    text = (rule or " | ".join(sets)).strip().strip('"')
    tokens = re.findall(r"[!&|()]|[^\s!&|()]+", text)
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1] if at <= len(tokens) else ""

    def operand() -> Column:
        t = take()
        if t == "!":
            return ~operand()
        if t == "(":
            inner = either()
            if take() != ")":
                raise ValueError(f"brackets don't match: {rule}")
            return inner
        if t not in sets:
            raise ValueError(f"no filter of that name: {t or 'end of rule'}")
        return sets[t]

    def both() -> Column:
        c = operand()
        while peek() == "&":
            take()
            c = c & operand()
        return c

    def either() -> Column:
        c = both()
        while peek() == "|":
            take()
            c = c | both()
        return c

    out = either()
    if at != len(tokens):
        raise ValueError(f"not a rule: {rule}")
    return out


def filter_script(text: str) -> Column:
    """The filter of a JSON script: {"filters": [{"id": name, property: value, ...}, ...], "rule": ...}, or one set of predicates."""
    script = json.loads(text)
    if "filters" not in script:
        return property_filter(script)
    return compound_filter({str(f.get("id", i)): {k: v for k, v in f.items() if k != "id"} for i, f in enumerate(script["filters"])}, script.get("rule"))


def bed_line(df: DataFrame) -> DataFrame:
    """BED text (0-based, half open)."""
    return df.select(F.concat_ws("\t", "ref", F.col("pos") - 1, alignment_end(F.col("pos"), F.col("cigar")), "name", "mapq", F.when(flag("reverse"), "-").otherwise("+")).alias("value"))


def fastq_lines(df: DataFrame) -> DataFrame:
    """FASTQ text; reverse reads are turned back."""
    from varloom.functions.scalars import revcomp

    seq = F.when(flag("reverse"), revcomp("seq")).otherwise(F.col("seq"))
    qual = F.when(flag("reverse"), F.reverse("qual")).otherwise(F.col("qual"))
    mate = F.when(flag("paired"), F.when(flag("first"), "/1").otherwise("/2")).otherwise("")
    return df.select(F.concat(F.lit("@"), "name", mate, F.lit("\n"), seq, F.lit("\n+\n"), qual).alias("value"))


def json_lines(df: DataFrame) -> DataFrame:
    """K13."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def fasta_lines(df: DataFrame) -> DataFrame:
    """FASTA text; reverse reads are turned back."""
    from varloom.functions.scalars import revcomp

    return df.select(F.concat(F.lit(">"), "name", F.lit("\n"), F.when(flag("reverse"), revcomp("seq")).otherwise(F.col("seq"))).alias("value"))


def cigar_text(cigar: Column) -> Column:
    return F.when(F.size(cigar) > 0, F.array_join(F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")).otherwise("*")


def sam_lines(df: DataFrame) -> DataFrame:
    """SAM text of reads as read_sam gives them; tags by name, as text or, AS and NM, as numbers."""
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda x: F.concat_ws(":", x["key"], F.when(x["key"].isin("AS", "NM"), "i").otherwise("Z"), x["value"]))
    mate = F.when((F.col("mate_ref") == F.col("ref")) & (F.col("ref") != "*"), "=").otherwise(F.col("mate_ref"))
    cells = [F.col(c).cast("string") for c in ("name", "flag", "ref", "pos", "mapq")] + [cigar_text(F.col("cigar")), mate] + [F.col(c).cast("string") for c in ("mate_pos", "insert_size", "seq", "qual")]
    return df.select(F.concat_ws("\t", *cells, tags).alias("value"))


def yaml_lines(df: DataFrame) -> DataFrame:
    """A YAML document per read."""
    rows = [F.concat(F.lit(f"{k}: "), F.col(c).cast("string")) for k, c in (("Name", "name"), ("AlignmentFlag", "flag"), ("Reference", "ref"), ("Position", "pos"), ("MapQuality", "mapq"), ("QueryBases", "seq"), ("Qualities", "qual"))]
    return df.select(F.concat_ws("\n", F.lit("---"), *rows, F.concat(F.lit("Cigar: "), cigar_text(F.col("cigar")))).alias("value"))


def in_region(df: DataFrame, region: str, order: list[str]) -> DataFrame:
    """Reads that begin in chr, chr:pos (on to its end), chr:a..b, chr:a-b or chrA:a..chrB:b; order: the sequences."""
    found = re.fullmatch(r"([^:]+)(?::([\d,]+)(?:(?:\.\.|-)(?:([^:]+):)?([\d,]+))?)?", region)
    if not found or found[1] not in order or (found[3] or found[1]) not in order:
        raise ValueError(f"not a region: {region}")
    number = lambda x, default: int(x.replace(",", "")) if x else default
    first, last = order.index(found[1]) + 1, order.index(found[3] or found[1]) + 1
    lo, hi = number(found[2], 0), number(found[4], 2**62)
    at = F.array_position(F.array(*map(F.lit, order)), F.col("ref"))
    return df.where(at.between(first, last) & ((at > first) | (F.col("pos") >= lo)) & ((at < last) | (F.col("pos") <= hi)))


def count_reads(df: DataFrame) -> DataFrame:
    """A33."""
    return df.agg(F.count(F.lit(1)).alias("n"))

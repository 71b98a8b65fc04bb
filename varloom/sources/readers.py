"""Readers and writers of the text formats, all through spark.read.text, so that any store Spark reads will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions.scalars import flip
from varloom.operators.reads import parse_cigar
from varloom.sources.places import numbered

Paths = str | list[str]


def _valid(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """Every row that reaches the result is checked."""
    return df.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def read_maf(spark: SparkSession, paths: Paths, bases: bool = True) -> DataFrame:
    """Pairwise blocks (a score= mismap=, two s lines, p lines skipped), blank lines between; plain or
    compressed. 0-based start and size become 1-based closed; query rows on - are flipped. bases: with the gapped rows."""
    blocks = spark.read.text(paths, lineSep="\n\n").select(F.array_join(F.filter(F.split("value", "\n"), lambda x: ~x.startswith("#") & (F.trim(x) != "")), "\n").alias("b")).where("b != ''")
    row = r"s +(\S+) +(\d+) +(\d+) +([+-]) +(\d+) +(\S+)"
    pattern = rf"^a +score=(-?\d+) +mismap=(\S+)\n{row}\n{row}(?:\n[pq][^\n]*)*$"
    # matched once; the parts of a sound block are what stands between blanks: a, score=, mismap=, and twice s and its five fields
    blocks = _valid(blocks, F.col("b").rlike(pattern), "not an alignment block").select(F.split("b", "[ \n]+", 18).alias("p"))
    after = {1: (1, "score="), 2: (2, "mismap=")}
    get = lambda i: F.substring(F.get("p", F.lit(after[i][0])), len(after[i][1]) + 1, 1 << 30) if i in after else F.get("p", F.lit(i + 1 if i < 9 else i + 2))
    num = lambda i: get(i).cast("long")
    rows = blocks.select(
        num(1).alias("score"), get(2).cast("double").alias("mismap"), get(3).alias("t_id"), (num(4) + 1).alias("t_start"), (num(4) + num(5)).alias("t_end"), get(8).alias("t_seq"),
        get(9).alias("q_id"), (num(10) + 1).alias("q_start"), (num(10) + num(11)).alias("q_end"), get(12).alias("strand"), num(13).alias("q_len"), get(14).alias("q_seq"),
    )
    rows = _valid(rows, (F.length("t_seq") == F.length("q_seq")) & (F.length("t_seq") > 0) & (F.least("t_start", "t_end", "q_start", "q_end") > 0), "alignment rows of unequal length, or bad coordinates")
    lo, hi = flip("q_start", "q_end", "q_len")
    back = F.col("strand") == "-"
    rows = rows.withColumns({"q_start": F.when(back, lo).otherwise(F.col("q_start")), "q_end": F.when(back, hi).otherwise(F.col("q_end"))})
    cols = ["t_id", "t_start", "t_end", "q_id", "q_start", "q_end", "strand", "score", "mismap"]
    return rows.select(*cols, *["t_seq", "q_seq"] * bases)


def read_fasta(spark: SparkSession, paths: Paths) -> DataFrame:
    """Fa, id (up to white space), seq, len, n_len. A record begins with > at the start of a line."""
    rows = spark.read.text(paths, lineSep="\n>").select(F.input_file_name().alias("fa"), F.regexp_replace("value", r"^\s*>", "").alias("value")).where("trim(value) != ''")
    head = F.regexp_extract("value", r"^\s*(\S+)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    rows = rows.select("fa", head.alias("id"), seq.alias("seq")).withColumns({"len": F.length("seq").cast("long"), "n_len": (F.length("seq") - F.length(F.translate("seq", "Nn", ""))).cast("long")})
    return rows


def unique_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """Fails on the first key that comes twice."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return _valid(df.join(n, key), F.col("_n") == 1, f"duplicate {key}").drop("_n")


def missing_ids(df: DataFrame, sequences: DataFrame, key: str) -> DataFrame:
    """Ids without a sequence."""
    return df.select(F.col(key).alias("id")).distinct().join(sequences.select("id"), "id", "left_anti")


def sequence_chunks(sequences: DataFrame, size: int = 10_000, overlap: int = 600) -> DataFrame:
    """Sequences of a table as overlapping pieces (id, chunk, start, seq), so that a fetch joins pieces, not whole sequences; those of a
    file are read as pieces by places.fasta_pieces."""
    # cut by bytes, which are bound to x once; characters would be counted from the start for each piece
    chunks = F.sequence(F.lit(0), F.floor((F.octet_length("seq") - 1) / size).cast("int"))
    piece = lambda x, k: F.substring(x, k * size + 1, F.lit(size + overlap)).cast("string")
    cut = F.flatten(F.transform(F.array(F.col("seq").cast("binary")), lambda x: F.transform(chunks, lambda k: F.struct(k.alias("chunk"), (k * size + 1).alias("start"), piece(x, k).alias("seq")))))
    rows = _valid(sequences.where("seq != ''"), F.octet_length("seq") == F.length("seq"), "a sequence has letters outside ASCII")
    return rows.select("id", F.inline(cut))


def fetch(regions: DataFrame, chunks: DataFrame, size: int = 10_000, overlap: int = 600) -> DataFrame:
    """Regions (id, start, end and others) with their bases, by an equi-join on the piece. A region that ends within
    the overlap of the piece it starts in takes it from there; a longer one is put together from all pieces it touches. What is
    beyond a sequence's end is left out; a region that starts there has no row."""
    piece = lambda pos: F.floor((F.col(pos) - 1) / size).cast("int")
    held = chunks.select("id", "chunk", F.col("start").alias("_at"), F.col("seq").alias("_s"))
    cut = lambda lo, hi: F.substring("_s", (lo - F.col("_at") + 1).cast("int"), F.greatest(F.lit(0), hi - lo + 1).cast("int"))
    rows = regions.withColumn("chunk", piece("start"))
    inside = F.col("end") <= (F.col("chunk") + 1) * size + overlap
    short = rows.where(inside).join(held, ["id", "chunk"]).withColumn("seq", cut(F.col("start"), F.col("end")))
    parts = rows.where(~inside).withColumn("chunk", F.explode(F.sequence("chunk", piece("end")))).join(held, ["id", "chunk"])
    part = cut(F.greatest("start", "_at"), F.least(F.col("end"), F.col("_at") + size - 1))
    long = parts.groupBy(*regions.columns).agg(F.array_sort(F.collect_set(F.struct("chunk", part.alias("s")))).alias("_p"), F.count(F.lit(1)).alias("_n"))
    # equal regions met in one group: a row for each
    long = long.withColumn("_n", F.explode(F.array_repeat(F.lit(1), (F.col("_n") / F.size("_p")).cast("int"))))
    long = long.withColumn("seq", F.array_join(F.transform("_p", lambda p: p["s"]), ""))
    return short.select(*regions.columns, "seq").where("seq != ''").unionByName(long.select(*regions.columns, "seq").where("seq != ''"))


def read_vcf(spark: SparkSession, paths: Paths, chrom: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sites, genotypes). Samples come from the #CHROM line, one row that goes to the driver; fields that a
    sample leaves out at the end are missing keys. chrom: one sequence only."""
    text = numbered(spark, paths)
    names = text.where("value like '#CHROM%'").limit(1).collect()
    samples = names[0].value.split("\t")[9:] if names else []
    rows = text.where("value not like '#%' and value != ''").select("line_no", F.split("value", "[\t ]+").alias("c"))
    if chrom is not None:
        rows = rows.where(F.get("c", 0) == chrom)
    at = lambda i: F.get("c", i)
    site = {"chrom": at(0), "pos": at(1).cast("long")}
    info = F.transform(F.filter(F.split(at(7), ";"), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit("="), F.lit(1)).alias("key"), F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).alias("value")))
    sites = rows.select(
        "line_no", *[v.alias(k) for k, v in site.items()], at(2).alias("id"), at(3).alias("ref"), F.split(at(4), ",").alias("alts"), at(5).try_cast("double").alias("qual"),
        F.split(at(6), ";").alias("filters"), F.map_from_entries(info).alias("info"),
    )
    keys = F.split(at(8), ":")
    long = rows.select("line_no", *[v.alias(k) for k, v in site.items()], keys.alias("k"), F.posexplode(F.slice("c", 10, max(1, len(samples)))).alias("sample_ord", "v"))
    vals = F.split("v", ":")
    n = F.least(F.size("k"), F.size(vals))
    fmt = F.when(F.col("v") == "./.", F.create_map(F.lit("GT"), F.lit("./."))).otherwise(F.map_from_arrays(F.slice("k", F.lit(1), n), F.slice(vals, F.lit(1), n)))
    genotypes = long.select("line_no", "chrom", "pos", "sample_ord", F.get(F.array(*map(F.lit, samples)), F.col("sample_ord")).alias("sample"), fmt.alias("fmt")) if samples else long.select("line_no", "chrom", "pos", "sample_ord", F.lit(None).cast("string").alias("sample"), fmt.alias("fmt")).limit(0)
    return sites, genotypes.withColumn("gt", F.col("fmt").getItem("GT"))


def format_vcf(sites: DataFrame, genotypes: DataFrame, samples: list[str]) -> DataFrame:
    """VCF text lines in order; INFO by key, FORMAT with GT first and the others by key."""
    info = F.array_join(F.array_sort(F.transform(F.map_entries("info"), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"])))), ";")
    keys = genotypes.groupBy("line_no").agg(F.array_sort(F.collect_set("_k")).alias("keys")) if "_k" in genotypes.columns else genotypes.select("line_no", F.explode(F.map_keys("fmt")).alias("_k")).where("_k != 'GT'").groupBy("line_no").agg(F.array_sort(F.collect_set("_k")).alias("keys"))
    rows = genotypes.join(keys, "line_no", "left").withColumn("keys", F.concat(F.array(F.lit("GT")), F.coalesce("keys", F.array().cast("array<string>"))))
    cell = F.when(F.coalesce("gt", F.lit("./.")) == "./.", "./.").otherwise(F.array_join(F.transform("keys", lambda k: F.coalesce(F.col("fmt")[k], F.lit("."))), ":"))
    cells = rows.groupBy("line_no").agg(F.first("keys").alias("keys"), F.array_sort(F.collect_list(F.struct("sample_ord", cell.alias("v")))).alias("cells"))
    fixed = [F.col("chrom"), F.col("pos"), F.coalesce("id", F.lit(".")), F.col("ref"), F.array_join("alts", ","), F.coalesce(F.format_string("%.2f", "qual"), F.lit(".")), F.array_join("filters", ";"), F.when(info == "", ".").otherwise(info)]
    body = sites.join(cells, "line_no", "left").select("line_no", F.concat_ws("\t", *fixed, F.array_join("keys", ":"), F.array_join(F.transform("cells", lambda x: x["v"]), "\t")).alias("value"))
    return body.orderBy("line_no").select("value")


def read_sam(spark: SparkSession, paths: Paths) -> DataFrame:
    """Reads of SAM text; several files are one table."""
    rows = numbered(spark, paths).where("value not like '@%' and value != ''").select("line_no", F.split("value", "\t").alias("c"))
    at = lambda i: F.get("c", i)
    tags = F.map_from_entries(F.transform(F.slice("c", F.lit(12), F.greatest(F.lit(0), F.size("c") - 11)), lambda x: F.struct(F.substring(x, 1, 2).alias("key"), F.substring(x, 6, 1 << 30).alias("value"))))
    return rows.select(
        "line_no", at(0).alias("name"), at(1).try_cast("int").alias("flag"), at(2).alias("ref"), at(3).try_cast("long").alias("pos"), at(4).try_cast("int").alias("mapq"),
        F.when(at(5) == "*", F.array().try_cast("array<struct<op:string,len:int>>")).otherwise(parse_cigar(at(5))).alias("cigar"),
        F.when(at(6) == "=", at(2)).otherwise(at(6)).alias("mate_ref"), at(7).try_cast("long").alias("mate_pos"), at(8).try_cast("int").alias("insert_size"), at(9).alias("seq"), at(10).alias("qual"), tags.alias("tags"),
    )


def read_sam_header(spark: SparkSession, paths: Paths) -> DataFrame:
    """Header lines of SAM text (kind, value), those of several files merged: each line once, in the order in which they
    are first met; of @HD the first one only."""
    lines = numbered(spark, paths).where("value rlike '^@[A-Z][A-Z](\t|$)'").select("line_no", "value", F.substring("value", 2, 2).alias("kind"))
    key = F.when(F.col("kind") == "HD", F.lit("")).otherwise(F.col("value"))
    rank = F.array_position(F.array(*map(F.lit, ("HD", "SQ", "RG", "PG", "CO"))), F.col("kind"))
    first = lines.groupBy("kind", key.alias("_k")).agg(F.min(F.struct("line_no", "value")).alias("f"))
    return first.select("kind", F.col("f.value").alias("value"), rank.alias("rank"), F.col("f.line_no").alias("line_no")).orderBy("rank", "line_no").select("kind", "value")


def read_lengths(spark: SparkSession, list_path: str) -> DataFrame:
    """A list of sample and file, each file with id and length; further columns don't count. The list is a few lines."""
    files = [r.value.split() for r in spark.read.text(list_path).where("trim(value) != ''").collect()]
    one = lambda sample, path: spark.read.text(path).where("trim(value) != ''").select(F.lit(sample).alias("sample"), F.get(F.split(F.trim("value"), "\\s+"), 0).alias("scaffold"), F.get(F.split(F.trim("value"), "\\s+"), 1).cast("long").alias("len"))
    out = None
    for sample, path in files:
        out = one(sample, path) if out is None else out.unionByName(one(sample, path))
    return out


def _fields(spark: SparkSession, paths: Paths, schema: str, comment: bool = True) -> DataFrame:
    rows = spark.read.text(paths).where("trim(value) != ''")
    rows = rows.where("value not like '#%'") if comment else rows
    cells = F.split(F.trim("value"), "\\s+")
    names = [x.split() for x in schema.split(",")]
    return rows.select(*[F.get(cells, i).cast(kind).alias(name) for i, (name, kind) in enumerate(names)])


def read_pedigree(spark: SparkSession, paths: Paths) -> DataFrame:
    """Unique by child."""
    return unique_ids(_fields(spark, paths, "family string, child string, father string, mother string, sex string, pheno string"), "child")


def read_training(spark: SparkSession, paths: Paths) -> DataFrame:
    """S12."""
    return _fields(spark, paths, "chrom string, pos long").distinct()


def read_regions(spark: SparkSession, paths: Paths) -> DataFrame:
    """Name, start, end."""
    return _fields(spark, paths, "name string, start long, end long")


def read_variant_regions(spark: SparkSession, paths: Paths) -> DataFrame:
    """S19."""
    return _fields(spark, paths, "t_id string, t_start long, t_end long, q_id string, q_start long, q_end long, info string")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text."""
    df.write.csv(path, sep="\t", header=False)


def write_split(df: DataFrame, keys: list[str], path: str) -> None:
    """One folder per key, sorted by position inside; keys with many rows go to several files."""
    df.repartition(*keys, F.pmod(F.xxhash64(*df.columns), F.lit(8))).sortWithinPartitions(*keys).write.partitionBy(*keys).parquet(path)


def ordered(df: DataFrame, *by: str) -> DataFrame:
    """A sorted table."""
    return df.orderBy(*by)


def in_order_of(df: DataFrame, key: str, names: list[str], *then: str) -> DataFrame:
    """In the order of a given list; what isn't listed is dropped."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col(key))
    return df.where(place > 0).orderBy(place, *then)

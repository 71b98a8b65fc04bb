"""Sources on files with many splits, against plain readers."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def fasta_files(folder) -> tuple[list[str], dict[str, str]]:
    rng, records = random.Random(1), {}
    for f in ("b.fa", "a.fa"):
        with open(folder / f, "w") as out:
            for i in range(60):
                q = "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 59, 60, 61, 700, 5000])))
                records[f"{f[0]}{i}"] = q
                w = rng.choice([60, 1, 10**6]) if len(q) < 1000 else rng.choice([60, 10**6])
                out.write(f">{f[0]}{i} some > text\n" + "".join(q[j : j + w] + "\n" for j in range(0, len(q), w)))
    return [str(folder / "b.fa"), str(folder / "a.fa")], records


@pytest.mark.parametrize(("size", "overlap"), [(100, 17), (1000, 0), (64, 200)])
def test_fasta_pieces_over_splits(spark, tmp_path, small_splits, size, overlap):
    from varloom.sources import places

    paths, records = fasta_files(tmp_path)
    rows = places.fasta_pieces(spark, paths, size, overlap).collect()
    got = {(r.id, r.chunk): (r.start, r.seq) for r in rows}
    want = {(i, k): (k * size + 1, q[k * size : k * size + size + overlap]) for i, q in records.items() for k in range(-(-len(q) // size))}
    assert got == want and len(rows) == len(want)
    some = places.fasta_pieces(spark, paths, size, overlap, only=["a3", "b59"]).collect()
    assert {(r.id, r.chunk) for r in some} == {k for k in want if k[0] in ("a3", "b59")}
    sizes = {r.id: (r.len, r.n_len) for r in places.fasta_lengths(spark, paths).collect()}
    assert sizes == {i: (len(q), q.count("N")) for i, q in records.items()}


def test_bases_before_a_header_fail(spark, tmp_path):
    from varloom.sources import places

    (tmp_path / "x.fa").write_text("ACGT\n>a\nACGT\n")
    with pytest.raises(Exception, match="bases before a header"):
        places.fasta_pieces(spark, str(tmp_path / "x.fa")).collect()


def test_line_numbers_follow_the_files_not_their_sizes(spark, tmp_path, small_splits):
    from varloom.sources import places, readers

    (tmp_path / "a.txt").write_text("".join(f"a{i}\n" for i in range(5)))
    (tmp_path / "b.txt").write_text("".join(f"b{i} {'x' * (i % 50)}\n" for i in range(3000)))
    want = [f"a{i}" for i in range(5)] + [f"b{i} {'x' * (i % 50)}" for i in range(3000)]
    for paths in (str(tmp_path), [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")]):
        assert [(r.line_no, r.value) for r in places.numbered(spark, paths).orderBy("line_no").collect()] == list(enumerate(want, 1))
    other = [str(tmp_path / "b.txt"), str(tmp_path / "a.txt")]
    assert places.numbered(spark, other).where("line_no = 3001").collect()[0].value == "a0"
    (tmp_path / "s").mkdir()
    sam = lambda n, lines: (tmp_path / "s" / n).write_text("".join(f"r{i}\t0\t{ref}\t{pos}\t9\t4M\t*\t0\t0\tACGT\tIIII\n" for i, ref, pos in lines))
    sam("a.sam", [(i, 1, 10 * i) for i in range(4)])
    sam("b.sam", [(100 + i, 1, i // 20) for i in range(900)] + [(2000, 2, 1)])
    rows = readers.read_sam(spark, str(tmp_path / "s")).withColumn("ref_no", F.col("ref").cast("int"))
    merged = places.merged_order(rows, ["ref_no", "pos", "line_no"]).orderBy("merged_no").collect()
    assert [r.merged_no for r in merged] == list(range(905))
    assert [(r.ref_no, r.pos, r.line_no) for r in merged] == sorted((r.ref_no, r.pos, r.line_no) for r in merged)


def bam_rows(n: int) -> list[tuple]:
    rng, rows = random.Random(3), []
    for i in range(n):
        k = rng.choice([0, 1, 10, 33, 100, 400_000 if i == n // 2 else 50])
        ref = rng.choice(["c1", "c2", "*"])
        cigar = [{"op": "S", "len": 1}, {"op": "M", "len": k - 1}] if k > 1 else [{"op": "M", "len": 1}] * k
        seq, qual = "".join(rng.choices("ACGTN", k=k)) or "*", "".join(chr(33 + rng.randrange(60)) for _ in range(k)) or "*"
        rows.append((f"r{i}", rng.randrange(4096), ref, rng.randint(1, 900) if ref != "*" else 0, rng.randrange(256), cigar, "*", 0, rng.randint(-500, 500), seq, qual, {"RG": f"g{i % 3}", "AS": str(i)}))
    return rows


@pytest.mark.parametrize("block_bytes", [0xFF00, 700])
def test_bam_in_splits(spark, tmp_path, block_bytes):
    from varloom.sources import bam

    schema = "name string, flag int, ref string, pos long, mapq int, cigar array<struct<op:string,len:int>>, mate_ref string, mate_pos long, insert_size int, seq string, qual string, tags map<string,string>"
    rows = bam_rows(1500)
    df, path = spark.createDataFrame(rows, schema), str(tmp_path / "x")
    bam.write_bam(df.coalesce(1), path, [("c1", 1000), ("c2", 1000)], block_bytes=block_bytes)
    (file,) = (tmp_path / "x").glob("*.bam")
    size = file.stat().st_size
    want = [tuple(r) for r in df.collect()]
    for split in (size + 1, size // 5, size // 40):
        got = bam.read_bam(spark, path, split)
        assert len(bam.BamReader({"path": path, "splitbytes": split}).partitions()) == -(-size // split)
        assert [tuple(r)[1:] for r in got.orderBy("offset").collect()] == want
    bam.write_bam(df.repartition(5), str(tmp_path / "y"), [("c1", 1000), ("c2", 1000)])
    assert sorted(r.name for r in bam.read_bam(spark, str(tmp_path / "y")).collect()) == sorted(r[0] for r in rows)
    assert not [p for p in (tmp_path / "y").iterdir() if p.name.startswith("_temporary")]


def test_bam_splits_beyond_the_tasks_go_together(spark, tmp_path):
    from varloom.sources import bam

    path, rows = str(tmp_path / "x"), spark.range(30_000).select(
        F.concat(F.lit("r"), "id").alias("name"), F.lit(0).alias("flag"), F.lit("c1").alias("ref"), (F.col("id") + 1).alias("pos"), F.lit(60).alias("mapq"), F.array(F.struct(F.lit("M").alias("op"), F.lit(4).alias("len"))).alias("cigar"), F.lit("*").alias("mate_ref"),
        F.lit(0).cast("long").alias("mate_pos"), F.lit(0).alias("insert_size"), F.lit("ACGT").alias("seq"), F.lit("IIII").alias("qual"), F.create_map(F.lit("AS"), F.col("id").cast("string")).alias("tags"),
    )
    bam.write_bam(rows, path, [("c1", 100_000)], block_bytes=2000)
    got = bam.read_bam(spark, path, 500)
    files, tasks = len(list((tmp_path / "x").glob("*.bam"))), 4 * spark.sparkContext.defaultParallelism
    assert got.rdd.getNumPartitions() <= 2 * tasks + files < len(bam.BamReader({"path": path, "splitbytes": 500}).partitions()) / 10
    assert sorted((r.name, r.pos, r.tags["AS"]) for r in got.collect()) == sorted((f"r{i}", i + 1, str(i)) for i in range(30_000))


def test_bam_records_in_columns_are_those_of_single_rows():
    import numpy as np
    import pyarrow as pa

    from pyspark.sql import Row
    from varloom.sources import bam

    names, number = bam.ARROW.names[1:], {"c1": 0, "c2": 1}
    rows = [dict(zip(names, r, strict=True)) for r in bam_rows(400)]
    rows[3] |= {"cigar": None, "seq": None, "qual": None, "tags": None, "ref": None}
    rows[4] |= {"name": "ré", "seq": "acgtx", "qual": "*", "tags": {"ZZ": "", "CO": "é x", "NM": "-3"}}
    batch = pa.RecordBatch.from_pylist([r | {"tags": list((r["tags"] or {}).items())} for r in rows], pa.schema(list(bam.ARROW)[1:]))
    single = [bam.encode(Row(**r), number) for r in rows]
    assert bam.encode_batch(batch, number) == b"".join(single) and bam.encode_batch(batch.slice(3, 50), number) == b"".join(single[3:53])
    odd = batch.slice(0, 1).set_column(names.index("tags"), "tags", pa.array([[("ABC", "1")]], bam.ARROW.field("tags").type))
    assert bam.encode_batch(odd, number) == bam.encode(Row(**(rows[0] | {"tags": {"ABC": "1"}})), number)

    more = b"XAAq" + b"Xcc\xff" + b"XII" + b"\xff" * 4 + b"XHHff\0"
    for tail, value in ((more, {}), (more + b"Xff\0\0\xc0\x3f", {"Xf": "1.5"})):
        records = [x[4:] + (tail if i == 4 else b"") for i, x in enumerate(single)]
        ends = np.cumsum([len(x) for x in records])
        got = bam.decode(b"".join(records), ends - [len(x) for x in records], ends, [("c1", 1000), ("c2", 1000)], np.arange(len(rows))).to_pylist()
        assert dict(got[4]["tags"]) == {"CO": "é x", "NM": "-3", "ZZ": "", "XA": "q", "Xc": "-1", "XI": "4294967295", "XH": "ff"} | value
        assert (got[4]["name"], got[4]["seq"], got[4]["qual"]) == ("ré", "ACGTN", "*")
        assert (got[3]["seq"], got[3]["qual"], got[3]["ref"], got[3]["cigar"], got[3]["tags"]) == ("*", "*", "*", [], [])
        assert all({k: dict(v) if k == "tags" else v for k, v in g.items() if k != "offset"} == r for i, (g, r) in enumerate(zip(got, rows, strict=True)) if i not in (3, 4))


def test_bam_ranges_of_any_size_give_each_record_once(tmp_path):
    import json

    import pyarrow as pa

    from varloom.sources import bam

    rng, schema = random.Random(7), pa.schema(list(bam.ARROW)[1:])
    rows = [{"name": f"r{i}", "flag": 0, "ref": "c1", "pos": 1, "mapq": 9, "mate_ref": "*", "mate_pos": 0, "insert_size": 0, "seq": "".join(rng.choices("ACGT", k=rng.choice([10, 3000, 9000]))), "qual": "*", "cigar": [], "tags": []} for i in range(900)]
    writer = bam.BamWriter({"path": str(tmp_path), "references": json.dumps([("c1", 1000)])}, False)
    writer.commit([writer.write(iter([pa.RecordBatch.from_pylist(rows, schema)]))])
    (file,) = tmp_path.glob("*.bam")
    size = file.stat().st_size
    for step in (size, size // 3, size // 7, size // 20, size // 90):
        got = [r for at in range(0, size, step) for b in bam.records(str(file), at, min(at + step, size)) for r in b.select(["name", "seq"]).to_pylist()]
        assert got == [{"name": r["name"], "seq": r["seq"]} for r in rows]


def test_bam_tags_of_all_kinds():
    import struct

    from varloom.sources.bam import _tags

    raw = b"XAAq" + b"XCC\xff" + b"Xcc\xff" + b"XSS" + struct.pack("<H", 65535) + b"Xff" + struct.pack("<f", 1.5) + b"XZZab c\0" + b"XBBs" + struct.pack("<i2h", 2, -1, 7)
    assert list(_tags(raw)) == [("XA", "q"), ("XC", "255"), ("Xc", "-1"), ("XS", "65535"), ("Xf", "1.5"), ("XZ", "ab c"), ("XB", "s,-1,7")]


def plain_pileup(reads: list[dict], reference: dict[str, str]) -> dict:
    """Position by position, a base at a time."""
    out: dict = {}
    for r in reads:
        if r["flag"] & 4:
            continue
        ref, at, cigar, new = r["pos"], 0, r["cigar"], True
        low = bool(r["flag"] & 16)
        case = str.lower if low else str.upper
        base_at = lambda p, s=reference.get(r["ref"], ""): s[p - 1].upper() if p <= len(s) else "N"
        for i, (op, n) in enumerate(cigar):
            after = [x[0] for x in cigar[i + 1 :]]
            for k in range(n if op in "M=XD" else 0):
                text = ""
                if op == "D":
                    text = "*"
                else:
                    if new and k == 0:
                        text += "^" + chr(min(93, r["mapq"]) + 33)
                    b = r["seq"][at + k]
                    text += ("," if low else ".") if b == "=" or b.upper() == base_at(ref + k) else case(b)
                    if k == n - 1:
                        rest = after
                        if after[:1] == ["I"]:
                            m = cigar[i + 1][1]
                            text += f"+{m}" + case(r["seq"][at + n : at + n + m])
                            rest = after[1:]
                        elif after[:1] == ["D"]:
                            m = cigar[i + 1][1]
                            text += f"-{m}" + case("".join(base_at(ref + n + j) for j in range(m)))
                            rest = after[1:]
                        text += "$" if not rest or rest[0] in "SNH" else ""
                q = r["qual"][at + k : at + k + 1] or " "
                out.setdefault((r["ref"], ref + k), []).append((text, q))
            new = op in "SNH"
            ref += n if op in "M=XDN" else 0
            at += n if op in "M=XIS" else 0
    return out


@pytest.mark.parametrize("bits", [3, 10])
def test_pileup_against_a_plain_one(spark, bits):
    from varloom.operators.pileup import pileup
    from varloom.sources.readers import sequence_chunks

    rng = random.Random(bits)
    reference = {"a": "".join(rng.choices("ACGTN", k=400)), "b": "".join(rng.choices("acgt", k=90))}
    rows = []
    for i in range(400):
        cigar = []
        for _ in range(rng.randint(1, 6)):
            op = rng.choice("MMMMIDNSHP=X")
            if not cigar or cigar[-1][0] != op:
                cigar.append((op, rng.randint(1, 12)))
        n = sum(k for op, k in cigar if op in "M=XIS")
        rows.append({"line_no": i, "ref": rng.choice("ab"), "pos": rng.randint(1, 80), "flag": rng.choice([0, 16, 0, 16, 4, 1024]), "mapq": rng.randrange(0, 255, 5), "cigar": cigar, "seq": "".join(rng.choices("ACGT=n", k=n)), "qual": "".join(rng.choices("ABCDEF", k=n))})
    rows = [r for r in rows if any(op in "M=XD" for op, _ in r["cigar"])]
    df = spark.createDataFrame([(r["line_no"], r["ref"], r["pos"], r["flag"], r["mapq"], r["cigar"], r["seq"], r["qual"]) for r in rows], "line_no long, ref string, pos long, flag int, mapq int, cigar array<struct<op:string,len:int>>, seq string, qual string")
    chunks = sequence_chunks(spark.createDataFrame(list(reference.items()), "id string, seq string"), 50, 30)
    got = {(r.ref, r.pos): (r.depth, r.bases, r.quals) for r in pileup(df.repartition(3), chunks, 50, 30, bits=bits).collect()}
    own = plain_pileup(sorted(rows, key=lambda r: (r["ref"], r["pos"], r["line_no"])), reference)
    assert got == {k: (len(v), "".join(t for t, _ in v), "".join(q for _, q in v)) for k, v in own.items()}
    assert pileup(df).count() == len(own)


def test_compound_rules(spark):
    from varloom.operators import reads

    rows = [(i, 1 if i % 2 else 0, i % 40, "7" if i % 3 else "8") for i in range(200)]
    df = spark.createDataFrame(rows, "n long, flag int, mapq int, ref string").withColumn("tags", F.create_map(F.lit("RG"), F.lit("x")))
    sets = {"good": {"mapQuality": ">=20"}, "pair": {"isPaired": "true"}, "seven": {"reference": "7"}}
    plain = {"good": lambda r: r[2] >= 20, "pair": lambda r: r[1] == 1, "seven": lambda r: r[3] == "7"}
    for rule, want in {
        "good & pair | seven": lambda r: plain["good"](r) and plain["pair"](r) or plain["seven"](r), "good & (pair | seven)": lambda r: plain["good"](r) and (plain["pair"](r) or plain["seven"](r)),
        "!good & pair": lambda r: not plain["good"](r) and plain["pair"](r), "!(good | !pair)&!!seven": lambda r: not (plain["good"](r) or not plain["pair"](r)) and plain["seven"](r), '"seven"': plain["seven"],
        None: lambda r: any(f(r) for f in plain.values()),
    }.items():
        got = {r.n for r in df.where(reads.compound_filter(sets, rule)).collect()}
        assert got == {r[0] for r in rows if want(r)}, rule
    for bad in ("good &", "(good", "good)", "none", "good pair"):
        with pytest.raises(ValueError, match="rule|filter|brackets"):
            reads.compound_filter(sets, bad)


def test_region_queries_read_fewer_files(spark, tmp_path):
    from varloom.sources import regions

    rng = random.Random(2)
    rows = [(rng.choice(["c1", "c2"]), s, s + rng.choice([0, 5, 3000, 2_000_000]), i) for i, s in enumerate(rng.randint(1, 50_000_000) for _ in range(4000))]
    df, path = spark.createDataFrame(rows, "ref string, start long, end long, i long"), str(tmp_path / "t")
    regions.write_regions(df, path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        files = {}
        for region, (lo, hi) in {"c1:1,000,000-1,200,000": (1_000_000, 1_200_000), "c1:8388600-8388700": (8388600, 8388700), "c1": (1, 1 << 29)}.items():
            q = regions.read_regions(spark, path, [region])
            assert {r.i for r in q.collect()} == {i for ref, s, e, i in rows if ref == "c1" and s <= hi and e >= lo}
            leaf = q._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
            files[region] = leaf.metrics().apply("numFiles").value()
            assert regions.count_region(spark, path, region).collect()[0].n == q.count()
        assert files["c1:8388600-8388700"] < files["c1"] / 5 and files["c1:1,000,000-1,200,000"] < files["c1"] / 5
        both = regions.read_regions(spark, path, ["c1:1-2000000", "c2:40,000,000"])
        assert sorted(r.i for r in both.collect()) == sorted(i for ref, s, e, i in rows if (ref == "c1" and s <= 2_000_000) or (ref == "c2" and e >= 40_000_000))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_letters_of_no_nucleotide_fail_on_demand(spark, tmp_path):
    from varloom.sources import places

    (tmp_path / "x.fa").write_text(">a\nACGTN\nRYK\n>b\nAC*T\n")
    assert places.fasta_pieces(spark, str(tmp_path / "x.fa"), only=["a"], check=True).collect()[0].seq == "ACGTNRYK"
    with pytest.raises(Exception, match="not nucleotides in b"):
        places.fasta_pieces(spark, str(tmp_path / "x.fa"), check=True).collect()


def test_alignment_blocks_of_several_files(spark, tmp_path):
    from varloom.sources.readers import read_maf

    block = "a score=5 mismap=0.5\ns t 0 4 + 9 ACGT\ns q 1 4 - 9 ACGA\n\n"
    (tmp_path / "a.maf").write_text(block)
    (tmp_path / "b.maf").write_text(block * 2)
    assert read_maf(spark, [str(tmp_path / "a.maf"), str(tmp_path / "b.maf")]).count() == 3


def test_region_tables_of_many_sequences_are_few_files(spark, tmp_path):
    """A folder per sequence and bin, dealt by start, was tens of thousands of files for 600,000 rows of 1000 sequences."""
    from varloom.sources import regions

    df = spark.range(6000).selectExpr("concat('c', id % 1000) as ref", "id * 1500 + 1 as start", "id * 1500 + 40 as end", "id as i")
    path = str(tmp_path / "t")
    regions.write_regions(df, path)
    assert len(list((tmp_path / "t" / "rows").rglob("*.parquet"))) <= regions.LEAST_FILES
    assert [r.i for r in regions.read_regions(spark, path, ["c7:1-3000000"]).collect()] == [7, 1007] and regions.count_region(spark, path, "c7:1-3000000").first().n == 2
    assert regions.read_regions(spark, path, ["nowhere"]).count() == 0 == regions.count_region(spark, path, "nowhere").first().n

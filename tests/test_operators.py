"""Operators on small tables: sources, the adjacency machine, folds, alignment goldens, scans over many windows."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from varloom.functions import scalars as S
from varloom.operators import align, genotype, intervals, qc, reads, realign, recalibrate, variants
from varloom.sources import readers


def brute_merge(rows, delta):
    out = []
    for k, s, e in sorted(rows):
        if out and out[-1][0] == k and s <= out[-1][2] + delta:
            out[-1][2] = max(out[-1][2], e)
            out[-1][3] += 1
        else:
            out.append([k, s, e, 1])
    return sorted(map(tuple, out))


@pytest.fixture(scope="module")
def spans(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else f"c{rng.randrange(4)}", s := rng.randrange(1, 200_000), s + rng.randrange(1, 300)) for _ in range(1500)]
    return rows, spark.createDataFrame(rows, "t_id string, t_start long, t_end long").repartition(4)


def test_merge_over_many_windows(spans):
    rows, df = spans
    got = sorted(map(tuple, intervals.merge(df, ["t_id"], "t_start", "t_end", 1).select("t_id", "t_start", "t_end", "n").collect()))
    assert got == brute_merge(rows, 1)


def test_covered_and_depth(spans):
    rows, df = spans
    covered: dict = {}
    for k, s, e in rows:
        for p in range(s, e + 1):
            covered.setdefault(k, {}).setdefault(p, 0)
            covered[k][p] += 1
    assert {r.t_id: r.covered for r in intervals.covered_length(df, ["t_id"], "t_start", "t_end").collect()} == {k: len(v) for k, v in covered.items()}
    runs = intervals.depth_runs(df, ["t_id"], "t_start", "t_end")
    got = {(r.t_id, r.pos): r.depth for r in intervals.per_base(runs, ["t_id"]).collect()}
    assert got == {(k, p): n for k, v in covered.items() for p, n in v.items()}


def test_interval_join_has_no_doubles(spans):
    rows, df = spans
    got = intervals.interval_join(df, df, "t_id", ("t_start", "t_end"), ("t_start", "t_end"), bits=6).count()
    assert got == sum(a[0] == b[0] and a[1] <= b[2] and a[2] >= b[1] for a in rows for b in rows)
    plan = intervals.interval_join(df, df, "t_id", ("t_start", "t_end"), ("t_start", "t_end"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_neighbours_over_windows(spans):
    rows, df = spans
    got = sorted((r.t_id, r.t_start, r.n) for r in intervals.neighbours(df, "t_id", "t_start", 50).collect())
    assert got == sorted((k, s, sum(a == k and abs(b - s) <= 50 for a, b, _ in rows)) for k, s, _ in rows)


MAF = """# made by hand
a score=221 mismap=1e-10
s chr1        17032965 5 + 35477943 AGT-TC
s scaffold665   120623 6 -   130124 AGTATC
p }}}}

a score=9 mismap=0.5
s chr2 0 3 + 50 ACG
s s2 4 3 + 20 ACG
"""


def test_maf(spark, tmp_path):
    (tmp_path / "x.maf").write_text(MAF)
    got = sorted(map(tuple, readers.read_maf(spark, str(tmp_path / "x.maf")).select("t_id", "t_start", "t_end", "q_id", "q_start", "q_end", "strand", "score", "mismap").collect()))
    assert got == [("chr1", 17032966, 17032970, "scaffold665", 130124 - 120629 + 1, 130124 - 120624 + 1, "-", 221, 1e-10), ("chr2", 1, 3, "s2", 5, 7, "+", 9, 0.5)]
    (tmp_path / "bad.maf").write_text(MAF.replace("ACG\ns s2", "AC\ns s2"))
    with pytest.raises(Exception, match="unequal length"):
        readers.read_maf(spark, str(tmp_path / "bad.maf")).count()


def test_fasta_and_fetch(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a first one\nACGTN\nacgtn\n>b\n" + "ACGT" * 20 + "\n")
    fa = readers.unique_ids(readers.read_fasta(spark, str(tmp_path / "x.fa")))
    assert sorted((r.id, r.seq, r.len, r.n_len) for r in fa.collect()) == [("a", "ACGTNacgtn", 10, 2), ("b", "ACGT" * 20, 80, 0)]
    chunks = readers.sequence_chunks(fa, size=7, overlap=20)
    at = spark.createDataFrame([("b", 5, 12), ("b", 70, 80), ("a", 1, 3)], "id string, start long, end long")
    assert {(r.id, r.start): r.seq for r in readers.fetch(at, chunks, 7).collect()} == {("b", 5): "ACGTACGT", ("b", 70): ("ACGT" * 20)[69:80], ("a", 1): "ACG"}
    with pytest.raises(Exception, match="duplicate id"):
        readers.unique_ids(fa.union(fa)).count()


VCF = """##fileformat=VCFv4.1
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
1\t10\t.\tA\tAC,G\t5.5\tPASS\tAC=2;NEG\tGT:AA:VS\t0/1:3,1\t./.
2\t7\tx\tAT\tA\t.\t.\t.\tGT:VS\t1/1:-1\t0/0:2
"""


def test_vcf_round_trip(spark, tmp_path):
    (tmp_path / "x.vcf").write_text(VCF)
    sites, gt = readers.read_vcf(spark, str(tmp_path / "x.vcf"))
    s = {r.pos: r for r in sites.collect()}
    assert s[10].alts == ["AC", "G"] and s[10].info == {"AC": "2", "NEG": None} and s[7].qual is None
    g = {(r.pos, r["sample"]): r.fmt for r in gt.collect()}
    assert g[10, "s1"] == {"GT": "0/1", "AA": "3,1"} and g[10, "s2"] == {"GT": "./."} and g[7, "s2"] == {"GT": "0/0", "VS": "2"}
    lines = [r.value for r in readers.format_vcf(sites, gt, ["s1", "s2"]).collect()]
    assert lines[0] == "1\t10\t.\tA\tAC,G\t5.50\tPASS\tAC=2;NEG\tGT:AA\t0/1:3,1\t./."
    assert readers.read_vcf(spark, str(tmp_path / "x.vcf"), "2")[0].count() == 1


SAM = """@HD\tVN:1.0
r1\t99\tc1\t100\t60\t2S5M2D3M\t=\t300\t250\tACGTACGTAC\tIIIIIIIIII\tRG:Z:g1\tAS:i:95
r2\t1027\tc1\t100\t60\t4M1I5M\tc2\t300\t0\tACGTACGTAC\tIIIIIIIIII\tRG:Z:g1\tAS:i:80
"""


def test_sam(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM)
    r = readers.read_sam(spark, str(tmp_path / "x.sam"))
    assert [x.name for x in reads.usable(r).collect()] == ["r1"]
    got = r.select("name", reads.alignment_end(F.col("pos"), F.col("cigar")).alias("e"), reads.indel_spans(F.col("pos"), F.col("cigar")).alias("x"), reads.query_position(F.col("pos"), F.col("cigar"), F.lit(107)).alias("q"), *[e.alias(f"c{i}") for i, e in enumerate(reads.clip_edges(F.col("pos"), F.col("cigar")))]).orderBy("name").collect()
    assert got[0].e == 109 and [tuple(x) for x in got[0].x] == [(105, 106)] and got[0].q == 7 and got[0].c0 == 99
    assert got[1].e == 108 and [tuple(x) for x in got[1].x] == [(103, 103)] and got[1].c0 is None
    spans = reads.depth_spans(r.where("name = 'r1'").withColumn("score", F.lit(95)), 0, 1000)
    assert sorted(tuple(x) for x in spans.collect()) == [("c1", "clipAlign", 99, 99), ("c1", "crossSignal", 105, 106)]


def test_gap_runs_and_walk_of_the_worked_example(spark):
    df = spark.createDataFrame([("t", "q", 1, 1, "-ab-c-t--", "aa-ccdcdt")], "t_id string, q_id string, t_start long, q_start long, t_seq string, q_seq string")
    ins = [tuple(r) for r in variants.gap_runs(df).select("anchor", "first", "last").collect()]
    assert ins == [(0, 1, 1), (2, 3, 3), (3, 5, 5), (4, 7, 8)]
    dels = [tuple(r) for r in variants.gap_runs(df, "q_seq", "t_seq", "q_start", "t_start").select("first", "last", "anchor").collect()]
    assert dels == [(2, 2, 2)]
    cols = variants.walk(df)
    assert [(r.t_pos, r.t_base, r.q_pos, r.q_base) for r in variants.snps(cols).collect()] == [(4, "t", 6, "c")]
    assert sorted((r.t_start, r.t_end, r.q_start, r.q_end) for r in variants.reference_calls(cols).collect()) == [(1, 1, 2, 2), (3, 3, 4, 4)]


def test_structural_calls(spark):
    row = lambda q, t, ts, te, qs, qe, s="+": (q, t, ts, te, qs, qe, s)
    rows = [row("a", "c1", 1, 10, 1, 10), row("a", "c1", 21, 30, 11, 20)]
    rows += [row("b", "c1", 1, 10, 1, 10), row("b", "c1", 21, 30, 11, 20, "-"), row("b", "c1", 41, 50, 21, 30)]
    rows += [row("c", "c1", 1, 10, 1, 10), row("c", "c2", 500, 520, 11, 20), row("c", "c1", 41, 50, 21, 30), row("d", "c1", 1, 5, 1, 5)]
    got = {}
    for r in variants.structural_calls(spark.createDataFrame(rows, "q_id string, t_id string, t_start long, t_end long, q_start long, q_end long, strand string")).collect():
        got.setdefault(r.q_id, []).append(r.kind)
    assert got == {"a": ["gap-2"], "b": ["INV"], "c": ["TRANS-INTER1"]}


def test_breakpoints():
    a = "ACGTTGCAGG" + "TCATCA" + "TCAGGACC"  # the excised TCATCA may also lie one to three places on
    got = align.breakpoints(a, 10, 17)
    assert (got["at"], got["outside"], got["inside"]) == (3, 0, 3)
    assert (got["start_lo"], got["start_hi"], got["end_lo"], got["end_hi"]) == (11, 13, 14, 19)
    assert align.breakpoints("AACG" + "TT" + "CGTT", 4, 7)["outside"] == 2
    assert align.breakpoints("ACGTACGT", 4, 5)["at"] == 0 and align.homology_of("ANN", "NNA") == 0
    rng = random.Random(2)
    for _ in range(300):
        x, y = ("".join(rng.choice("ACN") for _ in range(rng.randint(0, 8))) for _ in "ab")
        assert align.homology_of(x, y) == max((n for n in range(min(len(x), len(y)) + 1) if x[len(x) - n :] == y[:n] and "N" not in y[:n]), default=0)
    assert [align.excised_range(10, 17, m) for m in ("indel", "tdup", "invl", "invr")] == [(11, 16), (17, 10), (11, 17), (10, 16)]


def _plain_scores(a: str, b: str, sc) -> list[list[int]]:
    """Local alignment with affine gaps, cell by cell, by looking at gaps of every length."""
    f = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = 0 if "N" in (a[i - 1], b[j - 1]) else sc.match if a[i - 1] == b[j - 1] else sc.mismatch
            gaps = [f[i - k][j] + sc.gap + (k - 1) * sc.extend for k in range(1, i + 1)] + [f[i][j - k] + sc.gap + (k - 1) * sc.extend for k in range(1, j + 1)]
            f[i][j] = max(0, f[i - 1][j - 1] + s, *gaps)
    return f


def test_alignment_of_many_pairs_matches_brute_force(spark):
    rng = random.Random(6)
    pairs = []
    for k in range(60):
        a = "".join(rng.choice("ACGTN" if k % 3 else "AC") for _ in range(rng.randint(0, 12)))
        i = rng.randint(0, len(a))
        b = a[:i] + a[i + rng.randint(0, 4) :] if k % 2 else "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 12)))
        pairs.append((k, a, align.turned(b) if k % 5 == 0 else b))
    df = spark.createDataFrame(pairs, "pair_id long, a string, b string")
    for sc in (align.Scores(1, -2, -2, -1), align.Scores()):
        got = {r.pair_id: r for r in align.gap_excision(df, sc, both=True, tasks=2).collect()}
        local = {r.pair_id: r for r in align.smith_waterman(df, sc, tasks=2).collect()}
        for k, a, b in pairs:
            best = []
            for s in (b, align.turned(b)):
                f, r = _plain_scores(a, s, sc), _plain_scores(a[::-1], s[::-1], sc)
                n, m = len(a), len(s)
                high = lambda t, i, j: max(max(x[: j + 1]) for x in t[: i + 1])
                best.append(max(high(f, i, j) + high(r, n - i, m - j) for i in range(n + 1) for j in range(m + 1)))
            assert (got[k].score or 0) == max(best)
            assert got[k].strand == (None if not max(best) else "+" if best[0] >= best[1] else "-")
            assert local[k].score == max(map(max, _plain_scores(a, b, sc)))


def test_fetch_of_long_regions(spark):
    rng = random.Random(4)
    seqs = {k: "".join(rng.choice("ACGT") for _ in range(n)) for k, n in (("a", 57), ("b", 10), ("c", 1))}
    chunks = readers.sequence_chunks(spark.createDataFrame(list(seqs.items()), "id string, seq string"), 10, 6)
    rows = [(k, s, e) for k in seqs for s in (1, 5, 10, 11, 31) for e in (s, s + 3, s + 12, s + 60) if s <= len(seqs[k])] * 2
    got = sorted(map(tuple, readers.fetch(spark.createDataFrame(rows, "id string, start long, end long"), chunks, 10, 6).collect()))
    assert got == sorted((k, s, e, seqs[k][s - 1 : e]) for k, s, e in rows)


def test_fasta_headers_may_hold_the_mark(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a note c.10A>G here\nAC\nGTN\n\n>b\r\nacgt\r\n>c\n")
    assert sorted((r.id, r.seq, r.len, r.n_len) for r in readers.read_fasta(spark, str(tmp_path / "x.fa")).collect()) == [("a", "ACGTN", 5, 1), ("b", "acgt", 4, 0), ("c", "", 0, 0)]


def test_realigned_calls(spark):
    """Planted changes come back with their type, size and place; bases of the alleles differ by just that."""
    rng = random.Random(9)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    targets, queries, calls, want = [], [], [], {}
    for k in range(12):
        t = dna(1300)
        at, size = 640, 3 + k
        kind = ["DEL", "INS", "REPLACEMENT", "SNP"][k % 4]
        new = {"DEL": "", "INS": dna(size), "REPLACEMENT": dna(size + 5), "SNP": {"A": "C", "C": "G", "G": "T", "T": "A"}[t[at]]}[kind]
        gone = {"DEL": size, "INS": 0, "REPLACEMENT": size, "SNP": 1}[kind]
        q = t[:at] + new + t[at + gone :]
        if back := k >= 8:
            q = align.turned(q)
        targets.append((f"t{k}", t))
        queries.append((f"q{k}", q))
        lo = len(q) - at - len(new) if back else at
        expected = ("t%d" % k, at - 20, at + gone + 20) if k == 4 else (None, None, None)
        calls.append((k, "TRANS-INTRA1" if k == 4 else "gap-2", f"t{k}" if k != 4 else "t0", at - 10, at + gone + 10, f"q{k}", lo - 10, lo + len(new) + 10, 50, 0.001, *expected))
        want[k] = (kind, len(new) - gone)
    calls.append((99, "INV", "t0", 600, 650, "q0", 600, 640, 50, 0.001, None, None, None))
    calls.append((98, "gap-1", "t1", 100, 120, "q1", 100, 120, 50, 0.001, None, None, None))
    table = lambda rows: spark.createDataFrame(rows, "id string, seq string")
    long = "call_id long, type string, t_id string, t_start long, t_end long, q_id string, q_start long, q_end long, score long, mismap double, expected_id string, expected_start long, expected_end long"
    c = spark.createDataFrame(calls, long)
    t, q = (readers.sequence_chunks(table(x), 200, 120) for x in (targets, queries))
    lengths = lambda x: table(x).select("id", F.length("seq").cast("long").alias("len"))
    args = (t, q, lengths(targets), lengths(queries))
    rows = {r.call_id: r for r in realign.realign(c, *args, flank_size=200, size=200, overlap=120).collect()}
    assert len(rows) == 14 and rows[98].status == "RefHomo_Or_SNP"
    assert (rows[99].type, rows[99].t_start, rows[99].t_end) == ("INV", 600, 650)
    refs = spark.createDataFrame([("t2", 1, 1300, "other")], "t_id string, t_start long, t_end long, q_id string")
    final = {r.call_id: r for r in realign.detected(c, *args, refs, flank_size=200, size=200, overlap=120).collect()}
    seq_t, seq_q = dict(targets), dict(queries)
    for k, (kind, change) in want.items():
        r = final[k]
        assert r.type.split("=>")[0] == kind and r.strand == ("-" if k >= 8 else "+") and r.is_good_realign
        assert len(r.alt) - len(r.ref) == change
        own = align.turned(seq_q[f"q{k}"]) if k >= 8 else seq_q[f"q{k}"]
        s = seq_t[r.t_id]
        assert s[: r.t_start - 1] + r.alt + s[r.t_end :] == own, k  # the variant turns the target into the query
        assert s[r.t_start - 1 : r.t_end] == r.ref
        assert r.gt == ("0/1" if k == 2 else "1/1") and r["filter"] == "."
    assert final[4].type == "DEL=>TRANS#t0-630-657#q4-630-650"


def test_gap_excision(spark):
    sc = align.Scores(1, -2, -2, -1)
    left, right, out = "ACGGTCATTGCAGGTA", "TTGACCATGCCGATCA", "GGGGGCCCCCAAAAA"
    r = align.excise(left + out + right, left + right, sc)
    assert r["score"] == len(left + right) and r["same"] == len(left + right) and r["pct"] == 100
    assert (r["left_a_start"], r["right_a_end"], r["left_b_start"], r["right_b_end"]) == (1, 47, 1, 32)
    turned = align.align_pair(left + out + right, align.turned(left + right), sc, both=True)
    assert turned["strand"] == "-" and turned["score"] == 32
    inv = align.align_pair(left + out + right, left + align.turned(right), sc, mode="inv")
    assert inv["score"] == 32
    df = spark.createDataFrame([(1, left + out + right, left + right), (2, "", "A"), (3, None, "A")], "pair_id long, a string, b string")
    got = {x.pair_id: x.score for x in align.gap_excision(df, sc).collect()}
    assert got == {1: 32, 2: None, 3: None}


def test_local_alignment(spark):
    r = align.local_alignment("TTTACGTACGGA", "ACGTCGG", align.Scores(2, -2, -3, -1))
    assert r["cigar"] == "4M1D3M" and r["score"] == 14 - 3


def test_near_duplicates():
    row = lambda s, e, nr, vq, n: (s, e, nr, vq, 1, n)
    assert qc.settle([row(1, 5, 0.1, 10, 0), row(10, 15, 0.1, 30, 1), row(20, 22, 0.2, 99, 2)]) == {0: -2, 1: 1, 2: -2}
    assert qc.settle([row(1, 5, 0.3, 10, 0), row(10, 15, 0.1, 30, 1), row(100, 101, 0.9, 1, 2)]) == {0: -2, 1: 1, 2: 1}


def _remove_overlap(rows):
    """RemoveOverlap and Rm of the reference, line by line, on one sequence: [mark, nr, vq, line_no, start, end]."""
    info = [[-1 if m == -1 else 0, nr, vq, no, s, e] for s, e, nr, vq, m, no in sorted(rows, key=lambda r: (r[0], r[5]))]

    def rm(index):
        left = []
        for j in index:
            if left and info[j][2] > info[left[0]][2]:
                for x in left:
                    info[x][0] = -2
                left = [j]
            elif left and info[j][2] < info[left[0]][2]:
                info[j][0] = -2
            else:
                left.append(j)
        span = None
        for j in left:
            if span is None:
                if info[j][1] == 0:
                    span = info[j][4:]
                continue
            if info[j][4] <= span[1] and info[j][5] >= span[0]:
                info[j][0], span = -2, info[j][4:]
            span = [min(span[0], info[j][4]), max(span[1], info[j][5])]
        left = [j for j in index if info[j][0] == 0]
        for n, j in enumerate(left):
            info[j][0] = -2 if n else 1

    index, end = [], None
    for i, x in enumerate(info):
        if x[0] < 0:
            continue
        if end is None or end + 20 < x[4]:
            if len(index) > 1:
                rm(index)
            index, end = [i], x[5]
        elif x[1] < info[index[0]][1]:
            for j in index:
                info[j][0] = -2
            index, end = [i], x[5]
        elif x[1] == info[index[0]][1]:
            index.append(i)
            end = max(end, x[5])
        else:
            x[0] = -2
    if len(index) > 1:
        rm(index)
    return {x[3]: 1 if x[0] == 0 else x[0] for x in info}


def test_near_duplicates_without_marked_sites(spark):
    rng = random.Random(7)
    rows = []
    for chrom in range(60):
        at = 1
        for i in range(rng.randint(1, 40)):
            at += rng.choice([0, 3, 9, 18, 25, 40])
            rows.append((chrom, at, at + rng.choice([0, 4, 30]), rng.choice([0.0, 0.0, 0.1, 0.6]), rng.randint(1, 4), rng.choice([1, 1, 1, -1]), chrom * 100 + (i * 7) % 41))
    assert qc.settle([(1, 5, 0.1, 10, 1, 0), (8, 9, 0.0, 99, -1, 1), (10, 15, 0.1, 30, 1, 2)]) == {0: -2, 1: -1, 2: 1}
    assert qc.settle([(1, 5, 0.1, 10, 1, 0), (8, 60, 0.2, 99, 1, 1), (50, 55, 0.1, 30, 1, 2)]) == {0: 1, 1: -2, 2: 1}
    want = {}
    for chrom in range(60):
        want |= _remove_overlap([r[1:] for r in rows if r[0] == chrom])
    sites = spark.createDataFrame(rows, "chrom long, start long, end long, nr double, vq long, mark int, line_no long")
    assert {r.line_no: r.final for r in qc.near_duplicates(sites).collect()} == want
    assert {-2, -1, 1} == set(want.values())


def test_genotypes_of_a_clear_site(spark):
    rows = [(1, f"s{i}", *((20, 0) if i < 8 else (10, 10) if i < 14 else (0, 20))) for i in range(18)] + [(1, "none", 0, 0)]
    got = {r["sample"]: r for r in genotype.genotype(spark.createDataFrame(rows, "site long, sample string, rr long, aa long")).collect()}
    assert [got[f"s{i}"].gt for i in (0, 9, 16)] == ["0/0", "0/1", "1/1"] and got["none"].gt == "./." and got["s0"].gq > 20


def test_runs_of_site_models_match_plain_loops():
    import numpy as np

    rng = np.random.default_rng(8)
    x = np.clip(np.concatenate([rng.normal(0.02, 0.02, 9), rng.normal(0.5, 0.06, 7), rng.normal(0.98, 0.02, 5)]), 0, 1)
    starts = np.array([0.001, 0.5, 1.0]) * np.linspace(0.8, 1.2, 8)[:, None]
    done, means, variances = genotype._em(x, starts)
    for r, first in enumerate(starts):
        mean, var, weight, last, ok = list(first), [0.002] * 3, [1 / 3] * 3, -np.inf, False
        for _ in range(50):
            like = [[w * np.exp(-0.5 * (v - m) ** 2 / s) / np.sqrt(2 * np.pi * s) for m, s, w in zip(mean, var, weight, strict=True)] for v in x]
            total = sum(np.log(sum(row)) for row in like)
            if abs(total - last) < 1e-3:
                ok = True
                break
            last = total
            resp = [[p / sum(row) for p in row] for row in like]
            mass = [sum(row[k] for row in resp) for k in range(3)]
            mean = [sum(row[k] * v for row, v in zip(resp, x, strict=True)) / mass[k] for k in range(3)]
            var = [sum(row[k] * (v - mean[k]) ** 2 for row, v in zip(resp, x, strict=True)) / mass[k] + 1e-3 for k in range(3)]
            weight = [m / len(x) for m in mass]
        assert ok == done[r] and np.allclose(mean, means[r], atol=1e-6) and np.allclose(var, variances[r], atol=1e-6)


def test_recalibration_separates(spark):
    rng = random.Random(3)
    rows = [(i, i % 3 == 0 and i < 300, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400)] + [(1000 + i, False, rng.gauss(6, 1), rng.gauss(6, 1)) for i in range(100)]
    out = recalibrate.recalibrate(spark.createDataFrame(rows, "site long, training boolean, x double, y double"), ["x", "y"]).collect()
    good = sorted(r.lod for r in out if r.site < 1000)
    bad = sorted(r.lod for r in out if r.site >= 1000)
    assert good[len(good) // 2] > bad[len(bad) // 2]


def test_mixtures(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal((0, 0), 0.5, (150, 2)), rng.normal((4, 4), 0.7, (100, 2))])
    m = recalibrate.best_mixture(spark, x, 3, starts=5)
    assert sorted(np.round(m.mean[:, 0]).tolist()) == [0, 4] and abs(m.weight.max() - 0.6) < 0.05
    # one round in plain loops gives the same as run_em's products
    first, _, done = recalibrate.run_em(x, recalibrate.moments(x), 2, 3, rounds=1)
    pick = np.random.default_rng(3).choice(len(x), 2, replace=False)
    cov = np.cov(x.T) + 1e-3 * np.eye(2)
    r = np.zeros((len(x), 2))
    for i, row in enumerate(x):
        p = [np.exp(-0.5 * (row - c) @ np.linalg.inv(cov) @ (row - c)) for c in x[pick]]
        r[i] = np.array(p) / sum(p)
    for k in range(2):
        mean = sum(r[i, k] * x[i] for i in range(len(x))) / r[:, k].sum()
        var = sum(r[i, k] * np.outer(x[i] - mean, x[i] - mean) for i in range(len(x))) / r[:, k].sum() + 1e-3 * np.eye(2)
        assert np.allclose(first.mean[k], mean) and np.allclose(first.cov[k], var) and not done
    with pytest.raises(RuntimeError):
        recalibrate.best_mixture(spark, np.array([[np.nan, 1.0], [2.0, 3.0]]), 1, starts=2)


def test_sample_cap(spark):
    df = spark.range(5000).withColumn("y", F.col("id") % 7)
    got = [r.id for r in qc.sample_cap(df, 300, "id").collect()]
    assert got == [r.id for r in df.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(300).collect()]
    assert qc.sample_cap(df, 10_000, "id").count() == 5000
    assert qc.sample_cap(df.select(F.lit(1).alias("id")), 300, "id").count() == 300


def test_scalars(spark):
    df = spark.createDataFrame([("a;;b,c", "0|2", 8)], "s string, gt string, n long")
    r = df.select(S.split_set("s", ";,").alias("p"), S.first_alt("gt").alias("a"), S.collapse_gt("gt").alias("c"), S.size_bin_log("n").alias("l"), S.size_bin_log(F.lit(1)).alias("one"), S.size_bin_log(F.lit(9)).alias("nine")).first()
    assert r.p == ["a", "b", "c"] and r.a == 2 and r.c == "0|1" and r.l == "5-8" and r.one == "2-2" and r.nine == "9-16"
    S.register(spark)
    assert spark.sql("select revcomp('AACg') r, n_count('ANn') n").first() == ("cGTT", 2)


def test_streams(spark, tmp_path):
    from varloom.streaming.coverage import event_counts, stream_depth

    rows = [("c1", p, p + 49, p) for p in range(0, 1000, 25)]
    src = spark.createDataFrame(rows, "ref string, pos long, end long, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    src.write.parquet(str(tmp_path / "in"))
    q = stream_depth(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("depth").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select sum(bases) from depth").first()[0] == 50 * len(rows)
    ev = spark.createDataFrame([("a", 1.0)], "event_type string, value double").withColumn("ts", F.current_timestamp())
    assert event_counts(ev).count() == 1


def test_six_digits(spark):
    from varloom.sources.writers import six_digits

    values = [0.0, 1.0, -2.5, 0.1, 1 / 3, 123456.0, 1234567.0, 999999.5, 0.0001, 0.00001234567, 1e-10, 100.0, 250000.0, -0.05, 1e300]
    got = [r.s for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(six_digits("v").alias("s")).collect()]
    assert got == [f"{v:g}" for v in values]


def test_written_calls(spark, tmp_path):
    from varloom.sources import writers

    calls = [("t1", 9, 12, "q1", 4, 4, "+", 50, 0.001, "DEL", "ACGT", "A", True, True, False, "1/1", ".", 2, 0), ("t1", 3, 3, "q1", 7, 7, "-", 50, 0.5, "SNP", "A", "C", True, False, False, "0/1", "AGEFALSE", 0, 5)]
    kind = "t_id string, t_start long, t_end long, q_id string, q_start long, q_end long, strand string, score long, mismap double, type string, ref string, alt string, is_success_align boolean, is_good_realign boolean, x boolean, gt string, filter string, homo_run int, n_count int"
    df = spark.createDataFrame(calls, kind).withColumn("identity", F.expr("array(named_struct('len', 90, 'pct', 99), named_struct('len', 40, 'pct', 98), named_struct('len', 50, 'pct', 100))"))
    lines = writers.detector_lines(df)
    writers.write_lines(lines, str(tmp_path / "out"), "t_id", "t_start", header=writers.detector_header("s1"))
    sites, gt = readers.read_vcf(spark, [str(tmp_path / "out" / "header"), str(tmp_path / "out" / "lines")])
    assert [r.value for r in lines.orderBy("t_start").collect()][1] == "t1\t9\t.\tACGT\tA\t255\t.\t.\tGT:AGE:AS:END:HR:MS:NR:QR:TR:VS:VT\t1/1:T,+,90,99,40,98,50,100:50:12:2:0.001:0:q1=4-4:t1=9-12:-3:DEL"
    assert {(r.pos, tuple(r.alts), tuple(r.filters)) for r in sites.collect()} == {(9, ("A",), (".",)), (3, ("C",), ("AGEFALSE",))}
    assert {(r.pos, r["sample"], r.fmt["VS"], r.fmt["NR"]) for r in gt.collect()} == {(9, "s1", "-3", "0"), (3, "s1", "1", "0.0248756")}
    header = writers.detector_header("s1")
    assert header[:-1] == sorted(header[:-1]) and len(header) == 17
    writers.write_parts(lines, F.col("t_start") > 5, str(tmp_path / "parts"), "t_start")
    assert spark.read.text(str(tmp_path / "parts" / "kept" / "lines")).count() == spark.read.text(str(tmp_path / "parts" / "false" / "lines")).count() == 1


def test_qc_output(spark):
    from varloom.sources import writers

    lines = spark.createDataFrame([(0, "##fileformat=VCFv4.1"), (1, "##x"), (2, "#CHROM\tPOS"), (3, "1\t5\t.\tA\tC\t9\tLOW\tVQ=3;SPN=9\tGT\t0/1"), (4, "1\t6\t.\tA\tC\t9\t.\tVQ=3\tGT\t0/1")], "line_no long, value string")
    head = [r.value for r in writers.qc_header(lines, 3).orderBy("line_no", "part").collect()]
    assert len(head) == 7 and head[1].startswith("##FILTER=<ID=DUPLIC") and head[3].startswith("##FILTER=<ID=q3,") and head[5].startswith("##INFO=<ID=SPN") and head[6] == "#CHROM\tPOS"
    decided = spark.createDataFrame([(3, "PASS", 2), (4, "DUPLIC", 1)], "line_no long, filter string, samples int")
    assert [r.value for r in writers.qc_lines(lines, decided).orderBy("line_no").collect()] == ["1\t5\t.\tA\tC\t9\tPASS\tVQ=3;SPN=2\tGT\t0/1", "1\t6\t.\tA\tC\t9\tDUPLIC\tVQ=3;SPN=1\tGT\t0/1"]
    assert writers.qc_summary(decided).first().asDict() == {"total": 2, "pass": 1, "low": 0, "false": 0, "duplic": 1, "pass_ratio": "0.500", "low_ratio": "0.000", "false_ratio": "0.000", "duplic_ratio": "0.500"}


def test_sorted_input_is_checked(spark):
    df = spark.createDataFrame([(1, i, i // 2) for i in range(50)], "k int, line long, at long")
    assert intervals.assert_sorted(df, ["k"], "line", ["at"]).count() == 50
    with pytest.raises(Exception, match="not sorted at line 50"):
        intervals.assert_sorted(df.union(spark.createDataFrame([(1, 50, 3)], df.schema)), ["k"], "line", ["at"]).collect()


def test_reads_as_text(spark, tmp_path):
    (tmp_path / "x.sam").write_text(SAM.replace("@HD\tVN:1.0\n", "@HD\tVN:1.0\n@SQ\tSN:c1\tLN:500\n"))
    (tmp_path / "y.sam").write_text("@HD\tVN:1.5\n@SQ\tSN:c1\tLN:500\n@SQ\tSN:c2\tLN:9\n@CO\tx\n")
    r = readers.read_sam(spark, str(tmp_path / "x.sam"))
    lines = [x.value for x in reads.sam_lines(r.orderBy("line_no")).collect()]
    assert lines[1] == "r2\t1027\tc1\t100\t60\t4M1I5M\tc2\t300\t0\tACGTACGTAC\tIIIIIIIIII\tAS:i:80\tRG:Z:g1" and "\t=\t300" in lines[0]
    assert sorted(x.value for x in reads.fasta_lines(r).collect()) == [">r1\nACGTACGTAC", ">r2\nACGTACGTAC"]
    assert reads.yaml_lines(r).where("value like '%Cigar: 4M1I5M%'").count() == 1
    head = [x.value for x in readers.read_sam_header(spark, [str(tmp_path / "x.sam"), str(tmp_path / "y.sam")]).collect()]
    assert len(head) == 4 and head[0].startswith("@HD") and {x[:3] for x in head[1:3]} == {"@SQ"} and head[3] == "@CO\tx"

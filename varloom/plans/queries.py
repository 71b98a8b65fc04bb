"""One query per operator, each over whole tables, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.functions import scalars as S
from varloom.functions import tables
from varloom.operators import align, align_text, genotype, intervals, pileup, qc, reads, realign, recalibrate, support, variants
from varloom.plans import files
from varloom.plans.views import BASES, LETTERS, lengths, sql, table, view
from varloom.sources import bam, places, readers, regions, writers
from varloom.sources.shared import new_path, stored

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def _query(name: str, oracle: str | None = None, views: str = ""):
    def add(f: Callable) -> Callable:
        _QUERIES[name] = f
        if oracle:
            _SQL[name] = (("WITH RECURSIVE " if "RECURSIVE_" in oracle else "WITH ") + ", ".join(sql(v) for v in views.split()) + ("," if oracle.lstrip().startswith(",") else "") + oracle.lstrip().lstrip(",")).replace("RECURSIVE_", "") if views else oracle
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_REACH = "max(t_end) OVER (PARTITION BY t_id ORDER BY t_start, t_end, q_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@_query("A01_summary", "SELECT type AS key, count(*) AS num, CAST(sum(t_end - t_start + 1) AS BIGINT) AS len FROM intervals GROUP BY type", "intervals")
def _(spark, d):
    return variants.summary(view(spark, d, "intervals").withColumn("n", F.col("t_end") - F.col("t_start") + 1), "type", "n")


@_query("A02_vcf_summary", "SELECT '2.[VCF]' || type AS key, count(*) AS num, CAST(sum(greatest(t_end - t_start, q_end - q_start)) AS BIGINT) AS len FROM intervals GROUP BY type", "intervals")
def _(spark, d):
    return variants.vcf_summary(view(spark, d, "intervals"))


@_query("A03_interval_merge", f""", r AS (SELECT *, {_REACH} AS reach FROM intervals),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR t_start > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY t_id ORDER BY t_start, t_end, q_id ROWS UNBOUNDED PRECEDING) AS isl FROM r)
SELECT t_id, min(t_start) AS t_start, max(t_end) AS t_end, count(*) AS n FROM i GROUP BY t_id, isl""", "intervals")
def _(spark, d):
    return intervals.merge(view(spark, d, "intervals"), ["t_id"], "t_start", "t_end", 1)


@_query("A05_covered_length", f""", r AS (SELECT *, {_REACH} AS reach FROM intervals)
SELECT t_id, CAST(sum(greatest(0, t_end - greatest(t_start - 1, coalesce(reach, t_start - 1)))) AS BIGINT) AS covered FROM r GROUP BY t_id""", "intervals")
def _(spark, d):
    return intervals.covered_length(view(spark, d, "intervals"), ["t_id"], "t_start", "t_end")


_FURTHEST = """, r AS (SELECT *, max({'e': t_end, 's': -t_start, 'q': q_id}) OVER (PARTITION BY t_id ORDER BY t_start, t_end, q_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM intervals)"""


@_query("A06_scaffold_gaps", _FURTHEST + """ SELECT t_id, p.q AS left_id, q_id AS right_id, p.e + 1 AS gap_start, t_start - 1 AS gap_end, t_start - 1 - p.e AS length,
CASE WHEN t_start - 1 - p.e > 0 THEN 'InterGap' ELSE 'Overlap' END AS type FROM r WHERE p IS NOT NULL AND q_id <> p.q AND t_end > p.e""", "intervals")
def _(spark, d):
    return intervals.scaffold_gaps(view(spark, d, "intervals"))


@_query("A07_complement", f""", r AS (SELECT *, {_REACH} AS reach FROM intervals),
g AS (SELECT t_id, coalesce(reach, 0) + 1 AS s, t_start - 1 AS e FROM r UNION ALL SELECT t_id, max(t_end) + 1, max(t_end) + 7 FROM intervals GROUP BY t_id)
SELECT t_id, s AS "start", e AS "end", e - s + 1 AS length FROM g WHERE s <= e""", "intervals")
def _(spark, d):
    v = view(spark, d, "intervals")
    return intervals.complement(v, lengths(v, "t_id", "t_end", 7))


@_query("A08_clip_regions", """, h AS (SELECT q_id, min(q_start) AS lo, max(q_end) AS hi FROM intervals GROUP BY q_id)
SELECT q_id, 'head' AS side, CAST(1 AS BIGINT) AS "start", lo - 1 AS "end" FROM h WHERE lo > 1 UNION ALL SELECT q_id, 'tail', hi + 1, hi + 5 FROM h""", "intervals")
def _(spark, d):
    v = view(spark, d, "intervals")
    return intervals.clip_regions(v, lengths(v, "q_id", "q_end", 5))


@_query("A09_depth_runs", """, e AS (SELECT t_id, t_start AS pos, 1 AS d FROM intervals UNION ALL SELECT t_id, t_end + 1, -1 FROM intervals),
s AS (SELECT t_id, pos, sum(d) AS d FROM e GROUP BY t_id, pos HAVING sum(d) <> 0),
r AS (SELECT t_id, pos, sum(d) OVER (PARTITION BY t_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth, lead(pos) OVER (PARTITION BY t_id ORDER BY pos) AS nxt FROM s)
SELECT t_id, pos AS "start", nxt - 1 AS "end", CAST(depth AS BIGINT) AS depth FROM r WHERE depth > 0""", "intervals")
def _(spark, d):
    return intervals.depth_runs(view(spark, d, "intervals"), ["t_id"], "t_start", "t_end")


@_query("A09_per_base_depth", ", p AS (SELECT t_id, unnest(range(t_start, t_end + 1)) AS pos FROM intervals) SELECT t_id, pos, count(*) AS depth FROM p GROUP BY t_id, pos", "intervals")
def _(spark, d):
    return intervals.per_base(intervals.depth_runs(view(spark, d, "intervals"), ["t_id"], "t_start", "t_end"), ["t_id"])


@_query("A11_insert_sizes", """, r AS (SELECT o_orderpriority AS rg, CAST(l_quantity AS INT) * 10 AS insert_size, row_number() OVER (PARTITION BY o_orderpriority ORDER BY l_orderkey * 10 + l_linenumber) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT rg, ceil(avg(insert_size)) AS mean FROM r WHERE n <= 500 GROUP BY rg)
SELECT rg, CAST(mean AS BIGINT) AS mean, CAST(ceil(sqrt(avg((insert_size - mean) ** 2))) AS BIGINT) AS sd FROM r JOIN m USING (rg) WHERE n <= 500 GROUP BY rg, mean""", "points")
def _(spark, d):
    v = view(spark, d, "sites")
    return reads.insert_sizes(v.select(F.col("sample").alias("rg"), (F.col("size") * 10).cast("int").alias("insert_size"), "line_no"), 500)


@_query("A12_allele_support", """SELECT site, CAST(count(*) FILTER (r = 0 AND a <> 0) AS BIGINT) AS ref, CAST(count(*) FILTER (r <> 0 AND a = 0) AS BIGINT) AS alt, CAST(count(*) FILTER (r = 0 AND a = 0) AS BIGINT) AS both, CAST(count(*) FILTER (r <> 0 AND a <> 0) AS BIGINT) AS neither
FROM (SELECT site, size % 3 AS r, vq % 3 AS a FROM sites) GROUP BY site""", "sites")
def _(spark, d):
    return reads.allele_support(view(spark, d, "sites").select("site", (F.col("size") % 3).alias("ref_bad"), (F.col("vq") % 3).alias("alt_bad")))


_GT = "CASE WHEN rr + aa = 0 THEN './.' WHEN rr > 2 * aa THEN '0/0' WHEN aa > 2 * rr THEN '1/1' ELSE '0/1' END"


@_query("A13_allele_counts", f""", g AS (SELECT site, {_GT} AS gt FROM genotypes),
n AS (SELECT site, CAST(sum(CASE gt WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 ELSE 0 END) AS BIGINT) AS ac, count(*) FILTER (gt = '0/0') AS n_ref, count(*) FILTER (gt = '0/1') AS n_het, count(*) FILTER (gt = '1/1') AS n_hom FROM g GROUP BY site),
p AS (SELECT *, (2.0::DOUBLE * (n_ref + 1) + n_het + 1) / (2.0::DOUBLE * (n_ref + n_het + n_hom + 3)) AS p, n_ref + n_het + n_hom AS t FROM n)
SELECT site, ac, n_ref, n_het, n_hom, round(CASE WHEN t > 0 THEN 1.0::DOUBLE - n_het / (2.0::DOUBLE * p * (1.0::DOUBLE - p) * t) END, 6) AS inb_coeff, n_ref = t OR n_het = t OR n_hom = t AS false_genotype FROM p""", "genotypes")
def _(spark, d):
    g = view(spark, d, "genotypes").select("site", F.expr(_GT).alias("gt"))
    return genotype.allele_counts(g).withColumn("inb_coeff", F.round("inb_coeff", 6))


_PED = "(SELECT DISTINCT c.event_type AS child, f.event_type AS father, m.event_type AS mother FROM events c, events f, events m WHERE c.event_type = 'click' AND f.event_type = 'view' AND m.event_type = 'signup' LIMIT 1)"


@_query("A14_mendel", f""", g AS (SELECT site, sample, {_GT} AS gt FROM genotypes WHERE rr + aa > 0),
t AS (SELECT c.site, c.gt AS c, least(f.gt, m.gt) AS a, greatest(f.gt, m.gt) AS b FROM g c JOIN g f ON c.site = f.site AND f.sample = 'view' JOIN g m ON c.site = m.site AND m.sample = 'signup' WHERE c.sample = 'click'),
v AS (SELECT CASE a || '+' || b WHEN '0/0+0/0' THEN c = '0/0' WHEN '1/1+1/1' THEN c = '1/1' WHEN '0/1+0/1' THEN true WHEN '0/1+1/1' THEN c <> '0/0' WHEN '0/0+0/1' THEN c <> '1/1' ELSE c = '0/1' END AS fits FROM t)
SELECT count(*) FILTER (fits) AS matches, count(*) FILTER (NOT fits) AS violations, count(*) AS trios FROM v""", "genotypes")
def _(spark, d):
    g = view(spark, d, "genotypes").select("site", "sample", F.expr(_GT).alias("gt"))
    ped = spark.createDataFrame([("click", "view", "signup")], "child string, father string, mother string")
    return genotype.mendel_summary(genotype.mendel(g, ped))


@_query("A15_run_summary", f""", g AS (SELECT {_GT} AS gt, CAST(rr + aa AS INT) AS gq FROM genotypes)
SELECT count(*) FILTER (gt <> './.') AS called, count(*) FILTER (gq >= 10) AS gq10, count(*) FILTER (gq >= 20) AS gq20, count(*) FILTER (gq >= 30) AS gq30,
round(count(*) FILTER (gt = '0/0') / count(*) FILTER (gt <> './.'), 6) AS ref_ratio, round(count(*) FILTER (gt = '0/1') / count(*) FILTER (gt <> './.'), 6) AS het_ratio, round(count(*) FILTER (gt = '1/1') / count(*) FILTER (gt <> './.'), 6) AS hom_ratio FROM g""", "genotypes")
def _(spark, d):
    return genotype.run_summary(view(spark, d, "genotypes").select(F.expr(_GT).alias("gt"), (F.col("rr") + F.col("aa")).alias("gq")))


@_query("A16_site_medians", "SELECT site, median(size) AS size, median(vq) AS vq, median(nr) AS nr FROM sites GROUP BY site", "sites")
def _(spark, d):
    return recalibrate.site_medians(view(spark, d, "sites"), ["size", "vq", "nr"])


@_query("A17_normalised", "SELECT line_no, round((size - (SELECT avg(size) FROM sites)) / (SELECT stddev_pop(size) FROM sites), 6) AS z_size, round((vq - (SELECT avg(vq) FROM sites)) / (SELECT stddev_pop(vq) FROM sites), 6) AS z_vq FROM sites", "sites")
def _(spark, d):
    return recalibrate.normalised(view(spark, d, "sites"), ["size", "vq"])[0].select("line_no", F.round("z_size", 6).alias("z_size"), F.round("z_vq", 6).alias("z_vq"))


@_query("A19_feature_summary", "SELECT round(avg(vq), 6) AS mean, round(stddev_pop(vq), 6) AS std, median(vq) AS median, quantile_cont(vq, 0.25) AS q25, quantile_cont(vq, 0.5) AS q50, quantile_cont(vq, 0.75) AS q75 FROM sites", "sites")
def _(spark, d):
    return recalibrate.feature_summary(view(spark, d, "sites"), "vq").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@_query("A20_sample_scores", """, m AS (SELECT sample, avg(vq) FILTER (vq <> 0) AS m, stddev_pop(vq) FILTER (vq <> 0) AS s FROM sites GROUP BY sample)
SELECT line_no, round((vq - m) / nullif(s, 0), 6) AS z FROM sites JOIN m USING (sample)""", "sites")
def _(spark, d):
    return recalibrate.sample_scores(view(spark, d, "sites"), ["vq"]).select("line_no", F.round("z_vq", 6).alias("z"))


@_query("A21_cumulative", "SELECT vq, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY vq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM sites GROUP BY vq", "sites")
def _(spark, d):
    return qc.cumulative(view(spark, d, "sites"), "vq")


@_query("A21_cumulative_down", "SELECT vq, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY vq DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM sites GROUP BY vq", "sites")
def _(spark, d):
    return qc.cumulative(view(spark, d, "sites"), "vq", descending=True)


@_query("A22_mapping_quality", "SELECT t_id AS site, round(-10 * log10(1 - sum(score) FILTER (score > 0) / sum(score / (1 - mismap)) FILTER (score > 0)), 4) AS phred FROM intervals WHERE mismap > 0 GROUP BY t_id", "intervals")
def _(spark, d):
    rows = view(spark, d, "intervals").where("mismap > 0").select(F.col("t_id").alias("site"), "score", "mismap")
    return recalibrate.combined_mapping_quality(rows).withColumn("phred", F.round("phred", 4))


@_query("A23_numeric_spectrum", """SELECT coalesce(sample, '~Population') AS sample, coalesce(type, '0.Total') AS type, count(*) AS num, CAST(sum(size) AS BIGINT) AS len, min(size) AS min, max(size) AS max, printf('%.2f', avg(size)) AS mean
FROM sites WHERE type <> '9.REF' GROUP BY GROUPING SETS ((sample, type), (sample), (type), ())""", "sites")
def _(spark, d):
    return qc.numeric_spectrum(view(spark, d, "sites"))


@_query("A24_size_spectrum", """, b AS (SELECT sample, type, CASE WHEN size <= 0 THEN '0-0' ELSE CAST((CAST(ceil(size / 10) AS BIGINT) - 1) * 10 + 1 AS VARCHAR) || '-' || CAST(CAST(ceil(size / 10) AS BIGINT) * 10 AS VARCHAR) END AS bin FROM sites WHERE type NOT IN ('9.REF', '4.SNP'))
SELECT sample, coalesce(type, '0.ALLSV') AS type, bin, count(*) AS num FROM b GROUP BY GROUPING SETS ((sample, type, bin), (sample, bin))""", "sites")
def _(spark, d):
    return qc.size_spectrum(view(spark, d, "sites"), lambda c: S.size_bin(c, 10))


@_query("A24_size_report", """SELECT sample, type, count(*) FILTER (size BETWEEN 1 AND 10) AS "1-10", count(*) FILTER (size BETWEEN 11 AND 20) AS "11-20", count(*) FILTER (size BETWEEN 21 AND 30) AS "21-30", count(*) FILTER (size BETWEEN 31 AND 40) AS "31-40", count(*) FILTER (size BETWEEN 41 AND 50) AS "41-50"
FROM (SELECT sample, type, size FROM sites UNION ALL SELECT sample, '0.ALLSV', size FROM sites WHERE type NOT IN ('9.REF', '4.SNP')) WHERE type NOT IN ('9.REF', '4.SNP') GROUP BY sample, type""", "sites")
def _(spark, d):
    return qc.size_report(qc.size_spectrum(view(spark, d, "sites"), lambda c: S.size_bin(c, 10)), ["1-10", "11-20", "21-30", "31-40", "41-50"])


@_query("A25_vote", """, n AS (SELECT site, type, count(*) AS votes FROM sites GROUP BY site, type)
SELECT site, type, votes FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY votes DESC, type) AS r FROM n) WHERE r = 1""", "sites")
def _(spark, d):
    return qc.vote(view(spark, d, "sites"), ["type"])


@_query("A26_vote_alleles", """, n AS (SELECT site, type, size, count(*) AS votes FROM sites GROUP BY site, type, size)
SELECT site, type, size, votes FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY votes DESC, type, size) AS r FROM n) WHERE r = 1""", "sites")
def _(spark, d):
    return qc.vote(view(spark, d, "sites"), ["type", "size"])


@_query("A27_best_call", """, r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY nr, CASE WHEN type IN ('1.INS', '2.DEL') THEN 0 ELSE 3 END, size, line_no) AS k, count(*) OVER (PARTITION BY site) AS samples FROM sites)
SELECT site, type, nr, size, line_no AS sample_ord, samples FROM r WHERE k = 1""", "sites")
def _(spark, d):
    return qc.best_call(view(spark, d, "sites").select("site", "type", "nr", "size", F.col("line_no").alias("sample_ord")))


# Chains as a recursive walk over the sites that are not marked: state = chain (the number of the site that began it), its N ratio and reach.
_CHAINS = """, RECURSIVE_ s AS (SELECT chrom, "start", "start" + size % 4 AS "end", nr, vq, line_no, CASE WHEN nr * 6 > 0.5 OR inb <= -0.7 OR inb >= 0.7 THEN -1 ELSE 1 END AS mark FROM sites),
o AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY "start", line_no, "end", nr, vq) AS i FROM s WHERE mark <> -1),
w AS (SELECT chrom, i, i AS chain, CAST(NULL AS BIGINT) AS was, nr, "end" AS reach, 'new' AS act FROM o WHERE i = 1
UNION ALL SELECT chrom, i, CASE WHEN act IN ('new', 'evict') THEN i ELSE was END, was, CASE WHEN act IN ('new', 'evict') THEN own ELSE nr END, CASE act WHEN 'drop' THEN reach WHEN 'join' THEN greatest(reach, "end") ELSE "end" END, act FROM (
SELECT c.chrom, c.i, w.chain AS was, w.nr, c.nr AS own, w.reach, c."end", CASE WHEN w.reach + 20 < c."start" THEN 'new' WHEN c.nr < w.nr THEN 'evict' WHEN c.nr = w.nr THEN 'join' ELSE 'drop' END AS act FROM w JOIN o c ON c.chrom = w.chrom AND c.i = w.i + 1)),
m AS (SELECT w.chrom, w.i, row_number() OVER (PARTITION BY w.chrom, w.chain ORDER BY o.vq DESC, o.i) AS r, w.chain FROM w JOIN o ON o.chrom = w.chrom AND o.i = w.i WHERE act <> 'drop'),
best AS (SELECT chrom, i FROM m WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM w WHERE w.chrom = m.chrom AND w.act = 'evict' AND w.was = m.chain))
SELECT chrom, line_no, CAST(-1 AS INT) AS final FROM s WHERE mark = -1 UNION ALL SELECT o.chrom, line_no, CAST(CASE WHEN best.i IS NULL THEN -2 ELSE 1 END AS INT) FROM o LEFT JOIN best ON best.chrom = o.chrom AND best.i = o.i"""


@_query("A28_near_duplicates", _CHAINS, "sites")
def _(spark, d):
    v = view(spark, d, "sites").withColumn("mark", qc.bad_mark(F.col("nr") * 6, F.col("inb")))
    return qc.near_duplicates(v.select("chrom", "start", F.expr("`start` + size % 4").alias("end"), "nr", "vq", "mark", "line_no"))


@_query("A30_filter_counts", """SELECT filter, count(*) AS n, printf('%.3f', count(*) / (SELECT count(*) FROM sites)) AS ratio FROM sites GROUP BY filter""", "sites")
def _(spark, d):
    return qc.filter_counts(view(spark, d, "sites"))


_NEAR = "count(*) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 60 PRECEDING AND 60 FOLLOWING)"


@_query("A31_neighbours", f"SELECT event_id, {_NEAR} AS n FROM points", "points")
def _(spark, d):
    return intervals.neighbours(view(spark, d, "points"), "chrom", "pos", 60).select("event_id", "n")


@_query("A31_spectrum", f", c AS (SELECT {_NEAR} AS n FROM points) SELECT n, count(*) AS sites FROM c GROUP BY n", "points")
def _(spark, d):
    return intervals.spectrum(intervals.neighbours(view(spark, d, "points"), "chrom", "pos", 60))


_READS = "SELECT l_orderkey AS name_no, CAST((l_partkey * 7 + l_linenumber) % 2048 AS INT) AS flag, CAST(l_suppkey % 20 AS VARCHAR) AS ref, CAST(l_partkey % 20 AS VARCHAR) AS mate_ref, CAST(l_partkey % 5000 + 1 AS BIGINT) AS pos, CAST(l_orderkey % 5000 + 1 AS BIGINT) AS mate_pos, CAST(l_quantity * 10 - 100 AS INT) AS insert_size, CAST(l_linenumber * 10 AS INT) AS mapq, l_returnflag AS rg FROM lineitem"


def _reads(spark, d):
    return spark.sql(_READS.replace("VARCHAR", "STRING").replace("FROM lineitem", "FROM {t}"), t=table(spark, d, "lineitem"))


_BIT = lambda b: f"(flag & {b}) <> 0"


@_query("A32_flag_statistics", f"""WITH r AS ({_READS}) SELECT count(*) AS total, count(*) FILTER (NOT {_BIT(4)}) AS mapped, count(*) FILTER (NOT {_BIT(16)}) AS forward, count(*) FILTER ({_BIT(16)}) AS reverse, count(*) FILTER ({_BIT(512)}) AS failed,
count(*) FILTER ({_BIT(1024)}) AS duplicates, count(*) FILTER ({_BIT(1)}) AS paired, count(*) FILTER ({_BIT(1)} AND {_BIT(2)}) AS proper, count(*) FILTER ({_BIT(1)} AND NOT {_BIT(4)} AND NOT {_BIT(8)}) AS both_mapped,
count(*) FILTER ({_BIT(1)} AND {_BIT(64)}) AS read1, count(*) FILTER ({_BIT(1)} AND {_BIT(128)}) AS read2, count(*) FILTER ({_BIT(1)} AND NOT {_BIT(4)} AND {_BIT(8)}) AS singletons,
round(avg(abs(insert_size)) FILTER ({_BIT(1)} AND {_BIT(64)} AND NOT {_BIT(4)} AND NOT {_BIT(8)} AND ref = mate_ref), 6) AS mean_insert,
median(abs(insert_size)) FILTER ({_BIT(1)} AND {_BIT(64)} AND NOT {_BIT(4)} AND NOT {_BIT(8)} AND ref = mate_ref) AS median_insert FROM r""")
def _(spark, d):
    return reads.flag_statistics(_reads(spark, d)).withColumn("mean_insert", F.round("mean_insert", 6))


@_query("A36_model_statistics", f"""WITH r AS (SELECT *, CASE WHEN ref <> mate_ref THEN 'DIFF_CHROM' ELSE 'ONE' END AS model, abs(insert_size) AS size FROM ({_READS})),
o AS (SELECT rg, model, size, row_number() OVER (PARTITION BY rg, model ORDER BY size) - 1 AS i, count(*) OVER (PARTITION BY rg, model) AS total FROM r)
SELECT rg, model, total, max(size) FILTER (i = CAST(floor(total * 0.05) AS BIGINT)) AS low, max(size) FILTER (i = CAST(floor(total * 0.5) AS BIGINT)) AS median, max(size) FILTER (i = CAST(floor(total * 0.95) AS BIGINT)) AS high,
CAST(row_number() OVER (PARTITION BY rg ORDER BY total DESC, model) AS INT) AS rank FROM o GROUP BY rg, model, total""")
def _(spark, d):
    return reads.model_statistics(_reads(spark, d).withColumn("model", F.when(F.col("ref") != F.col("mate_ref"), "DIFF_CHROM").otherwise("ONE")), 0.1)


@_query("A37_first_arrivals", """SELECT t_id, t_start, t_end, type, q_id, line_no FROM (SELECT *, row_number() OVER (PARTITION BY t_id, t_start, t_end, type ORDER BY q_id, line_no) AS r FROM intervals) WHERE r = 1""", "intervals")
def _(spark, d):
    v = view(spark, d, "intervals").select("t_id", "t_start", "t_end", "type", "q_id", "line_no")
    return variants.first_arrivals(v, ["t_id", "t_start", "t_end", "type"], ["q_id", "line_no"])


@_query("A38_single_hits", "SELECT t_id, q_id, t_start, line_no FROM (SELECT *, count(*) OVER (PARTITION BY t_id, q_id, t_start) AS n FROM intervals) WHERE n = 1", "intervals")
def _(spark, d):
    return variants.single_hits(view(spark, d, "intervals")).select("t_id", "q_id", "t_start", "line_no")


@_query("A39_first_sites", "SELECT chrom, pos, min(event_id) AS event_id FROM points GROUP BY chrom, pos", "points")
def _(spark, d):
    return variants.first_arrivals(view(spark, d, "points").select("chrom", "pos", "event_id"), ["chrom", "pos"], ["event_id"])


@_query("J02_nomadic", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def _(spark, d):
    hit = table(spark, d, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("q_id"))
    return variants.nomadic(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), hit)


@_query("J03_overlap_anti", """SELECT t_id, q_id, t_start, line_no FROM intervals a WHERE type <> 'SNP' AND NOT EXISTS (SELECT 1 FROM intervals b WHERE b.type = 'SNP' AND b.t_id = a.t_id AND a.t_start <= b.t_end AND a.t_end >= b.t_start)""", "intervals")
def _(spark, d):
    v = view(spark, d, "intervals")
    out = intervals.interval_join(v.where("type != 'SNP'"), v.where("type = 'SNP'"), "t_id", ("t_start", "t_end"), ("t_start", "t_end"), bits=5, how="left_anti")
    return out.select("t_id", "q_id", "t_start", "line_no")


@_query("J04_contained", """SELECT DISTINCT a.t_id, a.q_id, a.t_start, a.t_end FROM intervals a WHERE a.type = 'INS' AND EXISTS (SELECT 1 FROM intervals b WHERE b.type = 'DEL' AND b.t_id = a.t_id AND b.q_id <> a.q_id AND b.t_start <= a.t_start AND a.t_end <= b.t_end)""", "intervals")
def _(spark, d):
    v = view(spark, d, "intervals").select("t_id", "q_id", "t_start", "t_end", "type")
    return intervals.contained(v.where("type = 'INS'").drop("type"), v.where("type = 'DEL'").drop("type"))


@_query("J05_points_in", """, p AS (SELECT chrom % 100 + 1 AS t_id, 8000 + pos % 2600 AS pos, event_id FROM points) SELECT event_id, count(*) AS n FROM p JOIN intervals i ON p.t_id = i.t_id AND p.pos BETWEEN i.t_start AND i.t_end GROUP BY event_id""", "points intervals")
def _(spark, d):
    p = view(spark, d, "points").select((F.col("chrom") % 100 + 1).alias("t_id"), (8000 + F.col("pos") % 2600).alias("pos"), "event_id")
    hit = intervals.points_in(p, view(spark, d, "intervals").select("t_id", "t_start", "t_end"), "t_id", "pos", "t_start", "t_end", bits=6)
    return hit.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@_query("J07_first_at_or_after", """, a AS (SELECT event_id, chrom, pos + 7 AS pos FROM points WHERE event_type = 'error'), b AS (SELECT chrom, pos AS hit, event_id AS v FROM points WHERE event_type = 'view'),
h AS (SELECT DISTINCT chrom, pos FROM a), m AS (SELECT h.chrom, h.pos, min(hit) AS hit FROM h LEFT JOIN b ON b.chrom = h.chrom AND b.hit >= h.pos GROUP BY h.chrom, h.pos)
SELECT m.chrom, m.pos, m.hit, min(v) AS v FROM m LEFT JOIN b ON b.chrom = m.chrom AND b.hit = m.hit GROUP BY m.chrom, m.pos, m.hit""", "points")
def _(spark, d):
    p = view(spark, d, "points")
    a = p.where("event_type = 'error'").select("chrom", (F.col("pos") + 7).alias("pos")).distinct()
    return intervals.first_at_or_after(a, p.where("event_type = 'view'").select("chrom", F.col("pos").alias("hit"), F.col("event_id").alias("v")), "chrom", "pos", "hit", "v")


@_query("J08_training_flag", "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS training FROM orders")
def _(spark, d):
    good = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return support.marked(table(spark, d, "orders"), good, ["o_custkey"], "training").select("o_orderkey", "training")


@_query("J15_merge_best", """WITH f AS (SELECT o_custkey AS chrom, o_orderkey AS pos, 0 AS file_no, o_totalprice AS qual, o_orderstatus AS info FROM orders UNION ALL SELECT o_custkey, o_orderkey, 1, o_totalprice + (o_orderkey % 3 - 1) * 10, o_orderpriority FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY qual DESC, file_no) AS k FROM f) SELECT chrom, pos, 0 AS file_no, qual, info FROM r WHERE k = 1""")
def _(spark, d):
    t = table(spark, d, "orders")
    one = t.select(F.col("o_custkey").alias("chrom"), F.col("o_orderkey").alias("pos"), F.lit(0).alias("file_no"), F.col("o_totalprice").alias("qual"), F.col("o_orderstatus").alias("info"))
    two = t.select(F.col("o_custkey").alias("chrom"), F.col("o_orderkey").alias("pos"), F.lit(1).alias("file_no"), (F.col("o_totalprice") + (F.col("o_orderkey") % 3 - 1) * 10).alias("qual"), F.col("o_orderpriority").alias("info"))
    return qc.merge_best(one.unionByName(two)).select("chrom", "pos", "file_no", "qual", "info")


@_query("W02_neighbour_ranks", """, o AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY t_id, t_start, q_start) AS ord FROM intervals)
SELECT q_id, line_no, CAST(ord AS INT) AS ord, CAST(ord - lag(ord) OVER (PARTITION BY q_id ORDER BY q_start, t_id, t_start) AS INT) AS step FROM o""", "intervals")
def _(spark, d):
    return variants.neighbour_ranks(view(spark, d, "intervals")).select("q_id", "line_no", "ord", "step")


@_query("W08_roc", """, n AS (SELECT vq, sum(CASE WHEN filter = 'PASS' THEN 1 ELSE 0 END) AS p, sum(CASE WHEN filter = 'PASS' THEN 0 ELSE 1 END) AS f FROM sites GROUP BY vq),
c AS (SELECT vq, p, f, sum(p) OVER (ORDER BY vq DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(f) OVER (ORDER BY vq DESC ROWS UNBOUNDED PRECEDING) AS fp, sum(p) OVER () AS pp, sum(f) OVER () AS ff FROM n)
SELECT vq AS threshold, round(tp / pp, 9) AS tpr, round(fp / ff, 9) AS fpr, round((f / ff) * (2 * tp - p) / pp / 2, 9) AS area FROM c""", "sites")
def _(spark, d):
    out = recalibrate.roc(view(spark, d, "sites").withColumn("y", F.col("filter") == "PASS"), "vq", "y")
    return out.select("threshold", *[F.round(c, 9).alias(c) for c in ("tpr", "fpr", "area")])


_COLS = """, c AS (SELECT t_id, q_id, t_start, q_start, t_seq, q_seq, unnest(range(1, length(t_seq) + 1)) AS i FROM aligned),
w AS (SELECT t_id, q_id, i - 1 AS col, substr(t_seq, i, 1) AS t_base, substr(q_seq, i, 1) AS q_base, t_start - 1 + length(replace(substr(t_seq, 1, i), '-', '')) AS t_pos, q_start - 1 + length(replace(substr(q_seq, 1, i), '-', '')) AS q_pos FROM c)"""


@_query("P04_walk", _COLS + " SELECT q_id, CAST(col AS INT) AS col, t_pos, q_pos, t_base, q_base FROM w", "aligned")
def _(spark, d):
    return variants.walk(view(spark, d, "aligned")).select("q_id", "col", "t_pos", "q_pos", "t_base", "q_base")


@_query("P05_snps", _COLS + " SELECT q_id, t_pos, q_pos, t_base, q_base FROM w WHERE t_base NOT IN ('-', 'N') AND q_base NOT IN ('-', 'N') AND t_base <> q_base", "aligned")
def _(spark, d):
    return variants.snps(variants.walk(view(spark, d, "aligned"), "snps")).select("q_id", "t_pos", "q_pos", "t_base", "q_base")


def _pair_runs(cond: str) -> str:
    return _COLS + f""", m AS (SELECT * FROM w WHERE {cond}), f AS (SELECT *, CASE WHEN t_pos <= lag(t_pos) OVER o + 1 AND q_pos <= lag(q_pos) OVER o + 1 THEN 0 ELSE 1 END AS new FROM m WINDOW o AS (PARTITION BY t_id, q_id ORDER BY t_pos)),
g AS (SELECT *, sum(new) OVER (PARTITION BY t_id, q_id ORDER BY t_pos ROWS UNBOUNDED PRECEDING) AS isl FROM f)
SELECT t_id, q_id, min(t_pos) AS t_start, max(t_pos) AS t_end, min(q_pos) AS q_start, max(q_pos) AS q_end FROM g GROUP BY t_id, q_id, isl"""


@_query("P06_n_calls", _pair_runs("(t_base = 'N' OR q_base = 'N') AND t_base <> '-' AND q_base <> '-'"), "aligned")
def _(spark, d):
    return variants.called_runs(view(spark, d, "aligned"), "n", view(spark, d, "aligned", False).select("t_id", "q_id"))


@_query("P07_reference_calls", _pair_runs("t_base = q_base AND t_base NOT IN ('-', 'N')"), "aligned")
def _(spark, d):
    return variants.called_runs(view(spark, d, "aligned"), "same", view(spark, d, "aligned", False).select("t_id", "q_id"))


@_query("P08_insertions", _COLS + """, g AS (SELECT *, col - row_number() OVER (PARTITION BY q_id ORDER BY col) AS run FROM w WHERE t_base = '-')
SELECT q_id, min(t_pos) AS anchor, min(q_pos) FILTER (q_base <> '-') AS first, max(q_pos) FILTER (q_base <> '-') AS last FROM g GROUP BY q_id, run HAVING count(*) FILTER (q_base <> '-') > 0""", "aligned")
def _(spark, d):
    return variants.gap_runs(view(spark, d, "aligned")).select("q_id", "anchor", "first", "last")


@_query("P08_deletions", _COLS + """, g AS (SELECT *, col - row_number() OVER (PARTITION BY q_id ORDER BY col) AS run FROM w WHERE q_base = '-')
SELECT q_id, min(q_pos) AS anchor, min(t_pos) FILTER (t_base <> '-') AS first, max(t_pos) FILTER (t_base <> '-') AS last FROM g GROUP BY q_id, run HAVING count(*) FILTER (t_base <> '-') > 0""", "aligned")
def _(spark, d):
    return variants.gap_runs(view(spark, d, "aligned"), "q_seq", "t_seq", "q_start", "t_start").select("q_id", "anchor", "first", "last")


@_query("S04_drop_double_gaps", _COLS + """ SELECT q_id, string_agg(t_base, '' ORDER BY col) AS t_seq, string_agg(q_base, '' ORDER BY col) AS q_seq FROM w WHERE NOT (t_base = '-' AND q_base = '-') GROUP BY q_id""", "aligned")
def _(spark, d):
    return variants.drop_double_gaps(view(spark, d, "aligned")).select("q_id", "t_seq", "q_seq")


@_query("P01_flip", "SELECT q_id, line_no, 2000 - q_end + 1 AS lo, 2000 - q_start + 1 AS hi FROM intervals WHERE strand = '-'", "intervals")
def _(spark, d):
    lo, hi = S.flip("q_start", "q_end", F.lit(2000))
    return view(spark, d, "intervals").where("strand = '-'").select("q_id", "line_no", lo.alias("lo"), hi.alias("hi"))


@_query("P02_swap", "SELECT q_id AS t_id, t_id AS q_id, q_start AS t_start, t_start AS q_start FROM intervals", "intervals")
def _(spark, d):
    return variants.swap(view(spark, d, "intervals").select("t_id", "q_id", "t_start", "q_start"))


@_query("P10_pair_gap", """, p AS (SELECT a.q_id, a.t_start AS s1, a.t_end AS e1, b.t_start AS s2, b.t_end AS e2, a.q_start AS u1, a.q_end AS v1, b.q_start AS u2, b.q_end AS v2, least(a.score, b.score) AS score FROM intervals a JOIN intervals b ON a.q_id = b.q_id AND b.line_no = a.line_no + 1),
e AS (SELECT *, CASE WHEN s1 <= s2 THEN e1 ELSE e2 END AS te, greatest(s1, s2) AS ts, CASE WHEN u1 <= u2 THEN v1 ELSE v2 END AS qe, greatest(u1, u2) AS qs FROM p)
SELECT q_id, least(te, ts) AS t_gap_start, greatest(te, ts) AS t_gap_end, least(qe, qs) AS q_gap_start, greatest(qe, qs) AS q_gap_end, score,
CASE WHEN te >= ts AND qe >= qs THEN 'gap-X1' WHEN qe >= qs THEN 'gap-X2' WHEN te >= ts THEN 'gap-1' ELSE 'gap-2' END AS type FROM e""", "intervals")
def _(spark, d):
    v = view(spark, d, "intervals").drop("type", "strand", "t_id")
    a, b = (v.select("q_id", *[F.col(c).alias(f"{c}_{s}") for c in v.columns if c != "q_id"]) for s in "ab")
    rows = a.join(b, "q_id").where("line_no_b = line_no_a + 1")
    return variants.pair_gap(rows).select("q_id", "t_gap_start", "t_gap_end", "q_gap_start", "q_gap_end", "score", "type")


@_query("P11_flank", "SELECT t_id, q_id, line_no, greatest(1, t_start - 9000) AS lo, least(10000, t_end + 500) AS hi FROM intervals", "intervals")
def _(spark, d):
    v = view(spark, d, "intervals").withColumn("len", F.lit(10000).cast("long"))
    lo, hi = variants.flank("t_start", "t_end", "len", 9000)[0], variants.flank("t_start", "t_end", "len", 500)[1]
    return v.select("t_id", "q_id", "line_no", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


@_query("P14_excised_type", """SELECT line_no, q_id, CASE WHEN a > 0 AND b = 0 THEN 'DEL' WHEN a = 0 AND b > 0 THEN 'INS' WHEN a = 1 AND b = 1 THEN 'SNP' WHEN a = b AND a > 0 THEN 'MNP' WHEN a > 0 AND b > 0 THEN 'REPLACEMENT' ELSE 'REFCALL' END AS type
FROM (SELECT line_no, q_id, t_start % 4 AS a, q_start % 4 AS b FROM intervals)""", "intervals")
def _(spark, d):
    return view(spark, d, "intervals").select("line_no", "q_id", variants.excised_type(F.col("t_start") % 4, F.col("q_start") % 4).alias("type"))


@_query("P17_vcf_call", """SELECT q_id, line_no, CASE WHEN type = 'INS' AND score % 2 = 0 THEN 'AGEFALSE' ELSE '.' END AS filter, CASE WHEN line_no = 1 THEN '0/1' ELSE '1/1' END AS gt FROM intervals""", "intervals")
def _(spark, d):
    v = view(spark, d, "intervals").withColumns({"is_success_align": F.col("type") == "INS", "is_good_realign": F.col("score") % 2 != 0, "is_hete": F.col("line_no") == 1})
    return variants.vcf_call(v).select("q_id", "line_no", "filter", "gt")


@_query("P24_reference_ratio", "SELECT site, sample, CASE WHEN rr + aa > 0 THEN rr / (rr + aa) ELSE 1.0 END AS ratio, rr + aa > 0 AS informative FROM genotypes", "genotypes")
def _(spark, d):
    return genotype.reference_ratio(view(spark, d, "genotypes")).select("site", "sample", "ratio", "informative")


@_query("P25_add_filter", "SELECT line_no, CASE WHEN filter IN ('.', 'PASS') THEN 'FALSE_GENOTYPE' ELSE 'FALSE_GENOTYPE;' || filter END AS filter FROM sites", "sites")
def _(spark, d):
    return view(spark, d, "sites").select("line_no", genotype.add_filter(F.col("filter")).alias("filter"))


@_query("P26_callable_sites", "SELECT site, sample, count(*) OVER (PARTITION BY site) >= 5 OR count(*) FILTER (rr + aa = 0) OVER (PARTITION BY site) = 0 AS callable FROM genotypes", "genotypes")
def _(spark, d):
    return genotype.callable_sites(genotype.reference_ratio(view(spark, d, "genotypes")), 5).select("site", "sample", "callable")


@_query("P29_size_type", """SELECT p_partkey, CASE WHEN p_type LIKE '%INV%' THEN '5.INV' WHEN p_brand = p_name THEN '9.REF' WHEN length(p_name) > length(p_brand) THEN '1.INS' WHEN length(p_name) < length(p_brand) THEN '2.DEL' WHEN length(p_brand) = 1 THEN '4.SNP' ELSE '3.MNP' END AS type,
CAST(CASE WHEN length(p_name) = length(p_brand) THEN length(p_brand) ELSE abs(length(p_name) - length(p_brand)) END AS INT) AS size FROM part""")
def _(spark, d):
    kind, size = variants.size_type(F.col("p_brand"), F.col("p_name"), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", kind.alias("type"), size.alias("size"))


@_query("P35_info_value", """SELECT event_id, nullif(regexp_extract(i, '(?:^|;)AC=([^;]*)', 1), '') AS ac, regexp_matches(i, '(?:^|;)NEG') AS neg FROM (SELECT event_id, 'X=1;AC=' || CAST(user_id AS VARCHAR) || CASE WHEN event_type = 'error' THEN ';NEG' ELSE '' END AS i FROM events)""")
def _(spark, d):
    t = table(spark, d, "events").withColumn("i", F.concat(F.lit("X=1;AC="), "user_id", F.when(F.col("event_type") == "error", ";NEG").otherwise("")))
    return t.select("event_id", S.info_value("i", "AC").alias("ac"), S.info_flag("i", "NEG").alias("neg"))


@_query("P36_clear_alleles", _COLS + """, a AS (SELECT q_id, CAST(col AS INT) AS col, translate(upper(t_base), 'WSKMYRVDBH', 'ACTACAAATA') AS ref, translate(upper(q_base), 'WSKMYRVDBH', 'ACTACAAATA') AS alt FROM w) SELECT * FROM a WHERE ref <> alt""", "aligned")
def _(spark, d):
    v = variants.walk(view(spark, d, "aligned"), "clear").select("q_id", "col", S.iupac_alt(F.upper("t_base")).alias("ref"), S.iupac_alt(F.upper("q_base")).alias("alt"))
    return v.where("ref != alt")


@_query("P37_39_filter_decision", """, m AS (SELECT line_no, vq, filter, CASE WHEN nr * 6 > 0.5 OR inb <= -0.7 OR inb >= 0.7 THEN -1 WHEN size % 5 = 0 THEN -2 ELSE 1 END AS mark, CASE WHEN "end" - "start" < 10 THEN "start" - 5 ELSE "start" END AS lo, CASE WHEN "end" - "start" < 10 THEN "end" + 5 ELSE "end" END AS hi FROM sites)
SELECT line_no, CASE WHEN lo < 0 THEN 1 ELSE lo END AS lo, hi, CASE WHEN mark = -1 THEN 'FALSE' WHEN mark = -2 AND vq >= 30 THEN CASE WHEN filter IN ('.', 'PASS') THEN 'DUPLIC' ELSE 'DUPLIC;' || filter END WHEN vq >= 30 THEN 'PASS' ELSE 'q30' END AS filter FROM m""", "sites")
def _(spark, d):
    v = view(spark, d, "sites").withColumn("mark", qc.bad_mark(F.col("nr") * 6, F.col("inb")))
    v = v.withColumn("mark", F.when((F.col("mark") == 1) & (F.col("size") % 5 == 0), -2).otherwise(F.col("mark")))
    lo, hi = qc.pad_small(F.col("start"), F.col("end"))
    return v.select("line_no", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), qc.filter_decision(F.col("mark"), F.col("vq"), 30, F.col("filter")).alias("filter"))


@_query("P41_orientation", f"""WITH r AS ({_READS}) SELECT CASE WHEN NOT {_BIT(1)} OR {_BIT(8)} THEN 'UNPAIRED' WHEN ref <> mate_ref THEN 'DIFF_CHROM' WHEN ({_BIT(16)}) = ({_BIT(32)}) THEN 'SAME'
WHEN CASE WHEN {_BIT(16)} THEN mate_pos ELSE pos END <= CASE WHEN {_BIT(16)} THEN pos ELSE mate_pos END THEN 'INNER' ELSE 'OUTTER' END AS orientation, count(*) AS n FROM r GROUP BY 1""")
def _(spark, d):
    r = _reads(spark, d)
    return r.select(reads.orientation(r).alias("orientation")).groupBy("orientation").agg(F.count(F.lit(1)).alias("n"))


_CIGAR = "concat(l_linenumber, 'S', CAST(l_quantity AS INT), 'M', l_linenumber, 'D3M2I', l_linenumber, 'M')"


@_query("P43_56_cigar", """SELECT l_orderkey, l_linenumber, 100 + q + k + 3 + k - 1 AS last, 100 + q AS del_start, 100 + q + k - 1 AS del_end, 100 + q + k + 2 AS ins_at, CAST(99 AS BIGINT) AS clip, CAST(k + 5 AS BIGINT) AS read_pos
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS k FROM lineitem WHERE l_quantity > 6)""")
def _(spark, d):
    t = table(spark, d, "lineitem").where("l_quantity > 6").withColumn("pos", F.lit(100).cast("long")).withColumn("cigar", reads.parse_cigar(F.expr(_CIGAR)))
    t = t.withColumn("x", reads.indel_spans(F.col("pos"), F.col("cigar")))
    return t.select(
        "l_orderkey", "l_linenumber", reads.alignment_end(F.col("pos"), F.col("cigar")).cast("long").alias("last"), F.get("x", 0)["start"].alias("del_start"), F.get("x", 0)["end"].alias("del_end"),
        F.get("x", 1)["start"].alias("ins_at"), reads.clip_edges(F.col("pos"), F.col("cigar"))[0].alias("clip"), reads.query_position(F.col("pos"), F.col("cigar"), F.lit(105)).alias("read_pos"),
    )


@_query("P46_allele_total", "SELECT site, CAST(sum(CASE g WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 ELSE 0 END) AS BIGINT) AS ac FROM (SELECT site, " + _GT + " AS g FROM genotypes) GROUP BY site", "genotypes")
def _(spark, d):
    return view(spark, d, "genotypes").select("site", F.expr(_GT).alias("g")).groupBy("site").agg(F.sum(qc.allele_total(F.col("g"))).alias("ac"))


@_query("P49_property_filter", f"WITH r AS ({_READS}) SELECT ref, count(*) AS n FROM r WHERE mapq >= 30 AND NOT {_BIT(1024)} AND {_BIT(1)} AND NOT ref = '7' AND insert_size < 300 GROUP BY ref")
def _(spark, d):
    keep = reads.property_filter({"mapQuality": ">=30", "isDuplicate": "false", "isPaired": "true", "reference": "!7", "insertSize": "<300"})
    return _reads(spark, d).where(keep).groupBy("ref").agg(F.count(F.lit(1)).alias("n"))


@_query("P54_flags", f"WITH r AS ({_READS}) SELECT flag, CAST(flag | 1024 AS INT) AS dup, CAST(flag & ~1024 AS INT) AS clear, count(*) AS n FROM r GROUP BY flag")
def _(spark, d):
    return _reads(spark, d).groupBy("flag").agg(F.count(F.lit(1)).alias("n")).select("flag", reads.set_flag("duplicate", True).alias("dup"), reads.set_flag("duplicate", False).alias("clear"), "n")


@_query("F_sequence_functions", """SELECT q_id, reverse(translate(t_seq, 'ACGTacgt', 'TGCAtgca')) AS revcomp, translate(t_seq, 'WSKMYRVDBH', 'ACGACAAACA') AS iupac, CAST(length(regexp_replace(t_seq, '[^Nn]', '', 'g')) AS INT) AS n_count,
printf('%.6f', length(regexp_replace(t_seq, '[^Nn]', '', 'g')) / length(t_seq)) AS n_ratio, substr(t_seq, 5, 10) AS sub, CAST(list_sum(list_transform(range(1, 61), lambda i: CASE WHEN substr(t_seq, i, 1) = substr(q_seq, i, 1) THEN 0 ELSE 1 END)) AS INT) AS bad FROM aligned""", "aligned")
def _(spark, d):
    return view(spark, d, "aligned").select(
        "q_id", S.revcomp("t_seq").alias("revcomp"), S.iupac("t_seq").alias("iupac"), S.n_count("t_seq").alias("n_count"), S.n_ratio("t_seq").alias("n_ratio"), S.subsequence("t_seq", F.lit(5), F.lit(14)).alias("sub"), S.mismatches("t_seq", "q_seq").alias("bad")
    )


@_query("F17_19_size_bins", """, s AS (SELECT DISTINCT size * size - 1 AS n FROM sites), w AS (SELECT n, CASE WHEN n <= 10 THEN 1 WHEN n <= 100 THEN 10 WHEN n <= 1000 THEN 100 ELSE 1000 END AS w FROM s)
SELECT n, CASE WHEN n <= 0 THEN '0-0' ELSE CAST((n - 1) // 10 * 10 + 1 AS VARCHAR) || '-' || CAST((n - 1) // 10 * 10 + 10 AS VARCHAR) END AS linear,
CASE WHEN n <= 0 THEN '0-0' ELSE CAST((n - 1) // w * w + 1 AS VARCHAR) || '-' || CAST((n - 1) // w * w + w AS VARCHAR) END AS decade FROM w""", "sites")
def _(spark, d):
    n = view(spark, d, "sites").select((F.col("size") * F.col("size") - 1).alias("n")).distinct()
    return n.select("n", S.size_bin("n", 10).alias("linear"), S.size_bin_decade("n").alias("decade"))


@_query("F21_interval_bins", """SELECT DISTINCT t_start * 37 AS s, CAST(CASE WHEN a >> 14 = b >> 14 THEN 4681 + (a >> 14) WHEN a >> 17 = b >> 17 THEN 585 + (a >> 17) WHEN a >> 20 = b >> 20 THEN 73 + (a >> 20) ELSE 9 + (a >> 23) END AS BIGINT) AS bin FROM (SELECT t_start, t_start * 37 AS a, t_start * 37 + 999 AS b FROM intervals)""", "intervals")
def _(spark, d):
    v = view(spark, d, "intervals").select((F.col("t_start") * 37).alias("s")).distinct()
    return v.select("s", S.interval_bin("s", F.col("s") + 1000).cast("long").alias("bin"))


@_query("F23_parse_region", """SELECT DISTINCT t_id, 'chr' || CAST(t_id AS VARCHAR) AS id, t_start AS lo, t_start + 10 AS hi FROM intervals""", "intervals")
def _(spark, d):
    text = F.format_string("chr%d:%s-%s", F.col("t_id"), F.format_number("t_start", 0), F.format_number(F.col("t_start") + 10, 0))
    v = view(spark, d, "intervals").select("t_id", "t_start").distinct().select("t_id", S.parse_region(text).alias("r"))
    return v.select("t_id", F.col("r.id").alias("id"), F.col("r.start").alias("lo"), F.col("r.end").alias("hi"))


@_query("U01_union_families", "SELECT type, count(*) AS n, min(rank) AS rank FROM (SELECT type, CASE type WHEN 'INS' THEN 0 WHEN 'DEL' THEN 1 ELSE 6 END AS rank FROM intervals) GROUP BY type", "intervals")
def _(spark, d):
    v = view(spark, d, "intervals")
    out = variants.union_families({kind: v.where(F.col("type") == kind) for kind in variants.FAMILIES})
    return out.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"))


@_query("O08_first_per_group", "SELECT rg, v FROM (SELECT o_orderpriority AS rg, o_orderkey AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 50")
def _(spark, d):
    return qc.rank_window(table(spark, d, "orders").select(F.col("o_orderpriority").alias("rg"), F.col("o_orderkey").alias("v")), ["rg"], ["v"], 50)


def _calls_sql() -> str:
    """The adjacency machine as a recursive walk: state = the numbers of the held alignments a and b, one step per alignment c."""
    near = lambda x, y: f"abs({x}.ord - {y}.ord) = 1"
    same = lambda x, y: f"{x}.t_id = {y}.t_id AND {x}.strand = {y}.strand"
    lo, hi = "least(a.t_start, c.t_start)", "greatest(a.t_end, c.t_end)"
    trans = f"{same('a', 'c')} AND NOT (b.t_id = a.t_id AND b.t_start <= {hi} AND b.t_end >= {lo})"
    inv = f"a.t_id = b.t_id AND {same('a', 'c')} AND a.strand <> b.strand AND b.t_start BETWEEN {lo} AND {hi}"

    def gap(x: str, y: str, where: str) -> str:
        first_end, second = f"CASE WHEN {x}.t_start <= {y}.t_start THEN {x}.t_end ELSE {y}.t_end END", f"greatest({x}.t_start, {y}.t_start)"
        over = lambda s: f"least({x}.{s}_end, {y}.{s}_end) >= greatest({x}.{s}_start, {y}.{s}_start)"
        kind = f"CASE WHEN {over('t')} AND {over('q')} THEN 'gap-X1' WHEN {over('q')} THEN 'gap-X2' WHEN {over('t')} THEN 'gap-1' ELSE 'gap-2' END"
        return f"SELECT {x}.q_id, {kind} AS kind, {x}.t_id, least({first_end}, {second}) AS t_start, greatest({first_end}, {second}) AS t_end, least({x}.q_end, {y}.q_start) AS q_start, greatest({x}.q_end, {y}.q_start) AS q_end FROM e WHERE {where}"

    at = lambda x, kind, where: f"SELECT {x}.q_id, {kind} AS kind, {x}.t_id, {x}.t_start, {x}.t_end, {x}.q_start, {x}.q_end FROM e WHERE {where}"
    parts = [
        gap("a", "c", "act = 'ac'"), gap("b", "c", "act = 'bc'"), gap("a", "b", f"act = 'end' AND {same('a', 'b')}"), at("b", "'INV'", "act = 'inv'"),
        at("b", "'TRANS-' || CASE WHEN b.t_id = a.t_id THEN 'INTRA' ELSE 'INTER' END || CASE WHEN b.strand = a.strand THEN '1' ELSE '2' END", "act = 'trans'"),
        at("a", "'Nos-JustNo'", "act = 'just'"), at("a", "'Nos-Complex'", "act = 'complex'"),
        *[at(x, "CASE WHEN a.t_id = b.t_id THEN 'Nos-Strand' ELSE 'Nos-Complex' END", f"act = 'end' AND NOT ({same('a', 'b')})") for x in "ab"],
    ]
    return f""", RECURSIVE_ v AS (SELECT 't' || CAST(t_id % 3 AS VARCHAR) AS t_id, CAST(q_id AS VARCHAR) AS q_id, t_start, t_end, q_start, q_end, strand FROM intervals),
o AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY q_start, t_id, t_start, t_end, q_end, strand) AS i, row_number() OVER (PARTITION BY q_id ORDER BY t_id, t_start, q_start, t_end, q_end, strand) AS k, count(*) OVER (PARTITION BY q_id) AS n FROM v),
r AS (SELECT * EXCLUDE (k), max(k) OVER (PARTITION BY q_id, q_start) AS ord FROM o WHERE n > 1),
w AS (SELECT q_id, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS ai, CAST(NULL AS BIGINT) AS bi, '' AS act, CAST(NULL AS BIGINT) AS pa, CAST(NULL AS BIGINT) AS pb FROM r WHERE i = 1
UNION ALL SELECT q_id, i, CASE WHEN pb IS NULL AND act <> 'ac' THEN pa WHEN pb IS NULL OR act IN ('trans', 'inv', 'bc') THEN i ELSE pb END, CASE WHEN pb IS NULL AND act = 'ac' OR act IN ('trans', 'inv', 'bc') THEN NULL ELSE i END, act, pa, pb FROM (
SELECT c.q_id, c.i, w.ai AS pa, w.bi AS pb, CASE WHEN w.bi IS NULL THEN CASE WHEN {near('c', 'a')} AND {same('a', 'c')} THEN 'ac' ELSE '' END
WHEN {near('c', 'a')} THEN CASE WHEN {trans} THEN 'trans' WHEN {near('c', 'b')} AND {same('b', 'c')} THEN 'bc' ELSE '' END
WHEN {near('b', 'a')} AND {near('c', 'b')} THEN CASE WHEN {inv} THEN 'inv' WHEN {same('b', 'c')} THEN 'bc' ELSE '' END
WHEN {near('b', 'a')} THEN 'just' ELSE 'complex' END AS act
FROM w JOIN r c ON c.q_id = w.q_id AND c.i = w.i + 1 JOIN r a ON a.q_id = w.q_id AND a.i = w.ai LEFT JOIN r b ON b.q_id = w.q_id AND b.i = w.bi)),
x AS (SELECT q_id, i, pa, pb, act FROM w WHERE act <> '' UNION ALL SELECT w.q_id, w.i, ai, bi, 'end' FROM w JOIN (SELECT q_id, max(i) AS i FROM r GROUP BY q_id) m ON m.q_id = w.q_id AND m.i = w.i WHERE bi IS NOT NULL),
e AS (SELECT x.act, a, b, c FROM x JOIN r a ON a.q_id = x.q_id AND a.i = x.pa LEFT JOIN r b ON b.q_id = x.q_id AND b.i = x.pb JOIN r c ON c.q_id = x.q_id AND c.i = x.i)
{" UNION ALL ".join(parts)}"""


@_query("V01_structural_calls", _calls_sql(), "intervals")
def _(spark, d):
    return variants.structural_calls(view(spark, d, "intervals").withColumn("t_id", F.format_string("t%d", F.col("t_id") % 3)).withColumn("q_id", F.col("q_id").cast("string")))


@_query("M01_genotype")
def _(spark, d):
    return genotype.genotype(view(spark, d, "genotypes"))


@_query("M01_genotype_sql")
def _(spark, d):
    """As M01_genotype, by the table function."""
    tables.register(spark)
    return spark.sql("SELECT * FROM site_genotype(TABLE(SELECT site, sample, rr, aa FROM {g}) PARTITION BY site ORDER BY sample)", g=view(spark, d, "genotypes"))


def _read_pairs(spark, d):
    """Each text of the conversations as bases, in pieces of 1000, against the piece without what stands in its middle fifth."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.translate(F.regexp_replace(F.upper("text"), "[^A-Z]", "E"), LETTERS, BASES.replace("-", "A")).alias("s"))
    pieces = F.posexplode(F.regexp_extract_all("s", F.lit(".{1,1000}"), F.lit(0))).alias("i", "a")
    t = t.select("conv_id", "turn", pieces).where("length(a) >= 20")
    n = F.expr("length(a) div 5")
    return t.select((F.col("conv_id") * 10_000_000 + F.col("turn") * 100_000 + F.col("i")).alias("pair_id"), "a", F.concat(F.left("a", n * 2), F.substr("a", n * 3 + 1)).alias("b"))


@_query("G01_reads_of_1000")
def _(spark, d):
    return align.gap_excision(_read_pairs(spark, d), align.Scores())


@_query("G01_realign_sql")
def _(spark, d):
    """As G01_reads_of_1000, by the table function."""
    tables.register(spark)
    return spark.sql("SELECT * FROM realign(TABLE(SELECT pair_id, a, b FROM {p}) PARTITION BY pmod(hash(pair_id), 64) ORDER BY (length(a), length(b)))", p=_read_pairs(spark, d))


@_query("K05_alignment_text")
def _(spark, d):
    return align_text.alignment_text(_read_pairs(spark, d), align.Scores())


@_query("G03_breakpoints")
def _(spark, d):
    return align.gap_breakpoints(_read_pairs(spark, d), align.Scores())


_ONCE = ", once AS (SELECT line_no, " + ", ".join(f'min("{c}") AS "{c}"' for c in ("site", "chrom", "start", "end", "size", "vq", "nr", "filter", "inb")) + " FROM sites GROUP BY line_no)"
_GENOTYPED = _ONCE + """, g AS (SELECT *, size % 7 <> 0 AS scored, size % 4 <> 0 AND size % 5 <> 0 AS two FROM once),
f AS (SELECT line_no, CAST(size % 3 <> 0 AS DOUBLE) AS biallelic, round(inb, 2) AS inb_coeff, CAST(least(least(100, start * 100 // 20000), 100 - least(100, "end" * 100 // 20000)) AS DOUBLE) AS leg, floor(1000 * nr + 0.5) / 10 AS n_ratio, CAST(vq AS DOUBLE) AS alt_perfect, CAST(line_no % 5 AS DOUBLE) AS both_imperfect, start, chrom FROM g WHERE scored
UNION ALL SELECT line_no, CAST(size % 3 <> 0 AS DOUBLE), round(inb, 2), CAST(least(size * 100 // 300, 100 - (size + 100) * 100 // 300) AS DOUBLE), 25.0, 2.0, 4.0, start, chrom FROM g WHERE scored AND two)"""


def _once(spark, d):
    """A site per line number; stored, as its users read it several times."""
    return stored(view(spark, d, "sites").groupBy("line_no").agg(*[F.min(c).alias(c) for c in ("site", "chrom", "start", "end", "size", "vq", "nr", "filter", "inb")]), "once")


def _genotyped(spark, v):
    """Sites and genotypes of VCF text with two samples, and the lengths of their scaffolds. v: _once()."""
    sites, calls = files.read_back(spark, "vcf", files.genotyped_vcf_of(v), "gzip")
    one = v.select(F.lit("s1").alias("sample"), F.concat(F.lit("sc"), "chrom").alias("scaffold"), F.lit(20_000).alias("len")).distinct()
    two = spark.range(3).select(F.lit("s2").alias("sample"), F.concat(F.lit("y-"), "id").alias("scaffold"), F.lit(300).alias("len"))
    return sites, calls, one.unionByName(two)


@_query("P28_site_features", _GENOTYPED + """ SELECT line_no, median(biallelic) AS biallelic, median(inb_coeff) AS inb_coeff, median(leg) AS leg, round(median(n_ratio), 6) AS n_ratio, median(alt_perfect) AS alt_perfect, median(both_imperfect) AS both_imperfect, chrom % 2 = 0 AS training FROM f GROUP BY line_no, chrom""", "sites")
def _(spark, d):
    v = _once(spark, d)
    sites, calls, lengths = _genotyped(spark, v)
    training = v.where("chrom % 2 = 0").select(F.col("chrom").cast("string").alias("chrom"), F.col("start").alias("pos"))
    out = recalibrate.site_features(sites, calls, lengths, training)
    ids = sites.select(F.col("line_no").alias("site"), F.substring("id", 2, 20).cast("long").alias("line_no"))
    return out.join(ids, "site").select("line_no", *recalibrate.FEATURES, "training").withColumn("n_ratio", F.round("n_ratio", 6))


@_query("M13_recalibrate_vcf")
def _(spark, d):
    """From VCF text to scores: features of samples, medians of sites, mixtures, log odds and culprits."""
    v = _once(spark, d)
    sites, calls, lengths = _genotyped(spark, v)
    training = v.where("chrom % 2 = 0").select(F.col("chrom").cast("string").alias("chrom"), F.col("start").alias("pos"))
    return recalibrate.recalibrate(recalibrate.site_features(sites, calls, lengths, training).drop("chrom", "pos"), recalibrate.FEATURES)


@_query("K08_scored_vcf", _ONCE + """, s AS (SELECT *, round(vq / 7.0 - 3, 2) AS lod FROM once)
SELECT 'r' || line_no AS id, greatest(lod, 0) AS qual, CASE WHEN size % 7 = 0 THEN 'AC=1;CU=leg' ELSE 'AC=1;CU=leg;InbCoeff=' || inb || ';NEG' END || CASE WHEN size % 2 = 0 THEN ';NEGATIVE_TRAIN_SITE' ELSE '' END || CASE WHEN size % 3 = 0 THEN ';POSITIVE_TRAIN_SITE' ELSE '' END || ';VQ=' || lod AS info FROM s""", "sites")
def _(spark, d):
    v = _once(spark, d)
    sites, _, _ = _genotyped(spark, v)
    v = v.select(F.concat(F.lit("r"), "line_no").alias("id"), (F.col("vq") / 7.0 - 3).alias("lod"), F.lit("leg").alias("culprit"), (F.col("size") % 3 == 0).alias("positive"), (F.col("size") % 2 == 0).alias("negative"))
    scores = sites.select(F.col("line_no").alias("site"), "id").join(v, "id").drop("id")
    return recalibrate.scored_vcf(sites, scores).select("id", "qual", recalibrate.info_text(F.col("info")).alias("info"))


@_query("K06_supported_vcf", _ONCE + """, s AS (SELECT *, CASE size % 3 WHEN 0 THEN 'G' WHEN 1 THEN 'AC' ELSE 'T' END AS alt FROM once),
c AS (SELECT site, size % 3 AS r, vq % 3 AS a FROM once), n AS (SELECT site, count(*) FILTER (r = 0 AND a <> 0) || ',' || count(*) FILTER (r <> 0 AND a = 0) || ',' || count(*) FILTER (r = 0 AND a = 0) || ',' || count(*) FILTER (r <> 0 AND a <> 0) AS aa FROM c GROUP BY site),
w AS (SELECT s.*, CASE WHEN line_no % 2 = 0 THEN coalesce(n.aa, '0,0,0,0') ELSE '0,0,0,0' END AS aa, length(alt) = 1 AS snp, size % 3 = 0 AS both FROM s LEFT JOIN n ON n.site = s.site),
x AS (SELECT *, CASE WHEN size % 3 = 0 THEN 'AC' ELSE alt END AS alt2, size % 4 = 0 AS missing, CASE WHEN size % 5 = 0 THEN '.' ELSE 'y-' || (chrom % 3) || '-' || size || '-' || (size + 100) END AS place FROM w)
SELECT 'r' || line_no AS id, alt2 AS alt, CASE WHEN missing THEN 'GT:AA:VS:VT' WHEN length(alt2) = 1 THEN 'GT:NR:QR:VS:VT' ELSE 'GT:AA:NR:QR:VS:VT' END AS format,
CASE WHEN missing THEN './.:' || aa || ':' || size || ':INS' WHEN length(alt2) = 1 THEN '1/1:0.25:' || place || ':7:DEL' ELSE '1/1:' || aa || ':0.25:' || place || ':7:DEL' END AS cell FROM x WHERE NOT (missing AND length(alt2) = 1)""", "sites")
def _(spark, d):
    """The second sample, with the support of its alleles on every other line."""
    v = _once(spark, d)
    sites, calls, _ = _genotyped(spark, v)
    n = reads.allele_support(v.select("site", (F.col("size") % 3).alias("ref_bad"), (F.col("vq") % 3).alias("alt_bad")))
    n = v.where("line_no % 2 = 0").select("site", F.concat(F.lit("r"), "line_no").alias("id")).join(n, "site").join(sites.select("line_no", "id"), "id").drop("site", "id")
    return support.supported_vcf(sites, calls, n, "s2").select("id", "alt", "format", "cell")


def _tabbed(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(F.concat_ws("\t", *[F.expr(c).cast("string") for c in cols]).alias("value"))


def _with_comment(lines: DataFrame) -> DataFrame:
    return lines.sparkSession.createDataFrame([("# a comment",), ("",)], "value string").unionByName(lines)


@_query("S12_training_sites", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS chrom, CAST(o_orderkey % 500 AS BIGINT) AS pos FROM orders")
def _(spark, d):
    lines = _tabbed(table(spark, d, "orders"), "o_custkey", "o_orderkey % 500", "'more'")
    return readers.read_training(spark, files.as_file(_with_comment(lines), "sites"))


@_query("S13_lengths", """SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS sample, 's' || s_suppkey AS scaffold, CAST(s_nationkey * 1000 AS BIGINT) AS len FROM supplier""")
def _(spark, d):
    t = table(spark, d, "supplier")
    part = lambda n: files.as_file(_tabbed(t.where(F.col("s_suppkey") % 2 == n), "concat('s', s_suppkey)", "s_nationkey * 1000", "'x'", "0"), "lengths")
    listed = spark.createDataFrame([(f"even\t{part(0)}",), (f"odd\t{part(1)}",)], "value string").coalesce(1)
    return readers.read_lengths(spark, files.as_file(listed, "list"))


@_query("S14_pedigree", "SELECT 'f' || c_nationkey AS family, 'c' || c_custkey AS child, 'a' || (c_custkey + 1) AS father, 'm' || (c_custkey + 2) AS mother, CAST(c_custkey % 2 AS VARCHAR) AS sex, '0' AS pheno FROM customer")
def _(spark, d):
    lines = _tabbed(table(spark, d, "customer"), "concat('f', c_nationkey)", "concat('c', c_custkey)", "concat('a', c_custkey + 1)", "concat('m', c_custkey + 2)", "c_custkey % 2", "0")
    return readers.read_pedigree(spark, files.as_file(lines, "ped"))


@_query("S17_gap_regions", 'SELECT CAST(t_id AS VARCHAR) AS name, t_start AS start, t_end AS "end" FROM intervals', "intervals")
def _(spark, d):
    return readers.read_regions(spark, files.as_file(_with_comment(_tabbed(view(spark, d, "intervals"), "t_id", "t_start", "t_end")), "gaps"))


@_query("S19_variant_regions", "SELECT 't' || t_id AS t_id, t_start, t_end, 'q' || q_id AS q_id, q_start, q_end, type AS info FROM intervals", "intervals")
def _(spark, d):
    lines = _tabbed(view(spark, d, "intervals"), "concat('t', t_id)", "t_start", "t_end", "concat('q', q_id)", "q_start", "q_end", "type")
    return readers.read_variant_regions(spark, files.as_file(_with_comment(lines), "regions"))


@_query("P53_merged_header", """SELECT 'HD' AS kind, '@HD' || chr(9) || 'VN:1.0' AS value UNION ALL SELECT 'SQ', '@SQ' || chr(9) || 'SN:n' || n_nationkey || chr(9) || 'LN:' || (n_nationkey * 100 + 1) FROM nation UNION ALL SELECT 'RG', '@RG' || chr(9) || 'ID:r' || r_regionkey FROM region""")
def _(spark, d):
    """Headers of two files of reads that share most of their lines."""
    hd = spark.createDataFrame([("@HD\tVN:1.0",)], "value string")
    sq = table(spark, d, "nation").select(F.concat(F.lit("@SQ\tSN:n"), "n_nationkey", F.lit("\tLN:"), F.col("n_nationkey") * 100 + 1).alias("value"), "n_nationkey")
    rg = table(spark, d, "region").select(F.concat(F.lit("@RG\tID:r"), "r_regionkey").alias("value"))
    reads_ = files.sam_of(_reads(spark, d))
    one = hd.unionByName(sq.where("n_nationkey < 20").select("value")).unionByName(rg).unionByName(reads_)
    two = hd.unionByName(sq.where("n_nationkey > 5").select("value")).unionByName(rg)
    return readers.read_sam_header(spark, [files.as_file(one, "sam"), files.as_file(two, "sam")])


@_query("F18_log_bins", """, s AS (SELECT DISTINCT size * size * size AS n FROM sites WHERE size > 0), b AS (SELECT n, 10 AS base FROM s UNION ALL SELECT n, 2 FROM s),
p AS (SELECT n, base, CAST(CASE WHEN n <= base THEN 0 ELSE (SELECT max(i) FROM range(1, 40) t(i) WHERE CAST(base AS DOUBLE) ** i < n) END AS INT) AS k FROM b)
SELECT n, base, CASE WHEN k = 0 THEN '2' ELSE CAST(CAST(base AS DOUBLE) ** k AS BIGINT) + 1 || '' END || '-' || CAST(CAST(base AS DOUBLE) ** (k + 1) AS BIGINT) AS bin FROM p WHERE n > 1""", "sites")
def _(spark, d):
    n = view(spark, d, "sites").where("size > 0").select((F.col("size") * F.col("size") * F.col("size")).alias("n")).distinct().where("n > 1")
    return n.select("n", F.lit(10).alias("base"), S.size_bin_log("n", 10).alias("bin")).unionByName(n.select("n", F.lit(2).alias("base"), S.size_bin_log("n", 2).alias("bin")))


@_query("K07_split_output", """SELECT CASE WHEN filter = 'PASS' THEN 'kept' ELSE 'false' END AS part, chrom || chr(9) || start || chr(9) || line_no AS value FROM sites""", "sites")
def _(spark, d):
    lines = view(spark, d, "sites").select("filter", "chrom", "start", F.concat_ws("\t", F.col("chrom").cast("string"), F.col("start").cast("string"), F.col("line_no").cast("string")).alias("value"))
    path = new_path(spark, "split")
    writers.write_parts(lines, F.col("filter") == "PASS", path, "chrom", "start")
    return spark.read.text(f"{path}/kept/lines").withColumn("part", F.lit("kept")).unionByName(spark.read.text(f"{path}/false/lines").withColumn("part", F.lit("false")))


@_query("K10_qc_vcf", _ONCE + """, d AS (SELECT *, CASE WHEN nr * 6 > 0.5 OR inb <= -0.7 OR inb >= 0.7 THEN -1 WHEN size % 5 = 0 THEN -2 ELSE 1 END AS mark FROM once),
f AS (SELECT *, CASE WHEN mark = -1 THEN 'FALSE' WHEN mark = -2 AND vq >= 30 THEN CASE WHEN filter IN ('.', 'PASS') THEN 'DUPLIC' ELSE 'DUPLIC;' || filter END WHEN vq >= 30 THEN 'PASS' ELSE 'q30' END AS decided FROM d)
SELECT chrom || chr(9) || start || chr(9) || 'r' || line_no || chr(9) || 'A' || chr(9) || CASE size % 3 WHEN 0 THEN 'AC,G' WHEN 1 THEN 'AC' ELSE 'T' END || chr(9) || vq || chr(9) || decided || chr(9) || CASE WHEN size % 7 = 0 THEN 'AC=1' ELSE 'InbCoeff=' || inb || ';AC=1;NEG' END || ';SPN=' || (1 + size % 4) AS value FROM f""", "sites")
def _(spark, d):
    """Lines of a VCF file with the filter and the number of assemblies that QC gives them, joined by line number; without the samples' columns."""
    v = _once(spark, d)
    lines = places.numbered(spark, files.as_file(files.genotyped_vcf_of(v), "vcf", "gzip"))
    mark = qc.bad_mark(F.col("nr") * 6, F.col("inb"))
    v = v.select(F.concat(F.lit("r"), "line_no").alias("id"), F.when((mark == 1) & (F.col("size") % 5 == 0), -2).otherwise(mark).alias("mark"), "vq", F.col("filter").alias("old"), (1 + F.col("size") % 4).alias("samples"))
    own = lines.where("value not like '#%'").select("line_no", F.get(F.split("value", "\t"), F.lit(2)).alias("id"))
    decided = own.join(v, "id").select("line_no", qc.filter_decision(F.col("mark"), F.col("vq"), 30, F.col("old")).alias("filter"), "samples")
    return writers.qc_lines(lines, decided).select(F.array_join(F.slice(F.split("value", "\t"), 1, 8), "\t").alias("value"))


@_query("A40_culprit_points", """, t AS (SELECT line_no, vq, size, nr, filter = 'PASS' AS training, CASE WHEN size % 2 = 0 THEN 'size' ELSE 'nr' END AS culprit FROM sites) SELECT culprit, training, line_no, CAST(vq AS DOUBLE) AS score, CAST(CASE culprit WHEN 'size' THEN size ELSE nr END AS DOUBLE) AS value FROM t""", "sites")
def _(spark, d):
    v = view(spark, d, "sites").select("line_no", "vq", "size", "nr", (F.col("filter") == "PASS").alias("training"), F.when(F.col("size") % 2 == 0, "size").otherwise("nr").alias("culprit"))
    return recalibrate.culprit_points(v, "vq", ["size", "nr"])


@_query("P48_converted_types", """, c AS (SELECT line_no, q_id, t_start % 3 AS t, q_start % 3 AS q, score % 2 = 0 AS simul FROM intervals)
SELECT line_no, q_id, CASE WHEN t > 0 AND q = 0 THEN CASE WHEN simul THEN 'SDEL' ELSE 'DEL' END WHEN t = 0 AND q > 0 THEN CASE WHEN simul THEN 'SINS' ELSE 'INS' END WHEN t = 1 AND q = 1 THEN 'SNP' WHEN t = q THEN 'BSubstitution' ELSE 'SimulGap' END AS type FROM c""", "intervals")
def _(spark, d):
    v = view(spark, d, "intervals").select("line_no", "q_id", (F.col("t_start") % 3).alias("t_gap"), (F.col("q_start") % 3).alias("q_gap"), (F.col("score") % 2 == 0).alias("simul"))
    return v.select("line_no", "q_id", support.converted_type(v).alias("type"))


@_query("P30_length_type", """SELECT p_partkey, CASE WHEN length(p_name) > length(p_brand) THEN '1.INS' WHEN length(p_name) < length(p_brand) THEN '2.DEL' WHEN length(p_brand) = 1 THEN '4.SNP' ELSE '3.MNP' END AS type,
CAST(CASE WHEN length(p_name) = length(p_brand) THEN length(p_brand) ELSE abs(length(p_name) - length(p_brand)) END AS INT) AS size FROM part""")
def _(spark, d):
    kind, size = variants.length_type(F.col("p_brand"), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", kind.alias("type"), size.alias("size"))


@_query("J03_without_no_solution", """SELECT line_no, q_id, q_start, q_end FROM intervals a WHERE type <> 'DEL' AND NOT EXISTS (SELECT 1 FROM intervals b WHERE b.type = 'DEL' AND b.q_id = a.q_id AND a.q_start <= b.q_end AND a.q_end >= b.q_start)""", "intervals")
def _(spark, d):
    v = view(spark, d, "intervals").select("line_no", "q_id", "q_start", "q_end", "type")
    return variants.without_no_solution(v.where("type != 'DEL'"), v.where("type = 'DEL'")).select("line_no", "q_id", "q_start", "q_end")


@_query("J10_scored_lines", _ONCE + """ SELECT CAST(chrom AS VARCHAR) AS chrom, start AS pos, 'r' || line_no AS id, vq / 4.0 AS lod FROM once""", "sites")
def _(spark, d):
    """Scores back onto the lines of a VCF file, by chromosome, position and line number."""
    lines, _, _ = _genotyped(spark, _once(spark, d))
    scores = lines.select("chrom", "pos", "line_no", (F.col("qual") / 4.0).alias("lod"))
    return support.scored_lines(lines.select("line_no", "chrom", "pos", "id"), scores).select("chrom", "pos", "id", "lod")


@_query("O04_05_listed_order", "SELECT line_no, type, CAST(CASE type WHEN '4.SNP' THEN 1 ELSE 2 END AS INT) AS place FROM sites WHERE type IN ('4.SNP', '1.INS')", "sites")
def _(spark, d):
    out = readers.in_order_of(view(spark, d, "sites"), "type", ["4.SNP", "1.INS"], "line_no")
    return out.select("line_no", "type", F.array_position(F.array(F.lit("4.SNP"), F.lit("1.INS")), F.col("type")).cast("int").alias("place"))


@_query("O06_restored_order", "SELECT line_no, chrom, start FROM sites", "sites")
def _(spark, d):
    return qc.restore_order(readers.ordered(view(spark, d, "sites"), "chrom", "start")).select("line_no", "chrom", "start")


@_query("M13_recalibrate")
def _(spark, d):
    v = view(spark, d, "sites").select(F.col("line_no").alias("site"), (F.col("filter") == "PASS").alias("training"), F.col("size").cast("double").alias("size"), F.col("vq").cast("double").alias("vq"), "nr")
    return recalibrate.recalibrate(v, ["size", "vq", "nr"])


@_query("G01_gap_excision")
def _(spark, d):
    v = view(spark, d, "aligned").select(F.col("q_id").alias("pair_id"), F.regexp_replace("t_seq", "-", "").alias("a"), F.regexp_replace("q_seq", "-", "").alias("b"))
    return align.gap_excision(v, align.Scores(1, -2, -2, -1), both=True)


@_query("V07_realign")
def _(spark, d):
    """Each text as a target, and without or with a run of bases in its middle as a query; a call around the place."""
    t = table(spark, d, "documents").where("length(text) > 0").select("doc_id", F.upper("text").alias("s"))
    t = t.select("doc_id", F.translate(F.regexp_replace("s", "[^A-Z]", "E"), LETTERS, BASES.replace("-", "A")).alias("s")).withColumn("at", F.expr("length(s) div 2"))
    t = stored(t, "bases")  # every use below would translate the whole text again
    left, right = F.expr("left(s, at)"), F.expr("substr(s, at + 1)")
    q = F.when(F.col("doc_id") % 2 == 0, F.concat(left, F.expr("substr(s, at + 21)"))).otherwise(F.concat(left, F.lit("ACCAGTTGCATTG"), right))
    targets, queries = t.select(F.col("doc_id").cast("string").alias("id"), F.col("s").alias("seq")), t.select(F.concat(F.lit("q"), "doc_id").alias("id"), q.alias("seq")).where("seq != ''")
    calls = t.select(
        F.col("doc_id").alias("call_id"), F.lit("gap-2").alias("type"), F.col("doc_id").cast("string").alias("t_id"), (F.col("at") - 5).alias("t_start"), (F.col("at") + 25).alias("t_end"),
        F.concat(F.lit("q"), "doc_id").alias("q_id"), (F.col("at") - 5).alias("q_start"), (F.col("at") + 15).alias("q_end"), F.lit(50).cast("long").alias("score"), F.lit(0.001).alias("mismap"),
        F.lit(None).cast("string").alias("expected_id"), F.lit(None).cast("long").alias("expected_start"), F.lit(None).cast("long").alias("expected_end"),
    )
    size = lambda x: x.select("id", F.length("seq").cast("long").alias("len"))
    none = calls.select("t_id", "t_start", "t_end", F.lit("").alias("q_id")).where("false")
    out = realign.detected(calls, readers.sequence_chunks(targets), readers.sequence_chunks(queries), size(targets), size(queries), none, flank_size=100)
    return out.select("call_id", "type", "t_id", "t_start", "t_end", "q_start", "q_end", "strand", "ref", "alt", "is_good_realign", "gt", "filter")


@_query("V08_detect")
def _(spark, d):
    """Alignment blocks and sequences as files, to variants: each text as a target; as a query without 20 bases of its middle, or with 13 others there."""
    t = table(spark, d, "documents").where("length(text) >= 60").select("doc_id", F.translate(F.regexp_replace(F.upper("text"), "[^A-Z]", "E"), LETTERS, BASES.replace("-", "A")).alias("s")).withColumn("at", F.expr("length(s) div 2"))
    gone = F.col("doc_id") % 2 == 0
    left, rest = F.expr("left(s, at)"), F.when(gone, F.expr("substr(s, at + 21)")).otherwise(F.expr("substr(s, at + 1)"))
    t = t.select("doc_id", "s", "at", left.alias("left"), rest.alias("rest"), F.when(gone, F.lit("")).otherwise(F.lit("ACCAGTTGCATTG")).alias("new"))
    t = stored(t.withColumn("q", F.concat("left", "new", "rest")), "bases")  # every use below would translate the whole text again
    record = lambda kind, seq: t.select(F.concat(F.lit(f">{kind}"), "doc_id", F.lit("\n"), F.regexp_replace(seq, "(.{60})", "$1\n")).alias("value"))
    fa, fq = files.as_file(record("t", "s"), "fasta"), files.as_file(record("q", "q"), "fasta")
    row = lambda kind, start, seq, whole: F.concat_ws(" ", F.lit("s"), F.concat(F.lit(kind), "doc_id"), start.cast("string"), F.length(seq).cast("string"), F.lit("+"), F.length(whole).cast("string"), seq)
    block = lambda t_at, q_at, seq: F.concat_ws("\n", F.lit("a score=500 mismap=1e-05"), row("t", t_at, F.col(seq), "s"), row("q", q_at, F.col(seq), "q"), F.lit(""))
    zero, end = F.lit(0), F.length("left") + F.length("new")
    blocks = t.select(F.explode(F.array(block(zero, zero, "left"), block(F.length("s") - F.length("rest"), end, "rest"))).alias("value"))
    maf = readers.read_maf(spark, files.as_file(blocks, "maf"))
    size = lambda path: places.fasta_lengths(spark, path).select("id", "len")
    out = realign.from_alignments(maf, places.fasta_pieces(spark, fa), places.fasta_pieces(spark, fq), size(fa), size(fq), flank_size=100)
    return out.select("type", "t_id", "t_start", "t_end", "q_id", "q_start", "q_end", "strand", "ref", "alt", "is_good_realign", "gt", "filter")


@_query("G13_smith_waterman")
def _(spark, d):
    v = view(spark, d, "aligned").select(F.col("q_id").alias("pair_id"), F.regexp_replace("t_seq", "-", "").alias("a"), F.regexp_replace("q_seq", "-", "").alias("b"))
    return align.smith_waterman(v)




@_query("P20_alt_allele", """SELECT p_partkey, CASE p_size % 3 WHEN 2 THEN 'G' ELSE 'AC' END AS alt, p_size % 3 = 0 AS snp FROM part""")
def _(spark, d):
    t = table(spark, d, "part").withColumn("gt", F.concat(F.lit("0/"), (F.col("p_size") % 3).cast("string")))
    alts = F.array(F.lit("AC"), F.lit("G"))
    return t.select("p_partkey", support.alt_allele(alts, F.col("gt")).alias("alt"), support.is_snp(F.lit("A"), F.array(F.when(F.col("p_size") % 3 == 0, "C").otherwise("CC"))).alias("snp"))


@_query("P22_collapse_gt", "SELECT p_partkey, CASE WHEN p_size % 12 > 1 THEN '0/1' ELSE '0/' || CAST(p_size % 12 AS VARCHAR) END AS gt, nullif(p_size % 12, 0) AS first FROM part")
def _(spark, d):
    gt = F.concat(F.lit("0/"), (F.col("p_size") % 12).cast("string"))
    return table(spark, d, "part").select("p_partkey", S.collapse_gt(gt).alias("gt"), S.first_alt(gt).alias("first"))


@_query("P23_borrowed", f""", g AS (SELECT site, sample, {_GT} AS gt, rr, aa FROM genotypes), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY CASE gt WHEN './.' THEN 2 WHEN '0/0' THEN 1 ELSE 0 END, sample) AS k FROM g)
SELECT site, rr, aa FROM r WHERE k = 1""", "genotypes")
def _(spark, d):
    g = view(spark, d, "genotypes").select("site", F.col("sample").alias("sample_ord"), F.expr(_GT).alias("gt"), "rr", "aa")
    return support.borrowed(g, ["rr", "aa"])


@_query("P33_34_site_genotypes", f""", g AS (SELECT site, {_GT} AS gt FROM genotypes) SELECT site, count(*) FILTER (gt NOT IN ('0/0', './.')) > 0 AS has, CAST(count(*) FILTER (gt <> './.') AS INT) AS present FROM g GROUP BY site""", "genotypes")
def _(spark, d):
    g = view(spark, d, "genotypes").groupBy("site").agg(F.collect_list(F.expr(_GT)).alias("gts"))  # a row per sample of the cohort
    return g.select("site", support.has_genotype(F.col("gts")).alias("has"), F.size(support.present(F.col("gts"))).alias("present"))


@_query("P32_shared_prefix", "SELECT q_id, CAST(list_max(list_transform(range(0, length(t_seq) + 1), lambda n: CASE WHEN substr(t_seq, 1, n) = substr(q_seq, 1, n) THEN n ELSE 0 END)) AS INT) AS n FROM aligned", "aligned")
def _(spark, d):
    return view(spark, d, "aligned").select("q_id", variants.shared_prefix(F.col("t_seq"), F.col("q_seq")).alias("n"))


@_query("P18_19_size_and_n_ratio", """SELECT q_id, CASE WHEN t_id % 2 = 0 THEN 9 ELSE length(q_seq) - length(t_seq) + 3 END AS size, round(length(regexp_replace(substr(q_seq, greatest(1, 20 - 5), least(length(q_seq), 30 + 5) - greatest(1, 20 - 5) + 1), '[^N]', '', 'g')) / (abs(-4) + 10), 6) AS n_ratio FROM aligned""", "aligned")
def _(spark, d):
    kind = F.when(F.col("t_id") % 2 == 0, "SNP").otherwise("INS")
    size = variants.variant_size(kind, F.lit(9), F.col("t_seq"), F.concat("q_seq", F.lit("AAA")))
    ratio = variants.n_ratio_around(F.col("q_seq"), F.lit(20), F.lit(30), F.lit(-4), 5)
    return view(spark, d, "aligned").select("q_id", size.cast("long").alias("size"), F.round(ratio, 6).alias("n_ratio"))


@_query("P47_concordance", f", g AS (SELECT {_GT} AS gt, CASE WHEN rr + aa > 0 THEN rr / (rr + aa) ELSE 1.0 END AS r FROM genotypes) SELECT gt, count(*) AS n, CAST(count(*) FILTER (CASE gt WHEN '1/1' THEN r > 0.4 WHEN '0/1' THEN r < 0.2 ELSE false END) AS BIGINT) AS errors FROM g GROUP BY gt", "genotypes")
def _(spark, d):
    g = genotype.reference_ratio(view(spark, d, "genotypes")).select(F.expr(_GT).alias("gt"), "ratio")
    return g.groupBy("gt").agg(F.count(F.lit(1)).alias("n"), F.count_if(qc.concordance_error(F.col("gt"), F.col("ratio"))).alias("errors"))


@_query("P52_random_reads")
def _(spark, d):
    r = _reads(spark, d).select("ref", F.col("pos").alias("at"), F.col("name_no").alias("read_no"))
    return support.random_reads(support.random_points(spark, r.groupBy("ref").agg(F.max("at").alias("len")), 500, 7), r)


@_query("J12_mates", """, a AS (SELECT q_id, q_start, q_end, max(t_start) AS s FROM intervals WHERE strand = '+' GROUP BY 1, 2, 3), e AS (SELECT q_id, q_start, q_end, max(t_start) AS s FROM intervals WHERE strand = '-' GROUP BY 1, 2, 3)
SELECT q_id, q_start, q_end, a.s AS t_start_a, e.s AS t_start_e FROM a FULL JOIN e USING (q_id, q_start, q_end)""", "intervals")
def _(spark, d):
    v = view(spark, d, "intervals").groupBy("q_id", "q_start", "q_end", (F.col("strand") == "-").alias("expected")).agg(F.max("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.max("t_id").alias("t_id"))
    return support.translocation_mates(v).select("q_id", "q_start", "q_end", "t_start_a", "t_start_e")


@_query("J16_candidates", f"WITH r AS ({_READS}) SELECT rg, count(*) AS n FROM r WHERE (rg, name_no) IN (SELECT rg, name_no FROM r WHERE flag < 200) GROUP BY rg")
def _(spark, d):
    r = _reads(spark, d).withColumnRenamed("name_no", "name")
    return support.candidates(r, r.where("flag < 200").select("rg", "name")).groupBy("rg").agg(F.count(F.lit(1)).alias("n"))


@_query("J09_with_lengths", "SELECT l_orderkey AS line, o_custkey AS len FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.lit("s").alias("sample"), F.col("l_orderkey").alias("scaffold"))
    ln = table(spark, d, "orders").select(F.lit("s").alias("sample"), F.col("o_orderkey").alias("scaffold"), F.col("o_custkey").alias("len"))
    return support.with_lengths(rows, ln).select(F.col("scaffold").alias("line"), "len")


@_query("J06_overlap_semi", """SELECT t_id, q_id, t_start, line_no FROM intervals a WHERE EXISTS (SELECT 1 FROM intervals b WHERE b.line_no = 7 AND b.t_id = a.t_id AND a.t_start <= b.t_end AND a.t_end >= b.t_start)""", "intervals")
def _(spark, d):
    v = view(spark, d, "intervals")
    out = intervals.interval_join(v, v.where("line_no = 7"), "t_id", ("t_start", "t_end"), ("t_start", "t_end"), bits=5, how="left_semi")
    return out.select("t_id", "q_id", "t_start", "line_no")


@_query("W03_furthest", _FURTHEST + " SELECT t_id, q_id, line_no, p.e AS prev_end, p.q AS prev_q FROM r WHERE p IS NOT NULL", "intervals")
def _(spark, d):
    return intervals.furthest(view(spark, d, "intervals")).where("prev is not null").select("t_id", "q_id", "line_no", F.col("prev.end").alias("prev_end"), F.col("prev.q_id").alias("prev_q"))


@_query("A18_threshold_counts", "SELECT filter AS culprit, count(*) AS n, " + ", ".join(f"count(*) FILTER (size >= {t}) AS lod{t}" for t in range(5)) + " FROM sites GROUP BY filter", "sites")
def _(spark, d):
    return recalibrate.culprits(view(spark, d, "sites").select(F.col("filter").alias("culprit"), F.col("size").alias("lod")))


@_query("A33_count_region", f"WITH r AS ({_READS}) SELECT count(*) AS n FROM r WHERE ref = '3' AND pos BETWEEN 100 AND 2000")
def _(spark, d):
    return reads.count_reads(reads.in_region(_reads(spark, d), "3:100..2,000", [str(i) for i in range(20)]))


@_query("P50_regions", f"WITH r AS ({_READS}) SELECT 'across' AS region, count(*) AS n FROM r WHERE ref = '3' AND pos >= 4000 OR ref = '4' OR ref = '5' AND pos <= 70 UNION ALL SELECT 'on', count(*) FROM r WHERE ref = '7' AND pos >= 900 UNION ALL SELECT 'whole', count(*) FROM r WHERE ref = '19'")
def _(spark, d):
    r, order = _reads(spark, d), [str(i) for i in range(20)]
    parts = [reads.count_reads(reads.in_region(r, text, order)).select(F.lit(name).alias("region"), "n") for name, text in (("across", "3:4000..5:70"), ("on", "7:900"), ("whole", "19"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query("K11_histogram", "SELECT CAST(least(19, floor((vq - 0) * 20 / 100.0)) AS INT) AS bin, count(*) AS n FROM sites WHERE vq BETWEEN 0 AND 100 GROUP BY 1", "sites")
def _(spark, d):
    return support.histogram(view(spark, d, "sites"), "vq", 0, 100, 20)


@_query("O05_fixed_order", "SELECT r_regionkey, r_name FROM region WHERE r_name IN ('EUROPE', 'ASIA', 'AFRICA')")
def _(spark, d):
    from varloom.sources.readers import in_order_of

    return in_order_of(table(spark, d, "region").select("r_regionkey", "r_name"), "r_name", ["EUROPE", "ASIA", "AFRICA"])


@_query("S21_full_merge", "SELECT user_id AS chrom, string_agg(event_id || '=' || CASE WHEN value < 50 THEN '0/1' ELSE '1/1' END || ':' || event_type, ',' ORDER BY event_id) AS samples FROM events GROUP BY user_id")
def _(spark, d):
    t = table(spark, d, "events").select(F.col("user_id").alias("chrom"), F.lit(1).alias("pos"), F.lit("A").alias("ref"), F.col("event_id").alias("sample_ord"), F.when(F.col("value") < 50, "0/1").otherwise("1/1").alias("gt"), F.col("event_type").alias("alt"))
    parts = [t.where(F.col("sample_ord") % 3 == k) for k in range(3)]
    cell = lambda x: F.concat(x["sample_ord"].cast("string"), F.lit("="), x["gt"], F.lit(":"), x["alt"])
    return support.full_merge(parts).select("chrom", F.array_join(F.transform("samples", cell), ",").alias("samples"))


@_query("K13_bed_lines", f"""WITH r AS ({_READS}) SELECT ref || chr(9) || CAST(pos - 1 AS VARCHAR) || chr(9) || CAST(pos + 9 AS VARCHAR) || chr(9) || CAST(name_no AS VARCHAR) || chr(9) || CAST(mapq AS VARCHAR) || chr(9) || CASE WHEN {_BIT(16)} THEN '-' ELSE '+' END AS value FROM r""")
def _(spark, d):
    return reads.bed_line(_reads(spark, d).withColumn("cigar", reads.parse_cigar(F.lit("10M"))).withColumnRenamed("name_no", "name"))


# Text outputs, and files that are written and read back.
_LENGTHS = ", tl AS (SELECT t_id AS id, max(t_end) + 7 AS len FROM intervals GROUP BY t_id), ql AS (SELECT q_id AS id, max(q_end) + 5 AS len FROM intervals GROUP BY q_id)"


@_query("K01_call_table", _LENGTHS + """, f AS (SELECT *, CASE type WHEN 'INS' THEN 1 WHEN 'DEL' THEN 2 ELSE 9 END AS rank FROM intervals),
b AS (SELECT f.*, tl.len AS a, ql.len AS b, concat_ws(chr(9), q_id, q_start, q_end, q_end - q_start + 1, ql.len, strand, score, CAST(round(mismap, 3) AS VARCHAR)) AS q FROM f JOIN tl ON tl.id = t_id JOIN ql ON ql.id = q_id)
SELECT CAST(rank AS INT) AS rank, t_id, t_start, t_end, 1 AS part, concat_ws(chr(9), t_id, t_start, t_end, t_end - t_start + 1, a, regexp_replace(regexp_replace(q, '0+$', ''), '[.]$', ''), type, CASE WHEN score > 25 THEN 'CanAGE' ELSE 'CanotAGE' END) AS value FROM b
UNION ALL SELECT CAST(rank AS INT), t_id, t_start, t_end, 2, concat_ws(chr(9), t_id, t_start + 1, t_end + 3, t_end - t_start + 3, a, regexp_replace(regexp_replace(q, '0+$', ''), '[.]$', ''), type || '-E') FROM b WHERE score % 7 = 0""", "intervals")
def _(spark, d):
    v = view(spark, d, "intervals")
    moved = lambda c: F.when(F.col("score") % 7 == 0, c)
    calls = v.withColumns({"family": writers.families(F.col("type")), "realigned": F.col("score") > 25, "expected_id": moved(F.col("t_id")), "expected_start": moved(F.col("t_start") + 1), "expected_end": moved(F.col("t_end") + 3)})
    return writers.call_lines(calls, lengths(v, "t_id", "t_end", 7).withColumnRenamed("t_id", "id"), lengths(v, "q_id", "q_end", 5).withColumnRenamed("q_id", "id"))


@_query("K02_gap_lines", """, r AS (SELECT *, max(struct_pack(e := t_end, s := -t_start, q := q_id, qs := q_start, qe := q_end)) OVER (PARTITION BY t_id ORDER BY t_start, t_end, q_id, q_start, q_end, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM intervals)
SELECT t_id, t_start, concat_ws(chr(9), t_id, CASE WHEN p.e >= t_start - 1 THEN p.e ELSE p.e + 1 END, CASE WHEN p.e >= t_start - 1 THEN t_start ELSE t_start - 1 END, t_start - p.e - 1, CASE WHEN p.e >= t_start - 1 THEN 'Overlap' ELSE 'InterGap' END,
concat(t_id, ':', -p.s, '-', p.e, '|', p.q, ':', p.qs, '-', p.qe, '#', t_id, ':', t_start, '-', t_end, '|', q_id, ':', q_start, '-', q_end)) AS value FROM r WHERE p.q IS NOT NULL AND p.q <> q_id""", "intervals")
def _(spark, d):
    return writers.gap_lines(view(spark, d, "intervals"))


@_query("K04_summary_lines", _LENGTHS + f""", s AS (SELECT '2.[VCF]' || type AS key, count(*) AS num, CAST(sum(greatest(t_end - t_start, q_end - q_start)) AS BIGINT) AS len FROM intervals GROUP BY type),
r AS (SELECT *, {_REACH} AS reach FROM intervals), c AS (SELECT t_id, CAST(sum(greatest(0, t_end - greatest(t_start - 1, coalesce(reach, t_start - 1)))) AS BIGINT) AS covered FROM r GROUP BY t_id)
SELECT 1 AS rank, key, concat_ws(chr(9), key, num, len) AS value FROM s
UNION ALL SELECT 2, CAST(t_id AS VARCHAR), concat_ws(chr(9), '# ' || t_id, covered || '/' || len, printf('%g', covered / len)) FROM c JOIN tl ON tl.id = t_id""", "intervals")
def _(spark, d):
    v = view(spark, d, "intervals")
    return writers.summary_lines(variants.vcf_summary(v), intervals.covered_length(v, ["t_id"], "t_start", "t_end"), lengths(v, "t_id", "t_end", 7).withColumnRenamed("t_id", "id"))


@_query("K12_coverage_lines", """, e AS (SELECT t_id AS ref, type, unnest(range(t_start, t_end + 1)) AS pos FROM intervals)
SELECT ref, pos, concat_ws(chr(9), ref, pos, count(*), count(*) FILTER (type = 'INS'), 0, count(*) FILTER (type = 'DEL'), 0, 0, count(*) FILTER (type = 'SNP'), 0) AS value FROM e GROUP BY ref, pos""", "intervals")
def _(spark, d):
    v = view(spark, d, "intervals").select(F.col("t_id").alias("ref"), F.col("t_start").alias("start"), F.col("t_end").alias("end"), "type")
    kind = F.when(F.col("type") == "INS", "properPair").when(F.col("type") == "DEL", "crossSignal").otherwise("single")
    return writers.coverage_lines(v.select("ref", kind.alias("class"), "start", "end"), v.select("ref", "start", "end"))


@_query("K10_qc_summary", """, f AS (SELECT CASE WHEN nr * 6 > 0.5 OR inb >= 0.7 OR inb <= -0.7 THEN 'FALSE' WHEN vq >= 40 THEN 'PASS' ELSE 'q40' END AS f FROM sites)
SELECT count(*) AS total, count(*) FILTER (f = 'PASS') AS pass, count(*) FILTER (f = 'q40') AS low, count(*) FILTER (f = 'FALSE') AS "false", count(*) FILTER (f LIKE 'DUPLIC%') AS duplic,
printf('%.3f', count(*) FILTER (f = 'PASS') / count(*)) AS pass_ratio, printf('%.3f', count(*) FILTER (f = 'q40') / count(*)) AS low_ratio, printf('%.3f', count(*) FILTER (f = 'FALSE') / count(*)) AS false_ratio, '0.000' AS duplic_ratio FROM f""", "sites")
def _(spark, d):
    v = view(spark, d, "sites").withColumn("mark", qc.bad_mark(F.col("nr") * 6, F.col("inb")))
    return writers.qc_summary(v.select("line_no", qc.filter_decision(F.col("mark"), F.col("vq"), 40, F.col("filter")).alias("filter")))


@_query("S05_fasta_read_back", """WITH s AS (SELECT doc_id, translate(regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z]', 'N', 'g'), 'BDEFHIJKLMOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTA') AS seq FROM documents WHERE length(text) > 0)
SELECT 'd' || doc_id AS id, CAST(length(seq) AS BIGINT) AS len, CAST(length(regexp_replace(seq, '[^Nn]', '', 'g')) AS BIGINT) AS n_len, md5(seq) AS bases FROM s""")
def _(spark, d):
    return files.read_back(spark, "fasta", files.fasta_of(table(spark, d, "documents"))).select("id", "len", "n_len", F.md5("seq").alias("bases"))


@_query("S01_maf_read_back", """, n AS (SELECT *, length(replace(t_seq, '-', '')) AS tn, length(replace(q_seq, '-', '')) AS qn FROM aligned)
SELECT q_id AS score, 't' || t_id AS t_id, t_start, t_start + tn - 1 AS t_end, 'q' || q_id AS q_id, CASE WHEN t_id % 2 = 1 THEN 10000000 - (q_start - 1 + qn) + 1 ELSE q_start END AS q_start,
CASE WHEN t_id % 2 = 1 THEN 10000000 - q_start + 1 ELSE q_start + qn - 1 END AS q_end, CASE WHEN t_id % 2 = 1 THEN '-' ELSE '+' END AS strand, 0.00001 AS mismap, t_seq, q_seq FROM n WHERE tn > 0 AND qn > 0""", "aligned")
def _(spark, d):
    some = F.col("t_seq").rlike("[^-]") & F.col("q_seq").rlike("[^-]")
    return files.read_back(spark, "maf", files.maf_of(view(spark, d, "aligned").where(some)))


@_query("S10_vcf_read_back", """SELECT CAST(chrom AS VARCHAR) AS chrom, start AS pos, 'r' || line_no AS id, CAST(vq AS DOUBLE) AS qual, filter, CAST(size AS VARCHAR) AS ac, type AS vt FROM sites""", "sites")
def _(spark, d):
    sites, calls = files.read_back(spark, "vcf", files.vcf_of(view(spark, d, "sites")))
    vt = calls.where("sample = 's1'").select("line_no", F.col("fmt")["VT"].alias("vt"))
    return sites.join(vt, "line_no").select("chrom", "pos", "id", "qual", F.array_join("filters", ";").alias("filter"), F.col("info")["AC"].alias("ac"), "vt")


@_query("S15_sam_read_back", f"""WITH r AS ({_READS}) SELECT 'r' || name_no AS name, flag, ref, pos, mapq, mate_ref, mate_pos, insert_size, rg, CAST(mapq AS VARCHAR) AS score, pos + 8 AS last FROM r""")
def _(spark, d):
    r = files.read_back(spark, "sam", files.sam_of(_reads(spark, d)))
    return r.select("name", "flag", "ref", "pos", "mapq", "mate_ref", "mate_pos", "insert_size", F.col("tags")["RG"].alias("rg"), F.col("tags")["AS"].alias("score"), reads.alignment_end(F.col("pos"), F.col("cigar")).cast("long").alias("last"))


_SEQUENCES = """s AS (SELECT doc_id, translate(regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z]', 'N', 'g'), 'BDEFHIJKLMOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTA') AS seq FROM documents WHERE length(text) > 0)"""


@_query("S24_fetch", f"""WITH {_SEQUENCES}, r AS (SELECT s.*, 1 + (doc_id * 37 + 11 * k) % length(seq) AS a, CASE k WHEN 0 THEN 1 WHEN 1 THEN 90 ELSE 1500 END AS n FROM s, (VALUES (0), (1), (2)) v(k))
SELECT 'd' || doc_id AS id, CAST(a AS BIGINT) AS start, CAST(a + n - 1 AS BIGINT) AS "end", substr(seq, CAST(a AS BIGINT), n) AS seq FROM r""")
def _(spark, d):
    """Three regions of each record of a FASTA file, one of them longer than a piece."""
    docs = table(spark, d, "documents")
    path = files.as_file(files.fasta_of(docs), "fasta")
    sizes = F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in enumerate((1, 90, 1500))]))
    regions = docs.where("length(text) > 0").select("doc_id", F.length("text").alias("len"), sizes).select(F.concat(F.lit("d"), "doc_id").alias("id"), (1 + (F.col("doc_id") * 37 + 11 * F.col("k")) % F.col("len")).alias("start"), "n")
    regions = regions.select("id", "start", (F.col("start") + F.col("n") - 1).alias("end"))
    return readers.fetch(regions, places.fasta_pieces(spark, path, 1000, 100), 1000, 100)


@_query("S05_fasta_lengths", f"WITH {_SEQUENCES} SELECT 'd' || doc_id AS id, CAST(length(seq) AS BIGINT) AS len, CAST(length(regexp_replace(seq, '[^Nn]', '', 'g')) AS BIGINT) AS n_len FROM s")
def _(spark, d):
    return places.fasta_lengths(spark, files.as_file(files.fasta_of(table(spark, d, "documents")), "fasta")).drop("fa")


@_query("S22_merged", f"""WITH r AS ({_READS}), f AS (SELECT *, CAST(name_no % 3 AS INT) AS file_no FROM r)
SELECT 'r' || name_no AS name, flag, ref, pos, mapq, rg, row_number() OVER (ORDER BY CAST(ref AS INT), pos, file_no, name_no, flag, mapq, insert_size, mate_ref, mate_pos, rg) - 1 AS merged_no FROM f""")
def _(spark, d):
    """Three sorted files of reads as one, in the order of a merge."""
    r = _reads(spark, d)
    order = [F.col("ref").cast("int"), *map(F.col, ("pos", "name_no", "flag", "mapq", "insert_size", "mate_ref", "mate_pos", "rg"))]
    parts = [files.as_file(files.sam_of(r.where(F.col("name_no") % 3 == n).orderBy(*order)), "sam") for n in range(3)]
    rows = readers.read_sam(spark, parts).withColumn("ref_no", F.col("ref").cast("int"))
    out = places.merged_order(rows, ["ref_no", "pos", "line_no"])
    return out.select("name", "flag", "ref", "pos", "mapq", F.col("tags")["RG"].alias("rg"), "merged_no")


@_query("J11_line_numbers", """WITH a AS (SELECT 'r' || event_id AS v, event_id FROM events WHERE event_id % 5 = 0), b AS (SELECT 'o' || o_orderkey AS v, o_orderkey FROM orders)
SELECT row_number() OVER (ORDER BY event_id) AS line_no, v AS value FROM a UNION ALL SELECT (SELECT count(*) FROM a) + row_number() OVER (ORDER BY o_orderkey), v FROM b""")
def _(spark, d):
    a = table(spark, d, "events").where("event_id % 5 = 0").orderBy("event_id").select(F.concat(F.lit("r"), "event_id").alias("value"))
    b = table(spark, d, "orders").orderBy("o_orderkey").select(F.concat(F.lit("o"), "o_orderkey").alias("value"))
    return places.numbered(spark, [files.as_file(a, "lines"), files.as_file(b, "lines")])


@_query("P49_compound_filter", f"""WITH r AS ({_READS}) SELECT ref, count(*) AS n FROM r WHERE NOT (mapq >= 30 AND {_BIT(1)} OR NOT (ref = '7' AND NOT {_BIT(1024)})) OR insert_size < -50 AND NOT mapq < 20 GROUP BY ref""")
def _(spark, d):
    script = """{"filters": [{"id": "good", "mapQuality": ">=30"}, {"id": "pair", "isPaired": "true"}, {"id": "seven", "reference": "7"}, {"id": "dup", "isDuplicate": "true"},
      {"id": "short", "insertSize": "<-50"}, {"id": "low", "mapQuality": "<20"}], "rule": "!(good & pair | !(seven & !dup)) | short & !low"}"""
    return _reads(spark, d).where(reads.filter_script(script)).groupBy("ref").agg(F.count(F.lit(1)).alias("n"))


@_query("S16_bam_read_back", f"""WITH r AS ({_READS}) SELECT 'r' || name_no AS name, flag, ref, pos, mapq, mate_ref, mate_pos, insert_size, rg, CAST(mapq AS VARCHAR) AS score, pos + 8 AS last FROM r""")
def _(spark, d):
    """The reads as BAM files, written by tasks and read in splits."""
    r = _reads(spark, d)
    rows = r.select(
        F.concat(F.lit("r"), "name_no").alias("name"), "flag", "ref", "pos", "mapq", reads.parse_cigar(F.lit("4M1I5M")).alias("cigar"), "mate_ref", "mate_pos", "insert_size", F.lit("ACGTACGTAC").alias("seq"),
        F.lit("IIIIIIIIII").alias("qual"), F.create_map(F.lit("RG"), "rg", F.lit("AS"), F.col("mapq").cast("string")).alias("tags"),
    )
    path = new_path(spark, "bam")
    bam.write_bam(rows, path, [(str(i), 10_000) for i in range(20)], block_bytes=16_384)
    b = bam.read_bam(spark, path, 1 << 15)
    return b.select("name", "flag", "ref", "pos", "mapq", "mate_ref", "mate_pos", "insert_size", F.col("tags")["RG"].alias("rg"), F.col("tags")["AS"].alias("score"), reads.alignment_end(F.col("pos"), F.col("cigar")).cast("long").alias("last"))


@_query("S23_indexed_regions", """, w AS (SELECT t_id, t_start * 997 AS s, t_end * 997 + CASE WHEN line_no = 1 THEN 9000000 ELSE 0 END AS e, q_id, line_no FROM intervals)
SELECT * FROM w WHERE (t_id = 3 AND s <= 8600000 AND e >= 8500000) OR (t_id = 7 AND s <= 17000000 AND e >= 16777000) OR t_id = 5""", "intervals")
def _(spark, d):
    """Three regions of a table that is clustered by bins; of the others no file is opened."""
    v = view(spark, d, "intervals").select("t_id", (F.col("t_start") * 997).alias("s"), (F.col("t_end") * 997 + F.when(F.col("line_no") == 1, 9_000_000).otherwise(0)).alias("e"), "q_id", "line_no")
    path = new_path(spark, "regions")
    regions.write_regions(v, path, "t_id", "s", "e")
    return regions.read_regions(spark, path, ["3:8,500,000-8,600,000", "7:16,777,000-17,000,000", "5"], "t_id", "s", "e").select("t_id", "s", "e", "q_id", "line_no")


@_query("A33_indexed_count", """, w AS (SELECT t_id, t_start * 997 AS s, t_end * 997 + CASE WHEN line_no = 1 THEN 9000000 ELSE 0 END AS e FROM intervals) SELECT count(*) AS n FROM w WHERE t_id = 3 AND s <= 10000000 AND e >= 8500000""", "intervals")
def _(spark, d):
    v = view(spark, d, "intervals").select("t_id", (F.col("t_start") * 997).alias("s"), (F.col("t_end") * 997 + F.when(F.col("line_no") == 1, 9_000_000).otherwise(0)).alias("e"))
    path = new_path(spark, "regions")
    regions.write_regions(v, path, "t_id", "s", "e")
    return regions.count_region(spark, path, "3:8,500,000-10,000,000", "t_id", "s", "e")


# Reads of 12 bases over the documents' records: four match, one inserted, two match, two deleted, three match and two clipped.
_PILE_READS = f"""{_SEQUENCES}, n AS (SELECT *, length(seq) AS len FROM s WHERE length(seq) >= 60),
r AS (SELECT doc_id, seq, len, k, 1 + (doc_id * 31 + 7 * k) % (len - 20) AS pos, (doc_id + k) % 3 = 0 AS rev, CAST(20 + (doc_id + k) % 40 AS INT) AS mapq FROM n, range(8) t(k))"""


def _pile_reads(spark, d):
    """The reads and the pieces of their sequences."""
    docs = table(spark, d, "documents")
    path = files.as_file(files.fasta_of(docs), "fasta")
    n = docs.where("length(text) >= 60").select("doc_id", F.length("text").alias("len"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    rev = (F.col("doc_id") + F.col("k")) % 3 == 0
    rows = n.select(
        (F.col("doc_id") * 8 + F.col("k")).alias("line_no"), F.concat(F.lit("d"), "doc_id").alias("ref"), (1 + (F.col("doc_id") * 31 + 7 * F.col("k")) % (F.col("len") - 20)).cast("long").alias("pos"),
        F.when(rev, 16).otherwise(0).alias("flag"), (20 + (F.col("doc_id") + F.col("k")) % 40).cast("int").alias("mapq"), reads.parse_cigar(F.lit("4M1I2M2D3M2S")).alias("cigar"),
        F.lit("ACGTTACGTACG").alias("seq"), F.lit("ABCDEFGHIJKL").alias("qual"),
    )
    return rows, places.fasta_pieces(spark, path, 1000, 100)


@_query("K13_pileup", f"""WITH {_PILE_READS}, o(i, b, q, kind) AS (VALUES (0, 'A', 'A', 'begin'), (1, 'C', 'B', ''), (2, 'G', 'C', ''), (3, 'T', 'D', 'ins'), (4, 'A', 'F', ''), (5, 'C', 'G', 'del'), (6, '', 'H', 'gone'), (7, '', 'I', 'gone'), (8, 'G', 'H', ''), (9, 'T', 'I', ''), (10, 'A', 'J', 'end')),
p AS (SELECT doc_id, k, pos + i AS pos, q, rev, mapq, kind, upper(substr(seq, CAST(pos + i AS BIGINT), 1)) AS base, upper(substr(seq, CAST(pos + i + 1 AS BIGINT), 2)) AS gone,
CASE WHEN kind = 'gone' THEN '*' WHEN b = upper(substr(seq, CAST(pos + i AS BIGINT), 1)) THEN CASE WHEN rev THEN ',' ELSE '.' END WHEN rev THEN lower(b) ELSE b END AS own FROM r, o),
t AS (SELECT *, CASE WHEN kind = 'begin' THEN '^' || chr(mapq + 33) ELSE '' END || own || CASE kind WHEN 'ins' THEN '+1' || CASE WHEN rev THEN 't' ELSE 'T' END WHEN 'del' THEN '-2' || CASE WHEN rev THEN lower(gone) ELSE gone END WHEN 'end' THEN '$' ELSE '' END AS txt, row_number() OVER (PARTITION BY doc_id ORDER BY r0, k) AS ord
FROM (SELECT p.*, p.pos - o.i AS r0 FROM p JOIN o ON o.q = p.q AND o.kind = p.kind))
SELECT 'd' || doc_id || chr(9) || pos || chr(9) || min(base) || chr(9) || count(*) || chr(9) || string_agg(txt, '' ORDER BY r0, k) || chr(9) || string_agg(q, '' ORDER BY r0, k) || chr(9) || string_agg(chr(mapq + 33), '' ORDER BY r0, k) AS value FROM t GROUP BY doc_id, pos""")
def _(spark, d):
    rows, pieces = _pile_reads(spark, d)
    return pileup.pileup_lines(pileup.pileup(rows, pieces, 1000, 100), mapqs=True).select("value")


@_query("A34_pileup_depth", f"""WITH {_PILE_READS}, p AS (SELECT 'd' || doc_id AS ref, unnest(range(CAST(pos AS BIGINT), CAST(pos + 11 AS BIGINT))) AS pos FROM r) SELECT ref, pos, count(*) AS depth FROM p GROUP BY ref, pos""")
def _(spark, d):
    return pileup.pileup(_pile_reads(spark, d)[0]).select("ref", "pos", "depth")


# Scalar functions over arrays, predicates of three alignments, validation of order.
_FLOATS = "WITH g AS (SELECT o_custkey AS k, list(o_totalprice / 1000 ORDER BY o_orderkey) AS v FROM orders GROUP BY o_custkey)"


@_query("F13_14_20_array_functions", _FLOATS + """ SELECT k, array_to_string(list_transform(v, lambda x: CAST(CAST(floor(x) AS BIGINT) AS VARCHAR)), ';') AS joined, round(list_avg(v), 10) AS mean, round(list_var_pop(v), 4) AS variance,
round(list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))), 6) AS lse, round(-0.5 * power((list_avg(v) - 100) / 30, 2) - ln(30) - 0.5 * ln(2 * pi()), 6) AS density FROM g""")
def _(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_totalprice") / 1000).alias("x")))).alias("v"))  # a customer's orders
    g = g.withColumn("v", F.transform("v", lambda x: x["x"]))
    whole = F.transform("v", lambda x: F.floor(x).cast("string"))
    return g.select(
        "k", S.joined(whole, ";").alias("joined"), F.round(S.mean_of("v"), 10).alias("mean"), F.round(S.variance_of("v"), 4).alias("variance"), F.round(S.log_sum_exp("v"), 6).alias("lse"),
        F.round(S.log_normal(S.mean_of("v"), F.lit(100.0), F.lit(30.0)), 6).alias("density"),
    )


@_query("F16_hull", " SELECT q_id, min(t_start) AS first, max(t_end) AS second FROM intervals GROUP BY q_id", "intervals")
def _(spark, d):
    return intervals.hulls(view(spark, d, "intervals"), ["q_id"], "t_start", "t_end")


@_query("F22_places", """SELECT p_partkey, CAST(p_size AS BIGINT) - 1 AS v_first, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS BIGINT) + 9 ELSE CAST(p_size AS BIGINT) - 1 + length(p_brand) END AS v_last, CAST(p_size AS BIGINT) - 1 AS s_first, CAST(p_size AS BIGINT) - 1 + CASE WHEN p_size % 3 = 0 THEN 1 ELSE p_size + 12 END AS s_last FROM part""")
def _(spark, d):
    t = table(spark, d, "part").withColumns({"info": F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("X=1;END="), (F.col("p_size") + 9).cast("string"))).otherwise("END2=5"), "cigar": F.when(F.col("p_size") % 3 == 0, "*").otherwise(F.concat(F.lit("3S"), F.col("p_size").cast("string"), F.lit("M2I5D7N1H")))})
    return t.select("p_partkey", S.vcf_interval("p_size", "p_brand", "info").alias("v"), S.sam_interval("p_size", "cigar").alias("s")).select("p_partkey", F.col("v.first").alias("v_first"), F.col("v.last").alias("v_last"), F.col("s.first").alias("s_first"), F.col("s.last").alias("s_last"))


@_query("P09_predicates", """, v AS (SELECT 't' || CAST(t_id % 3 AS VARCHAR) AS t_id, q_id, t_start, t_end, q_start, strand, row_number() OVER (PARTITION BY q_id ORDER BY q_start, t_id, line_no) AS i FROM intervals)
SELECT a.q_id, a.i, a.t_id = c.t_id AND a.strand = c.strand AS simul, a.t_id = c.t_id AND a.strand = c.strand AND NOT (b.t_id = a.t_id AND b.t_start <= greatest(a.t_end, c.t_end) AND b.t_end >= least(a.t_start, c.t_start)) AS trans,
a.t_id = c.t_id AND a.strand = c.strand AND b.t_id = a.t_id AND b.strand <> a.strand AND b.t_start BETWEEN least(a.t_start, c.t_start) AND greatest(a.t_end, c.t_end) AS inv
FROM v a JOIN v b ON a.q_id = b.q_id AND b.i = a.i + 1 JOIN v c ON a.q_id = c.q_id AND c.i = a.i + 2""", "intervals")
def _(spark, d):
    v = view(spark, d, "intervals")
    w = Window.partitionBy("q_id").orderBy("q_start", "t_id", "line_no")
    one = F.struct(F.concat(F.lit("t"), (F.col("t_id") % 3).cast("string")).alias("t_id"), "t_start", "t_end", "strand")
    rows = v.select("q_id", "q_start", "t_id", "line_no", one.alias("a")).select("q_id", F.row_number().over(w).cast("long").alias("i"), "a", F.lead("a", 1).over(w).alias("b"), F.lead("a", 2).over(w).alias("c")).where("c is not null")
    a, b, c = (F.col(x) for x in "abc")
    return rows.select("q_id", "i", variants.simultaneous(a, c).alias("simul"), variants.translocated(a, b, c).alias("trans"), variants.inverted(a, b, c).alias("inv"))


@_query("W09_sorted", "SELECT count(*) AS n FROM orders")
def _(spark, d):
    rows = table(spark, d, "orders").select(F.lit(1).alias("k"), F.col("o_orderkey").alias("line_no"), (F.col("o_orderkey") * 3).alias("at"))
    return intervals.assert_sorted(rows, ["k"], "line_no", ["at"]).agg(F.count(F.lit(1)).alias("n"))

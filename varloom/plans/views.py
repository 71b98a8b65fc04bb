"""Projections of the driver tables onto the data model, for Spark and, as SQL text, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Alignments from order lines: target = supplier, positions = days; query = order.
INTERVALS = """
SELECT CAST(l_suppkey AS BIGINT) AS t_id, CAST({days} AS BIGINT) AS t_start, CAST({days} + CAST(l_quantity AS INT) - 1 AS BIGINT) AS t_end,
  CAST(l_orderkey AS BIGINT) AS q_id, CAST(l_partkey % 1000 + 1 AS BIGINT) AS q_start, CAST(l_partkey % 1000 + CAST(l_quantity AS INT) AS BIGINT) AS q_end,
  CASE WHEN l_linenumber % 2 = 1 THEN '+' ELSE '-' END AS strand, CAST(l_linenumber AS BIGINT) AS line_no, CAST(l_quantity AS BIGINT) AS score, l_discount / 10 AS mismap,
  CASE l_returnflag WHEN 'A' THEN 'INS' WHEN 'N' THEN 'DEL' ELSE 'SNP' END AS type
FROM lineitem"""
POINTS = "SELECT user_id AS chrom, CAST({minutes} AS BIGINT) AS pos, event_id, event_type FROM events"
#: Sites from order lines, calls of five samples.
SITES = """
SELECT CAST(o_custkey AS BIGINT) AS site, CAST(l_suppkey AS BIGINT) AS chrom, CAST({days} AS BIGINT) AS "start", CAST({days} + CAST(l_quantity AS INT) AS BIGINT) AS "end", o_orderpriority AS sample,
  CASE l_linenumber % 4 WHEN 0 THEN '1.INS' WHEN 1 THEN '2.DEL' WHEN 2 THEN '4.SNP' ELSE '9.REF' END AS type, CAST(l_quantity AS BIGINT) AS size,
  CAST(floor(l_extendedprice / 1000) AS BIGINT) AS vq, l_discount AS nr, CASE l_returnflag WHEN 'R' THEN '.' WHEN 'A' THEN 'PASS' ELSE 'LOW' END AS filter,
  CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS line_no, l_tax AS inb, CAST(l_linenumber AS INT) AS sample_ord
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
GENOTYPES = """
SELECT user_id AS site, event_type AS sample, CAST(sum(CASE WHEN value < 50 THEN 1 ELSE 0 END) AS BIGINT) AS rr, CAST(sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS aa
FROM events GROUP BY user_id, event_type"""
#: Gapped rows from text, letters onto ACGT, N and -: a whole text against itself from its second character on, cut into pieces
#: of 60 columns, a row each; i numbers them.
LETTERS, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACNTACGTACGTA-"
ALIGNED = f"""
SELECT CAST(doc_id % 50 AS BIGINT) AS t_id, CAST(doc_id * 1000000 + i AS BIGINT) AS q_id, CAST(doc_id + 1 + 60 * i AS BIGINT) AS t_start, CAST(doc_id * 2 + 1 + 60 * i AS BIGINT) AS q_start,
  translate(regexp_replace(translate(t, '{LETTERS.lower()}', '{LETTERS}'), '[^A-Z]', 'Z'{{g}}), '{LETTERS}', '{BASES}') AS t_seq,
  translate(regexp_replace(translate(q, '{LETTERS.lower()}', '{LETTERS}'), '[^A-Z]', 'E'{{g}}), '{LETTERS}', '{BASES}') AS q_seq
FROM {{pieces}}"""
_PIECES = "SELECT doc_id, regexp_extract_all(text, '(?s).{{1,60}}'{group}) AS t, regexp_extract_all(concat(substr(text, 2), ' '), '(?s).{{1,60}}'{group}) AS q FROM documents WHERE length(text) > 0"
SPARK_PIECES = f"(SELECT doc_id, i, x.t, x.q FROM (SELECT doc_id, posexplode(arrays_zip(t, q)) AS (i, x) FROM ({_PIECES.format(group=', 0').replace('{', '{{').replace('}', '}}')})))"
DUCK_PIECES = f"(SELECT doc_id, unnest(range(len(t))) AS i, unnest(t) AS t, unnest(q) AS q FROM ({_PIECES.format(group='')}))"
SPARK = {"days": "datediff(l_shipdate, DATE'1970-01-01')", "minutes": "timestampdiff(MINUTE, timestamp_ntz'2024-01-01 00:00:00', ts)", "g": "", "pieces": SPARK_PIECES}
DUCK = {"days": "date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))", "minutes": "date_diff('minute', TIMESTAMP '2024-01-01 00:00:00', ts)", "g": ", 'g'", "pieces": DUCK_PIECES}
TEXTS = {"intervals": INTERVALS, "points": POINTS, "sites": SITES, "genotypes": GENOTYPES, "aligned": ALIGNED}
_TABLES = {"intervals": ["lineitem"], "points": ["events"], "sites": ["lineitem", "orders"], "genotypes": ["events"], "aligned": ["documents"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, dealt: bool = True) -> DataFrame:
    """A view of the tables. Whole texts are dealt out before they are cut, as a file of few row groups would be as few tasks; not dealt:
    for columns that take little to make."""
    tables = {t: table(spark, sf_dir, t) for t in _TABLES[name]}
    tables |= {"documents": tables["documents"].select("doc_id", "text").repartition("doc_id")} if dealt and "documents" in tables else {}
    return spark.sql(TEXTS[name].format(**SPARK).replace('"', "`").replace("FROM lineitem", "FROM {lineitem}").replace("JOIN orders", "JOIN {orders}").replace("FROM events", "FROM {events}").replace("FROM documents", "FROM {documents}"), **tables)


def sql(name: str) -> str:
    """WITH text of a view in DuckDB."""
    return f"{name} AS ({TEXTS[name].format(**DUCK)})"


def lengths(df: DataFrame, key: str, end: str, more: int) -> DataFrame:
    return df.groupBy(key).agg((F.max(end) + more).alias("len"))

"""The corpus queries that have SQL, against DuckDB on the smallest driver tables."""

from __future__ import annotations

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
@pytest.mark.parametrize("name", ["op1_decontaminate", "op4_quality_rules", "op5_secret_scan", "op8_substring_dedup", "op13_conversation_repair"])
def test_matches_sql(spark, name):
    from varloom.llm import queries

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.fetchall())

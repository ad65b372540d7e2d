"""Corpus queries that SQL expresses give DuckDB's rows."""

import duckdb
import pytest

from logweave.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    found = con.execute(ORACLES[name])
    assert [d[0] for d in found.description] == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())

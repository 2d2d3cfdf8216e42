"""The corpus queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from lathe.llm.queries import ORACLE_SQL, QUERIES

from .test_operators import SF


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    answer = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted(tuple(r[i] for i in at) for r in answer.fetchall()) == sorted(map(tuple, df.select(*columns).collect()))

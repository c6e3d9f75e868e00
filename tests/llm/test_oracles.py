"""The operators that SQL can express, on the same tables, values included."""

import duckdb
import pytest

from erloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got = QUERIES[name](spark, sf).toPandas()
    want = con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    columns = sorted(got.columns)
    rows = lambda f: sorted(map(str, f[columns].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)

"""Each query with an SQL form gives the rows that DuckDB gives for it."""

import pytest
from compare import rows

from episodica.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(name, spark, data, duck):
    df = QUERIES[name](spark, data)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows(want.columns, want.fetchall())
    assert got

"""Every query that SQL can express gives what DuckDB gives."""

from pathlib import Path

import duckdb
import pytest

from ledgerline.jobs import catalog

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def test_every_query_has_sql():
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    df, sql = catalog.QUERIES[name](spark, str(SF)), con.sql(catalog.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    order = [sql.columns.index(c) for c in columns]
    assert ours == sorted((tuple(r[i] for i in order) for r in sql.fetchall()), key=repr)

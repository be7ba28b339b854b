"""Every registered query with SQL equals DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from rillmark.plans.queries import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Q, SQL = queries(), oracle_sql()


def plain(row):
    return tuple(round(x, 6) if isinstance(x, float) else x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x for x in row)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, con, sf_dir):
    df = Q[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = con.sql(f"select {', '.join(cols)} from ({SQL[name]})").fetchall()
    got = df.select(*cols).collect()
    assert sorted(map(plain, got), key=repr) == sorted(map(plain, want), key=repr)


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_runs(name, spark, sf_dir):
    assert Q[name](spark, sf_dir).count() > 0

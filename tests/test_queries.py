"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from scanloom.plans import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, db, name):
    made = registry.queries()[name](spark, D)
    want = db.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(made.columns) == sorted(columns)
    assert rows_of(made.columns, made.collect()) == rows_of(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, D).count() >= 0

"""Every query with SQL gives what DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from gaugeworks.plans.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return out


def shown(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return f"{v:.7g}" if isinstance(v, float) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(shown(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_duckdb(spark, db, name):
    df, want = QUERIES[name](spark, D), db.execute(ORACLE_SQL[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_the_others_run(spark, name):
    assert QUERIES[name](spark, D).count() > 0

"""Each query against its SQL, in DuckDB, over the same files."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def normal(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows) if not any(v is None for r in rows for v in r) else sorted(map(repr, rows))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, SMALL)
    want = sql.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(df.columns) == columns
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert normal(got) == normal(want.project(", ".join(columns)).fetchall())


def test_every_query_has_sql_or_a_reason():
    without = {k for k in entry.queries() if k not in entry.oracle_sql()}
    assert all(k.startswith("op") or k == "pipeline" for k in without)


def test_entry(spark):
    assert {r["label"] for r in entry.entry(spark).collect()} <= {"pos", "neg", "neu"}


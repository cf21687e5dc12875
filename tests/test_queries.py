"""Every registered timed-text query against its SQL in DuckDB, on the small tables."""

import math

import duckdb
import pytest

from cuewright.plans.oracle import ORACLE_SQL
from cuewright.plans.queries import QUERIES

TABLES = "conversations documents".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return int(v) if isinstance(v, float) and v == int(v) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_check_shuffles_once(spark, sf, capsys):
    from cuewright.operators.rules import check
    from cuewright.plans.derived import cues

    check(cues(spark, sf)).explain("simple")
    assert capsys.readouterr().out.count("Exchange hashpartitioning(doc_id") == 1

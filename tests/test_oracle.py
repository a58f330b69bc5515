"""Every registered plan against its SQL on the small tables."""

import math

import duckdb
import pytest

from tallyloom.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_says_the_same(spark, duck, small, name):
    want = duck.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, small)
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in want.fetchall()), key=str)
    seen = sorted((tuple(map(plain, r)) for r in got.select(*sorted(got.columns)).collect()), key=str)
    assert len(seen) == len(expected)
    for a, b in zip(seen, expected):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and x == pytest.approx(y, abs=2e-5)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_run_and_repeat(spark, small, name):
    rows = sorted(map(str, QUERIES[name](spark, small).collect()))
    assert rows and rows == sorted(map(str, QUERIES[name](spark, small).collect()))


def test_entry_and_guard(spark, monkeypatch):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    monkeypatch.setattr(__spark_entry__, "_llm", None)
    jobs = {"job1_incremental_counts", "job2_region_extract"}
    assert set(__spark_entry__.queries()) == set(QUERIES) | jobs and set(__spark_entry__.oracle_sql()) == set(ORACLE_SQL) | jobs

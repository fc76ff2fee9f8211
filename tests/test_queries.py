"""Every registered query against its SQL, on the smallest tables."""

import datetime
import decimal
import math
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from rowgate.plans import file_oracle, file_queries, oracle, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def value(x):
    if x is None or isinstance(x, bool | str):
        return x
    if isinstance(x, datetime.datetime | datetime.date):
        return str(x)[:19].removesuffix(" 00:00:00")
    if isinstance(x, decimal.Decimal | int | float):
        return None if isinstance(x, float) and math.isnan(x) else round(float(x), 6)
    return str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


SQL = oracle.SQL | file_oracle.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = {f.__name__: f for f in queries.QUERIES + file_queries.QUERIES}[name](spark, DATA)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted((tuple(value(x) for x in r) for r in want.fetchall()), key=str)
    assert sorted((tuple(value(r[n]) for n in names) for r in df.collect()), key=str) == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["rowgate.llm", "corpus_pipeline"])
def test_registry_without_the_corpus_part(monkeypatch, missing):
    for name in [m for m in sys.modules if m.startswith(missing)]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)  # an import of it fails
    assert set(entry.queries()) == {f.__name__ for f in queries.QUERIES + file_queries.QUERIES} and set(entry.oracle_sql()) == set(SQL)


def test_capture_of_one_run_has_no_difference(spark):
    from rowgate.operators import compare

    run = queries.batch(spark, DATA)
    one = compare.capture(run.decided, run.alerts)
    assert compare.diff_captures(one, one).count() == 0

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from graphloom.plans import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "documents essay chunks triples relations nodes kg name_vectors eval_items source_targets".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_like_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(driver.oracle_sql()[name])
    at = [d[0] for d in want.description]
    assert sorted(at) == columns
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in want.fetchall()), key=repr)


def test_answers_hold_whole_chunks(spark, monkeypatch):
    monkeypatch.setattr(core.json_repair, "parsed", lambda raw, kind: F.when(F.length(raw) > 2000, raw))
    assert driver.queries()["json_answers"](spark, SF).filter("parsed").count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(core.QUERIES.keys() - core.SQL.keys()))
def test_without_sql(spark, name):
    assert driver.queries()[name](spark, SF).count() > 0

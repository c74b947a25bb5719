"""Operators that SQL can express, against DuckDB on the given tables."""

import os

import duckdb
import pytest

from fundloom.llm import shared
from fundloom.llm.queries import QUERIES, SQL
from tests.test_queries import TABLES, plain


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '/root/testdata/sf{sf}/{t}.parquet'")
    df, want = QUERIES[name](spark, f"/root/testdata/sf{sf}"), con.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)


def test_scratch_tables_can_be_cleared(spark):
    kept = shared.saved(spark.range(3), "numbers")
    assert spark.read.parquet(kept).count() == 3 and shared.clear_scratch(spark) > 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(kept)


def test_archives_and_media_are_cleared_too(spark):
    shared.clear_scratch(spark)
    had = set(os.listdir(shared.scratch_dir(spark)))
    for name in ("op4_warc", "op7_media"):
        QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert set(os.listdir(shared.scratch_dir(spark))) > had and shared.clear_scratch(spark) > 0
    assert set(os.listdir(shared.scratch_dir(spark))) <= had


@pytest.mark.parametrize("size", [10, 10**9])
def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch, size):
    monkeypatch.setattr(shared, "BROADCAST_BYTES", size)
    narrow = shared.materialize(spark.range(50).selectExpr("id", "array(id, id) as xs", "cast(id as string) as s"), "narrow")
    big = spark.range(100)
    plan = shared.attach(big, narrow, ["id"])
    assert plan.count() == 50
    assert ("ResolvedHint (strategy=broadcast)" in plan._jdf.queryExecution().analyzed().toString()) == (size > 10)

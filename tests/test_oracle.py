"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tallyforge.plans import more, parsing, texts

QUERIES, SQL = more.QUERIES | parsing.QUERIES | texts.QUERIES, more.SQL | parsing.SQL | texts.SQL


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NaT or v != v:
            return ""
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10]
        try:
            return f"{float(v):.4f}"
        except (TypeError, ValueError):
            return str(v)

    columns = sorted(frame.columns)
    return sorted(tuple(map(text, r)) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf, duck, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


def test_same_with_one_partition(spark, sf):
    query = QUERIES["dedupe_register_debit"]
    many = canonical(query(spark, sf).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert canonical(query(spark, sf).toPandas()) == many
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")

"""Every registered query with SQL against DuckDB, and all of them under two partition counts."""

import os

import duckdb
import pandas as pd
import pytest

from folioscan.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return connection


def plain(x):
    if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
        return None
    if isinstance(x, float):  # pandas holds whole numbers with nulls among them as floats, or not
        return int(x) if x.is_integer() else round(x, 9)
    return x


def normal(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(plain(x) for x in row)) for row in df.astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(name, spark, sf, duck):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_do_not_depend_on_partitions(name, spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    first = normal(registry.QUERIES[name](spark, sf).toPandas())
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert first == normal(registry.QUERIES[name](spark, sf).toPandas()) and first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(entry.REPO)

"""Registration of queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


class Shared:
    """Input columns made from a driver table by expressions that Spark and plain SQL read alike."""

    def __init__(self, table: str, **columns: str):
        self._table, self._columns = table, columns

    @property
    def sql(self) -> str:
        return f"SELECT {', '.join(f'{e} AS {name}' for name, e in self._columns.items())} FROM {self._table}"

    def of(self, t: Tables) -> DataFrame:
        return getattr(t, self._table).selectExpr(*(f"{e} AS {name}" for name, e in self._columns.items()))


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Registers a function of the tables under its name; sql: the same result in SQL."""

    def add(of: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return of(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = of.__name__, of.__doc__
        QUERIES[of.__name__] = run
        if sql:
            ORACLES[of.__name__] = sql
        return run

    return add

"""What a client keeps: tables whose broken copies give way to the last good one, and history within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.sources import versions


def load_or_last_good(spark: SparkSession, path: str, schema: str, store: str, key: str) -> DataFrame:
    """The JSON lines at `path`; if one of them is broken, or the path is gone, the last good rows instead.

    Good rows become a version of the table at `store` (by `key`, rows without it are left out);
    a copy with a broken line changes nothing there. Before the first good copy there are no rows.
    """
    kinds = T.StructType([*spark.createDataFrame([], schema).schema.fields, T.StructField("_broken", T.StringType())])
    try:
        lines = spark.read.text(path).where("trim(value) <> ''")
        read = lines.select(F.from_json("value", kinds, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("x")).select("x.*")
        broken = not read.where("_broken is not null").isEmpty()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        broken = True
    if not broken:
        versions.merge(store, read.drop("_broken"), key)
    if versions.manifest(spark, store) is None:
        return spark.createDataFrame([], schema)
    return versions.read_version(spark, store)


def shed_to_budget(rows: DataFrame, owner: str, newest: str, tie: str, size: str, budget: int, least: int = 5) -> DataFrame:
    """The newest rows of each owner whose sizes together stay within the budget, `least` of them at any rate.

    Rows are taken from the newest on (ties by `tie`) until the budget is over; what comes after
    goes, however small it is. A null size counts 0.
    """
    own = Window.partitionBy(owner).orderBy(F.desc(newest), tie)
    held = rows.withColumn("_sum", F.sum(F.coalesce(size, F.lit(0))).over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_place", F.row_number().over(own))
    return held.where((F.col("_sum") <= budget) | (F.col("_place") <= least)).drop("_sum", "_place")

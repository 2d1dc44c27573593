import random

from folioscan.llm.components import connected_components


def test_random_graphs_paths_and_stars(spark):
    r = random.Random(3)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(50)] + [(5, 5), (None, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    found = {x.node: x.label for x in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {x: find(x) for x in parent}


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_scratch_can_be_cleared(spark):
    from folioscan.llm.common import clear_scratch, materialize

    held = materialize(spark.range(3), "held")
    path = held.inputFiles()[0]
    clear_scratch(spark)
    import os

    assert not os.path.exists(path.removeprefix("file://"))


def test_operators_in_threads_leave_each_others_tables(spark, sf):
    from concurrent.futures import ThreadPoolExecutor

    from folioscan.llm import queries

    names = ["op2_fingerprints", "op5_mix_sources", "op7_substring_dedup", "op9_minhash"]
    rows = lambda name: sorted(map(str, queries.QUERIES[name](spark, sf).collect()))
    with ThreadPoolExecutor(4) as pool:
        together = list(pool.map(rows, names))
    assert together == [rows(name) for name in names]


def test_a_hub_is_split(spark, tmp_path):
    from pyspark.sql import functions as F

    from folioscan.llm.components import _large

    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    hub = spark.range(60_000).select(F.lit(7).cast("long").alias("u"), (F.col("id") + 100).alias("v"))
    rest = spark.range(4_000).select((F.col("id") + 200_000).alias("u"), (F.col("id") + 300_000).alias("v"))
    hub.union(rest).repartition(12).write.parquet(f"{tmp_path}/links")
    before = {key: spark.conf.get(key) for key in low if key in dict(spark.sparkContext.getConf().getAll())}
    try:
        for key, value in low.items():
            spark.conf.set(key, value)
        found = _large(spark.read.parquet(f"{tmp_path}/links"))
        assert len(found.collect()) == 64_000
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in low:
            spark.conf.set(key, before[key]) if key in before else spark.conf.unset(key)

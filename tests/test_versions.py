"""Versioned tables: stopped anywhere and run again, streams, digests, writers at once; feedback as a stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from folioscan.operators import providers as P
from folioscan.sources import versions as V
from folioscan.sources.files import Files
from folioscan.streaming import usage as U


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


class Stopped(Exception):
    pass


def stopping(at):
    seen = []

    def after(step):
        seen.append(step)
        if len(seen) == at:
            raise Stopped(step)

    return after, seen


def test_a_run_stopped_after_any_step_leaves_the_old_version_and_ends_when_run_again(spark, tmp_path):
    base = spark.range(40).select(F.col("id").alias("key"), (F.col("id") * 10).alias("x"))
    new = spark.range(30, 60).select(F.col("id").alias("key"), (F.col("id") * 100).alias("x"))
    old, both = rows_of(base), rows_of(base.where("key < 30").union(new))
    after, steps = stopping(0)
    V.merge(f"{tmp_path}/whole", base, "key", parts=2, every=1)
    V.merge(f"{tmp_path}/whole", new, "key", every=1, after=after)
    assert steps == ["written", "recorded", "written", "recorded", "before publishing", "published"]
    for at in range(1, len(steps) + 1):
        path, calls = f"{tmp_path}/{at}", []

        def work(rows, calls=calls):
            calls.append(1)
            return rows

        assert V.merge(path, base, "key", parts=2, every=1) == 1
        with pytest.raises(Stopped):
            V.merge(path, new, "key", work, every=1, after=stopping(at)[0])
        published = steps[at - 1] == "published"
        assert rows_of(V.read_version(spark, path)) == (both if published else old)
        before = len(calls)
        V.merge(path, new, "key", work, every=1)
        assert rows_of(V.read_version(spark, path)) == both and V.damaged_parts(spark, path) == []
        redone = len(calls) - before
        assert redone == (2 if at in (1, 6) else 1 if at <= 3 else 0)  # a published run that comes again is a new one


def test_untouched_parts_are_taken_over_and_old_versions_can_go(spark, tmp_path):
    path = f"{tmp_path}/t"
    V.merge(path, spark.range(200).select(F.col("id").alias("key"), F.lit("a").alias("x")), "key", parts=8)
    first = V.manifest(spark, path)
    assert V.merge(path, spark.range(5, 6).select(F.col("id").alias("key"), F.lit("b").alias("x")), "key") == 2
    second = V.manifest(spark, path)
    assert sum(first["parts"][k]["path"] != p["path"] for k, p in second["parts"].items()) == 1
    assert [r.x for r in V.read_version(spark, path).where("key = 5").collect()] == ["b"] and V.read_version(spark, path, 1).where("x = 'b'").isEmpty()
    V.merge(path, spark.range(6, 7).select(F.col("id").alias("key"), F.lit("c").alias("x")), "key")
    V.expire(spark, path, 1)
    assert V.read_version(spark, path).count() == 200 and Files(spark).names(f"{path}/versions") == ["0000000003.json"]
    assert len(Files(spark).names(f"{path}/data/v2")) <= 1


def test_odd_rows_and_nothing_new(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "lost"), (2, None)], "key long, x string")
    assert V.merge(path, rows.limit(0), "key") == 0
    with pytest.raises(ValueError):
        V.read_version(spark, path)
    assert V.merge(path, rows, "key") == 1 and rows_of(V.read_version(spark, path)) == [(1, "a"), (2, None)]
    assert V.merge(path, rows, "key", only_missing=True) == 1
    assert V.merge(path, rows.where("key is null"), "key") == 1


def test_of_two_writers_one_publishes(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.range(3).select(F.col("id").alias("key"))

    def other(step):
        if step == "before publishing":
            V.merge(path, spark.range(9, 10).select(F.col("id").alias("key")), "key")

    with pytest.raises(V.Conflict):
        V.merge(path, rows, "key", after=other)
    assert rows_of(V.read_version(spark, path)) == [(9,)]


def test_a_damaged_part_is_found(spark, tmp_path):
    path = f"{tmp_path}/t"
    V.merge(path, spark.range(50).select(F.col("id").alias("key")), "key", parts=4)
    at = V.manifest(spark, path)["parts"]["2"]["path"]
    spark.createDataFrame([(7_000,)], "key long").write.mode("append").parquet(at)
    assert V.damaged_parts(spark, path) == [2]


def test_a_stream_of_texts_is_embedded_once_each(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/vectors"
    embed = P.hashing_embedder(4)
    work = lambda rows: P.embedded(rows, "key", "text", embed)
    spark.createDataFrame([(i, f"text {i}") for i in range(20)], "key long, text string").write.parquet(source)

    def run():
        stream = spark.readStream.schema("key long, text string").parquet(source).writeStream.foreachBatch(V.version_sink(path, "key", work, parts=4))
        stream.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    run()
    spark.createDataFrame([(i, f"text {i}") for i in range(15, 30)], "key long, text string").write.mode("append").parquet(source)
    run()
    got = V.read_version(spark, path)
    assert sorted(r.key for r in got.collect()) == list(range(30)) and V.manifest(spark, path)["version"] == 2
    V.version_sink(path, "key", work)(spark.read.parquet(source), 7)
    assert V.manifest(spark, path)["version"] == 2


AT = dt.datetime(2024, 1, 1, 12)


def at(minutes):
    return AT + dt.timedelta(minutes=minutes)


def test_feedback_in_time_gives_the_same_on_streams_and_tables(spark, tmp_path):
    usage = [("a", at(0), 1), ("b", at(1), 2), ("c", at(2), 3), ("a", at(30), 4), (None, at(3), 5), ("d", at(50), 6)]
    answers = [("a", at(5), "up", 1), ("a", at(9), "down", 2), ("a", at(9), "up", 3), ("c", at(1), "early", 4), ("c", at(200), "too late", 5), ("x", at(4), "nobody", 6), ("d", at(110), "at the end", 7)]
    kinds = ("key string, ts timestamp, n long", "key string, ts timestamp, rating string, seq long")
    want = U.feedback_in_time(spark.createDataFrame(usage, kinds[0]), spark.createDataFrame(answers, kinds[1]), "key", "ts", "seq")
    want = sorted((r.n, r.feedback and r.feedback.rating) for r in want.collect())
    assert want == [(1, "up"), (2, None), (3, None), (4, None), (5, None), (6, "at the end")]

    flush = at(2000)
    steps = [(usage[:4], answers[:2]), (usage[4:], answers[2:6]), ([], [*answers[6:], ("x", at(112), "x", 8)]), ([("z", flush, 99)], [("z", flush, "z", 99)]), ([("z", flush, 98)], [("z", flush, "z", 98)])]
    for k, rows in enumerate(zip(*steps, strict=True)):
        for i, part in enumerate(rows):
            if i == 0:
                spark.createDataFrame(part, kinds[k]).coalesce(1).write.parquet(f"{tmp_path}/{k}")
    stream = [spark.readStream.schema(kinds[k]).parquet(f"{tmp_path}/{k}") for k in (0, 1)]
    joined = U.feedback_in_time(stream[0], stream[1], "key", "ts", "seq")
    seen = {}

    def keep(batch, i):
        for r in batch.collect():
            assert r.n not in seen
            seen[r.n] = (i, r.feedback and r.feedback.rating)

    query = joined.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        query.processAllAvailable()
        assert not seen  # nothing is certain before the watermark passes
        for part in steps[1:]:
            for k in (0, 1):
                if part[k]:
                    spark.createDataFrame(part[k], kinds[k]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{k}")
            query.processAllAvailable()
    finally:
        query.stop()
    assert sorted((n, x[1]) for n, x in seen.items() if n < 90) == want

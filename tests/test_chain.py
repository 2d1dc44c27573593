"""Chains of providers: one deadline that ends calls, rests that all tasks share."""

import time

from pyspark.sql import functions as F

from folioscan.operators import providers as P
from folioscan.sources import versions as V
from folioscan.streaming import usage as U


def prompts(spark, n=40, parts=4):
    return spark.range(n).select(F.col("id").alias("key"), F.concat(F.lit("question "), "id").alias("prompt")).repartition(parts)


def failing(folder):
    """A provider that notes each call as a file and fails."""

    def call(prompt):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        raise RuntimeError("429 quota")

    return call


def statuses(row):
    return [a.status for a in row.attempts]


def test_a_sleeping_provider_is_given_up_in_time(spark):
    def sleeps(prompt):
        time.sleep(30)
        return "too late"

    began = time.monotonic()
    rows = P.answered(prompts(spark, 2, 2), [("slow", sleeps), ("next", lambda p: "x")], "key", "prompt", deadline=0.6).collect()
    assert time.monotonic() - began < 15
    assert {tuple(statuses(r)) for r in rows} == {("late", "late")} and all(r.answer is None for r in rows)
    rows = P.answered(prompts(spark, 2, 2), [("slow", sleeps), ("next", lambda p: "x")], "key", "prompt", deadline=5, cap=0.2).collect()
    assert {tuple(statuses(r)) for r in rows} == {("late", "ok")}


def test_resting_providers_are_not_asked(spark, tmp_path):
    resting = spark.createDataFrame([("first", 10, "over"), ("second", int(time.time() * 1000) + 3_600_000, "429"), ("other", 9_999_999_999_999, "x")], "pool string, until_ms long, reason string")
    rows = P.answered(prompts(spark), [("second", failing(tmp_path)), ("first", lambda p: p.upper())], "key", "prompt", resting=resting).collect()
    assert {tuple(statuses(r)) for r in rows} == {("cooling", "ok")} and not list(tmp_path.iterdir())
    assert {r.answer for r in rows} == {f"QUESTION {i}" for i in range(40)}
    assert P.answered(prompts(spark).limit(0), [("a", lambda p: p)], "key", "prompt", resting=resting.limit(0)).collect() == []


def test_what_one_task_saw_fail_no_later_round_asks(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    chain = [("broken", failing(tmp_path / "calls")), ("good", lambda p: "fine")]
    done = P.answered_in_rounds(prompts(spark), f"{tmp_path}/answers", f"{tmp_path}/rests", chain, "key", "prompt", rounds=4, cooldown=lambda e: 3600 if "429" in str(e) else 0)
    rows = done.collect()
    assert len(rows) == 40 and {r.answer for r in rows} == {"fine"}
    in_round = {r.key: r["round"] for r in prompts(spark).select("key", F.pmod(F.xxhash64("key"), F.lit(4)).alias("round")).collect()}
    asked = {in_round[r.key] for r in rows if "error" in statuses(r)}
    assert len(asked) == 1 and len(list((tmp_path / "calls").iterdir())) == sum("error" in statuses(r) for r in rows)
    assert [r.pool for r in V.read_version(spark, f"{tmp_path}/rests").collect()] == ["broken"]


def test_a_stream_of_replies_keeps_a_stream_of_prompts_from_asking(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    now = int(time.time() * 1000)
    spark.createDataFrame([("broken", now, 3_600_000), ("good", now, 0)], "pool string, at_ms long, rest_ms long").write.parquet(f"{tmp_path}/replies")
    replies = spark.readStream.schema("pool string, at_ms long, rest_ms long").parquet(f"{tmp_path}/replies")
    query = U.track_cooldowns(replies).writeStream.outputMode("update").foreachBatch(U.rest_sink(f"{tmp_path}/rests")).option("checkpointLocation", f"{tmp_path}/c1")
    query = query.start()  # its timers keep it running
    until = time.monotonic() + 60
    while time.monotonic() < until and not V.manifest(spark, f"{tmp_path}/rests"):
        time.sleep(0.5)
    query.stop()
    prompts(spark, 12).write.parquet(f"{tmp_path}/prompts")
    asked = spark.readStream.schema("key long, prompt string").parquet(f"{tmp_path}/prompts")
    sink = P.answer_batches(f"{tmp_path}/answers", f"{tmp_path}/rests", [("broken", failing(tmp_path / "calls")), ("good", lambda p: "fine")], "key", "prompt")
    asked.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    rows = V.read_version(spark, f"{tmp_path}/answers").collect()
    assert len(rows) == 12 and {tuple(statuses(r)) for r in rows} == {("cooling", "ok")} and not list((tmp_path / "calls").iterdir())

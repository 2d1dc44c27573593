"""Usage events and feedback as streams: cooldowns, deduplication, windows and incremental work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import fixed
from folioscan.functions.text import empty
from folioscan.operators.providers import note_rests


def cooldown_seconds(status: Column, body: Column | str) -> Column:
    """How long a provider rests after a reply: a daily limit, a limit by the minute, a broken key; else 0."""
    flat = F.translate(F.lower(empty(body)), "_ ", "")
    daily = F.exists(F.array(*map(F.lit, fixed.DAILY_MARKERS)), lambda m: F.contains(flat, m))
    return F.when(status == 429, F.when(daily, fixed.COOLDOWN_DAILY).otherwise(fixed.COOLDOWN_MINUTE)).when(status.isin(401, 403, 404), fixed.COOLDOWN_BROKEN).otherwise(0)


def cooldown_status(events: DataFrame, pool: str, ts: str, order: str, status: Column, body: Column | str, now: Column) -> DataFrame:
    """pool, reason, seconds_left of the pools that rest at `now`: the last reply that caused a rest counts."""
    rows = events.withColumn("_s", cooldown_seconds(status, body)).where("_s > 0")
    last = rows.groupBy(pool).agg(F.max_by(F.struct(F.col(ts).alias("ts"), F.col("_s").alias("s"), status.cast("string").alias("reason")), F.struct(ts, order)).alias("x"))
    left = F.col("x.s") - (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("x.ts").cast("timestamp"))) / 1_000_000
    return last.select(pool, F.col("x.reason").alias("reason"), F.floor(left).cast("long").alias("seconds_left")).where("seconds_left > 0")


def _track(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"pool": [key[0]], "until_ms": [0], "resting": [False]})
        return
    until = state.get[0] if state.exists else 0
    for rows in batches:
        until = max([until, *(rows["at_ms"] + rows["rest_ms"]).tolist()])
    now = state.getCurrentProcessingTimeMs()
    if until > now:
        state.update((until,))
        state.setTimeoutDuration(int(until - now))
    yield pd.DataFrame({"pool": [key[0]], "until_ms": [int(until)], "resting": [until > now]})


def track_cooldowns(replies: DataFrame) -> DataFrame:
    """Stream of pool, until_ms, resting from a stream of replies(pool, at_ms, rest_ms); a timer ends each rest."""
    rows = replies.where("rest_ms > 0")
    return rows.groupBy("pool").applyInPandasWithState(_track, "pool string, until_ms long, resting boolean", "until long", "update", "ProcessingTimeTimeout")


def rest_sink(cooldowns: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of track_cooldowns: rests go to the shared table that chains of providers read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where("resting").select("pool", "until_ms", F.lit("reply").alias("reason"))
        if not rows.isEmpty():
            note_rests(rows, cooldowns)

    return write


def first_seen(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Stream without repeats of a key within the time that events may be late."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def event_counts(events: DataFrame, ts: str, kind: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by window and kind; on a stream, late ones count until the watermark passes."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, window), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")


def append_new(batch_work: Callable[[DataFrame], DataFrame], path: str, key: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that works on rows whose key the table at `path` lacks, and appends the result.

    The key is the checkpoint: a batch that runs again finds its rows done and adds nothing.
    Rows without key are left out. The keys of the whole table are read for each batch; for
    large tables, or readers that must never see half a batch, take sources.versions.version_sink.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
        try:
            done = spark.read.parquet(path).select(key)
        except Exception as e:  # the table begins with the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            new = new.join(done, key, "left_anti")
        batch_work(new).write.mode("append").parquet(path)

    return work


def conversations_with_feedback(usage: DataFrame, feedback: DataFrame, key: str = "request_id") -> DataFrame:
    """Every usage event with the last feedback on it, if any."""
    last = feedback.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("timestamp")))).where("_n = 1")
    return usage.join(last.select(key, "rating", "reasons"), key, "left")


def feedback_in_time(usage: DataFrame, feedback: DataFrame, key: str, ts: str, tie: str, within: str = "1 hour", late: str = "10 minutes", slot: str = "10 minutes") -> DataFrame:
    """usage with the last row of feedback on its key that came up to `within` after it, as struct `feedback`, else null.

    On streams both sides have watermarks and the join a range of time, so a usage row is held
    for `within` plus the delay of the slower stream, then goes out with what came; so does one
    that nobody answered. Rows later than `late` are dropped. A second stateful step picks the
    last answer by slots of usage time. usage and feedback have `key` and `ts`; the last is by
    ts, then by `tie`, a column of feedback. Equal rows of usage count once; a null key gets no answer.
    """
    answers = feedback.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.struct(ts, *(c for c in feedback.columns if c not in (key, ts))).alias("_answer"))
    asked = usage.withColumn("_at", F.col(ts))
    if usage.isStreaming or feedback.isStreaming:
        asked, answers = asked.withWatermark("_at", late), answers.withWatermark("_ts", late)
    in_time = (F.col(key) == F.col("_key")) & (F.col("_ts") >= F.col("_at")) & (F.col("_ts") <= F.col("_at") + F.expr(f"INTERVAL {within}"))
    last = F.max_by("_answer", F.when(F.col("_answer").isNotNull(), F.struct("_ts", F.col(f"_answer.{tie}")))).alias("feedback")
    joined = asked.join(answers, in_time, "left_outer")
    return joined.groupBy(F.window("_at", slot), *usage.columns).agg(last).drop("window")

"""Retrieval evaluation and the way from feedback to new cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.text import empty, value_in_context
from folioscan.operators.guards import values_guard


def first_relevant(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """cases with `best_rank`: the best rank of any accepted document, null if none came.

    cases: case_id, expect_doc (array), expect_absent; retrieved: case_id, rank, doc_id.
    """
    return best_ranks(cases, cases.select("case_id", F.explode("expect_doc").alias("doc_id")).distinct(), retrieved)


def best_ranks(cases: DataFrame, wanted: DataFrame, retrieved: DataFrame) -> DataFrame:
    """cases with `best_rank`, from accepted documents as rows wanted(case_id, doc_id): no case's documents are gathered."""
    best = wanted.join(retrieved, ["case_id", "doc_id"]).groupBy("case_id").agg(F.min("rank").alias("best_rank"))
    return cases.join(best, "case_id", "left")


def metrics(ranked: DataFrame) -> DataFrame:
    """One row: cases, scored, hits, recall, mrr. Absence cases are no part of recall and MRR."""
    scored = ~F.coalesce("expect_absent", F.lit(False))
    n = F.count(F.when(scored, 1))
    hits = F.count(F.when(scored & F.col("best_rank").isNotNull(), 1))
    mrr = F.coalesce(F.sum(F.when(scored, 1 / F.col("best_rank"))), F.lit(0.0))
    one = ranked.agg(F.count(F.lit(1)).alias("cases"), n.alias("scored"), hits.alias("hits"), mrr.alias("sum"))
    share = lambda c: F.round(F.coalesce(F.col(c) / F.nullif(F.col("scored"), F.lit(0)), F.lit(0.0)), 6)
    return one.select("cases", "scored", "hits", share("hits").alias("recall"), share("sum").alias("mrr"))


def stratified_sample(chunks: DataFrame, doc: str, key: str, n: int, seed: int = 7) -> DataFrame:
    """At most n rows of each document, drawn by a hash of the key: the same in every run."""
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    own = Window.partitionBy(doc).orderBy(drawn, key)
    return chunks.withColumn("draw", F.row_number().over(own)).where(F.col("draw") <= n)


def draft_cases(feedback: DataFrame, seen: DataFrame | None = None, also_up: bool = False) -> DataFrame:
    """Draft evaluation cases from feedback rows; those already in seen(id) are left out.

    A thumbs-up vouches for the first document it cited, a thumbs-down says nothing about
    the right one. Rows without a question and other ratings give no case.
    """
    take = F.trim(empty("rating")).isin(["down", "up"] if also_up else ["down"])
    rows = feedback.where(take & (F.trim(empty("question")) != ""))
    rid = F.trim(F.coalesce(F.nullif(empty("request_id"), F.lit("")), empty("message_id")))
    sources = F.filter(F.transform(F.split(empty("sources"), ";"), lambda s: F.trim(s)), lambda s: s != "")
    note = lambda name: F.when(F.trim(empty(name)) != "", F.concat(F.lit(f"{name}: "), F.trim(name)))
    head = F.trim(F.concat(F.lit("FEEDBACK "), F.trim("rating"), F.lit(" "), empty("timestamp")))
    listed = F.when(F.size(sources) > 0, F.concat(F.lit("retrieved: "), F.array_join(sources, "; ")))
    notes = F.concat_ws(" | ", head, note("reasons"), note("correction"), note("note"), note("provider"), listed, F.lit("CANDIDATE — set expect_doc/expect_page/gold_value from the manual."))
    drafts = rows.select(
        F.concat(F.lit("fb-"), F.coalesce(F.nullif(F.substring(rid, 1, 10), F.lit("")), F.lit("norid"))).alias("id"),
        F.trim("question").alias("question"),
        F.when(F.trim("rating") == "up", F.substring_index(F.try_element_at(sources, F.lit(1)), " p.", 1)).alias("expect_doc"),
        notes.alias("notes"),
    )
    first = drafts.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("notes", "question"))).where("_n = 1").drop("_n")
    return first.join(seen.select("id"), "id", "left_anti") if seen is not None else first


def all_metrics(cases: DataFrame) -> DataFrame:
    """One row: cases, recall, mrr, value_retrieved, guard, absence, ctx_chars_mean; shares are 0 without a case.

    cases: case_id, gold, wrong, context, expect_absent, best_rank. A value is retrieved if the
    squeezed context holds it. The guard is right if of an answer with the gold and a wrong
    value the first stays and the second goes; on absence cases, if the wrong value goes.
    """
    absent = F.coalesce("expect_absent", F.lit(False))
    answer = F.when(absent, F.concat(F.lit("The specified value is "), "wrong", F.lit("."))).otherwise(F.concat(F.lit("The correct value is "), "gold", F.lit(". An incorrect claim would be "), "wrong", F.lit(".")))
    rows = cases.select(absent.alias("absent"), "best_rank", "gold", "wrong", F.char_length(empty("context")).alias("chars"), value_in_context("gold", "context").alias("got"), values_guard(answer, "context")["clean"].alias("clean"))
    gone, kept = ~value_in_context("wrong", "clean"), value_in_context("gold", "clean")
    scored, held = ~F.col("absent"), ~F.col("absent") & F.col("got")
    share = lambda part, of: F.round(F.coalesce(F.count(F.when(of & part, 1)) / F.nullif(F.count(F.when(of, 1)), F.lit(0)), F.lit(0.0)), 6)
    mrr = F.coalesce(F.sum(F.when(scored, 1 / F.col("best_rank"))) / F.nullif(F.count(F.when(scored, 1)), F.lit(0)), F.lit(0.0))
    return rows.agg(
        F.count(F.lit(1)).alias("cases"), share(F.col("best_rank").isNotNull(), scored).alias("recall"), F.round(mrr, 6).alias("mrr"), share(F.col("got"), scored).alias("value_retrieved"),
        share(gone & kept, held).alias("guard"), share(gone, F.col("absent")).alias("absence"), F.round(F.avg("chars"), 6).alias("ctx_chars_mean"),
    )

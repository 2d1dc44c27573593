"""Newest-wins supersession and the pairing of old passages with their restatements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import fixed


def newest_superseder(chunks: DataFrame, position: str = "position") -> DataFrame:
    """old_doc_id, doc_id, issue_date: of the documents that declare to supersede old_doc_id the newest.

    chunks: doc_id, issue_date (string, compared as text, null as ''), supersedes (array) and
    a position; equal dates go to the first position.
    """
    rows = chunks.select("doc_id", F.coalesce("issue_date", F.lit("")).alias("issue_date"), F.col(position).alias("position"), F.explode("supersedes").alias("old_doc_id"))
    newest = rows.groupBy("old_doc_id").agg(F.max_by(F.struct("doc_id", "issue_date"), F.struct("issue_date", (-F.col("position")).alias("p"))).alias("x"))
    return newest.select("old_doc_id", "x.doc_id", "x.issue_date")


def mark_superseded(chunks: DataFrame, newest: DataFrame) -> DataFrame:
    """chunks with newer_doc_id (null if none) and superseded."""
    side = newest.select(F.col("old_doc_id").alias("doc_id"), F.col("doc_id").alias("newer_doc_id"))
    return chunks.join(side, "doc_id", "left").withColumn("superseded", F.col("newer_doc_id").isNotNull())


_SEATS = "array<struct<chunk_id:bigint,pulled_by:bigint>>"


def _seated(finals: Column, pool: Column, least: float) -> Column:
    """All seats in order, as one fold over a query's final rows: each row, then what it pulls from the pool."""
    seat = lambda chunk, by: F.struct(chunk.cast("bigint").alias("chunk_id"), by.cast("bigint").alias("pulled_by"))

    def add(held: Column, old: Column) -> Column:
        tokens = F.array_distinct(F.coalesce(old["tokens"], F.array().cast("array<string>")))
        free = F.filter(pool, lambda c: (c["doc_id"] == old["newer_doc_id"]) & ~F.array_contains(held["present"], c["chunk_id"]))
        shared = F.transform(free, lambda c, i: F.struct((-F.size(F.array_intersect(tokens, F.coalesce(c["tokens"], F.array().cast("array<string>"))))).alias("missed"), i.alias("place"), c["chunk_id"].alias("chunk_id")))
        best = F.array_min(shared)
        pulls = (F.size(tokens) > 0) & best.isNotNull() & (-best["missed"] >= F.lit(least) * F.size(tokens))
        own = F.array(seat(old["chunk_id"], F.lit(None)))
        new = F.when(pulls, F.concat(own, F.array(seat(best["chunk_id"], old["chunk_id"])))).otherwise(own)
        present = F.when(pulls, F.concat(held["present"], F.array(best["chunk_id"]))).otherwise(held["present"])
        return F.struct(present.alias("present"), F.concat(held["seats"], new).alias("seats"))

    start = F.struct(F.transform(finals, lambda f: f["chunk_id"]).alias("present"), F.array().cast(_SEATS).alias("seats"))
    return F.aggregate(finals, start, add, lambda held: held["seats"])


def _trimmed(seats: Column, k: int) -> Column:
    """seats without what stands beyond k: the last rows outside pairs go first, then the last old halves, never what was pulled."""
    pulled = F.transform(F.filter(seats, lambda s: s["pulled_by"].isNotNull()), lambda s: s["pulled_by"])
    numbered = F.transform(seats, lambda s, i: F.struct(F.array_contains(pulled, s["chunk_id"]).alias("paired"), (-i).alias("back"), s["pulled_by"].isNull().alias("own")))
    leaving = F.array_sort(F.transform(F.filter(numbered, lambda n: n["own"]), lambda n: F.struct(n["paired"], n["back"])))
    gone = F.transform(F.slice(leaving, 1, F.greatest(F.size(seats) - k, F.lit(0))), lambda n: -n["back"])
    return F.filter(seats, lambda s, i: ~F.array_contains(gone, i))


def with_amendments(finals: DataFrame, pool: DataFrame, k: int = fixed.TOP_K_FINAL, least: float = fixed.AMENDMENT_MIN_OVERLAP) -> DataFrame:
    """query_id, rank, chunk_id, pulled_by: each superseded final row is followed by its restatement.

    finals: query_id, rank, chunk_id, doc_id, newer_doc_id, tokens; pool: query_id, rank,
    chunk_id, doc_id, tokens. The restatement is the pool's chunk of the newer document that
    shares the most tokens (of equals the first), if it shares `least` of the old one's and isn't
    seated yet. Rows beyond k go from the end: first rows outside pairs, then old halves. Seating
    one chunk changes what later rows may pull, so a query's rows (k and its pool, a fixed
    number) are one array that a fold goes through; queries spread over the tasks.
    """
    listed = lambda df, *cols: df.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *cols))).alias("x"))
    own = listed(finals, "chunk_id", "doc_id", "newer_doc_id", "tokens").withColumnRenamed("x", "finals")
    wanted = pool.join(finals.where("newer_doc_id is not null").select("query_id", F.col("newer_doc_id").alias("doc_id")).distinct(), ["query_id", "doc_id"], "left_semi")
    able = listed(wanted, "chunk_id", "doc_id", "tokens").withColumnRenamed("x", "pool")
    rows = own.join(able, "query_id", "left").withColumn("pool", F.coalesce("pool", F.filter(F.array(F.lit(None).cast(able.schema["pool"].dataType.elementType)), lambda x: x.isNotNull())))
    rows = rows.select("query_id", _seated(F.col("finals"), F.col("pool"), least).alias("seats"))
    rows = rows.select("query_id", F.posexplode(_trimmed(F.col("seats"), k)).alias("rank", "seat"))
    return rows.select("query_id", (F.col("rank") + 1).alias("rank"), "seat.chunk_id", "seat.pulled_by")

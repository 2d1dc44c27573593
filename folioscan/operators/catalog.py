"""Counts, shelves and facets over the chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions.text import dotted_date, empty


def area_counts(chunks: DataFrame, area: Column | str, doc: Column | str) -> DataFrame:
    """area, chunks, documents of areas with content, the largest first."""
    rows = chunks.select((F.col(area) if isinstance(area, str) else area).alias("area"), (F.col(doc) if isinstance(doc, str) else doc).alias("doc")).where("area is not null")
    return rows.groupBy("area").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("doc").alias("documents")).orderBy(F.desc("chunks"), "area")


def document_shelf(chunks: DataFrame, doc: str, position: Column, first: list[str], page: str) -> DataFrame:
    """A row per document: fields of its first chunk, its chunk count and its distinct pages (nulls not counted)."""
    own = F.min_by(F.struct(*first), position)
    return chunks.groupBy(doc).agg(own.alias("x"), F.count(F.lit(1)).alias("chunks"), F.countDistinct(page).alias("pages")).select(doc, "x.*", "chunks", "pages")


def newest_first(shelf: DataFrame, date: str, title: str) -> DataFrame:
    return shelf.orderBy(F.desc(F.coalesce(F.nullif(F.col(date), F.lit("")), F.lit("0000"))), F.desc(title))


def filtered(shelf: DataFrame, doc_type: str | None = None, coach: str | None = None, system: str | None = None) -> DataFrame:
    """Documents of a type, for a coach (or for all of them: 'common') and in an area."""
    keep = F.lit(True)
    if doc_type:
        keep &= F.col("doc_type") == doc_type
    if coach:
        keep &= F.array_contains("coach_type", coach) | F.array_contains("coach_type", "common")
    if system:
        keep &= F.col("system") == system
    return shelf.where(keep)


def shelf_filter(shelf: DataFrame, coach: str | None, doc_type: str | None, needle: str, columns: list[str]) -> DataFrame:
    """The reader's filter: exact coach, exact type and a case-folded substring in any of the columns."""
    keep = F.lit(True)
    if coach:
        keep &= F.array_contains("coach_type", coach)
    if doc_type:
        keep &= F.col("doc_type") == doc_type
    if needle.strip():
        low = needle.strip().lower()
        hit = F.lit(False)
        for c in columns:
            hit |= F.contains(F.lower(empty(c)), F.lit(low))
        keep &= hit
    return shelf.where(keep)


def facets(shelf: DataFrame, coach: str = "coach_type", doc_type: str = "doc_type") -> DataFrame:
    """facet, value: the distinct coaches and types."""
    coaches = shelf.select(F.lit("coach").alias("facet"), F.explode(coach).alias("value"))
    types = shelf.select(F.lit("type").alias("facet"), F.col(doc_type).alias("value"))
    return coaches.union(types).where("value <> ''").distinct().orderBy("facet", "value")


def facts_lines(shelf: DataFrame, doc_type: str = "doc_type") -> DataFrame:
    """A line per document for the block of counted facts, in reference order."""
    date = dotted_date("issue_date")
    ref = F.coalesce(F.nullif(empty("letter_no"), F.lit("")), F.lit("(no letter no.)"))
    line = F.concat(F.lit("  - "), ref, F.when(date != "", F.concat(F.lit(" ("), date, F.lit(")"))).otherwise(""), F.lit(" — "), "title")
    return shelf.select(doc_type, line.alias("line"), F.coalesce(F.nullif(empty("letter_no"), F.lit("")), F.col("title")).alias("by")).orderBy("by")


def recent_threads(threads: DataFrame, owner: str, updated: str, tie: str, most: int = 40) -> DataFrame:
    """Each owner's newest threads, `most` of them."""
    order = Window.partitionBy(owner).orderBy(F.desc(updated), F.asc(tie))
    return threads.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new in place of rows of old with their key; the rest of old stays."""
    return old.join(new, key, "left_anti").unionByName(new)

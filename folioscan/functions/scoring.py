"""Score factors of a candidate; all multiply, 1.0 is neutral."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions import fixed
from folioscan.functions.text import col, empty


def hybrid_base(similarity: Column | str, top_similarity: Column | str, hits: Column | str, terms: Column | str) -> Column:
    """Weighted sum of the similarity relative to the best (0.01 at least) and the share of query terms hit."""
    semantic = F.coalesce(col(similarity), F.lit(0.0)) / F.greatest(col(top_similarity), F.lit(0.01))
    keyword = F.coalesce(col(hits), F.lit(0)) / F.greatest(col(terms), F.lit(1))
    return F.lit(fixed.SEMANTIC_WEIGHT) * F.coalesce(semantic, F.lit(0.0)) + F.lit(fixed.KEYWORD_WEIGHT) * keyword


def procedural_factor(procedural: Column | str, tags: Column | str) -> Column:
    has = lambda *names: F.arrays_overlap(F.coalesce(col(tags), F.array().cast("array<string>")), F.array(*map(F.lit, names)))
    up = F.when(has("procedure", "testing"), 1.3).otherwise(1.0)
    down = F.when(has("overview", "general information"), 0.5).otherwise(1.0)
    return F.when(col(procedural), up * down).otherwise(1.0)


def section_factor(section: Column | str, query_words: Column | str) -> Column:
    """Abbreviation lists sink; each word of three letters that the title shares with the question lifts."""
    title = F.lower(empty(section))
    shared = F.size(F.array_intersect(F.array_distinct(F.regexp_extract_all(title, F.lit("[a-z]{3,}"), F.lit(0))), col(query_words)))
    return F.when(title.contains("abbreviation"), 0.4).otherwise(1.0) * (1.0 + 0.15 * shared)


def maker_factor(maker: Column | str, asked: Column | str) -> Column:
    return F.when(empty(asked) == "", 1.0).when(empty(maker) == col(asked), 1.8).when(empty(maker) != "", 0.3).otherwise(1.0)


def coach_factor(coaches: Column | str, asked: Column | str) -> Column:
    """coaches: array; 'common' serves every coach."""
    own = F.coalesce(col(coaches), F.array().cast("array<string>"))
    other = (F.size(own) > 0) & ~F.array_contains(own, "common")
    return F.when(empty(asked) == "", 1.0).when(F.array_contains(own, col(asked)), 1.5).when(other, 0.4).otherwise(1.0)


def system_of(subsystem: Column | str, tags: Column | str) -> Column:
    sub = F.lower(empty(subsystem))
    tag = F.transform(F.coalesce(col(tags), F.array().cast("array<string>")), F.upper)
    slide, fire = F.array_contains(tag, "WSP"), F.arrays_overlap(tag, F.array(F.lit("FSDS"), F.lit("FDSS")))
    return F.when(sub.contains("wheel slide") | sub.contains("wsp"), "WSP").when(sub.contains("fire"), "FSDS").when(slide, "WSP").when(fire, "FSDS")


def system_factor(system: Column | str, asked: Column | str) -> Column:
    return F.when(col(asked).isNotNull() & (col(system) != col(asked)), 0.3).otherwise(1.0)


def recency_factor(issue_date: Column | str, doc_type: Column | str) -> Column:
    head = F.substring(empty(issue_date), 1, 4)
    year = F.when(head.rlike("^[0-9]+$"), head.try_cast("int"))
    newer = 1.0 + F.greatest(F.lit(0), F.least(year - 2010, F.lit(20))) * 0.004
    kind = empty(doc_type)
    ruling = kind.contains("circular") | kind.contains("instruction") | (kind == "correction_slip")
    return F.when(year.isNull(), 1.0).otherwise(newer + F.when(ruling, 0.03).otherwise(0.0))


def supersession_factor(superseded: Column | str) -> Column:
    return F.when(F.coalesce(col(superseded), F.lit(False)), fixed.SUPERSEDED_PENALTY).otherwise(1.0)


def document_cap(chunks: Column | str, k: Column | int = fixed.TOP_K_FINAL) -> Column:
    """Slots of one document among k: grows with the square root of its size, and with k's share."""
    root = F.floor(F.floor(F.sqrt(F.coalesce(col(chunks), F.lit(0)).cast("double"))) / 4)
    share = F.greatest(F.lit(1), F.floor(F.lit(k) / fixed.TOP_K_FINAL)) if isinstance(k, int) else F.greatest(F.lit(1), F.floor(k / fixed.TOP_K_FINAL))
    return (F.greatest(F.lit(fixed.PER_DOC_CAP), root) * share).cast("int")

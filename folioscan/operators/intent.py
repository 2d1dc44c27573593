"""What a question asks for, as columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.functions import fixed
from folioscan.functions import lexicon as lexicon_values
from folioscan.functions.text import col, empty, first_pattern, words


def is_enumeration(text: Column | str) -> Column:
    return empty(text).rlike(fixed.ENUMERATION)


def is_procedural(text: Column | str) -> Column:
    low = F.lower(empty(text))
    return F.exists(F.array(*map(F.lit, fixed.PROCEDURAL_SIGNALS)), lambda s: F.contains(low, s))


def asked_maker(text: Column | str) -> Column:
    return first_pattern(text, fixed.QUERY_OEMS)


def asked_coach(text: Column | str) -> Column:
    return first_pattern(text, fixed.QUERY_COACHES)


def asked_system(text: Column | str) -> Column:
    """FSDS or WSP if the question shows signs of exactly one of them."""
    low = F.lower(empty(text))
    fire, slide = low.rlike(fixed.FIRE_SIGNALS), low.rlike(fixed.SLIDE_SIGNALS)
    return F.when(fire & ~slide, "FSDS").when(slide & ~fire, "WSP")


def asked_doc_type(text: Column | str) -> Column:
    return first_pattern(text, fixed.DOC_TYPE_PATTERNS, lower=False)


def is_corpus_count(text: Column | str) -> Column:
    """Asks how many, and of something that is a document."""
    return empty(text).rlike(fixed.COUNTING) & (asked_doc_type(text).isNotNull() | empty(text).rlike(fixed.GENERIC_DOCUMENT))


def signals(queries: DataFrame, id_col: str, text: Column | str) -> DataFrame:
    """All signals of each question, a row per query_id; k is its number of final rows."""
    enumerating = is_enumeration(text)
    return queries.select(
        F.col(id_col).alias("query_id"),
        is_procedural(text).alias("procedural"),
        enumerating.alias("enumerating"),
        F.when(enumerating, fixed.TOP_K_ENUMERATE).otherwise(fixed.TOP_K_FINAL).alias("k"),
        asked_maker(text).alias("asked_maker"),
        asked_coach(text).alias("asked_coach"),
        asked_system(text).alias("asked_system"),
        words(text, 3).alias("query_words"),
    )


def scoped_question(question: Column | str, coach: Column | str) -> Column:
    """The selected coach is put before a question that names none; unknown selections are ignored."""
    chosen = F.trim(empty(coach))
    ignored = (chosen == "") | F.lower(chosen).isin("all", "any") | asked_coach(question).isNotNull() | asked_coach(chosen).isNull()
    return F.when(ignored, empty(question)).otherwise(F.concat(chosen, F.lit(" "), empty(question)))


def expand(queries: DataFrame, lexicon: DataFrame, id_col: str, text: Column | str) -> DataFrame:
    """query_id, expanded: the lower-case question followed by the expansions of its known words, in their order.

    lexicon: term, expansion (a dimension table; join strategy is left to its size).
    """
    split = queries.select(F.col(id_col).alias("query_id"), F.filter(F.split(F.lower(empty(text)), r"\s+"), lambda w: w != "").alias("list"))
    token = split.select("query_id", F.posexplode("list").alias("place", "word")).withColumn("term", F.regexp_replace("word", r"[^\p{L}\p{N}_]", ""))
    added = token.join(lexicon.select("term", "expansion").where("expansion <> ''"), "term").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "expansion"))).alias("x"))
    more = F.coalesce(F.transform("x", lambda s: s["expansion"]), F.array().cast("array<string>"))
    return split.join(added, "query_id", "left").select("query_id", F.array_join(F.concat("list", more), " ").alias("expanded"))


def default_lexicon(spark: SparkSession) -> DataFrame:
    """The short forms that questions are expanded with, as a dimension table."""
    return spark.createDataFrame(list(lexicon_values.ABBREVIATIONS.items()), "term string, expansion string")


def rewritten(text: Column | str) -> Column:
    """The lower-case question, its code-mixed phrases in English; word by word `expand` does the rest."""
    low = F.trim(F.regexp_replace(F.lower(empty(text)), r"\s+", " "))
    return reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), lexicon_values.MIXED_PHRASES, low)


def enriched(queries: DataFrame, mixed: DataFrame, id_col: str, text: str) -> DataFrame:
    """query_id, enriched: the question's rewritten form, then what its words mean by the mixed lexicon (term, expansion)."""
    own = queries.select(F.col(id_col).alias("query_id"), F.col(text).alias("text"))
    plain = F.array_join(F.filter(F.split(F.lower(empty("text")), r"\s+"), lambda w: w != ""), " ")
    added = expand(own, mixed, "query_id", "text").join(own.select("query_id", plain.alias("plain"), rewritten("text").alias("rewritten")), "query_id")
    return added.select("query_id", F.concat("rewritten", F.substr("expanded", F.char_length("plain") + 1)).alias("enriched"))


def retrieval_text(queries: DataFrame, lexicon: DataFrame, mixed: DataFrame, id_col: str, text: str) -> DataFrame:
    """query_id, full: the question expanded by the lexicon, then its rewritten form with the mixed lexicon's words."""
    first, second = expand(queries, lexicon, id_col, text), enriched(queries, mixed, id_col, text)
    return first.join(second, "query_id").select("query_id", F.concat_ws(" ", "expanded", "enriched").alias("full"))


def area_words(areas: tuple[tuple[str, str, tuple[str, ...]], ...]) -> dict[str, list[str]]:
    """The words that name each area (id, label, parts): its id, and words of three letters of its label and parts."""
    named = {}
    for area, label, parts in areas:
        found = [w for source in (label, *parts) for w in re.findall("[a-z]{3,}", source.lower()) if w not in fixed.AREA_STOP_WORDS]
        named[area] = list(dict.fromkeys([area.replace("-", " "), *found]))
    return named


def asked_area(text: Column | str, named: dict[str, list[str]]) -> Column:
    """The first area, in the given order, of which a word stands in the question as a whole; else null."""
    return first_pattern(text, {area: r"\b(?:" + "|".join(map(re.escape, found)) + r")\b" for area, found in named.items()})


def refolded(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """User turns with the question that retrieval should see.

    A turn right after a clarifying prompt, or a bare answer of a few words that names a
    coach or maker, is put behind the last non-blank user turn before it.
    """
    order = Window.partitionBy(conv).orderBy(turn)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    asked_back = (F.lag(role).over(order) == "assistant") & F.lower(F.lag(text).over(order)).contains(fixed.CLARIFY_MARKER)
    count = F.size(F.filter(F.split(empty(text), r"\s+"), lambda w: w != ""))
    bare = (count <= fixed.SHORT_ANSWER_WORDS) & (asked_coach(text).isNotNull() | asked_maker(text).isNotNull())
    prior = F.last(F.when((F.col(role) == "user") & (F.trim(text) != ""), F.col(text)), True).over(before)
    rows = turns.withColumn("_prior", prior).withColumn("_fold", F.coalesce(asked_back, F.lit(False)) | bare)
    folded = F.when(F.col("_fold") & F.col("_prior").isNotNull(), F.concat("_prior", F.lit(" "), text)).otherwise(F.col(text))
    return rows.where(F.col(role) == "user").select(conv, turn, folded.alias("retrieval_query"))


def recent_history(turns: DataFrame, pairs: int = 4, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The last 2 * pairs turns of each conversation that have text and one of the two speaking roles."""
    spoken = turns.where(col(role).isin("user", "assistant") & (F.trim(text) != ""))
    return spoken.withColumn("back", F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))).where(F.col("back") <= 2 * pairs)


def retried(turns: DataFrame, failed: Column, conv: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    """turns without failed answers and the questions right before them, as a retry asks them again."""
    own = Window.partitionBy(conv).orderBy(turn)
    rows = turns.withColumn("_failed", (F.col(role) == "assistant") & F.coalesce(failed, F.lit(False)))
    asked = (F.col(role) == "user") & F.coalesce(F.lead("_failed").over(own), F.lit(False))
    return rows.withColumn("_asked", asked).where("not _failed and not _asked").drop("_failed", "_asked")

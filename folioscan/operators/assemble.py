"""Context and citations of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import fixed
from folioscan.functions.text import citation, col, dotted_date, empty, header_field, page_label, whitespace_folded


def source_text(text: Column | str, most: int = fixed.CONTEXT_CHUNK_CHARS) -> Column:
    """A chunk as context shows it: tables keep their lines, prose is one line, cut at `most`."""
    raw = F.trim(empty(text))
    flat = F.when(raw.contains("|") & raw.contains("\n"), F.regexp_replace(raw, r"[ \t]+", " ")).otherwise(whitespace_folded(raw))
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit(" …"))).otherwise(flat)


def source_header(rank: Column | str) -> Column:
    """[Source n: title | clause section | page | coach | maker | reference | status] from the row's columns."""
    clause = F.when(empty("section_num") != "", F.concat(F.lit("Clause "), header_field("section_num"), F.lit(" "))).otherwise("")
    section = F.trim(F.concat(clause, header_field("section")))
    page = header_field(page_label("page_num", "printed_page"))
    coach = header_field(F.array_join(F.coalesce("coach_type", F.array().cast("array<string>")), ", "))
    ref = header_field(citation("letter_no", "issue_date"))
    field = lambda name, value: F.when(value != "", F.concat(F.lit(f" | {name}"), value)).otherwise("")
    return F.concat(
        F.lit("[Source "), col(rank).cast("string"), F.lit(": "), header_field(F.coalesce("title", F.col("doc_id").cast("string"))),
        field("", F.substring(section, 1, 70)), field("", page), field("Coach: ", coach), field("OEM: ", header_field("oem")), field("Ref: ", ref),
        field("SUPERSEDED by ", header_field("superseded_by")), F.when(empty("status") == "draft", " | DRAFT (lower authority)").otherwise(""), F.lit("]"),
    )


def build_context(ranked: DataFrame) -> DataFrame:
    """query_id, context: the sources of each question in rank order, with blank lines between."""
    one = F.concat(source_header("rank"), F.lit("\n"), source_text("text"))
    listed = ranked.select("query_id", F.struct("rank", one.alias("s")).alias("x")).groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return listed.select("query_id", F.array_join(F.transform("x", lambda s: s["s"]), "\n\n").alias("context"))


def within_budget(sources: DataFrame, most: int, size: Column | str, separator: int = 2) -> DataFrame:
    """Leading sources of each question that fit into `most` characters together; the first always stays.

    sources: query_id, rank; each source after the first costs `separator` characters more.
    """
    own = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    cost = col(size) + F.when(F.col("rank") > 1, separator).otherwise(0)
    return sources.withColumn("used", F.sum(cost).over(own)).where((F.col("used") <= most) | (F.col("rank") == 1))


def citations(ranked: DataFrame) -> DataFrame:
    """Citation rows of each question: one per title, clause and section, in rank order."""
    section = F.substring(empty("section"), 1, 50)
    rows = ranked.withColumn("_key", F.concat_ws("|", F.coalesce("title", F.col("doc_id").cast("string")), empty("section_num"), section))
    own = Window.partitionBy("query_id", "_key").orderBy("rank")
    url, page = empty("download_url"), empty(F.col("page_num").cast("string"))
    return (
        rows.withColumn("_n", F.row_number().over(own))
        .where("_n = 1")
        .select(
            "query_id", "rank", "doc_id", F.coalesce("title", F.col("doc_id").cast("string")).alias("title"), section.alias("section"), empty("section_num").alias("clause"), "page_num",
            dotted_date("issue_date").alias("date_label"), citation("letter_no", "issue_date").alias("ref"),
            F.when((url != "") & (page != ""), F.concat(url, F.lit("#page="), page)).otherwise(url).alias("url"),
        )
    )


def citation_markdown(ranked: DataFrame) -> DataFrame:
    """query_id, sources: the citations as a markdown list."""
    rows = citations(ranked).join(ranked.select("query_id", "rank", page_label("page_num", "printed_page").alias("label")), ["query_id", "rank"])
    safe = F.translate("title", "[]", "()")
    name = F.when(F.col("url") == "", F.concat(F.lit("**"), "title", F.lit("**"))).otherwise(F.concat(F.lit("[**"), safe, F.lit("**]("), "url", F.lit(")")))
    place = F.concat_ws(" ", F.when(F.col("clause") != "", F.concat(F.lit("Clause "), "clause")), F.nullif("section", F.lit("")))
    line = F.concat(F.lit("- "), name, F.when(place != "", F.concat(F.lit(" → "), place)).otherwise(""), F.when(F.col("label") != "", F.concat(F.lit(" ("), "label", F.lit(")"))).otherwise(""), F.when(F.col("ref") != "", F.concat(F.lit(" — "), "ref")).otherwise(""))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda s: s["l"]), "\n").alias("sources"))

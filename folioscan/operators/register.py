"""Rows of a register from files' names and first pages, with where each field is from and what a person should look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import fixed, rules
from folioscan.functions import text as X
from folioscan.operators.quality import stop_word_ratio

IMAGE_ONLY_CHARS = 120


def _first(*sources: tuple[str, Column]) -> tuple[Column, Column]:
    """(value, name of its source) of the first source that has one; '' and 'none' if none has."""
    filled = [(name, F.nullif(value, F.lit(""))) for name, value in sources]
    value = F.coalesce(*(v for _, v in filled), F.lit(""))
    return value, F.coalesce(*(F.when(v.isNotNull(), F.lit(name)) for name, v in filled), F.lit("none"))


def register_entries(files: DataFrame, doc_types: tuple[tuple[str, str], ...], subsystems: tuple[tuple[str, str], ...], prefix: str = "VB_", system: str = "VB", coach: str = "Vande Bharat") -> DataFrame:
    """path, doc_id, doc_type, title, system, coach_type, subsystem, issue_date, letter_no, force_ocr, origin, review.

    files: path, first_page, pages, scans, text_chars. Date, letter number and title are the
    page's where it has them, else the file name's; origin tells which. review lists what a
    person should look at: fields on which name and page disagree (what a scanner misreads), or
    that neither has, scanned pages, a garbled first page, a missing subject line. Nulls count
    as '' or 0; a file without pages isn't called image-only. Texts are read by one projection
    and what they give compared by the next, so that each pattern is searched once a row.
    """
    count = lambda c: F.coalesce(c, F.lit(0))
    page, name = F.col("_page"), F.col("_name")
    read = files.select("path", X.empty("first_page").alias("_page"), F.regexp_extract(F.replace(X.empty("path"), F.lit("\\"), F.lit("/")), r"[^/]*$", 0).alias("_name"), count("pages").alias("_pages"), count("scans").alias("_scans"), count("text_chars").alias("_chars"))
    read = read.withColumn("_both", F.concat_ws(" ", name, page)).select(
        "*", X.filename_date(name).alias("_named_date"), X.letterhead_date(page).alias("_page_date"), X.letter_of_filename(name).alias("_named_letter"), X.letter_of_text(page).alias("_page_letter"),
        F.trim(F.replace(F.regexp_replace(name, r"(.)\.[^./\\]*$", "$1"), F.lit("_"), F.lit(" "))).alias("_stem"), X.title_of_text(page, F.lit("")).alias("_subject"), stop_word_ratio(page).alias("_ratio"),
    )
    both, named_date, page_date, named_letter, page_letter, stem, subject, pages, scans, chars = map(F.col, ("_both", "_named_date", "_page_date", "_named_letter", "_page_letter", "_stem", "_subject", "_pages", "_scans", "_chars"))
    date, date_from = _first(("page", page_date), ("name", named_date))
    letter, letter_from = _first(("page", page_letter), ("name", named_letter))
    title, title_from = _first(("page", subject), ("name", stem))
    flat = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("")))
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    versus = lambda what, a, b: F.concat(F.lit(f"{what}: filename="), a, F.lit(" vs page="), b)
    review = F.array(
        F.when((named_date != "") & (page_date != "") & (named_date != page_date), versus("date", named_date, page_date)),
        F.when(date == "", "no date found"),
        F.when((named_letter != "") & (page_letter != "") & ~F.contains(flat(page_letter), flat(named_letter)), versus("letter_no", quoted(named_letter), quoted(page_letter))),
        F.when(letter == "", "no letter_no found"),
        F.when(scans > 0, F.concat(scans.cast("string"), F.lit("/"), pages.cast("string"), F.lit(" pages are scans, look again when they have been read"))),
        F.when(F.col("_ratio") < fixed.STOP_WORD_MIN, "page 1 text is mojibake"),
        F.when(~page.rlike(rules.SUBJECT), "no 'Sub:' line, title taken from filename"),
    )
    return read.select(
        "path",
        X.document_slug(name, prefix).alias("doc_id"),
        X.classified(both, doc_types, "circular").alias("doc_type"),
        title.alias("title"),
        F.lit(system).alias("system"),
        F.array(F.lit(coach)).alias("coach_type"),
        X.classified(both, subsystems, "").alias("subsystem"),
        date.alias("issue_date"),
        letter.alias("letter_no"),
        ((pages > 0) & (chars / F.greatest(pages, F.lit(1)) < IMAGE_ONLY_CHARS)).alias("force_ocr"),
        F.struct(date_from.alias("issue_date"), letter_from.alias("letter_no"), title_from.alias("title")).alias("origin"),
        F.filter(review, lambda x: x.isNotNull()).alias("review"),
    )

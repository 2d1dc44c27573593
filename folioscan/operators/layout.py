"""Geometry of pages: reading order, regions, table candidates and what continues over a page break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import rules
from folioscan.functions.text import empty, label_like, markdown_cells, whitespace_folded

SCAN_COVERAGE = 0.9


def html_lines(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, place, text, heading: the visible lines of web pages, with whether a heading tag held them.

    Scripts, styles, comments and tags go; block tags end a line; the five named entities
    and no-break space are decoded.
    """
    html = F.regexp_replace(empty(html_col), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    html = F.regexp_replace(html, r"(?i)<h[1-6]\b[^>]*>", "\n\x01")
    html = F.regexp_replace(html, r"(?i)<(?:/?(?:p|div|li|ul|ol|tr|table|section|article|header|footer|nav|body|head|title|main|aside|blockquote|pre|form|dl|dt|dd)|/h[1-6]|br)\b[^>]*>", "\n")
    text = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda s: whitespace_folded(s)), lambda s: (s != "") & (s != "\x01"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.posexplode(lines).alias("place", "text"))
    return rows.withColumn("heading", F.col("text").startswith("\x01")).withColumn("text", F.trim(F.replace("text", F.lit("\x01"), F.lit(""))))


def reading_order(words: DataFrame, page: str, x: str, y: str, tie: str) -> DataFrame:
    """words with `place`: by height to one decimal, then from the left, at one spot by `tie`."""
    return words.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy(F.round(y, 1), x, tie)))


def body_size(runs: DataFrame, doc: str, size: str, chars: str) -> DataFrame:
    """doc, body_size: the font size, to half points, with the most characters; the larger of equals."""
    sums = runs.groupBy(doc, (F.round(F.col(size) * 2) / 2).alias("s")).agg(F.sum(chars).alias("n"))
    return sums.groupBy(doc).agg(F.max_by("s", F.struct("n", "s")).alias("body_size"))


def is_scanned(image_area: Column, page_area: Column) -> Column:
    return F.coalesce(image_area / F.nullif(page_area, F.lit(0)), F.lit(0.0)) >= SCAN_COVERAGE


def ocr_needed(pages: DataFrame, least_chars: int = 50) -> DataFrame:
    """Pages that are scans or hold hardly any text, and that nobody tried to read yet.

    pages: chars, image_area, page_area, ocr_attempted.
    """
    return pages.where((is_scanned(F.col("image_area"), F.col("page_area")) | (F.col("chars") < least_chars)) & ~F.coalesce("ocr_attempted", F.lit(False)))


def outside_regions(boxes: DataFrame, regions: DataFrame, page: str) -> DataFrame:
    """Boxes (x0, y0, x1, y1) whose centre lies in no region of their page: an anti join on the page and the range."""
    r = regions.select(F.col(page).alias("_page"), *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (F.col(page) == F.col("_page")) & cx.between(F.col("_x0"), F.col("_x1")) & cy.between(F.col("_y0"), F.col("_y1"))
    return boxes.join(r, inside, "left_anti")


def table_measures(candidates: DataFrame, lines: DataFrame, page: str) -> DataFrame:
    """candidates with covered, clipped and swallowed lines.

    candidates: page, table_id, x0, y0, x1, y1; lines: page, x0, y0, x1, y1, running. A line at
    the table's height is covered if its centre is inside, clipped if beside it; a running
    line inside is swallowed.
    """
    ln = lines.select(F.col(page).alias("_page"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), "running")
    near = candidates.join(ln, (F.col(page) == F.col("_page")) & F.col("cy").between(F.col("y0"), F.col("y1")), "left")
    within = F.col("cx").between(F.col("x0"), F.col("x1"))
    count = lambda c: F.count(F.when(c, 1))
    return near.groupBy(*candidates.columns).agg(count(within & ~F.col("running")).alias("covered"), count(~within & ~F.col("running")).alias("clipped"), count(within & F.col("running")).alias("swallowed"))


def best_strategy(measured: DataFrame, page: str) -> DataFrame:
    """page, strategy: the least unnamed columns, then clipped, swallowed, most covered, fewest columns, first name.

    measured: page, strategy, unnamed, clipped, swallowed, covered, columns per table.
    """
    sums = measured.groupBy(page, "strategy").agg(*(F.sum(c).alias(c) for c in ("unnamed", "clipped", "swallowed", "covered", "columns")))
    return sums.groupBy(page).agg(F.min_by("strategy", F.struct("unnamed", "clipped", "swallowed", (-F.col("covered")).alias("c"), "columns", "strategy")).alias("strategy"))


def header_quality(header: Column | str) -> Column:
    """Share of a header row's cells that read like labels."""
    cells = markdown_cells(header)
    return F.size(F.filter(cells, lambda c: label_like(c))) / F.greatest(F.size(cells), F.lit(1))


def carried_headers(tables: DataFrame, doc: str, order: str, page: str, header: str) -> DataFrame:
    """tables with `used_header`: their own if it is good, else the last good one that continues to here.

    A header continues to a table of as many columns while no page without one lies between;
    tables of one column count follow each other in `order`.
    """
    rows = tables.withColumn("_n", F.size(markdown_cells(header))).withColumn("_good", header_quality(header) >= 0.5)
    own = Window.partitionBy(doc, "_n").orderBy(page, order)
    rows = rows.withColumn("_break", F.col("_good") | (F.coalesce(F.col(page) - F.lag(page).over(own), F.lit(99)) > 1))
    rows = rows.withColumn("_run", F.sum(F.col("_break").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    first = Window.partitionBy(doc, "_n", "_run").orderBy(page, order)
    led = F.first(F.when(F.col("_good"), F.col(header))).over(first)
    return rows.withColumn("used_header", F.coalesce(led, F.col(header))).drop("_n", "_good", "_break", "_run")


def header_names(header: Column | str) -> Column:
    """The distinct labels of a header row that name something, without marks and white space."""
    named = F.filter(markdown_cells(header), lambda c: (F.trim(F.regexp_replace(c, r"\*+", "")) != "") & ~F.trim(F.regexp_replace(c, r"\*+", "")).rlike(r"^Col\d+$"))
    return F.array_distinct(F.filter(F.transform(named, lambda c: F.lower(F.regexp_replace(c, r"[\s|*_`]+", ""))), lambda c: c != ""))


def carried_labels(tables: DataFrame, doc: str, order: str, page: str, header: str, label: str) -> DataFrame:
    """tables with `carried_label`: the group label still open where a table goes on from the one before, else ''.

    label: the last group label inside each table, null if it has none. A table goes on from
    the one before it if no page lies between and their headers share three names, or half
    of the shorter header's. An open label passes through tables without one.
    """
    own = Window.partitionBy(doc).orderBy(page, order)
    rows = tables.withColumn("_names", header_names(header))
    names, before = F.col("_names"), F.lag("_names").over(own)
    shared = F.size(F.array_intersect(names, before))
    goes_on = (F.col(page) - F.lag(page).over(own) <= 1) & (F.size(names) > 0) & (F.size(before) > 0) & ((shared >= 3) | (shared >= F.least(F.size(names), F.size(before)) * 0.5))
    rows = rows.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(doc, "_run").orderBy(page, order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("carried_label", F.coalesce(F.last(label, True).over(run), F.lit(""))).drop("_names", "_new", "_run")


def group_label(row: Column | str) -> Column:
    """The one text that all filled cells of a spanning row repeat, else ''."""
    cells = F.transform(markdown_cells(row), lambda c: whitespace_folded(F.regexp_replace(F.regexp_replace(c, r"\*+", ""), r"\s*<br>\s*", " ")))
    filled = F.array_distinct(F.filter(cells, lambda c: c != ""))
    label = F.try_element_at(filled, F.lit(1))
    fits = F.char_length(label).between(3, 140) & (F.char_length(F.regexp_replace(label, r"[^\p{L}]", "")) >= 3)
    return F.when((F.size(cells) >= 2) & (F.size(filled) == 1) & fits, label).otherwise("")


def equipment_runs(rows: DataFrame, table: str, order: str, value: str) -> DataFrame:
    """rows with `equipment` (carried down a merged column) and `opens` where a run begins.

    A table in which over a third of the rows would open a run has no merged column: none opens.
    """
    v = whitespace_folded(F.regexp_replace(empty(value), r"\s*<br>\s*", " "))
    word_count = F.size(F.split(v, " "))
    prose = v.startswith("_") | F.lower(v).startswith("note") | (word_count > 10) | (v.rlike(rules.EQUIPMENT_COLUMN) & (word_count <= 4))
    named = F.char_length(v).between(3, 140) & (F.char_length(F.regexp_replace(v, r"[^\p{L}]", "")) >= 3) & ~prose
    own = Window.partitionBy(table).orderBy(order)
    marked = rows.withColumn("_v", F.when(named, v))
    marked = marked.withColumn("equipment", F.last("_v", True).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.last("_v", True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("opens", F.col("_v").isNotNull() & ~F.col("_v").eqNullSafe(before))
    whole = Window.partitionBy(table)
    able = F.sum(F.col("opens").cast("int")).over(whole) <= F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(whole) / 3))
    return marked.withColumn("_able", able).withColumn("opens", F.col("opens") & F.col("_able")).withColumn("equipment", F.when(F.col("_able"), F.col("equipment"))).drop("_v", "_able")


def folded_header(header: Column | str, labels: Column | str) -> Column:
    """A two-level header as one row, if the row below has more named labels; else the header."""
    h, f = markdown_cells(header), markdown_cells(labels)
    plain = lambda c: F.trim(F.regexp_replace(c, r"\*+", ""))
    named = lambda c: (plain(c) != "") & ~plain(c).rlike(r"^Col\d+$")
    flat = lambda c: F.lower(F.regexp_replace(c, r"[\s|*_`]+", ""))
    within = lambda a, b: (F.char_length(flat(b)) >= 3) & F.contains(flat(a), flat(b))

    def merge(a: Column, b: Column) -> Column:
        a, b = plain(a), plain(b)
        return F.when(~named(a) | within(b, a), b).when((b == "") | within(a, b), a).otherwise(F.concat(a, F.lit(" "), b))

    more = F.size(F.filter(f, lambda c: named(c))) > F.size(F.filter(h, lambda c: named(c)))
    joined = F.concat(F.lit("|"), F.array_join(F.zip_with(h, f, merge), "|"), F.lit("|"))
    return F.when((F.size(h) == F.size(f)) & more, joined).otherwise(empty(header))


def subject_title(text: Column | str, title: Column | str, page: Column | str) -> Column:
    """Section title of a read page: its subject line, the registered title, a short line, the page."""
    subject = F.trim(F.regexp_replace(F.regexp_extract(empty(text), rules.SUBJECT, 1), r"[*_`]", ""), F.lit(" .:-"))
    lines = F.filter(F.transform(F.split(empty(text), "\n"), lambda s: F.trim(s)), lambda s: F.char_length(s).between(3, 80))
    registered = F.substring(F.trim(empty(title)), 1, 120)
    page = F.concat(F.lit("Page "), (F.col(page) if isinstance(page, str) else page).cast("string"))
    return F.coalesce(F.when(F.char_length(subject).between(3, 120), subject), F.nullif(registered, F.lit("")), F.try_element_at(lines, F.lit(1)), page)


def letter_sections(sections: DataFrame, pages: Column) -> DataFrame:
    """Sections of short letters take the letter's title; sections: doc_type, title, section."""
    letter = F.col("doc_type").isin(*rules.LETTER_TYPES) & (pages <= rules.LETTER_MAX_PAGES) & (F.trim(empty("title")) != "")
    return sections.withColumn("section", F.when(letter, F.trim("title")).otherwise(F.col("section")))


def drawing_items(index: DataFrame, groups: DataFrame) -> DataFrame:
    """gid, number, name, page: the drawings that an index lists, with a page where the order proves it.

    index: text of a drawing index; groups: gid, low, high. The page is exact only if a
    group lists as many drawings as it has pages, else it is the group's first one.
    """
    text = whitespace_folded("text")
    body = F.regexp_replace(text, rules.INDEX_GROUP, "\x01$1\x02$2\x02")
    parts = F.filter(F.split(body, "\x01"), lambda s: s.contains("\x02"))
    part = index.select(F.explode(parts).alias("part")).select(F.split("part", "\x02").alias("p"))
    listed = part.select(F.col("p")[0].alias("gid"), F.regexp_extract_all(F.trim(F.col("p")[2]), F.lit(rules.INDEX_ITEM), F.lit(0)).alias("items"))
    rows = listed.join(groups, "gid").withColumn("exact", F.size("items") == F.col("high") - F.col("low") + 1)
    rows = rows.select("gid", "low", "exact", F.posexplode("items").alias("k", "item"))
    return rows.select("gid", F.regexp_extract("item", r"^(\d+)", 1).cast("int").alias("number"), F.trim(F.regexp_extract("item", r"^\d+\.\s+(.+)$", 1)).alias("name"), F.when(F.col("exact"), F.col("low") + F.col("k")).otherwise(F.col("low")).alias("page"), "exact")


def read_sections(pages: DataFrame, native: str, read: str, title: str, page: str) -> DataFrame:
    """pages with `text` and `section`, of documents whose native text isn't to be trusted: one section per page.

    What was read from the page's image comes first, native text only where nothing was read;
    pages without either go.
    """
    text = F.coalesce(F.nullif(F.col(read), F.lit("")), whitespace_folded(native))
    rows = pages.withColumn("text", text).where("text <> ''")
    return rows.withColumn("section", subject_title("text", title, page))


def per_page(sections: DataFrame, pages: DataFrame, doc: str, least_sections: int = 3, least_pages: int = 4) -> DataFrame:
    """doc of the documents whose headings failed: fewer than least_sections sections on least_pages pages or more.

    sections: doc, section_no; pages: doc, page. A document without any section counts too.
    """
    found = sections.groupBy(doc).agg(F.countDistinct("section_no").alias("_sections"))
    sizes = pages.groupBy(doc).agg(F.countDistinct("page").alias("_pages"))
    return sizes.join(found, doc, "left").where((F.coalesce("_sections", F.lit(0)) < least_sections) & (F.col("_pages") >= least_pages)).select(doc)


def _filled(row: Column | str) -> Column:
    return F.filter(markdown_cells(row), lambda c: F.trim(F.regexp_replace(c, r"\*+", "")) != "")


def label_row(row: Column | str) -> Column:
    """Whether a row names columns: no filled cell is longer than 60 characters, and half of them are bold."""
    cells = _filled(row)
    longest = F.array_max(F.transform(cells, lambda c: F.char_length(F.trim(F.regexp_replace(c, r"\*+", "")))))
    bold = F.size(F.filter(cells, lambda c: c.startswith("**")))
    return (F.size(cells) > 0) & (longest <= 60) & (bold >= F.greatest(F.lit(1), F.floor(F.size(cells) / 2)))


def running_row(row: Column | str, repeated: Column | str) -> Column:
    """Whether a row is one of the repeated lines of its document (array) spread over the columns."""
    flat = lambda c: F.lower(F.regexp_replace(c, r"[\s|*_`]+", ""))
    joined = flat(F.array_join(F.filter(_filled(row), lambda c: ~F.trim(F.regexp_replace(c, r"\*+", "")).rlike(r"^Col\d+$")), ""))
    lines = F.filter(F.transform(F.col(repeated) if isinstance(repeated, str) else repeated, flat), lambda x: F.char_length(x) >= 12)
    return (F.char_length(joined) >= 12) & F.exists(lines, lambda x: F.contains(joined, x) | F.contains(x, joined))


def repaired_headers(tables: DataFrame, header: str, first_row: str) -> DataFrame:
    """tables with `repaired` and `row_used`: the header with the labels of the first row, where that row names columns."""
    folded = F.when(label_row(first_row), folded_header(header, first_row)).otherwise(empty(header))
    return tables.withColumn("repaired", folded).withColumn("row_used", folded != empty(header))

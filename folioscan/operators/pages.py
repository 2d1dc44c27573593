"""Web pages to blocks: headings, lines and tables with merged cells, then sections in two passes.

A page's markup is one row a token. What a parser keeps on a stack is told by windows over a
page's tokens: the depth of tables is a running sum that never falls below 0, the innermost open
table the last one opened at the present depth, rows and cells are counted inside it. So tags
that nobody closed or opened, and tables in cells, have one reading:

- a table tag opens a table, its end closes the innermost one; what is never closed goes on to
  the end of the page; an end without a beginning does nothing but end the line;
- a row begins at each tr; a cell at each td or th, and ends with it, its row, or the next one;
- text in a cell is the cell's, in order, without that of tables inside it; other text is
  lines, which block tags, br and tables end; a line in h1-h6 is a heading.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.functions import fixed
from folioscan.functions.text import empty, whitespace_folded
from folioscan.operators.layout import subject_title
from folioscan.operators.quality import stop_word_ratio

TOKEN = r"(?is)<!--.*?(?:-->|$)|<[!?][^>]*>?|<(?:script|style)\b.*?(?:</(?:script|style)\s*>|$)|</?[a-z][a-z0-9]*\b[^>]*>?|[^<]+|<"
BLOCK = "p div li ul ol tr td th table caption thead tbody tfoot section article header footer nav body head title main aside blockquote pre form dl dt dd br hr h1 h2 h3 h4 h5 h6".split()
HEADING = ["h1", "h2", "h3", "h4", "h5", "h6"]
MOST_SPAN = 1000


def decoded(text: Column) -> Column:
    """Text with the named entities of markup, and the no-break space, as characters."""
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def markup_tokens(pages: DataFrame, page: str, html: str) -> DataFrame:
    """page, i, tag (null for text), closes, text, and what is open there: depth, table, cell, row, heading, line."""
    tokens = pages.select(F.col(page).alias("page"), F.posexplode(F.regexp_extract_all(empty(html), F.lit(TOKEN), F.lit(0))).alias("i", "raw"))
    name = F.lower(F.regexp_extract("raw", r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    silent = F.col("raw").startswith("<!") | F.col("raw").startswith("<?") | name.isin("script", "style")
    rows = tokens.withColumn("i", F.col("i") + 1).withColumn("tag", F.when(~silent & (name != ""), name)).withColumn("closes", F.col("raw").startswith("</"))
    rows = rows.withColumn("text", F.when(silent, F.lit(" ")).when(F.col("tag").isNull(), decoded(F.col("raw"))))
    opens = lambda *names: F.col("tag").isin(*names) & ~F.col("closes")
    own = Window.partitionBy("page").orderBy("i")
    step = F.when(F.col("tag") == "table", F.when(F.col("closes"), -1).otherwise(1)).otherwise(0)
    rows = rows.withColumn("_sum", F.sum(step).over(own)).withColumn("depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(own)))
    level = Window.partitionBy("page", "depth").orderBy("i")
    rows = rows.withColumn("table", F.when(F.col("depth") > 0, F.last(F.when(opens("table"), F.col("i")), True).over(level)))
    inside = Window.partitionBy("page", "table").orderBy("i")
    rows = rows.withColumn("row", F.when(F.col("table").isNotNull(), F.sum(opens("tr").cast("int")).over(inside)))
    edge = F.when(opens("td", "th"), F.col("i")).when(F.col("tag").isin("td", "th", "tr"), 0)
    rows = rows.withColumn("cell", F.when(F.col("table").isNotNull(), F.coalesce(F.last(edge, True).over(inside), F.lit(0))))
    rows = rows.withColumn("heading", F.coalesce(F.last(F.when(F.col("tag").isin(*HEADING), ~F.col("closes")), True).over(own), F.lit(False)))
    return rows.withColumn("line", F.sum(F.coalesce(F.col("tag").isin(*BLOCK), F.lit(False)).cast("int")).over(own)).drop("_sum")


def _joined(by: str, between: str) -> Column:
    """The texts of a group in the order of `by`."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), between)


def laid_out(cells: list[dict]) -> list[list[str]]:
    """A table's rows from its cells (row, text, across, down) in their order: a merged cell fills all its places.

    A cell takes the first free place of its row; a span ends with the table. Of cells that
    overlap the first keeps the place. Rows are filled up to the longest one with ''.
    """
    numbers = {r: k for k, r in enumerate(sorted({c["row"] for c in cells}))}
    taken: dict[tuple[int, int], str] = {}
    for c in cells:
        r, at = numbers[c["row"]], 0
        while (r, at) in taken:
            at += 1
        for down in range(r, min(len(numbers), r + c["down"])):
            for across in range(at, at + c["across"]):
                taken.setdefault((down, across), c["text"])
    width = 1 + max((a for _, a in taken), default=-1)
    return [[taken.get((r, a), "") for a in range(width)] for r in range(len(numbers))]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _laid_out(cells: pd.Series) -> pd.Series:
    return cells.map(lambda own: laid_out(sorted(own, key=lambda c: (c["row"], c["i"]))))


def page_tables(tokens: DataFrame) -> DataFrame:
    """page, i, rows of every table that has a cell: an array of rows of as many cells each."""
    number = lambda name: F.greatest(F.lit(1), F.least(F.lit(MOST_SPAN), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("raw", rf"(?i)\s{name}\s*=\s*[\"']?(\d{{1,4}})", 1), F.lit("")), F.lit("9999")).cast("int"), F.lit(1))))
    held = tokens.where("cell > 0")
    text = held.groupBy("page", "table", "row", "cell").agg(whitespace_folded(_joined("i", " ")).alias("text"))
    spans = tokens.where("cell = i").select("page", F.col("i").alias("cell"), number("colspan").alias("across"), number("rowspan").alias("down"))
    cells = text.join(spans, ["page", "cell"]).groupBy("page", "table").agg(F.collect_list(F.struct("row", F.col("cell").alias("i"), "text", "across", "down")).alias("cells"))
    return cells.select("page", F.col("table").alias("i"), _laid_out("cells").alias("rows"))


def markdown(rows: Column | str) -> Column:
    """A table's rows as markdown, the first one as its header; bars in cells are escaped."""
    line = lambda cells: F.concat(F.lit("|"), F.array_join(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))), "|"), F.lit("|"))
    rows = F.col(rows) if isinstance(rows, str) else rows
    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(rows[0])))
    return F.array_join(F.concat(F.array(line(rows[0]), rule), F.transform(F.slice(rows, 2, F.size(rows)), line)), "\n")


def page_blocks(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """page, i, kind ('heading', 'line', 'table'), text, rows (of tables): a page's blocks in the order of i.

    A null page has none; pages with equal ids are one page, their tokens mixed: ids are unique.
    """
    tokens = markup_tokens(pages, page, html)
    loose = tokens.where("coalesce(cell, 0) = 0")
    lines = loose.groupBy("page", "line").agg(F.min(F.when(F.col("tag").isNull() & (F.trim("text") != ""), F.col("i"))).alias("i"), whitespace_folded(_joined("i", "")).alias("text"), F.max(F.when(F.col("tag").isNull(), F.col("heading"))).alias("heading"))
    lines = lines.where("text <> '' and i is not null").select("page", "i", F.when(F.col("heading"), "heading").otherwise("line").alias("kind"), "text", F.lit(None).cast("array<array<string>>").alias("rows"))
    tables = page_tables(tokens)
    return lines.union(tables.select("page", "i", F.lit("table").alias("kind"), markdown("rows"), "rows"))


def document_sections(blocks: DataFrame, places: DataFrame, read: DataFrame | None = None, title: str = "", least_sections: int = 3, least_pages: int = 4) -> DataFrame:
    """doc, page_no, place, section, kind, text: the blocks of documents under their sections, in two passes.

    blocks: of page_blocks; places: page, doc, page_no; read: page, text as read from the page's
    image. A page whose native lines are garbled and that was read gives up its lines and
    headings; what was read follows its tables as a section of its own, titled by its subject
    line. What was read of other pages follows in the section that is open. Then the second
    pass: a document of least_pages or more with fewer than least_sections sections gets one
    section a page. Blocks before the first heading stand under 'Introduction'.
    """
    ratio = blocks.where("kind <> 'table'").groupBy("page").agg(_joined_lines().alias("whole")).select("page", (stop_word_ratio("whole") < fixed.STOP_WORD_MIN).alias("garbled"))
    read = (read if read is not None else blocks.limit(0)).select("page", F.nullif(F.trim("text"), F.lit("")).alias("read")).where("read is not null")
    pages = places.join(ratio, "page", "left").join(read, "page", "left").withColumn("replaced", F.coalesce("garbled", F.lit(False)) & F.col("read").isNotNull())
    own = blocks.select("page", "i", "kind", "text").join(pages, "page").where("kind = 'table' or not replaced")
    last = F.lit(1 << 30)
    added = pages.where("read is not null").select("page", last.alias("i"), F.lit("line").alias("kind"), F.col("read").alias("text"), "doc", "page_no", "garbled", "read", "replaced")
    opened = added.where("replaced").select("page", (last - 1).alias("i"), F.lit("heading").alias("kind"), subject_title("read", F.lit(title), "page_no").alias("text"), "doc", "page_no", "garbled", "read", "replaced")
    rows = own.unionByName(added).unionByName(opened)
    order = Window.partitionBy("doc").orderBy("page_no", "page", "i")
    rows = rows.withColumn("_no", F.sum((F.col("kind") == "heading").cast("int")).over(order))
    body = rows.where("kind <> 'heading'")
    counts = body.groupBy("doc").agg(F.countDistinct("_no").alias("_sections")).join(places.groupBy("doc").agg(F.countDistinct("page_no").alias("_pages")), "doc")
    failed = counts.where((F.col("_sections") < least_sections) & (F.col("_pages") >= least_pages)).select("doc", F.lit(True).alias("_by_page"))
    titles = rows.where("kind = 'heading'").select("doc", "_no", F.col("text").alias("_title"))
    named = body.join(titles, ["doc", "_no"], "left").join(failed, "doc", "left")
    whole = named.withColumn("_first", F.first("text").over(Window.partitionBy("doc", "page").orderBy("i")))
    section = F.when(F.col("_by_page"), subject_title("_first", F.lit(title), "page_no")).otherwise(F.coalesce("_title", F.lit("Introduction")))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("page_no", "page", "i"))
    return whole.select("doc", "page_no", place.alias("place"), section.alias("section"), "kind", "text")


def _joined_lines() -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ")

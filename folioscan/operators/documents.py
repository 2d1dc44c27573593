"""Whole documents: from sections and their blocks to chunk rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import fixed
from folioscan.functions.text import chunk_id, empty, table_columns, whitespace_folded
from folioscan.operators import chunking as K
from folioscan.operators import tagging as G
from folioscan.sources.files import written
from folioscan.sources.tables import register as with_defaults

GENERAL = ("", "introduction", "general")
JOIN = " › "


def _stripped(c: Column | str) -> Column:
    return F.regexp_replace(empty(c), r"^\s+|\s+$", "")


def merged_sections(sections: DataFrame, blocks: DataFrame, least: int = fixed.MIN_SECTION_CHARS) -> tuple[DataFrame, DataFrame]:
    """(hosts, blocks): tiny sections dissolve in others, and their titles stay as text.

    sections: doc_id, section_no, section, section_num, page_start; blocks: doc_id, section_no,
    place, type (text or table), text, page, table_index. hosts are the sections that stay,
    a 'General' one (-1) for a document of tiny ones; blocks get host_no and `at`, their
    place in the host. A dissolved title (but for introduction and general) opens its blocks.
    """
    chars = blocks.groupBy("doc_id", "section_no").agg(F.sum(F.char_length(empty("text"))).alias("chars"), F.min_by("page", "place").alias("first_page"))
    sized = K.merge_tiny_sections(sections.join(chars, ["doc_id", "section_no"], "left"), "doc_id", "section_no", "chars", least)
    page = F.coalesce("first_page", "page_start")
    title, num = whitespace_folded("section"), F.trim(empty("section_num"))
    dissolved = sized.where((F.col("host_no") != F.col("section_no")) & ~F.lower(title).isin(*GENERAL))
    label = F.concat(F.trim(F.concat_ws(" ", num, title)), F.lit(":"))
    titles = dissolved.select("doc_id", "section_no", F.lit(-1).cast("long").alias("place"), F.lit("text").alias("type"), label.alias("text"), page.cast("int").alias("page"), F.lit(None).cast("int").alias("table_index"))
    own = blocks.select("doc_id", "section_no", F.col("place").cast("long").alias("place"), "type", empty("text").alias("text"), F.col("page").cast("int").alias("page"), F.col("table_index").cast("int").alias("table_index"))
    placed = own.unionByName(titles).join(sized.select("doc_id", "section_no", "host_no"), ["doc_id", "section_no"])
    inside = Window.partitionBy("doc_id", "host_no").orderBy("section_no", "place", "type", "text")
    placed = placed.withColumn("at", F.row_number().over(inside)).drop("section_no", "place")
    stay = sized.where(F.col("host_no") == F.col("section_no")).select("doc_id", "host_no", empty("section").alias("section"), num.alias("section_num"), F.col("page_start").cast("int").alias("page_start"))
    lone = sized.where("host_no = -1").groupBy("doc_id").agg(F.min_by(page, "section_no").cast("int").alias("page_start"))
    general = lone.select("doc_id", F.lit(-1).alias("host_no"), F.lit("General").alias("section"), F.lit("").alias("section_num"), "page_start")
    return stay.unionByName(general.withColumn("host_no", F.col("host_no").cast(stay.schema["host_no"].dataType))), placed


def chunk_documents(sections: DataFrame, blocks: DataFrame, register: DataFrame, printed: DataFrame | None = None, least: int = fixed.MIN_SECTION_CHARS) -> DataFrame:
    """Chunk rows of whole documents, with the register's columns of each document.

    sections and blocks as in merged_sections; register: doc_id and any of the register's
    columns (context_header, oem, system, ...; a document without a row gets the defaults);
    printed: doc_id, page, printed_page. Of a section the packed text comes first, then the
    pieces of its tables; a short text right above a table goes into its first piece if it
    fits, and stays text if not. The first of equal pieces of a document stays. A group label
    of a table takes the place of the section's title. Where the register has a
    context_header, header and section path open every piece. Nulls count as empty; a
    document of one section is as much as one task handles together. Hosts and placed blocks
    are written to the shared folder: several steps read them, none makes them again.
    """
    hosts, placed = merged_sections(sections, blocks, least)
    hosts = K.breadcrumbs(hosts, "doc_id", "host_no", "section_num", "section")
    known = with_defaults(register)
    known = known.withColumn("oem", empty("oem") if "oem" in register.columns else F.lit(""))
    header = known.select("doc_id", "context_header")
    title = F.substring(whitespace_folded("section"), 1, 120)
    hosts = hosts.join(header, "doc_id", "left").withColumn("title_", title)
    crumb = F.concat_ws(JOIN, F.nullif("context_header", F.lit("")), F.coalesce(F.nullif("section_path", F.lit("")), F.nullif("title_", F.lit(""))))
    hosts = hosts.withColumn("crumb", F.when(empty("context_header") != "", crumb).otherwise("")).drop("context_header")
    hosts, placed = written(hosts, "hosts"), written(placed, "placed")

    key = F.struct("doc_id", "host_no")
    tables = K.table_intros(placed.withColumn("_own", key), "_own", "at").join(hosts.select("doc_id", "host_no", "crumb", "title_"), ["doc_id", "host_no"])
    tables = tables.withColumn("block", F.concat_ws("\x1f", *(F.col(c).cast("string") for c in ("doc_id", "host_no", "at")))).withColumn("lead", _stripped("intro"))
    cut = K.split_tables(tables.select(F.col("block").alias("table_id"), F.col("text").alias("markdown"), F.coalesce(F.nullif("crumb", F.lit("")), "title_").alias("section"), F.col("lead").alias("intro")))
    cut = cut.withColumnsRenamed({"table_id": "block", "text": "piece_text"}).join(tables.select("block", "doc_id", "host_no", "at", "page", "table_index", "lead"), "block")
    placed_in = cut.where((F.col("lead") != "") & F.contains("piece_text", F.col("lead"))).select("doc_id", "host_no", (F.col("at") - 1).alias("at")).distinct()
    name = F.concat(F.col("doc_id").cast("string"), F.lit(":p"), F.col("page").cast("string"), F.lit(":t"), F.coalesce("table_index", F.lit(0)).cast("string"))
    of_tables = cut.select("doc_id", "host_no", F.lit(1).alias("kind"), "at", "piece", F.col("piece_text").alias("text"), "page", F.col("group_label").alias("label"), name.alias("table_id"))

    prose = placed.where("type = 'text'").join(placed_in, ["doc_id", "host_no", "at"], "left_anti")
    listed = prose.groupBy("doc_id", "host_no").agg(F.array_sort(F.collect_list(F.struct("at", "text", "page"))).alias("b"))
    packed = listed.select("doc_id", "host_no", F.posexplode(K.packed(F.transform("b", lambda x: F.struct(x["text"].alias("text"), x["page"].alias("page"))))).alias("piece", "p")).join(hosts.select("doc_id", "host_no", "crumb"), ["doc_id", "host_no"])
    whole = F.when(F.col("crumb") != "", F.concat("crumb", F.lit(":\n"), "p.text")).otherwise(F.col("p.text"))
    of_text = packed.select("doc_id", "host_no", F.lit(0).alias("kind"), F.lit(0).alias("at"), "piece", whole.alias("text"), F.col("p.page").alias("page"), F.lit("").alias("label"), F.lit("").alias("table_id"))

    pieces = of_text.unionByName(of_tables).withColumn("text", _stripped("text"))
    order = ("host_no", "kind", "at", "piece")
    pieces = K.deduplicated(pieces, "doc_id", "text", *order)
    own = Window.partitionBy("doc_id", "host_no")
    pieces = pieces.withColumn("chunk_index", F.row_number().over(own.orderBy("kind", "at", "piece")) - 1).withColumn("total_chunks_in_section", F.count(F.lit(1)).over(own).cast("int"))
    rows = pieces.join(hosts, ["doc_id", "host_no"]).join(known, "doc_id", "left")
    rows = rows.withColumn("section", F.when(F.col("label") != "", F.substring("label", 1, 120)).otherwise(F.col("title_"))).withColumn("page_num", F.coalesce("page", "page_start"))
    if printed is not None:
        rows = rows.join(printed.select("doc_id", F.col("page").alias("page_num"), "printed_page"), ["doc_id", "page_num"], "left")
    else:
        rows = rows.withColumn("printed_page", F.lit(""))
    rows = rows.withColumn("maker_", G.chunk_maker("text", "system", "oem"))
    more = [c for c in known.columns if c not in ("doc_id", "oem", "context_header")]
    return rows.select(
        chunk_id("doc_id", "section", "chunk_index", "text").alias("chunk_id"), "doc_id", "section", "section_num", "section_path", "page_num", empty("printed_page").alias("printed_page"), "chunk_index", "total_chunks_in_section",
        G.tags("text", "section", "system", "maker_").alias("tags"), empty("maker_").alias("oem"), F.when(F.col("table_id") != "", "table").otherwise("text").alias("chunk_type"), "table_id",
        F.when(F.col("table_id") != "", table_columns("text")).otherwise(F.array().cast("array<string>")).alias("columns"), *more, "text", F.char_length("text").alias("char_count"),
    )

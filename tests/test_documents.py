"""Chunk rows of whole documents against a plain walk over each document."""

import hashlib
import re

from pyspark.sql import functions as F

from folioscan.functions import fixed
from folioscan.operators import chunking as K
from folioscan.operators.documents import chunk_documents, merged_sections
from folioscan.plans import registry, structure
from folioscan.plans.base import Tables
from tests.test_chunking import plain_pack

BLOCKS = "doc_id long, section_no long, place long, type string, text string, page int, table_index int"
SECTIONS = "doc_id long, section_no long, section string, section_num string, page_start int"


def walk(doc_id, sections, blocks, header="", least=fixed.MIN_SECTION_CHARS):
    """(section, path, page, index, total, type, table id, text) of one document, section by section."""
    fold = lambda s: " ".join((s or "").split())
    hosts, waiting = [], []
    for s in sorted(sections, key=lambda s: s["section_no"]):
        own = sorted((b for b in blocks if b["section_no"] == s["section_no"]), key=lambda b: b["place"])
        if sum(len(b["text"] or "") for b in own) < least:
            if fold(s["section"]).lower() not in ("", "introduction", "general"):
                name = f"{(s['section_num'] or '').strip()} {fold(s['section'])}".strip()
                waiting.append({"type": "text", "text": f"{name}:", "page": own[0]["page"] if own else s["page_start"]})
            waiting += own
        else:
            hosts.append((s["section"], (s["section_num"] or "").strip(), s["page_start"], waiting + own))
            waiting = []
    if waiting:
        if hosts:
            hosts[-1][3].extend(waiting)
        else:
            hosts.append(("General", "", waiting[0]["page"], waiting))
    out, seen, open_, last = [], set(), {}, ""
    for section, num, page_start, own in hosts:
        title = fold(section)[:120]
        short = fold(section)[:80]
        if re.fullmatch(r"\d+(\.\d+)*", num):
            open_[num] = short
            parts = num.split(".")
            ups = [".".join(parts[: k + 1]) for k in range(len(parts))]
            path = last = " › ".join(f"{u} {open_[u]}" for u in ups if u in open_)
        else:
            path = f"{last} › {short}" if last else ""
        crumb = " › ".join(x for x in (header, path or title) if x) if header else ""
        used, of_tables = set(), []
        for k, b in enumerate(own):
            if b["type"] != "table":
                continue
            up = own[k - 1] if k else None
            fits = up is not None and up["type"] == "text" and up["page"] == b["page"] and len(up["text"] or "") <= 600
            intro = (up["text"] or "").strip() if fits else ""
            pieces = K.table_pieces(b["text"] or "", crumb or title, intro)
            if intro and any(intro in t for t, _ in pieces):
                used.add(k - 1)
            of_tables += [(t, b["page"], label, f"{doc_id}:p{b['page']}:t{b.get('table_index') or 0}") for t, label in pieces]
        prose = [(b["text"] or "", b["page"]) for k, b in enumerate(own) if b["type"] == "text" and k not in used]
        found = [(f"{crumb}:\n{t}" if crumb else t, p, "", "") for t, p in plain_pack(prose)] + of_tables
        fresh = []
        for piece in found:
            text = piece[0].strip()
            if text and text not in seen:
                seen.add(text)
                fresh.append((text, *piece[1:]))
        for i, (text, page, label, table) in enumerate(fresh):
            name = label[:120] if label else title
            cid = hashlib.md5(f"{doc_id}|{name}|{i}|{text}".encode()).hexdigest()[:12]
            out.append((cid, name, path, page if page is not None else page_start, i, len(fresh), "table" if table else "text", table, text))
    return sorted(out)


def rows_of(df):
    found = {}
    for r in df.collect():
        found.setdefault(r.doc_id, []).append((r.chunk_id, r.section, r.section_path, r.page_num, r.chunk_index, r.total_chunks_in_section, r.chunk_type, r.table_id, r.text))
    return {d: sorted(x) for d, x in found.items()}


def wanted(sections, blocks, headers):
    docs = {}
    for s in sections:
        docs.setdefault(s["doc_id"], ([], []))[0].append(s)
    for b in blocks:
        docs[b["doc_id"]][1].append(b)
    return {d: w for d, (s, b) in docs.items() if (w := walk(d, s, b, headers.get(d, "")))}


def test_pages_equal_a_plain_walk(spark, sf):
    sections, blocks, register = structure._documents(Tables(spark, sf))
    want = wanted([r.asDict() for r in sections.collect()], [r.asDict() for r in blocks.collect()], {r.doc_id: r.context_header for r in register.collect()})
    assert rows_of(registry.QUERIES["chunked_documents"](spark, sf)) == want and len(want) > 10


def test_odd_documents(spark):
    table = "\n".join(["|Item|Check|", "|---|---|", "|▸ Converter|", *(f"|row {i} {'x' * 50}|ok|" for i in range(80))])
    long = "This sentence is long enough to count. " * 12
    sections = [
        (1, 0, "Scope", "1", 1), (1, 1, "Tiny  title", "1.1", 1), (1, 2, "Drive", "1.2", 2), (1, 3, "Notes", "", 3), (1, 4, "General", "", 3), (1, 5, None, None, 4),
        (2, 0, "Only", "", 7), (3, 0, None, None, None), (4, 0, "Twice", "2", 1), (4, 1, "Again", "3", 1),
    ]
    blocks = [
        (1, 0, 0, "text", long, 1, None), (1, 1, 0, "text", "short one", 1, None), (1, 2, 0, "text", "Read this first.", 2, None), (1, 2, 1, "table", table, 2, 3), (1, 2, 2, "text", long, None, None),
        (1, 3, 0, "text", "tail", 3, None), (1, 4, 0, "text", None, 3, None), (2, 0, 0, "text", "A lone short section that is kept all the same.", 7, None), (4, 0, 0, "text", long, 1, None), (4, 1, 0, "text", long, 1, None),
    ]
    s, b = spark.createDataFrame(sections, SECTIONS).withColumn("text", F.lit("x")), spark.createDataFrame(blocks, BLOCKS)
    register = spark.createDataFrame([(1, "Book", "WSP", "MAKER"), (2, None, None, None)], "doc_id long, context_header string, system string, oem string")
    got = chunk_documents(s, b, register, spark.createDataFrame([(1, 2, "ii")], "doc_id long, page int, printed_page string"))
    names = lambda kind: [f.split()[0] for f in kind.split(", ")]
    want = wanted([dict(zip(names(SECTIONS), x, strict=True)) for x in sections], [dict(zip(names(BLOCKS), x, strict=True)) for x in blocks], {1: "Book"})
    assert rows_of(got) == want and set(want) == {1, 2, 4} and len(want[4]) == 1
    rows = got.collect()
    assert {r.printed_page for r in rows if r.doc_id == 1 and r.page_num == 2} == {"ii"} and {r.oem for r in rows if r.doc_id == 1} == {"MAKER"}
    assert any("1.1 Tiny title: " in r.text for r in rows) and {tuple(r.columns) for r in rows if r.chunk_type == "table"} == {("Item", "Check")}
    assert {r.section for r in rows if r.chunk_type == "table"} == {"Converter"} and all(len(r.text) == r.char_count for r in rows)
    hosts, _ = merged_sections(s, b)
    assert {(r.doc_id, r.host_no) for r in hosts.collect()} == {(1, 0), (1, 2), (2, -1), (3, -1), (4, 0), (4, 1)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SECTIONS), spark.createDataFrame([], BLOCKS), spark.createDataFrame([], "doc_id long")
    assert chunk_documents(*none).collect() == []


def test_pages_are_parsed_and_placed_once(spark, sf):
    plan = registry.QUERIES["chunked_documents"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "page_id" in plan and "script|style" not in plan

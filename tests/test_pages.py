"""Blocks of pages against a plain walk with a stack; merged cells; sections in two passes."""

import random
import re

from folioscan.operators import pages as P

NAMES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def fold(text):
    return " ".join(re.split(r"[ \t\n\r\f\x0b \s]+", text)).strip()


def walk(html):
    """(kind, text or rows) of a page's blocks, token by token."""
    stack, lines, tables = [], [], []
    line, heading, begun, state = "", False, None, False

    def end():
        nonlocal line, heading, begun
        if fold(line):
            lines.append((begun, "heading" if heading else "line", fold(line)))
        line, heading, begun = "", False, None

    for i, m in enumerate(re.finditer(P.TOKEN, html or ""), 1):
        raw = m[0]
        tag = re.match(r"</?([A-Za-z][A-Za-z0-9]*)", raw)
        name = tag[1].lower() if tag else None
        silent = raw.startswith(("<!", "<?")) or name in ("script", "style")
        closes = raw.startswith("</")
        if silent or name is None:
            text = " "
            if not silent:
                text = raw
                for a, b in NAMES:
                    text = text.replace(a, b)
            if stack and stack[-1]["cell"] is not None:
                stack[-1]["cell"]["parts"].append(text)
            else:
                line += text
                heading |= state
                if begun is None and not silent and text.strip(" "):
                    begun = i
                if begun is None and silent and text.strip(" "):
                    begun = i
            continue
        if name in P.BLOCK:
            end()
        if name in P.HEADING:
            state = not closes
        if name == "table":
            if closes:
                if stack:
                    stack.pop()
            else:
                stack.append({"i": i, "row": 0, "cell": None, "cells": []})
                tables.append(stack[-1])
        elif stack and name in ("tr", "td", "th"):
            top = stack[-1]
            top["cell"] = None
            if name == "tr":
                top["row"] += not closes
            elif not closes:
                span = {k: re.search(rf"(?i)\s{k}\s*=\s*[\"']?(\d{{1,4}})", raw) for k in ("colspan", "rowspan")}
                top["cell"] = {"row": top["row"], "i": i, "parts": [], "across": max(1, min(1000, int(span["colspan"][1]))) if span["colspan"] else 1, "down": max(1, min(1000, int(span["rowspan"][1]))) if span["rowspan"] else 1}
                top["cells"].append(top["cell"])
    end()
    out = [(i, kind, text) for i, kind, text in lines]
    for t in tables:
        if t["cells"]:
            out.append((t["i"], "table", P.laid_out([{**c, "text": fold(" ".join(c["parts"]))} for c in t["cells"]])))
    return sorted(out, key=lambda x: x[0])


def blocks(spark, htmls):
    rows = spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")
    found = [[] for _ in htmls]
    for r in P.page_blocks(rows).orderBy("page", "i").collect():
        found[r.page].append((r.i, r.kind, r.rows if r.kind == "table" else r.text))
    return found


def test_odd_markup_equals_the_walk(spark):
    r = random.Random(2)
    bits = ["<table>", "</table>", "<TABLE class='x'>", "<tr>", "</tr>", "<td>", "<td colspan=2>", "<th rowspan='2'>", "</td>", "</th>", "<p>", "</p>", "<br/>", "<h2>", "</h2>", "<b>", "</b>", "<!-- no -->", "<script>var t='<td>'</script>", "one ", "two", " three &amp; four ", "a < b", "&nbsp;", "\n", "<td colspan=0>", "<td rowspan=999>", "<!-- open", "<div", "<!DOCTYPE html>", "<?x"]
    weights = [1] * len(bits)
    for k in (-1, -3, -4):
        weights[k] = 0.02
    htmls = ["".join(r.choices(bits, weights, k=r.randint(0, 60))) for _ in range(300)] + [None, "", "plain", "</table></td>x", "<table><tr><td>a<table><tr><td>in</td></tr></table>b</td></tr></table>after"]
    assert blocks(spark, htmls) == [walk(h) for h in htmls]


def test_all_pages_equal_the_walk(spark, sf):
    htmls = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect()]
    htmls += [h.replace("<ul>", "<table>").replace("</ul>", "</table>").replace("<li>", "<tr><td colspan=2>").replace("</li>", "</td><td>x") for h in htmls if h]
    got = blocks(spark, htmls)
    assert got == [walk(h) for h in htmls] and sum(map(len, got)) > 500 and any(k == "table" for b in got for _, k, _ in b)


def test_merged_cells_fill_their_places():
    cell = lambda row, text, across=1, down=1: {"row": row, "text": text, "across": across, "down": down}
    assert P.laid_out([cell(1, "a", 2), cell(1, "b", 1, 3), cell(2, "c"), cell(2, "d"), cell(5, "e"), cell(5, "f", 3)]) == [["a", "a", "b", ""], ["c", "d", "b", ""], ["e", "f", "b", "f"]]
    assert P.laid_out([cell(1, "a", 1, 9), cell(1, "b"), cell(2, "c")]) == [["a", "b"], ["a", "c"]]
    assert P.laid_out([]) == []


def test_sections_in_two_passes(spark):
    prose = "the pump of the brake is to be set and the valve in the line is for the air that is with it"
    noise = "xq zv kk jq ww zz qq pp xx vv bb nn mm"
    html = {1: f"<h1>Brakes</h1><p>{prose}</p>", 2: f"<h1>xqzv</h1><p>{noise}</p><table><tr><td>k</td><td>v</td></tr></table>", 3: f"<p>{prose} again</p>", 4: f"<h2>Doors</h2><p>{prose} end</p>"}
    html |= {10 + k: f"<p>page {k} {prose}</p>" for k in range(4)}
    blocks_ = P.page_blocks(spark.createDataFrame(list(html.items()), "page_id long, html string"))
    places = spark.createDataFrame([(p, "flat" if p >= 10 else "doc", p) for p in html], "page long, doc string, page_no int")
    read = spark.createDataFrame([(2, "Sub: Pump overhaul\nset the pump"), (3, "labels"), (4, " ")], "page long, text string")
    rows = P.document_sections(blocks_, places, read).orderBy("doc", "place").collect()
    found = [(r.page_no, r.section, r.kind, r.text.split("\n")[0][:10]) for r in rows if r.doc == "doc"]
    assert found == [(1, "Brakes", "line", "the pump o"), (2, "Brakes", "table", "|k|v|"), (2, "Pump overhaul", "line", "Sub: Pump "), (3, "Pump overhaul", "line", "the pump o"), (3, "Pump overhaul", "line", "labels"), (4, "Doors", "line", "the pump o")]
    assert len({r.section for r in rows if r.doc == "flat"}) == 4

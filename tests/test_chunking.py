import random

from pyspark.sql import functions as F

from folioscan.functions import fixed
from folioscan.operators import chunking as K


def sentences(text, most=fixed.HARD_MAX):
    import re

    out = []
    for p in re.split(r"(?<=[.!?।])\s+|\n+", text):
        p = p.strip(" ")
        while p:
            out.append(p[:most])
            p = p[most:]
    return out


def plain_pack(blocks):
    pieces, held, size, page = [], [], 0, None
    for text, at in blocks:
        for s in sentences(text):
            limit = fixed.TARGET_HIGH if size >= fixed.TARGET_LOW else fixed.HARD_MAX
            if held and size + len(s) + 1 > limit:
                pieces.append((" ".join(held), page))
                keep = []
                while held and sum(map(len, keep)) + len(held[-1]) <= fixed.OVERLAP_CHARS:
                    keep.insert(0, held.pop())
                held, size, page = keep, sum(map(len, keep)), at
            page = at if page is None else page
            held.append(s)
            size += len(s) + 1
    if held and size > fixed.LEAST_PIECE:
        pieces.append((" ".join(held), page))
    return pieces


def test_packing_equals_a_plain_walk(spark):
    r = random.Random(1)
    rows = []
    for i in range(40):
        rows.append((i, [(" ".join("w" * r.randint(1, 60) + r.choice(["", ".", "!", "\n"]) for _ in range(r.randint(0, 120))), p) for p in range(r.randint(0, 5))]))
    rows += [(100, [("x" * 5000, 1)]), (101, []), (102, [("short", 3)]), (103, [("", 1), ("This piece is long enough to stay, surely.", 2)])]
    df = spark.createDataFrame(rows, "id long, blocks array<struct<text:string,page:int>>")
    for row in df.withColumn("p", K.packed("blocks")).collect():
        assert [(x.text, x.page) for x in row.p] == plain_pack([(b.text, b.page) for b in row.blocks])


def table(rows):
    return "\n".join(["|Item|Check|", "|---|---|", *rows])


def test_a_small_table_stays_whole():
    assert K.table_pieces(table(["|a|b|"]), "Brakes") == [("Table — Brakes:\n" + table(["|a|b|"]), "")]


def test_every_row_once_with_header_and_group_on_each_piece():
    rows = [f"|row {i:03d} {'x' * 60}|ok|" for i in range(90)]
    rows.insert(0, "|▸ Converter|")
    rows.insert(50, "|▸ Battery|")
    pieces = K.table_pieces(table(rows), "Electrical", "Read this first.")
    assert len(pieces) > 2 and all(len(t) <= fixed.TABLE_MAX for t, _ in pieces)
    for i in range(90):
        assert sum(t.count(f"row {i:03d} ") for t, _ in pieces) == 1
    assert all("|Item|Check|\n|---|---|" in t for t, _ in pieces)
    assert sum("Read this first." in t for t, _ in pieces) == 1 and "Read this first." in pieces[0][0]
    assert pieces[0][1] == "Converter" and pieces[-1][1] == "Battery" and "▸ Battery" in pieces[-1][0]


def test_a_row_wider_than_a_piece_is_cut_at_cells():
    wide = "|" + "|".join("c" * 900 for _ in range(6)) + "|"
    pieces = K.table_pieces(table(["|a|b|", wide, "|z|z|"]), "S")
    assert all(len(t) <= fixed.TABLE_MAX for t, _ in pieces)
    assert sum(t.count("c" * 900) for t, _ in pieces) == 6
    assert "".join(K.row_fragments("y" * 700, 0)) == "y" * 700


def test_tables_as_rows(spark):
    df = spark.createDataFrame([(1, table(["|a|b|"]), "S", None), (2, None, None, None)], "table_id long, markdown string, section string, intro string")
    assert {r.table_id for r in K.split_tables(df).collect()} == {1, 2}


def test_tiny_sections_go_forward_and_the_last_ones_back(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 1, 300), (1, 2, 20), (1, 3, 5), (1, 4, 900), (1, 5, 7), (2, 0, 9), (2, 1, None)], "d int, n int, chars int")
    got = {(r.d, r.n): r.host_no for r in K.merge_tiny_sections(df, "d", "n", "chars").collect()}
    assert got == {(1, 0): 1, (1, 1): 1, (1, 2): 4, (1, 3): 4, (1, 4): 4, (1, 5): 4, (2, 0): -1, (2, 1): -1}


def test_breadcrumbs(spark):
    rows = [(1, 0, "5", "Care"), (1, 1, "5.7", "Drive"), (1, 2, "", "Notes"), (1, 3, "5.7.1", "Line"), (1, 4, "6", "End"), (2, 0, None, "Intro"), (1, 5, "5.9.1", "Skipped")]
    df = spark.createDataFrame(rows, "d int, n int, num string, title string")
    got = {(r.d, r.n): r.section_path for r in K.breadcrumbs(df, "d", "n", "num", "title").collect()}
    assert got[1, 3] == "5 Care › 5.7 Drive › 5.7.1 Line" and got[1, 2] == "5 Care › 5.7 Drive › Notes"
    assert got[1, 4] == "6 End" and got[2, 0] == "" and got[1, 5] == "5 Care › 5.9.1 Skipped"


def test_breadcrumbs_of_a_number_that_repeats_make_no_pairs(spark):
    df = spark.range(20_000).selectExpr("1 AS d", "id AS n", "if(id % 2 = 0, '1', '1.1') AS num", "'T' || id AS title")
    got = K.breadcrumbs(df, "d", "n", "num", "title")
    rows = {r.n: r.section_path for r in got.collect()}
    assert len(rows) == 20_000 and rows[19_998] == "1 T19998" and rows[19_999] == "1 T19998 › 1.1 T19999"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= 2  # only each section's path meets its row again (initial and final plan)


def test_intros_and_sections(spark):
    blocks = spark.createDataFrame([(1, 0, "text", "intro", 4), (1, 1, "table", "t", 4), (1, 2, "text", "x" * 700, 4), (1, 3, "table", "t", 4), (1, 4, "text", "y", 5), (1, 5, "table", "t", 6)], "d int, n int, type string, text string, page int")
    assert {r.n: r.intro for r in K.table_intros(blocks, "d", "n").collect()} == {1: "intro", 3: "", 5: ""}
    lines = spark.createDataFrame([(1, 0, "before"), (1, 1, "# A"), (1, 2, "a"), (1, 3, "# B")], "d int, n int, text string")
    got = [(r.section_no, r.section) for r in K.section_numbers(lines, "d", F.col("text").startswith("#"), "n").orderBy("n").collect()]
    assert got == [(0, None), (1, "# A"), (1, "# A"), (2, "# B")]

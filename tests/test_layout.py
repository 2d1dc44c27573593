from pyspark.sql import functions as F

from folioscan.functions import rules
from folioscan.operators import excerpts as P
from folioscan.operators import layout as L
from folioscan.operators import tagging as G
from folioscan.operators import transcripts as N


def test_html_lines(spark):
    html = "<head><title>T &amp; U</title><script>var x = '<p>no</p>';</script></head><body><h2 class='a'>Head&nbsp;one</h2><p>first <b>bold</b> text<br>second</p><!-- hidden --><ul><li>a</li><li>b</li></ul></body>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "plain")], "page_id long, html string")
    rows = L.html_lines(df).orderBy("page_id", "place").collect()
    assert [(r.page_id, r.text, r.heading) for r in rows] == [(1, "T & U", False), (1, "Head one", True), (1, "first bold text", False), (1, "second", False), (1, "a", False), (1, "b", False), (3, "plain", False)]


def test_headers_continue_without_a_gap(spark):
    good, bad = "|Item|Check|", "|a b|lower case|"
    rows = [(1, 1, 1, good), (1, 2, 2, bad), (1, 3, 3, bad), (1, 4, 6, bad), (1, 5, 2, "|x|y|z|"), (1, 6, 7, "|New|Labels|"), (1, 7, 8, bad)]
    df = spark.createDataFrame(rows, "d int, n int, page int, header string")
    got = {r.n: r.used_header for r in L.carried_headers(df, "d", "n", "page", "header").collect()}
    assert got == {1: good, 2: good, 3: good, 4: bad, 5: "|x|y|z|", 6: "|New|Labels|", 7: "|New|Labels|"}


def test_group_rows_and_equipment_runs(spark):
    df = spark.createDataFrame([("|1. Converter|1. Converter||",), ("|a|b|",), ("|ab|",), ("|**X<br>yz**|X yz|",), ("|12|12|",)], "r string")
    assert [r.g for r in df.select(L.group_label("r").alias("g")).collect()] == ["1. Converter", "", "", "X yz", ""]
    cells = ["Bogie", "", None, "Bogie", "Axle box", "", "Note: see", "", "", ""]
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate(cells)] + [(2, i, f"Part {'abcdef'[i]}") for i in range(6)], "t int, n int, v string")
    got = {(r.t, r.n): (r.equipment, r.opens) for r in L.equipment_runs(rows, "t", "n", "v").collect()}
    assert [got[1, i][1] for i in range(10)] == [True, False, False, False, True, False, False, False, False, False]
    assert got[1, 9] == ("Axle box", False) and got[2, 0] == (None, False)


def test_two_level_headers(spark):
    rows = [("|Item|Periodicity|Col3|", "|Item|T|M|"), ("|A|B|", "|x|"), ("|Item|Col2|", "||SS1|"), ("|A|B|C|", "|a||c|")]
    df = spark.createDataFrame(rows, "h string, f string")
    assert [r.x for r in df.select(L.folded_header("h", "f").alias("x")).collect()] == ["|Item|Periodicity T|M|", "|A|B|", "|Item|Col2|", "|A|B|C|"]


def test_titles_and_drawings(spark):
    rows = [("**Sub:** Wheel _defects_ .\nbody", "Reg", 3), ("no subject here", " Registered ", 3), ("x\nShort line\nmore", "", 3), ("", None, 4)]
    df = spark.createDataFrame(rows, "t string, title string, p int")
    assert [r.x for r in df.select(L.subject_title("t", "title", "p").alias("x")).collect()] == ["Wheel defects", "Registered", "Short line", "Page 4"]
    index = spark.createDataFrame([("Contents 6.1. Bogie frame 1. Side frame 2. Bolster 6.2. Brake 1. Rod 2. Cylinder 3. Valve",)], "text string")
    groups = spark.createDataFrame([("6.1", 10, 11), ("6.2", 20, 30)], "gid string, low int, high int")
    got = [(r.gid, r.number, r["name"], r.page) for r in L.drawing_items(index, groups).orderBy("gid", "number").collect()]
    assert got[:2] == [("6.1", 1, "Side frame", 10), ("6.1", 2, "Bolster", 11)] and [g[3] for g in got[2:]] == [20, 20, 20]
    letters = spark.createDataFrame([("circular", "Title", "addr"), ("report", "Title", "addr"), ("circular", "", "addr")], "doc_type string, title string, section string")
    assert [r.section for r in L.letter_sections(letters, F.lit(3)).collect()] == ["Title", "addr", "addr"]


def test_scans(spark):
    df = spark.createDataFrame([(1, 10, 95.0, 100.0, None), (2, 500, 95.0, 100.0, True), (3, 500, 5.0, 100.0, None), (4, 3, 0.0, 0.0, False)], "n int, chars int, image_area double, page_area double, ocr_attempted boolean")
    assert {r.n for r in L.ocr_needed(df).collect()} == {1, 4}


def test_tags(spark):
    rows = [
        ("Step 1 check the relay. LHB knorr knorr faiveley", "General", "WSP"), ("nothing", "x", "FSDS"), ("FDSS panel", "x", "FSDS"), ("SKF and Timken bearing", "y", "VB"), (None, None, None),
        ("step 1 test fault code maintenance install inspect warning wiring battery spares relay brake valve", "overview general", "WSP"),
    ]
    df = spark.createDataFrame(rows, "t string, s string, y string").withColumn("m", G.chunk_maker("t", "y", F.lit("HOUSE")))
    got = df.select("m", G.tags("t", "s", "y", "m").alias("x")).collect()
    assert got[0].m == "KNORR BREMSE" and got[0].x[0] == "WSP" and {"procedure", "testing", "relay", "LHB coaches", "KNORR BREMSE", "general information"} <= set(got[0].x)
    assert got[1].x == ["FSDS", "HOUSE"] and got[2].x[0] == "FDSS" and got[3].x[:2] == ["VB", "Vande Bharat"] and got[3].m == "SKF"
    assert got[4].x == ["HOUSE"] and len(got[5].x) <= rules.MAX_TAGS


def best_rows(text, query, budget):
    """Rows within the budget by brute force over the order of their worth."""
    lines = [x.strip() for x in (text or "").split("\n")]
    rule = lambda x: not x.strip("|:- ")
    rows = [x for x, y in zip(lines, [*lines[1:], ""], strict=True) if not rule(x) and not (x.startswith("Table —") and x.endswith(":")) and not (x[0] == "|" and y and rule(y))]
    rows = [" ".join(x.replace("▸", "").replace("<br>", " ").replace("|", " ").split()) for x in rows]
    terms = {w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split() if len(w) >= 3} - set(rules.SNIPPET_STOP_WORDS)
    worth = lambda r: (n := sum(t in r.lower() for t in terms)) and n + any(a[:1].isdigit() and b[:1].isalpha() for a, b in zip(r.split(), [*r.split()[1:], ""], strict=True)) / 2
    left, taken = budget, set()
    for i in sorted(range(len(rows)), key=lambda i: (-worth(rows[i]), i)):
        if terms and left > 0 and (not taken or len(rows[i]) + 1 <= left):
            taken.add(i)
            left -= len(rows[i]) + 1
    return " ".join(rows[i] for i in range(len(rows)) if i in taken or not terms)[:budget] or " ".join((text or "").split())[:budget]


def test_snippets_keep_the_rows_that_matter(spark):
    table = "Table — Bolts:\n|Item|Torque|\n|---|---|\n" + "\n".join(f"|filler row {i} of link|text|" for i in range(40)) + "\n|▸ group<br>x||\n|stabilizer link|85 Nm|"
    rows = [(t, q, n) for t in (table, "Table — x:\n|---|", "one line\n\nan other line with 5 mm\n  third  ", "x" * 500 + "\nshort link") for q in ("stabilizer link torque", "what is the", "line 5 mm", "") for n in (20, 50, 120, 5000)]
    df = spark.createDataFrame([*rows, (None, None, 10)], "t string, q string, n int")
    got = [r.s for r in df.select(P.snippets("t", "q", F.col("n")).alias("s")).collect()]
    assert got == [*(best_rows(t, q, n) for t, q, n in rows), ""]
    assert "85 Nm" in got[2] and all(len(s) <= n for s, (_, _, n) in zip(got, rows, strict=False))


def test_answer_parts_and_json(spark):
    df = spark.createDataFrame([(1, "lead\n**Direct Answer:** yes\n**Reference:**\nbook"), (2, "one **Bold** word"), (3, None)], "id int, t string")
    got = [(r.id, r.label, r.body) for r in P.answer_parts(df, "id", "t").orderBy("id", "place").collect()]
    assert got == [(1, "answer", "lead"), (1, "Direct Answer", "yes"), (1, "Reference", "book")]
    js = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("none",)], "t string").select(P.model_json("t", "a int").alias("j")).collect()
    assert js[0].j.a == 1 and (js[1].j is None or js[1].j.a is None)
    m = spark.createDataFrame([({"a": "1", "b": "", "c": "0", "rerank_fired": "false", "type": "x"},)], "m map<string,string>").select(P.trace_entry("m", ["type"]).alias("m")).first().m
    assert m == {"a": "1", "rerank_fired": "false"}


def test_sentence_parts(spark):
    text = " ".join(f"Sentence number {i} is here." for i in range(60)) + " " + "x" * 1000
    parts = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(P.sentence_parts("t").alias("p")).collect()
    assert all(len(p) <= 450 for p in parts[0].p) and " ".join(parts[0].p).replace(" ", "") == text.replace(" ", "")
    assert parts[1].p == [] and parts[2].p == []


def test_headings(spark):
    rows = [("5.1 Scope", False, 10.0), ("GENERAL NOTES", False, 10.0), ("Plain bold", True, 10.0), ("plain text", False, 10.0), ("5.1 Scope ....... 12", False, 10.0), ("Large", False, 14.0)]
    df = spark.createDataFrame(rows, "t string, b boolean, s double")
    assert [r.h for r in df.select(P.heading_like("t", F.col("b"), F.col("s"), F.lit(10.0)).alias("h")).collect()] == [True, True, True, False, False, True]


def test_transcripts(spark):
    noise, fix = ["thank you for watching", "so", "you."], {"dump valv": "dump valve", "valv": "valve"}
    rows = [("So dump valv test",), ("Thank you for watching everyone",), ("so.",), ("dump valve nahi you",), (None,), ("a",)]
    got = [r.x for r in spark.createDataFrame(rows, "t string").select(N.repaired("t", noise, fix).alias("x")).collect()]
    assert got == ["dump valve test", "", "", "dump valve nahi you", "", ""]
    cases = [("", "", []), ("x", "word", []), ("", "that was the best part of this", ["dump valve"]), ("dump valve test", "dump valve test", ["dump valve", "test"])]
    got = [spark.createDataFrame([c[:2]], "a string, b string").select(N.confidence("a", "b", c[2]).alias("x")).first().x for c in cases]
    assert got == [0.0, 0.3, 0.1, 0.92]
    assert N.Lexicon({"wsp": "wheel slide"}, ["wsp test", "zzz"]).offers("wsp tset")[0] == "WSP Test"
    passes = spark.createDataFrame([("a", 1, "x", 0.5), ("a", 2, "y", 0.5), ("a", 3, "z", None), ("b", 1, None, None)], "k string, pass int, text string, confidence double")
    assert {r.k: r.text for r in N.best_transcripts(passes, "k").collect()} == {"a": "x", "b": None}

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioscan.functions import text as X
from folioscan.operators import assemble as A
from folioscan.operators import catalog as C
from folioscan.operators import providers as V
from folioscan.operators import quality as Q
from folioscan.sources import tables as S
from folioscan.streaming import usage as U


def test_jsonl_and_csv(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"chunk_id": "a", "tags": ["x"], "page_num": 3}) + "\n\n" + json.dumps({"chunk_id": "b", "oem": None}) + "\n")
    rows = {r.chunk_id: r for r in S.read_jsonl(spark, str(tmp_path / "c.jsonl")).where("chunk_id is not null").collect()}
    assert rows["a"].tags == ["x"] and rows["b"].page_num is None
    assert S.read_jsonl(spark, str(tmp_path / "none")).count() == 0
    S.write_jsonl(spark.createDataFrame([("z", 1)], "chunk_id string, page_num int"), str(tmp_path / "out"))
    assert S.read_jsonl(spark, str(tmp_path / "out")).first().chunk_id == "z"
    (tmp_path / "f.csv").write_bytes('﻿rating,note\ndown,"two\nlines, ""quoted"""\n'.encode())
    row = S.read_csv(spark, str(tmp_path / "f.csv")).first()
    assert row.rating == "down" and row.note == 'two\nlines, "quoted"'


def test_register_lookup_and_spans(spark):
    r = S.register(spark.createDataFrame([("a", None), ("b", "t")], "doc_id string, title string"))
    assert r.first().coach_type == [] and [x.title for x in r.orderBy("doc_id").collect()] == ["", "t"]
    assert S.lookup(r, "doc_id", "a").first().doc_id == "a"
    with pytest.raises(Exception, match="unknown doc_id"):
        S.lookup(r, "doc_id", "zzz").collect()
    df = spark.createDataFrame([(None, None, 9), (0, 4, 9), (5, 2, 9), (50, 60, 9), (2, 99, 9)], "a int, b int, n int")
    low, high = S.page_span(F.col("a"), F.col("b"), F.col("n"))
    assert [(x.l, x.h) for x in df.select(low.alias("l"), high.alias("h")).collect()] == [(1, 9), (1, 4), (5, 5), (9, 9), (2, 9)]


def test_ledger_feedback_and_vectors(spark, tmp_path):
    row = spark.createDataFrame([tuple("x" * (i % 3 + 1) for i in range(12))], ", ".join(f"`{c}` string" for c in S.LEDGER))
    for _ in range(2):
        S.append_ledger(row, str(tmp_path / "ledger"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "ledger")).count() == 2
    fb = S.feedback_rows(spark.createDataFrame([("n" * 900, None, "q", "a" * 5000)], "note string, correction string, question string, answer string")).first()
    assert (len(fb.note), fb.correction, len(fb.answer)) == (500, "", 2000)
    keys = spark.createDataFrame([(0, "a"), (1, "b")], "row_id int, key string")
    cache = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "key string, embedding array<float>")
    assert [r.embedding for r in S.assembled_vectors(keys, cache).collect()] == [[1.0], [2.0]]
    with pytest.raises(Exception, match="no vector"):
        S.assembled_vectors(keys, cache.limit(1)).collect()


def test_cooldowns_in_batch(spark):
    t0 = datetime(2024, 1, 1)
    rows = [("p", t0, 1, 429, "tokens per day (TPD)"), ("q", t0, 2, 429, "slow"), ("r", t0, 3, 500, ""), ("s", t0, 4, 404, None), ("q", t0 + timedelta(seconds=30), 5, 200, "")]
    df = spark.createDataFrame(rows, "pool string, ts timestamp, n int, status int, body string")
    at = lambda s: {r.pool: r.seconds_left for r in U.cooldown_status(df, "pool", "ts", "n", F.col("status"), "body", F.lit(t0 + timedelta(seconds=s))).collect()}
    assert at(60) == {"p": 3540, "q": 30, "s": 3540} and at(100) == {"p": 3500, "s": 3500} and at(4000) == {}


def _run(stream, mode, name, spark, tmp_path):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(once=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_streams(spark, tmp_path):
    rows = [("p", 1000, 90_000_000_000_000), ("p", 2000, 0), ("q", 5, 10)]
    spark.createDataFrame(rows, "pool string, at_ms long, rest_ms long").write.parquet(str(tmp_path / "in"))
    replies = spark.readStream.schema("pool string, at_ms long, rest_ms long").parquet(str(tmp_path / "in"))
    found = {r.pool: r.resting for r in _run(U.track_cooldowns(replies), "update", "cooling", spark, tmp_path)}
    assert found == {"p": True, "q": False}

    ts = datetime(2024, 1, 1, 10)
    spark.createDataFrame([("a", ts, "x"), ("a", ts + timedelta(minutes=5), "x"), ("b", ts, "y")], "id string, ts timestamp, kind string").coalesce(1).write.parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema("id string, ts timestamp, kind string").parquet(str(tmp_path / "ev"))
    assert sorted(r.id for r in _run(U.first_seen(events, "id", "ts"), "append", "once", spark, tmp_path)) == ["a", "b"]
    assert {(r.kind, r.n) for r in _run(U.event_counts(events, "ts", "kind"), "complete", "counted", spark, tmp_path)} == {("x", 2), ("y", 1)}


def test_incremental_sink_adds_each_key_once(spark, tmp_path):
    path = str(tmp_path / "done")
    work = U.append_new(lambda df: df.withColumn("n", F.length("k")), path, "k")
    for keys in (["a", "bb", "a"], ["bb", "ccc"], ["ccc"]):
        work(spark.createDataFrame([(k,) for k in keys], "k string"), 0)
    assert sorted((r.k, r.n) for r in spark.read.parquet(path).collect()) == [("a", 1), ("bb", 2), ("ccc", 3)]


def test_providers(spark):
    embed = V.hashing_embedder(8)
    chunks = spark.createDataFrame([("a", "one two"), ("b", "three"), ("a", "one two"), ("c", None)], "key string, text string")
    cache = spark.createDataFrame([("b", [9.0])], "key string, embedding array<float>")
    got = {r.key: r.embedding for r in V.fill_cache(chunks, cache, "key", "text", embed).collect()}
    assert set(got) == {"a", "b", "c"} and got["b"] == [9.0] and got["a"] == pytest.approx(embed(["one two"])[0])

    def broken(_):
        raise RuntimeError("503")

    prompts = spark.createDataFrame([(1, "x"), (2, "yy")], "id int, prompt string")
    chain = [("first", broken), ("second", lambda t: "" if t == "x" else t.upper()), ("third", lambda t: "last")]
    rows = {r.id: r for r in V.answered(prompts, chain, "id", "prompt").collect()}
    assert (rows[1].provider, rows[2].answer) == ("third", "YY") and [a.status for a in rows[1].attempts] == ["error", "empty", "ok"]
    none = V.answered(prompts, [("first", broken)], "id", "prompt").first()
    assert none.provider is None and none.answer is None

    pages = spark.createDataFrame([(1, 1, b"ok"), (1, 2, b"bad"), (1, 3, b"")], "doc int, page int, image binary").coalesce(1)
    seen = spark.createDataFrame([(1, 9)], "doc int, page int")

    def reader(image):
        if bytes(image) == b"bad":
            raise ValueError
        return bytes(image).decode()

    assert sorted((r.page, r.text) for r in V.read_pages(pages, seen, ["doc", "page"], reader).collect()) == [(1, "ok"), (3, "")]


def test_context_and_citations(spark):
    schema = "query_id int, rank int, doc_id string, title string, section string, section_num string, page_num int, printed_page string, coach_type array<string>, oem string, letter_no string, issue_date string, superseded_by string, status string, download_url string, text string"
    rows = [
        (1, 2, "d", None, "S|x", "5.1", 4, "2", ["LHB", "ICF"], "A", "L/1", "2024-10-01", "N, dt. 2025", "draft", "http://u", "a|b\n|c  d|"),
        (1, 1, "e", "T [1]", None, None, None, None, None, None, None, None, None, None, None, " two\n\nlines " + "x" * 3000),
        (1, 3, "d", None, "S|x", "5.1", 9, None, None, None, None, None, None, None, None, "again"),
    ]
    df = spark.createDataFrame(rows, schema)
    context = A.build_context(df).first().context
    first, second, third = context.split("\n\n[")
    assert first.startswith("[Source 1: T (1)]\ntwo lines xxx") and first.endswith(" …")
    assert second == "Source 2: d | Clause 5.1 S/x | p.2 (PDF p.4) | Coach: LHB, ICF | OEM: A | Ref: L/1, dt. 01.10.2024 | SUPERSEDED by N, dt. 2025 | DRAFT (lower authority)]\na|b\n|c d|"
    cites = A.citations(df).orderBy("rank").collect()
    assert [(c["rank"], c.url) for c in cites] == [(1, ""), (2, "http://u#page=4")]
    assert A.citation_markdown(df).first().sources == "- **T [1]**\n- [**d**](http://u#page=4) → Clause 5.1 S|x (p.2 (PDF p.4)) — L/1, dt. 01.10.2024"


def test_quality(spark):
    prose, broken = "the fire of the coach is to be in the system and it shall not be on the board", "xq zz vv bb nn mm kk ll pp oo ii uu yy"
    df = spark.createDataFrame([("a", prose), ("a", broken), ("a", "Table — " + broken), ("b", "short"), ("b", None)], "d string, t string")
    assert {r.d: (r.judged, r.flagged) for r in Q.garble_audit(df, "d", "t").collect()} == {"a": (2, 1), "b": (0, 0)}
    lines = spark.createDataFrame([(1, p, t) for p in range(1, 6) for t in (["Head -  1", "x"] if p % 2 else ["Head - 1", f"body {p}"])], "d int, p int, t string")
    running = Q.running_lines(lines, "d", "p", "t")
    assert [(r.key, r.pages) for r in running.collect()] == [("Head-1", 5)]
    assert Q.without_running_lines(lines, running, "d", "t").count() == 5
    assert [r.line for r in Q.lines_on_all_pages(spark.createDataFrame([(1, 1, "a"), (1, 2, " a "), (1, 2, "b")], "d int, p int, t string"), "d", "p", "t").collect()] == ["a"]


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.filename_date(F.lit("a_07.09.2024.pdf"))) == "2024-09-07" and one(X.filename_date(F.lit("x 11082025 y"))) == "2025-08-11" and one(X.filename_date(F.lit("99_99_2025"))) == ""
    assert one(X.document_slug(F.lit("My (2) file--x_ab12cd34.pdf"), "VB_")) == "VB_My_file_x"
    assert one(X.symbols(F.lit("abc"), "", "✓")) == "a✓bc"
    assert one(X.spoken(F.lit("## T\n**Direct Answer:** It is **85 Nm**, see the table for all of the other values here.\n**Step 1**"))) == "It is 85 Nm, see the table for all of the other values here."
    assert one(X.question_language(F.lit("kaise kare"))) == "hi" and one(X.question_language(F.lit("how to check"))) == "en" and one(X.question_language(F.lit("यह क्या है"))) == "hi"
    assert one(X.url_path(F.lit("a b/ü+1.pdf"))) == "a%20b/%C3%BC%2B1.pdf"
    assert one(X.shattered(F.lit("|ab|cd|ef|gh|ij|kl|"))) and not one(X.shattered(F.lit("|Ab|Cd|Ef|Gh|Ij|")))
    assert one(X.unnamed_columns(F.lit("|Col6|Col7|Col8|"))) == 3
    assert one(X.index_order(F.lit("[1, 1, 9, 0]"), 3)) == [1, 0] and one(X.index_order(F.lit("none"), 3)) is None
    assert one(X.overlap_ratio(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5


def test_catalog_scopes(spark):
    shelf = spark.createDataFrame([("a", "report", ["LHB"], "x"), ("b", "report", ["common"], "x"), ("c", "circular", [], "y"), ("d", "report", None, "x")], "doc_id string, doc_type string, coach_type array<string>, system string")
    assert {r.doc_id for r in C.filtered(shelf, "report", "LHB", "x").collect()} == {"a", "b"}
    assert {r.doc_id for r in C.shelf_filter(shelf, "LHB", None, " REP ", ["doc_type"]).collect()} == {"a"}
    dates = spark.createDataFrame([("a", "2024", "t1"), ("b", "", "t2"), ("c", "2024", "t3"), ("d", None, "t4")], "d string, date string, title string")
    assert [r.d for r in C.newest_first(dates, "date", "title").collect()] == ["c", "a", "d", "b"]


def test_ledger_rows_come_back_without_headers(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    for k in range(3):
        S.append_ledger(spark.createDataFrame([tuple(f"{c}{k}" for c in S.LEDGER)], ", ".join(f"{c} string" for c in S.LEDGER)), path)
    assert sorted(r.commit for r in S.read_ledger(spark, path).collect()) == ["commit0", "commit1", "commit2"]


def test_providers_share_a_deadline_and_cool_down(spark):
    import time

    from folioscan.operators import providers as V

    def fail(text):
        raise RuntimeError("quota")

    def slow(text):
        time.sleep(0.3)
        return " "

    prompts = spark.createDataFrame([(i, "q") for i in range(3)], "id long, q string").coalesce(1)
    rows = V.answered(prompts, [("a", fail), ("b", slow), ("c", lambda t: "yes")], "id", "q", cooldown=lambda e: 60.0).orderBy("id").collect()
    assert [[x.status for x in r.attempts] for r in rows] == [["error", "empty", "ok"], ["cooling", "empty", "ok"], ["cooling", "empty", "ok"]]
    (row,) = V.answered(prompts.where("id = 1"), [("b", slow), ("c", lambda t: "yes")], "id", "q", deadline=0.2).collect()
    assert [x.status for x in row.attempts] == ["late", "late"] and row.answer is None


def test_reading_ladder_and_bands():
    from folioscan.operators import providers as V

    def fail(image):
        raise OSError("no")

    assert V.ladder(fail, lambda i: " ", lambda i: "text")(b"") == "text"
    assert V.ladder(fail, lambda i: None)(b"") == ""
    with pytest.raises(OSError, match="no"):
        V.ladder(fail, fail)(b"")
    lines = ["a", "b", "c", "d", "e"]
    cut = lambda image: ["\n".join(lines[i : i + 3]).encode() for i in (0, 1, 2)]
    assert V.banded(lambda b: b.decode(), cut)(b"") == "a\nb\nc\nd\ne"


def test_sizes_of_documents_are_hashed_and_odd_pages_count(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, " a "), (1, 2, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, " "), (3, None, "c"), (None, 1, "d"), (4, 5, None)], "d int, p int, t string")
    found = Q.lines_on_all_pages(rows, "d", "p", "t")
    assert sorted((r.d, r.line) for r in found.collect()) == [(1, "a"), (3, "c")]
    assert "ShuffledHashJoin" in found._jdf.queryExecution().executedPlan().toString()

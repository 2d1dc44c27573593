"""Broken copies give way to the last good one; histories shed to a budget; register rows of odd files."""

from folioscan.functions import text as X
from folioscan.operators import register as G
from folioscan.sources import local as K


def test_a_broken_copy_gives_the_last_good_rows(spark, tmp_path):
    path, store, schema = str(tmp_path / "threads.json"), str(tmp_path / "good"), "id long, title string"
    load = lambda: sorted((r.id, r.title) for r in K.load_or_last_good(spark, path, schema, store, "id").collect())
    assert load() == []
    with open(path, "w") as f:
        f.write('{"id": 1, "title": "a"}\n\n{"id": 2}\n')
    assert load() == [(1, "a"), (2, None)]
    with open(path, "w") as f:
        f.write('{"id": 1, "title": "changed"}\n{"id": 3, "tit')
    assert load() == [(1, "a"), (2, None)]
    with open(path, "w") as f:
        f.write('{"id": "x", "title": "a"}\n')
    assert load() == [(1, "a"), (2, None)]
    with open(path, "w") as f:
        f.write('{"id": 2, "title": "b"}\n')
    assert (2, "b") in load()
    (tmp_path / "threads.json").unlink()
    assert (2, "b") in load()


def test_history_is_shed_from_the_oldest_on(spark):
    rows = [("a", i, 100) for i in range(20)] + [("b", i, 10_000) for i in range(8)] + [("c", 1, None), ("c", 2, 300), ("d", 1, 1), ("d", 2, 5_000), ("d", 3, 10)]
    df = spark.createDataFrame(rows, "owner string, at int, size long")
    kept = {}
    for r in K.shed_to_budget(df, "owner", "at", "size", "size", 1_000).collect():
        kept.setdefault(r.owner, []).append(r.at)
    assert sorted(kept["a"]) == list(range(10, 20)) and sorted(kept["b"]) == list(range(3, 8)) and sorted(kept["c"]) == [1, 2] and sorted(kept["d"]) == [1, 2, 3]
    assert [r.at for r in K.shed_to_budget(df.where("owner = 'd'"), "owner", "at", "size", "size", 1_000, 1).collect()] == [3]


def test_register_rows_of_odd_files(spark):
    rows = [(None, None, None, None, None), ("a\\b\\Note.pdf", "", 0, 0, 0), ("dir/.hidden", "Sub: short", 3, 3, 10), ("2024-13-40 x.pdf", "Date: 99.99.2024", 1, 0, 500)]
    df = spark.createDataFrame(rows, "path string, first_page string, pages int, scans int, text_chars int").withColumn("title", X.F.lit("clash"))
    got = {r.path: r for r in G.register_entries(df, X.DOC_TYPES, ()).collect()}
    assert [got[p].force_ocr for p, *_ in rows] == [False, False, True, False]
    assert got["a\\b\\Note.pdf"].title == "Note" and got["a\\b\\Note.pdf"].origin.title == "name" and got[None].origin.title == "none"
    assert "3/3 pages are scans, look again when they have been read" in got["dir/.hidden"].review and got["dir/.hidden"].origin.title == "name"
    assert got["2024-13-40 x.pdf"].issue_date in ("", "2024") and "no letter_no found" in got["2024-13-40 x.pdf"].review


def test_each_pattern_of_a_register_row_is_searched_once(spark):
    df = spark.createDataFrame([("a/x.pdf", "Date: 3.4.2024", 1, 0, 10)], "path string, first_page string, pages int, scans int, text_chars int")
    plan = G.register_entries(df, X.DOC_TYPES, ())._jdf.queryExecution().optimizedPlan().toJSON()
    assert plan.count("expressions.RegExpExtract\"") < 200  # 2,649 where fields are written out again in each comparison

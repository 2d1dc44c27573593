"""Queries that leave no row of their table out."""

import re

from folioscan.functions import text as X
from folioscan.operators import layout as L
from folioscan.plans import registry


def read_aloud(text, limit=800):
    text = text or ""
    chosen = text
    if "**Direct Answer:**" in text:
        chosen = re.split(r"\*\*Step", text.split("**Direct Answer:**", 1)[1], maxsplit=1)[0].strip()
    if len(chosen) < 50 and "**Step-by-step Action:**" in text:
        steps = text.split("**Step-by-step Action:**", 1)[1].lstrip()
        chosen += ". " + re.split(r"\*\*Safety|\*\*Reference|---|\n📚", steps, maxsplit=1)[0].strip()
    chosen = re.sub(r"\*\*([^*]+)\*\*", r"\1", chosen)
    chosen = re.sub(r"#{1,3}\s*", "", chosen)
    chosen = re.sub(r"\[Source.*?\]", "", chosen)
    chosen = chosen.split("---", 1)[0].split("📚", 1)[0]
    chosen = re.sub(r"\n\s*\d+\.\s*", ". ", chosen)
    chosen = re.sub(r"\n\s*[-→✔]\s*", ". ", chosen)
    chosen = " ".join(re.split(r"[ \t\n\r\f\x0b]+", re.sub(r"[*_`~]", "", chosen).strip(" \t\n\r\f\x0b")))
    return chosen[:limit] + "." if len(chosen) > limit else chosen


def test_all_turns_are_spoken(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    lead, tail = "**Direct Answer:** Use `M8` bolts.\n**Step-by-step Action:**\n1. Lift\n- ", "\n---\n[Source 1]"
    want = sorted((r.conv_id, r.turn, read_aloud(lead + r.text + tail if r.turn % 2 and r.text is not None else None if r.turn % 2 else r.text)) for r in rows)
    got = sorted(tuple(r) for r in registry.QUERIES["spoken_all"](spark, sf).collect())
    assert got == want and any(len(s) == 801 for _, _, s in got)


def test_marks_and_long_turns(spark):
    texts = ["# Head\n1. one\n2. two", "a **b** [Source 3, p. 4] c --- d", "x" * 801, "y" * 800, "_z_ 📚 w", None, "**Direct Answer:** " + "long " * 20 + "**Step-by-step Action:** no"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    assert [r.s for r in rows.select("n", X.spoken("t").alias("s")).orderBy("n").collect()] == [read_aloud(t) for t in texts]


def test_words_at_one_spot_have_an_order(spark):
    rows = spark.createDataFrame([(1, n, 5.0, 7.0) for n in (4, 2, 9, 1)] + [(1, 3, 1.0, 7.0)], "page int, n int, x double, y double")
    got = L.reading_order(rows, "page", "x", "y", "n").orderBy("place").collect()
    assert [r.n for r in got] == [3, 1, 2, 4, 9]


def test_no_row_is_left_out(spark, sf):
    for name, table in (("detectors_all", "part"), ("spoken_all", "conversations"), ("reading_order_all", "lineitem")):
        assert registry.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{table}.parquet").count()

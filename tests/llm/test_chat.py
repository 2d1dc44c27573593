import hashlib
import random

from pyspark.sql import functions as F

from folioscan.llm import chat, queries


def turns_of(rows):
    found = {}
    for c, t, r, x in rows:
        found.setdefault(c, []).append((t if t is not None else -(1 << 40), r or "", x or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in found.items()}


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("t", F.lit(2))
    done = chat.format_conversations(df).withColumn("back", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    want = turns_of(rows)
    assert {r.conv_id for r in done} == set(want)
    for r in done:
        assert r.identical
        assert [(x.role, x.text) for x in r.back] == want[r.conv_id]
        spans = [(r.formatted[s.start : s.end], s.strong) for s in r.loss_spans]
        texts = [x for role, x in want[r.conv_id] if role == "assistant"]
        assert [unescape(s) for s, strong in spans if not strong] == [x for x, (_, strong) in zip(texts, spans, strict=True) if not strong]
        assert r.loss == "".join(texts)
    return done


def unescape(s):
    import re

    return re.sub(r"\\(\\*)(###|</turn>)", r"\1\2", s)


def test_hostile_texts_come_back(spark):
    r = random.Random(2)
    bits = ["\\", "###", "#", "</turn>", "<", " </turn>\n", "### user: ", "\n", "a", " ", ": ", "é", "\U0001f600", "/2", "$1", "\r\n", "</", "turn>"]
    rows = [(i, k, r.choice(["user", "assistant", "system", "odd: role", "### x", "", None, "a/2"]), "".join(r.choice(bits) for _ in range(r.randint(0, 14)))) for i in range(60) for k in range(r.randint(1, 5))]
    rows += [(100, 0, "user", None), (100, 0, "user", None), (100, None, "assistant", "first"), (None, 1, "assistant", "no id"), (101, 1, "assistant", "x" * 500_000)]
    done = check(spark, rows)
    assert all(row.formatted.count(" </turn>\n") == len(row.back) for row in done)


def test_empty_table(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_query_digests(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "### there"), (2, 0, "assistant", None), (2, 1, "assistant", "b"), (1, 2, "system", "</turn>")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: r for r in queries.op3_chat_format(spark, str(tmp_path)).collect()}
    tricky = "\\### Assistant: </turn> ok"
    want = turns_of([*rows, (-7, 0, "user", tricky), (-7, 1, "assistant", tricky)])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        row = found.pop(c)
        assert (row.n_turns, row.turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)))
        assert (row.loss_chars, row.loss_sha256) == (len(loss), sha(loss))
    assert not found


def test_strong_escape_is_reversible(spark):
    r = random.Random(6)
    rows = [("".join(r.choice("\\#<hlb x") for _ in range(12)),) for _ in range(300)]
    df = spark.createDataFrame(rows, "x string").withColumn("y", chat._strong(F.col("x"))).withColumn("z", chat._unstrong(F.col("y")))
    for row in df.collect():
        assert row.x == row.z and "#" not in row.y and "<" not in row.y

"""Operator 12: words and updates against plain loops, held-out accuracy, odd rows."""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioscan.llm import quality
from folioscan.llm.quality import Ftrl, Rates, classify_quality, features, hashed_words, score_quality, train_quality


def plain_words(text):
    return [m[0] for m in re.finditer(rb"[A-Za-z0-9\x80-\xff]+|([\x21-\x7e])\1*", text.encode())]


def test_words_are_runs_and_equal_words_hash_alike(monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 40)
    texts = ["Ab ab,, c!!?", "", "élan A1-b2 \x00\x01 ab", "x" * 100 + " y", ",,", " ", "ab"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    hashed, row = hashed_words(data, offsets)
    want = [(i, w) for i, t in enumerate(texts) for w in plain_words(t)]
    assert row.tolist() == [i for i, _ in want]
    seen = {}
    assert all(seen.setdefault(w, h) == h for (_, w), h in zip(want, hashed.tolist(), strict=True)) and len(set(seen.values())) == len(seen)


def test_features_have_norm_one_and_do_not_depend_on_neighbours():
    texts = ["a b a b", None, "same same same", "x"]
    both = list(features(pa.array(texts, pa.string()), 18))
    for text, (at, x) in zip(texts, both, strict=True):
        alone = list(features(pa.array([text], pa.string()), 18))[0]
        assert at.tolist() == alone[0].tolist() and x.tolist() == alone[1].tolist()
        assert math.isclose(float(x @ x), 1.0) if text else len(at) == 0
    assert sorted(round(v * v * 9) for v in both[0][1]) == [1, 2, 2, 2, 2] and len(both[2][0]) == 3


def test_updates_equal_a_plain_loop():
    rates, r = Rates(0.7, 1.0, 0.05, 0.1), np.random.default_rng(1)
    model, z, n = Ftrl(8, rates), [0.0] * 9, [0.0] * 9
    weight = lambda i: 0.0 if abs(z[i]) <= (l1 := rates.l1 * (i < 8)) else -(z[i] - math.copysign(l1, z[i])) / ((rates.beta + math.sqrt(n[i])) / rates.alpha + rates.l2 * (i < 8))
    for _ in range(60):
        at, label = np.sort(r.choice(8, 3, replace=False)), int(r.integers(2))
        x = r.random(3)
        model.learn(at, x, label, 1.5)
        row = [*zip(at.tolist(), x.tolist(), strict=True), (8, 1.0)]
        w = {i: weight(i) for i, _ in row}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in row)))
        for i, v in row:
            g = 1.5 * (p - label) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / rates.alpha * w[i]
            n[i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.weights(np.arange(9)), [weight(i) for i in range(9)])


def test_held_out_labels_are_predicted(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = classify_quality(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    marked = got.join(labels, "doc_id").where("held_out")
    right, n = marked.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count(F.lit(1))).first()
    assert n > 50 and right / n >= 0.98
    assert got.count() == 1000 and got.where("score < 0 or score > 1 or predicted <> cast(score >= 0.3 as int)").count() == 0


def test_held_out_labels_teach_nothing(spark, docs):
    rows = [(i, f"good words {i}" if i % 2 else "### junk $$$") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    turned = labels.withColumn("quality", F.when(quality.learns(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality")))
    assert np.array_equal(train_quality(docs(rows), labels, steps=200), train_quality(docs(rows), turned, steps=200))


def test_odd_rows(spark, docs):
    rows = [(1, "fine words"), (1, "fine words"), (2, None), (3, ""), (None, "no id"), (4, "z" * 200_000), (5, "&&& %%%")]
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (2, 1), (3, 0), (3, 1), (None, 1), (99, 0), (4, None), (6, 7)], "doc_id long, quality int").withColumn("text", F.lit("clash")).withColumn("score", F.lit(1))
    got = classify_quality(docs(rows, score=2.0, label=3, predicted="x"), labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = got.collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows)
    by = {}
    for r in found:
        assert by.setdefault(r["doc_id"], r["score"]) == r["score"]
    assert by[2] == by[3]


def test_no_labels_and_no_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in classify_quality(docs([(1, "a")]), none).collect()] == [0.5]
    assert score_quality(docs([(1, "a")]).limit(0), np.zeros((1 << 18) + 1, np.float32)).collect() == []

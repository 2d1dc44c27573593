import zlib

import numpy as np
import pytest

from folioscan.llm import langid as L


def slow_code_length(texts, text, order=L.ORDER):
    """PPM with escape method C and exclusion, written out per byte; texts: the language's sample."""
    counts = {}
    for t in texts:
        b = t.lower().encode()
        for i in range(len(b)):
            for k in range(min(order, i) + 1):
                counts.setdefault(b[i - k : i], {}).setdefault(b[i], 0)
                counts[b[i - k : i]][b[i]] += 1
    return counts


def bits(counts, alphabet, data, order=L.ORDER):
    total = 0.0
    for i in range(len(data)):
        k = min(order, i)
        while k and data[i - k : i] not in counts:
            k -= 1
        excluded = set()
        while True:
            seen = {s: n for s, n in counts.get(data[i - k : i], {}).items() if s not in excluded}
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                total -= np.log2(seen[data[i]] / (n + d))
                break
            if d:
                total -= np.log2(d / (n + d))
            excluded |= set(seen)
            if k == 0:
                total += 8.0
                break
            k -= 1
    return total


SAMPLE = [("the cat and the hat sat on the mat", "en"), ("that is the thing then", "en"), ("der hund und die katze", "de"), ("das ist die sache dann", "de")]


def model_of(sample, **bounds):
    langs = sorted({lang for _, lang in sample})
    return L.Model(langs, [L.grow([t for t, x in sample if x == lang], **bounds) for lang in langs])


def test_code_lengths_equal_a_plain_coder():
    model = model_of(SAMPLE, max_nodes=10_000, least_count=1)
    texts = ["the hat is on the cat", "die katze ist da", "xyz q"]
    found = L.code_lengths(model, [t.encode() for t in texts]) / L.UNIT
    for k, lang in enumerate(model.langs):
        counts = slow_code_length([t for t, x in SAMPLE if x == lang], "")
        for t, row in zip(texts, found, strict=True):
            assert row[k] == pytest.approx(bits(counts, None, t.encode()), abs=0.002 * len(t))


def test_a_bounded_tree_holds_the_most_frequent_contexts_and_their_shorter_ones():
    texts = ["the cat and the hat sat on the mat " * 20, "that is the thing then " * 9, ""]
    whole, small = L.grow(texts, least_count=1), L.grow(texts, max_nodes=40, least_count=1)
    assert len(small.contexts) == 40 and set(small.contexts) < set(whole.contexts)
    for tree in (whole, small):
        for key in tree.contexts[1:]:
            depth = next(k for k in range(L.ORDER, 0, -1) if key >= L.BASE ** (k - 1))
            assert key % L.BASE ** (depth - 1) in tree.contexts
    assert any(small.contexts >= L.BASE**3)
    assert L.grow(["", ""]) is None


def test_more_languages_take_nothing_from_a_tree(docs, spark):
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    rng = np.random.default_rng(3)
    base = "the cat and the hat sat on the mat while that thing was there with other words of them " * 30
    tables = ["".join(rng.permutation(list(alphabet))) for _ in range(70)]
    rows = [(base.translate(str.maketrans(alphabet, x)), f"l{k:02d}") for k, x in enumerate(tables)]
    many = L.train(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    assert many.langs == [lang for _, lang in rows]
    for tree in many.trees:
        assert (tree.contexts >= L.BASE**3).any()
    alone = L.grow([rows[7][0]])
    assert all((getattr(alone, f) == getattr(many.trees[7], f)).all() for f in ("contexts", "pairs", "whole", "escape", "below", "onward", "log_n"))
    said = ["that hat was on them".translate(str.maketrans(alphabet, x)).encode() for x in tables]
    assert (L.code_lengths(many, said).argmin(1) == np.arange(70)).all()


def test_a_table_of_few_slots_gives_the_same(monkeypatch):
    model = model_of(SAMPLE, least_count=1)
    texts = [b"the cat sat", b"", b"der hund " * 500, bytes(range(97, 123)) * 40]
    assert (L.Coder(model, memory=600).code_lengths(texts) == L.code_lengths(model, texts)).all()


def test_pieces_and_batches_do_not_matter(monkeypatch):
    model = model_of(SAMPLE, least_count=1)
    texts = [b"the cat sat", b"", b"der hund " * 50, b"x", b"die und der" * 9]
    whole = L.code_lengths(model, texts)
    assert (whole == np.concatenate([L.code_lengths(model, [t]) for t in texts])).all()
    monkeypatch.setattr(L, "PIECE", 7)
    assert (whole == L.code_lengths(model, texts)).all()


def test_held_out_accuracy(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = L.identify(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in tested) >= 0.97 * len(tested)


def test_edges(docs, spark, sf):
    learn = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.train(L.training_sample(learn))
    odd = docs([(1, None), (2, ""), (3, "123 ... !!"), (4, "the and of with " * 60_000), (5, "é"), (5, "é"), (None, "the and")], score="x", held_out=1)
    found = sorted(((r.doc_id or -1), r.lang_pred, r.score > 0) for r in L.predict_language(odd, model).collect())
    assert [x[1] for x in found if x[0] in (1, 2, 3)] == ["und"] * 3
    assert [x for x in found if x[0] == 4] == [(4, "en", True)]
    assert len(found) == 7 and found[0][1] == "en"
    assert L.identify(docs([])).collect() == []
    assert [r.lang_pred for r in L.identify(docs([(1, "no labels at all")])).collect()] == ["und"]
    kept = L.keep_identified(odd.drop("score", "held_out"), model)
    assert kept.columns == odd.drop("score", "held_out").columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 4, 5, 5]


def test_held_out_and_unlabelled_rows_do_not_teach(docs):
    rows = [(i, f"word{i} text", "en" if zlib.crc32(str(i).encode()) % 3 == 1 else None) for i in range(200)]
    assert L.training_sample(docs(rows)).collect() == []


def test_signs_that_are_no_letters_are_undetermined(docs):
    rows = [(1, "\u00bd \u00b2 \u2460 12 ..."), (2, "\u00bd a"), (3, "\u4e2d"), (4, "_"), (5, "\u0660")]
    found = {r.doc_id: r.lang_pred for r in L.predict_language(docs(rows), model_of(SAMPLE, least_count=1)).collect()}
    assert [d for d, x in sorted(found.items()) if x == L.UNDETERMINED] == [1, 4, 5]


def test_long_texts_are_drawn_in_part_and_no_number_of_languages_is_too_many(docs):
    rows = [(i, ("lang alone words " * 3000), None, None) for i in range(9)]
    table = docs(rows).drop("lang").selectExpr("doc_id", "text", "'xx' AS lang")
    sample = L.training_sample(table).collect()
    assert sample and {len(r.text) for r in sample} == {L.MAX_DOC_CHARS}
    many = docs([(i, f"words of {i} " * 9, None, None) for i in range(900)]).drop("lang").selectExpr("doc_id", "text", "cast(doc_id as string) AS lang")
    assert len(L.train(L.training_sample(many)).langs) == many.where(~L.held_out(many.doc_id)).count()

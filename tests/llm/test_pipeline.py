import random
from collections import Counter

import pytest

import corpus_pipeline
from folioscan.llm import decontaminate, langid, secrets
from folioscan.llm.mixing import mix_sources

from .conftest import words
from .test_minhash import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, found = spark.read.parquet(f"{sf}/documents.parquet"), {}
    found["start"] = docs
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, sf).cache()
        found[name] = docs
    return found


def rows(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def test_stages_stand_in_the_dealt_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontaminate", "secret_scan", "mixing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_each_stage_against_its_plain_form(stages, spark, sf):
    before = rows(stages["start"])
    model = langid.train(langid.training_sample(stages["start"]))
    able = [r for r in before if r[1] and any(c.isalpha() for c in r[1])]
    kept = [r for r in able if langid.code_lengths(model, [r[1].lower().encode()]).min() <= 7.5 * langid.UNIT * len(r[1].lower().encode())]
    assert rows(stages["language_id"]) == kept

    one = {d for d, x in brute([(r[0], r[1]) for r in kept], 5, 80).items() if x[2]}
    kept = [r for r in kept if r[0] in one]
    assert rows(stages["near_dedup"]) == kept

    items = [decontaminate.fold(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    near = lambda t: any(decontaminate.distance(i, t, len(i) // 10)[0] <= int(len(i) * 0.1) for i in items if len(i) >= 24)
    short = [r for r in kept if len(r[1]) < 4000]
    left = {r[0] for r in rows(stages["decontaminate"])}
    for r in short[:60]:
        assert (r[0] in left) == (not near(decontaminate.fold(r[1])))
    assert not any(i in decontaminate.fold(r[1]) for r in kept if r[0] in left for i in items)
    kept = [r for r in kept if r[0] in left]

    tagger = secrets.train()
    clean = [(r[0], secrets.redact(r[1], tagger), *r[2:4], len(secrets.redact(r[1], tagger))) for r in kept]
    assert rows(stages["secret_scan"]) == sorted(clean, key=str)
    assert not any(secrets.base_spans(r[1]) for r in clean)

    read = Counter(r.doc_id for r in stages["mixing"].collect())
    assert set(read) == {r[0] for r in clean}
    assert read == Counter(r.doc_id for r in mix_sources(stages["secret_scan"]).collect())


def test_all_but_the_last_return_the_columns_of_documents(stages):
    for name in ("language_id", "near_dedup", "decontaminate", "secret_scan"):
        assert stages[name].columns == COLUMNS


def test_odd_rows_and_empty_input(spark, sf, docs):
    sample = spark.read.parquet(f"{sf}/documents.parquet")
    pool = [w for r in sample.where("lang = 'en' and n_chars > 2000").orderBy("doc_id").limit(3).collect() for w in r.text.split() if w.isalpha()]
    text, other = (" ".join(random.Random(k).sample(pool, 60)) for k in range(2))
    odd = docs([(-1, None), (-2, ""), (-3, "123"), (-4, text), (-5, text), (None, other), (-6, "the token=abcdef123456 of the and in that")])
    sample = sample.select(odd.columns)
    frame, left = odd.union(sample), {}
    for name, f in corpus_pipeline.STAGES:
        frame = f(spark, frame, sf).cache()
        left[name] = {r.doc_id: r for r in frame.collect() if r.doc_id is None or r.doc_id < 0}
    assert left["language_id"].keys() == {-4, -5, None, -6}
    assert left["near_dedup"].keys() == left["decontaminate"].keys() == left["mixing"].keys() == {-5, None, -6}
    assert left["secret_scan"].keys() == {-5, None, -6} and "abcdef123456" not in left["secret_scan"][-6].text

    frame = odd.limit(0)
    for _, f in corpus_pipeline.STAGES:
        frame = f(spark, frame, sf)
        assert frame.count() == 0


def test_near_dedup_tells_rows_apart_and_not_ids(spark, sf, docs):
    a, b, c = (" ".join(words(30, k)) for k in range(3))
    frame = docs([(1, a), (2, a), (2, b), (5, f"{b} more"), (7, c), (7, c), (None, c), (None, "own words here"), (8, ""), (8, "")])
    kept = corpus_pipeline.near_dedup(spark, frame, sf).collect()
    assert sorted((r.text, r.doc_id) for r in kept if r.text) == sorted([(a, 1), (f"{b} more", 5), (c, kept_id(kept, c)), ("own words here", None)])
    assert len([r for r in kept if r.text == ""]) == 2


def kept_id(kept, text):
    """Of copies that share their ids or have none, any may stay, but one only."""
    (row,) = [r for r in kept if r.text == text]
    return row.doc_id


def test_run(spark, sf, stages):
    assert Counter(map(tuple, corpus_pipeline.run(spark, sf).collect())) == Counter(map(tuple, stages["mixing"].collect()))

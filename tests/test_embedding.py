"""Embedding against services that refuse: waits, halving, quota; no row twice, none lost."""

import os

import pytest

from folioscan.operators import providers as P
from folioscan.sources import versions as V


def test_busy_services_are_waited_for():
    answers, waits = iter([429, 503, 500, None]), []

    def embed(texts):
        status = next(answers)
        if status:
            raise P.Refused(status)
        return [[float(len(t))] for t in texts]

    assert P.patient(embed, sleep=waits.append)(["a", "bb"]) == [[1.0], [2.0]] and waits == [1, 2, 4]

    def never(texts):
        raise P.Refused(429)

    waits.clear()
    with pytest.raises(P.OutOfQuota):
        P.patient(never, cap=10, sleep=waits.append)(["a"])
    assert waits == [1, 2, 4, 8, 10, 10]
    assert P.patient(never)([]) == []


def test_bad_texts_are_found_by_halving():
    calls = []

    def embed(texts):
        calls.append(len(texts))
        if any("bad" in t for t in texts):
            raise P.Refused(400, "no")
        if len(texts) > 12:
            raise ValueError("too many")
        if texts == ["short"]:
            return []
        return [[1.0]] * len(texts)

    texts = [f"t{i}" for i in range(64)]
    texts[17] = "bad one"
    got = P.patient(embed)(texts)
    assert [i for i, v in enumerate(got) if v is None] == [17] and len(calls) < 24
    assert P.patient(embed)(["short"]) == [None]


def counted(folder, quota):
    """Every call leaves a file of its texts; after `quota` calls the service refuses."""

    def embed(texts):
        import uuid

        if any(t == "poison" for t in texts):
            raise P.Refused(400)
        if len(os.listdir(folder)) >= quota:
            raise P.Refused(429)
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(texts))
        return [[float(len(t))] for t in texts]

    return P.patient(embed, tries=2, sleep=lambda s: None)


def test_a_run_that_meets_its_quota_goes_on_later(spark, tmp_path):
    folder, path = tmp_path / "calls", f"{tmp_path}/vectors"
    folder.mkdir()
    rows = [(i, f"text {i}") for i in range(60)] + [(60, "poison"), (None, "no key"), (3, "text 3")]
    chunks = spark.createDataFrame(rows, "key long, text string")
    left = P.fill_vectors(chunks, path, "key", "text", counted(folder, 4), batch=8, parts=4, every=1).collect()
    done = {r.key for r in V.read_version(spark, path).collect()}
    assert done and {r.key for r in left if r.status == "left"} and done.isdisjoint({r.key for r in left}) and done | {r.key for r in left} == set(range(61))
    left = P.fill_vectors(chunks, path, "key", "text", counted(folder, 999), batch=8).collect()
    assert [(r.key, r.status) for r in left] == [(60, "bad")]
    found = V.read_version(spark, path).collect()
    assert sorted(r.key for r in found) == list(range(60)) and all(r.embedding == [len(f"text {r.key}")] for r in found)
    asked = [t for f in folder.iterdir() for t in f.read_text().split("\n")]
    assert sorted(asked) == sorted(f"text {i}" for i in range(60))
    assert P.fill_vectors(chunks.where("key < 60"), path, "key", "text", counted(folder, 0)).collect() == []

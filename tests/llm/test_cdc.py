import numpy as np
import pyarrow as pa

from folioscan.llm import cdc
from folioscan.llm.common import text_buffers

from .conftest import words


def cut(texts):
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    rows = [[] for _ in texts]
    for row, digest, word, n, start, end in zip(*cdc.chunks(data, offsets), strict=True):
        rows[row].append((int(digest), int(word), int(n), int(start), int(end)))
    return rows


def test_chunks_cover_all_words_and_do_not_depend_on_neighbours():
    texts = [" ".join(words(400, 1)), "", None, "  one two  ", "x", " ".join(words(300, 2)) + "\n", "é ü"]
    rows = cut(texts)
    for t, own in zip(texts, rows, strict=True):
        assert cut([t])[0] == own
        assert sum(c[2] for c in own) == len((t or "").split())
        pieces = " ".join((t or "").encode()[c[3] : c[4]].decode() for c in own)
        assert pieces.split() == (t or "").split()


def test_insertions_do_not_move_cuts():
    base = words(500, 3)
    a, b = cut([" ".join(base), " ".join([*words(7, 9), *base])])
    assert len(a) > 20 and len({c[0] for c in a} & {c[0] for c in b}) >= len(a) - 3


def test_gear_is_the_rolling_hash():
    hashed = np.arange(1, 90, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for size in (1, 3, 25, 64, 80):
        shift, h = -(-64 // size), 0
        with np.errstate(over="ignore"):
            table = cdc.mix(hashed + cdc._GEAR)
        rolling = cdc.gear(hashed, size)
        for i, x in enumerate(table.tolist()):
            h = ((h << shift) + x) % (1 << 64)
            assert int(rolling[i]) == h
        if size < 80:  # what is `size` words back no longer counts
            assert (cdc.gear(hashed[size:], size)[size - 1 :] == rolling[2 * size - 1 :]).all()


def test_equal_passages_hold_an_equal_cut_whatever_surrounds_them():
    passage = words(50, 12)
    for k in range(20):
        texts = [" ".join([*words(3 * k + i, 60 + i), *passage, *words(k, 90 + i)]) for i in range(2)]
        data, offsets = text_buffers(pa.array(texts))
        hashed, row = cdc.words(data, offsets)
        at, _ = cdc.cuts(hashed, row, 50)
        first = np.searchsorted(row, [0, 1]) + np.array([3 * k, 3 * k + 1])
        inside = [{int(a - f) for a in at if f <= a <= f + 25} for f in first]
        assert inside[0] & inside[1]


def fifty(rows, length=50):
    """Documents that share a window of `length` words with another, and the words that such windows cover."""
    where = {}
    for d, t in rows:
        w = (t or "").lower().split()
        for i in range(len(w) - length + 1):
            where.setdefault(tuple(w[i : i + length]), []).append((d, i))
    covered = {}
    for places in where.values():
        if len({d for d, _ in places}) > 1:
            for d, i in places:
                covered.setdefault(d, set()).update(range(i, i + length))
    return covered


def test_passages_are_found_to_the_word_and_clean_documents_left(docs):
    rows, passage = [], {n: words(n, 50 + n) for n in (38, 49, 50, 51, 55, 90)}
    for i in range(90):
        own = words(150, 1000 + i)
        if i % 3 == 0:
            own = own[: i % 70] + passage[list(passage)[i // 3 % 6]] + own[i % 70 :]
        rows.append((i, " ".join(own) + " Licensed under the same short line."))
    whole = " ".join(words(70, 7))
    rows += [(100, whole), (101, whole.upper()), (102, None), (103, ""), (104, " ".join(words(30_000, 8))), (105, " ".join(words(60, 77) * 2))]
    found = cdc.repeated_passages(docs(rows, digest=1, word=2, run=3)).collect()
    want = fifty(rows)
    assert {r.doc_id for r in found} == set(want) and 105 not in want
    text = dict(rows)
    for r in found:
        part = text[r.doc_id].encode()[r.byte_start : r.byte_end].decode().split()
        assert len(part) == r.words >= 50
        size = len(want[r.doc_id])
        assert r.words <= size and (size >= 62 or r.words == size)
    fresh = {r.doc_id: r.fresh_words for r in found}
    assert (fresh[100], fresh[101]) == (70, 0)
    inside = {r.doc_id for r in cdc.repeated_passages(docs(rows), across=False).collect()}
    assert inside == set(want) | {105}


def test_documents_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = fifty([(r.doc_id, r.text) for r in df.collect()])
    found = {r.doc_id for r in cdc.repeated_passages(df).collect()}
    assert set(want) == found


def test_edges(docs):
    assert cdc.repeated_passages(docs([])).collect() == []
    text = " ".join(words(80, 4))
    rows = cdc.repeated_passages(docs([(None, text), (3, text), (3, text)])).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["3", "3"]
    assert cdc.repeated_passages(docs([(3, text), (3, text)])).collect() == []


def as_words(rows, found):
    """Words of each document that its passages hold."""
    text, held = dict(rows), {}
    for r in found:
        data = text[r.doc_id].encode()
        first = len(data[: r.byte_start].split())
        assert len(data[r.byte_start : r.byte_end].split()) == r.words
        held.setdefault(r.doc_id, set()).update(range(first, first + r.words))
    return held


def test_frequent_phrases_alone_are_no_passages(docs):
    import random

    r, phrases = random.Random(5), [" ".join(words(7, 300 + i)) for i in range(200)]
    rows = [(i, " ".join(r.choices(phrases, k=30))) for i in range(1500)]
    shared = " ".join(words(60, 999))
    rows += [(2000 + i, " ".join([*r.choices(phrases, k=12), shared, *r.choices(phrases, k=12)])) for i in range(3)]
    want = fifty(rows)
    assert as_words(rows, cdc.repeated_passages(docs(rows)).collect()) == want and set(want) == {2000, 2001, 2002}


def test_fresh_words_are_those_of_no_earlier_document(docs):
    a, b = words(120, 61), words(200, 62)
    rows = [(1, " ".join(b[60:130])), (2, " ".join(a)), (3, " ".join(words(9, 1) + a + b)), (4, " ".join(b)), (5, " ".join(b[:140] + a))]
    found = cdc.repeated_passages(docs(rows)).collect()
    assert as_words(rows, found) == fifty(rows)
    assert sorted((r.doc_id, r.words, r.fresh_words) for r in found) == [(1, 70, 70), (2, 120, 120), (3, 320, 130), (4, 200, 0), (5, 260, 0)]


def test_periodic_passages_are_found(docs):
    rows = []
    for period in (1, 1, 1, 2, 2, 3, 5, 5, 7, 11, 24, 25, 40):
        for repeated in (50, 53, 80):
            unit, n = words(period, 400 + len(rows)), len(rows)
            for k in range(2):
                inner = (unit * 80)[:repeated]
                rows.append((n + k, " ".join([*words(20 + 7 * k, 5000 + n + k), *inner, *words(30, 6000 + n + k)])))
    want = fifty(rows)
    assert set(want) == {d for d, _ in rows}
    assert as_words(rows, cdc.repeated_passages(docs(rows)).collect()) == want

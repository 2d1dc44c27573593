"""Operator 11 against plain counting, with shards of a few bytes and of all texts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from folioscan.llm.phrases import collocations, pack, unpack


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, least=10, top=2000):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            sizes["und" if lang is None else lang] += len(words)
            for k in (1, 2, 3):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        ranked = []
        for p, a in found.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 50 * a for q, b in found.items()):
                continue
            score, _, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, sizes[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top])]
    return sorted(out)


def rows_of(n, seed=3):
    r = random.Random(seed)
    words = ["a", "B", "c", "Öl", "öl", "x-y", "the", "of", " z", "q q", "'"]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!", "?"]
    return [(r.choice(["en", "en", "de", None, "und"]), "".join(r.choice(words) + r.choice(ends) for _ in range(r.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("shard_bytes", [64, 1 << 20])
def test_equals_plain_counting(spark, docs, shard_bytes):
    rows = rows_of(160) + [("en", None), (None, ""), ("en", " \t. ,"), ("de", "the of the of " * 400), ("xx", "only once here")]
    rows += [rows[0]] * 12
    got = collocations(docs([(i, t, lang) for i, (lang, t) in enumerate(rows)], word="w", n=1, phrase=None), shard_bytes=shard_bytes)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_top_and_cover_cut_after_ranking(spark, docs):
    rows = rows_of(120, 5)
    got = collocations(docs([(i, t, lang) for i, (lang, t) in enumerate(rows)]), top=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, top=5)


def test_no_rows_and_no_phrases(spark, docs):
    assert collocations(docs([(1, "a b", "en")]).limit(0)).collect() == []
    assert collocations(docs([(1, "a b c", "en"), (2, None, None)])).collect() == []


def test_packed_numbers_come_back():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**21, 2**28 - 1, 2**28, 2**32 - 1])
    data, ends = pack(values)
    assert unpack(data).tolist() == values.tolist() and ends[-1] == len(data)
    assert len(unpack(pack(np.zeros(0, np.int64))[0])) == 0

import random
import re

import pytest

from folioscan.llm.minhash import near_duplicates

from .conftest import words


def shingles(text, size):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1)))


def brute(rows, size, percent):
    sets = {d: shingles(t, size) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def mutated(base, n, seed):
    r = random.Random(seed)
    out = list(base)
    for _ in range(n):
        out[r.randrange(len(out))] = words(1, r.random())[0]
    return out


@pytest.mark.parametrize(("size", "percent"), [(4, 80), (5, 80), (3, 60)])
def test_groups_of_all_kinds_match_brute_force(docs, size, percent):
    rows, k = [], 0
    for g in range(4):  # groups around a base, some members too far from it but near each other
        base = words(160, g)
        for m in range(14):
            rows.append((k, " ".join(mutated(base, m // 2, 100 * g + m))))
            k += 1
        far = mutated(base, 12, g)
        rows += [(k, " ".join(far)), (k + 1, " ".join(mutated(far, 1, 7))), (k + 2, " ".join(far).upper())]
        k += 3
    chain = words(120, 99)
    for _ in range(6):  # each links to its neighbours only
        rows.append((k, " ".join(chain)))
        chain = mutated(chain, 3, k)
        k += 1
    rows += [(k, ""), (k + 1, None), (k + 2, " \t\n"), (k + 3, "two words"), (k + 4, "TWO\x0bwords"), (k + 5, "two wörds")]
    random.Random(1).shuffle(rows)
    assert got(near_duplicates(docs(rows, digest="x", bucket=1, label=2, u=3), size=size, percent=percent)) == brute(rows, size, percent)


def test_documents_match_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert got(near_duplicates(df, size=4)) == brute(rows, 4, 80)


def test_repeated_rows_null_ids_and_empty_table(docs, spark):
    text = " ".join(words(30))
    df = docs([(5, text), (5, text), (3, text), (None, text), (9, "other words stand here")])
    result = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert result == [(-1, None, True), (3, 3, True), (5, 3, False), (5, 3, False), (9, 9, True)]
    assert near_duplicates(docs([])).collect() == []


def test_very_long_text(docs):
    long = " ".join(words(200_000, 3))
    result = got(near_duplicates(docs([(1, long), (2, long + " tail"), (3, "x" * 2_000_000), (4, "x" * 2_000_000)])))
    assert (result[1][1], result[2][1], result[3][:2], result[4][:2]) == (1, 1, (1, 3), (1, 3))


def test_a_family_below_the_limit_makes_few_pairs(docs, monkeypatch):
    """2,000 texts at a likeness of 0.7 with each other, of nearly one size: no link, and next to no pair."""
    from folioscan.llm import minhash

    made, crossed = [], minhash._crossed

    def counted(*given):
        pairs = crossed(*given)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(minhash, "_crossed", counted)
    shared = words(145, 5)
    rows = [(i, " ".join([*shared, *words(30 + i % 3, 9000 + i)])) for i in range(2000)]
    rows += [(5000 + i, rows[7 * i][1] + " tail") for i in range(20)]
    found = got(near_duplicates(docs(rows)))
    assert {d for d, x in found.items() if not x[2]} == {5000 + i for i in range(20)}
    assert all(found[5000 + i][1] == 7 * i for i in range(20))
    assert made and made[0] <= 2 * len(rows)

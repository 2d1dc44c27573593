"""Operator 13 against a plain evaluation of every term and pair."""

import random
import re
from collections import Counter, defaultdict

from folioscan.llm.divergence import source_divergence


def brute(rows, min_docs):
    counts, frequency, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        frequency[lang].update(set(terms))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in frequency[lang].items() if n >= min_docs]
        own = sorted(s for x, s in groups if x == lang)
        whole = sum((counts[lang, s] for s in own), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: share(counts[lang, s]) for s in own}, share(whole)
        for s in own:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:10]
            for part, ranked in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(ranked)]
    return sorted(out)


def test_equals_the_plain_evaluation(spark, docs):
    r = random.Random(7)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["Éa", "éa", "ÀB", "don't", "x1y"]
    rows = []
    for i in range(300):
        source = r.choice(["s0", "s0", "s1", "s2", None, ""])
        bias = r.sample(words, 15)
        rows.append((r.choice(["en", "en", "de", None]), source, " ".join(r.choice(bias) for _ in range(r.randint(0, 40)))))
    rows += [("en", "empty", ""), ("en", "null", None), ("zz", "alone", "few words"), ("zz", "other", "12 34"), rows[0], rows[0]]
    got = source_divergence(docs([(i, t, lang, s) for i, (lang, s, t) in enumerate(rows)], term="t", n=1, value=2), min_docs=5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 5)


def test_sources_without_kept_terms_are_equal(spark, docs):
    got = source_divergence(docs([(1, "a b", "en", "x"), (2, None, "en", "y")]), min_docs=3).collect()
    assert sorted(map(tuple, got)) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_terms_with_one_vector_are_ranked_by_name(spark, docs):
    rows = [(i, "bb aa cc" if i % 2 else "common", "en", "x" if i % 2 else "y") for i in range(20)]
    got = source_divergence(docs(rows), min_docs=2, top=2).where("part = 'term' and source = 'x'").orderBy("rank").collect()
    assert [(r["item"], r["rank"]) for r in got] == [("aa", 1), ("bb", 2)] and got[0]["value"] == got[1]["value"]


def test_no_rows(spark, docs):
    assert source_divergence(docs([(1, "a", "en", "x")]).limit(0)).collect() == []

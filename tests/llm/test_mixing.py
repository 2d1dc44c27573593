import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from folioscan.llm import mixing as M


def make(docs, spark):
    rows, k = [], 0
    for source, n, size in (("big", 120, 30), ("mid", 40, 20), ("small", 9, 12), ("tiny", 2, 5), (None, 3, 7), ("none", 2, 0)):
        for i in range(n):
            rows.append((k, " ".join(["w"] * (size + i % 5 if size else 0)) if size or i else None, "en", source))
            k += 1
    return rows


def totals(rows):
    t = defaultdict(int)
    for _, text, _, s in rows:
        t[s] += len(re.findall(r"\S+", text or ""))
    return dict(t)


def key(*parts):
    return int(hashlib.md5(":".join("-" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)


def brute(rows, weights, blocks, seed=5):
    """Rows of the mixture by a plain walk over each source's permutation."""
    out = Counter()
    for s, w in weights.items():
        own = [(d, len(re.findall(r"\S+", t or ""))) for d, t, _, x in rows if x == s]
        for d, _n in own:
            out[d] += w.whole
        left = w.rest
        by = defaultdict(list)
        for d, n in own:
            by[key(seed, d) % blocks[s]].append((d, n))
        for b in sorted(by, key=lambda b: (key(seed, w.whole, s, b), b)) if left > 0 else []:
            size = sum(n for _, n in by[b])
            if size <= left:
                for d, _n in by[b]:
                    out[d] += 1
                left -= size
                continue
            for d, n in sorted(by[b], key=lambda x: (key(seed, w.whole, x[0]), x[0], x[1])):
                if n > left:
                    break
                out[d] += 1
                left -= n
            break
    return +out


@pytest.mark.parametrize("how", [{"max_repeats": 4.0}, {"target_entropy": 1.2}, {"max_repeats": 3.0, "budget_tokens": 2000}, {"max_repeats": 1.0}])
def test_mixture_matches_a_plain_walk(docs, spark, how):
    rows = make(docs, spark)
    df = docs(rows, weight=1, block=2)
    tokens = M.token_table(df)
    w = {r.source: r for r in M.source_weights(tokens, block_tokens=100, **{"target_entropy": None, "max_repeats": None, **how}).collect()}
    t = totals(rows)
    assert {s: r.tokens for s, r in w.items()} == t
    alpha = w["big"].alpha
    power = {s: (n / sum(t.values())) ** alpha for s, n in t.items() if n}
    for s, p in power.items():
        assert w[s].weight == pytest.approx(p / sum(power.values()))
    if "target_entropy" in how:
        assert -sum(w[s].weight * math.log(w[s].weight) for s in power) == pytest.approx(1.2, abs=1e-6)
    passes = {s: w[s].budget / t[s] for s in power}
    if "budget_tokens" not in how:
        assert min(passes.values()) >= 1
        if "max_repeats" in how:
            assert max(passes.values()) <= how["max_repeats"] + 1e-6
    mix = M.mix_sources(df, block_tokens=100, **{"target_entropy": None, "max_repeats": None, **how}).collect()
    assert Counter(r.doc_id for r in mix) == brute(rows, w, {s: r.blocks for s, r in w.items()})
    for s in power:
        read = sum(r.n_tokens for r in mix if r.source == s)
        assert read <= w[s].budget


def test_bisection_meets_the_limit_closely(docs, spark):
    w = M.source_weights(M.token_table(docs(make(docs, spark))), max_repeats=4.0).collect()
    share = [r.tokens for r in w if r.tokens]
    alpha = w[0].alpha
    assert (max(share) / min(share)) ** (1 - alpha) == pytest.approx(4.0, rel=1e-8)


def test_edges(docs):
    assert M.mix_sources(docs([])).collect() == []
    only_empty = M.mix_sources(docs([(1, None, "en", "a"), (2, "", "en", None)])).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in only_empty) == [(1, 0), (2, 0)]
    one = M.mix_sources(docs([(1, "a b", "en", "s"), (1, "a b", "en", "s"), (None, "c", "en", "s")])).collect()
    assert len(one) == 3 and {r["pass"] for r in one} == {0}

"""Table candidates against a plain sweep of each page; offers of a lexicon against comparing all its terms."""

import random
import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F

from folioscan.functions import fixed
from folioscan.operators import grids as G
from folioscan.operators import transcripts as N


def runs(rows, low, high, gap):
    """rows in runs that are `gap` apart."""
    out, reach = [], None
    for r in sorted(rows, key=lambda r: (r[low], r["n"])):
        if reach is None or r[low] >= reach + gap:
            out.append([])
        out[-1].append(r)
        reach = r[high] if reach is None else max(reach, r[high])
    return out


def plain(words, gap=8.0, slack=3.0):
    found = set()
    for page in {w["page"] for w in words if w["page"] is not None}:
        lines = []
        for no, line in enumerate(runs([w for w in words if w["page"] == page and w["x0"] <= w["x1"] and w["y0"] <= w["y1"]], "y0", "y1", 0.0), 1):
            cells = [{"n": k, "line": no, **{c: f(w[c] for w in run) for c, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max))}} for k, run in enumerate(runs(line, "x0", "x1", gap), 1)]
            lines.append((no, cells))
        band = []
        for no, cells in [*lines, (0, [])]:
            if len(cells) > 1:
                band.append((no, cells))
                continue
            if len(band) >= 2:
                every = [c for _, own in band for c in own]
                box = (min(c["x0"] for c in every), min(c["y0"] for c in every), max(c["x1"] for c in every), max(c["y1"] for c in every))
                edges = []
                for x in sorted(c["x0"] for c in every):
                    if not edges or x - last > slack:  # noqa: F821
                        edges.append(x)
                    last = x  # noqa: F841
                starts = {"gaps": [min(c["x0"] for c in run) for run in runs(every, "x0", "x1", gap)], "edges": edges, "head": [c["x0"] for c in band[0][1]]}
                heads = [c["x0"] for c in band[0][1]]
                for strategy, xs in starts.items():
                    ranges = list(zip(xs, [*xs[1:], float("inf")], strict=True))
                    found.add((page, band[0][0], strategy, *box, len(xs), sum(not any(a <= h < b for h in heads) for a, b in ranges)))
            band = []
    return found


def test_candidates_equal_the_plain_sweep(spark):
    r = random.Random(4)
    words = []
    for page in range(40):
        for n in range(r.randint(0, 60)):
            x, y = r.choice([r.randint(0, 300), 60 * r.randint(0, 4) + r.randint(0, 2)]), 12 * r.randint(0, 14) + r.choice([0, 0, 0, 3])
            words.append({"page": page, "n": n, "x0": float(x), "y0": float(y), "x1": float(x + r.choice([5, 20, 20, 80])), "y1": float(y + 10)})
    words += [{"page": None, "n": 1, "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}, {"page": 1, "n": 999, "x0": 9.0, "y0": 0.0, "x1": 1.0, "y1": 1.0}]
    df = spark.createDataFrame([tuple(w.values()) for w in words], "page long, n long, x0 double, y0 double, x1 double, y1 double").withColumn("line", F.lit("clash")).withColumn("cell", F.lit(0))
    got = {tuple(x) for x in G.table_candidates(df).collect()}
    assert got == plain(words) and len(got) > 60
    chosen = G.chosen_tables(df, F.col("n") % 7 == 0).collect()
    assert {c.page for c in chosen} == {x[0] for x in got} and all(len({c.strategy for c in chosen if c.page == p}) == 1 for p in {c.page for c in chosen})
    assert G.table_candidates(df.limit(0)).collect() == []


def walked(text, short_forms, terms, most):
    low = text.lower().strip()
    offers = []
    for i, w in enumerate(low.split()):
        form = short_forms.get(re.sub(r"\W", "", w), "").split()
        if form:
            offers.append(" ".join([*low.split()[:i], form[0], *low.split()[i + 1 :]]))
    offers += [t for t in terms if 0.40 < SequenceMatcher(None, low, t).ratio() < 0.95]
    unique = [o for o in dict.fromkeys(offers) if o != low and len(o) > 1]
    best = sorted(unique, key=lambda o: -SequenceMatcher(None, low, o).ratio())[:most]
    return [" ".join(w.upper() if w in short_forms and re.fullmatch("[a-z]{1,5}", w) else w.capitalize() if w.isascii() else w for w in o.split()) for o in best]


def test_offers_equal_comparing_all_terms():
    r = random.Random(8)
    syllables = "ver ba lo pum val ve bra ke spring door axle bo gie whe el wsp cbc".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    terms = [" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(1500)] + ["älv", "x"]
    terms += terms[:20]
    forms = {"wsp": "wheel slide", "cbc": "coupler", "none": ""}
    texts = [" ".join(r.choice([word(), "wsp", "cbc.", word()[:-1]]) for _ in range(r.randint(0, 4))) for _ in range(150)] + [r.choice(terms) for _ in range(20)] + ["", "  ", "x", "zzzz"]
    lexicon = N.Lexicon(forms, terms)
    assert [lexicon.offers(t) for t in texts] == [walked(t, forms, terms, 3) for t in texts]
    assert lexicon.offers(None) == []
    assert lexicon.compared < 0.35 * len(texts) * len(terms)


def test_whole_query_of_offers_equals_comparing_all_terms(spark, sf):
    from folioscan.plans import layout, registry

    terms, forms = [f"{a} {n}" for a in layout._ADJECTIVES for n in layout._NOUNS] + ["clock", "purse", "review", "sign up now"], {"click": "press button", "bolt": "screw thread"}
    rows = registry.QUERIES["alternatives"](spark, sf).collect()
    known = {t: ";".join(walked(t, forms, terms, 3)) for t in {r.heard for r in rows}}
    assert len(rows) == 1200 and all(r.offers == known[r.heard] for r in rows)


def brute_confidence(original, corrected, terms):
    if not corrected or len(corrected.strip()) < 2:
        return 0.0
    words = corrected.lower().split()
    if len(words) <= 1:
        return 0.3
    hits = sum(1 for t in terms if set(t.split()) & set(words))
    filler = len(set(words) & set(fixed.FILLER_WORDS)) / len(set(words))
    if not hits and not set(words) & set(fixed.TRANSCRIPT_MARKERS) and not re.search("[ऀ-ॿ]", corrected) and filler > 0.3:
        return 0.1 if filler > 0.5 else 0.25
    alike = SequenceMatcher(None, (original or "").lower(), corrected.lower()).ratio()
    return round(min(0.3 * alike + 0.4 * min(hits / 2, 1) + 0.3 * min(len(words) / 4, 1), 1), 2)


def test_repeated_texts_are_read_once_a_batch():
    calls = []
    rows = pd.Series(["a b", None, "a b", "c"] * 500)
    got = N.each_once(lambda x: calls.append(x) or [x], rows)
    assert got.tolist() == [[x] for x in rows] and len(calls) == 3
    assert N.each_once(max, pd.Series([], dtype=object)).tolist() == []


def test_confidence_equals_its_definition(spark):
    r = random.Random(3)
    pool = ["the", "a", "is", "valve", "dump", "kaise", "Pump", "brake", "क", "x", "that", "good"]
    rows = [(" ".join(r.choices(pool, k=r.randint(0, 6))), " ".join(r.choices(pool, k=r.randint(0, 6)))) for _ in range(200)] + [(None, "dump valve"), ("a", None), ("", " ")]
    terms = ["dump valve", "brake", "pump set"]
    got = [x.c for x in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(N.confidence("a", "b", terms).alias("c")).collect()]
    assert all(abs(g - brute_confidence(a, b, terms)) < 0.0101 for g, (a, b) in zip(got, rows, strict=True))
    assert sum(g == brute_confidence(a, b, terms) for g, (a, b) in zip(got, rows, strict=True)) > 195

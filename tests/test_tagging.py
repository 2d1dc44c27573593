"""Strings that a tag pattern needs, and tags with and without looking for them first."""

import re

from pyspark.sql import functions as F

from folioscan.functions import rules
from folioscan.operators import tagging as G


def test_every_match_holds_a_needed_string():
    assert G.needed(r"(?i)\bfault\b|not working") == ["fault", "not working"] and G.needed(r"(?i)\binspect(ion|ed)?\b") == ["inspect"]
    assert G.needed(r"\bK\d{2}\b|\bcode\b") == [] and G.needed(r"(?i)(ab)*c?") == [] and G.needed(r"(?i)x(yz)+") == ["yz"]
    texts = ["Step 2", "3) turn", "FAULT CODE k05", "Daily trip examination", "110 V MCB", "part no. 7", "anti skid valve", "short  circuit", "SS-2 and POH", "vande  bharat", "axle box", "re-profiling", "obs/m", "air gap", "tyre defect"]
    for _, *patterns in rules.TAG_RULES:
        for p in filter(None, patterns):
            held = G.needed(p)
            for t in texts:
                assert not (held and re.search(p, t)) or any(x in t.lower() for x in held)
    assert sum(bool(G.needed(t)) for _, t, _ in rules.TAG_RULES if t) > 30


def test_beginnings_of_words_find_what_the_patterns_find(spark):
    assert G.alternatives(r"(?i)\ba(b|c)\b|[|)]x|\|y") == [r"(?i)\ba(b|c)\b", r"(?i)[|)]x", r"(?i)\|y"]
    assert G.heads(r"(?i)\b(fault|failure|error)\s*codes?\b") == ["fault", "failure", "error"] and G.heads(r"(?i)\bSS-?[12]\b") == ["ss"] and G.heads(r"(?i)fault") == [] and G.heads(r"\bK\d{2}\b") == []
    plain = ["Step 2", "3) turn", "FAULT CODE k05", "Daily trip examination", "110 V MCB", "part no. 7", "anti skid valve", "short  circuit", "SS-2 and POH", "vande  bharat", "axle box", "re-profiling", "obs/m", "air gap", "tyre defect", "not working"]
    odd = [f(x) for x in plain for f in (str.upper, lambda x: f"é{x}é", lambda x: f"_{x}", lambda x: f"(\u212a{x}\u0301 {x}s", lambda x: f"one-{x}\u0130 11{x}")] + ["", None]
    rows = spark.createDataFrame([(t,) for t in plain + odd], "t string")
    for column in (1, 2):
        patterns = [x[column] for x in rules.TAG_RULES if x[column]]
        begun = G._Begun(patterns)
        got = rows.select(begun.of("t").alias("seen"), "t").select(*(begun.has(F.col("seen"), "t", p).alias(f"a{i}") for i, p in enumerate(patterns)), *(F.coalesce("t", F.lit("")).rlike(p).alias(f"b{i}") for i, p in enumerate(patterns))).collect()
        for i, p in enumerate(patterns):
            assert [r[f"a{i}"] for r in got] == [r[f"b{i}"] for r in got], p

"""Audit of how sources of a language diverge in their words (operator 13).

A term is a run of letters A-Z, a-z and characters outside ASCII, A-Z lower-cased. A language
keeps the terms that stand in `min_docs` of its documents. The counts of a kept term by source
are its vector, with an entry only for sources that hold it. Terms with the same vector say the
same about every pair of sources, so vectors are grouped, each distinct one is evaluated once
and multiplied by the number of its terms; only the ranking of terms goes back to the terms.

Vectors are sparse: a pair's sum over all V kept terms is
V f(p0, q0), plus f(p, q0) - f(p0, q0) for the terms of the first source, the same for those of
the second, plus what is left, f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0), for those of both.
p0 and q0 are the shares of a term that a source doesn't hold.

Odd input: null text, lang or source counts as ''. A source without kept terms still is a group;
where no term is kept, all pairs are 0 and no term is ranked. Repeated rows count each. Without
rows there is no result. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import materialize, only_read, small_batches, written

SCALE = 1_000_000_000
#: Entries that a task gathers before it passes them on; a later sum makes up for it.
HELD = 400_000
#: Bytes of UTF-8 to what terms are split by: letters in lower case and all of non-ASCII text stay.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

_COUNTED = "lang string, source string, term binary, n long, docs long"


def _rows(counts: dict, docs: dict) -> pa.RecordBatch:
    keys = [(lang, source, term, n, docs[lang, source][term]) for (lang, source), own in counts.items() for term, n in own.items()]
    columns = list(zip(*keys, strict=True)) or [()] * 5
    kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "source", "term", "n", "docs"])


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by (lang, source); a task may give a term more than once."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang, source, text in zip(langs, sources, batch.column(2), strict=True):
            terms = text.as_py().translate(TERM_BYTES).split()
            counts[lang, source].update(terms)
            docs[lang, source].update(set(terms))
        if sum(map(len, counts.values())) > HELD:
            yield _rows(counts, docs)
            counts, docs = defaultdict(Counter), defaultdict(Counter)
    yield _rows(counts, docs)


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)), exact for counts of any size; null if nothing is kept."""
    wide = lambda c: c.cast("decimal(20,0)")
    over = F.lit(SCALE).cast("decimal(10,0)") * (wide(n) + F.lit(2))
    under = wide(total) + F.lit(2).cast("decimal(1,0)") * wide(kept)
    return F.when(kept > 0, F.lit(1) + F.call_function("div", over, under))


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def term_vectors(docs: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, vec: the counts of each kept term, an array of (source, n) by source."""
    counted = small_batches(docs).select("lang", "source", F.col("text").cast("binary")).mapInArrow(_count_terms, _COUNTED)
    by_source = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vec = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vec")
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), vec)
    return by_term.where(F.col("docs") >= min_docs).select("lang", F.col("term").cast("string").alias("term"), "vec")


def _pair_values(held: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of each ordered pair of sources of a language.

    held: vid, lang, m, source, p, p0 of every source that holds terms of a distinct vector.
    """
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    p, q, p0, q0 = map(F.col, ("p", "q", "p0", "q0"))
    none = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("kept") * F.coalesce(distance(p0, q0), F.lit(0))).alias("value"))
    cells = held.groupBy("lang", "source", "p", "p0").agg(F.sum("m").alias("m"))
    one = cells.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("m") * (distance(p, q0) - distance(p0, q0))).alias("value"))
    member = F.array_sort(F.collect_list(F.struct("source", "p", "p0")))
    both = lambda x, y: F.struct(
        x["source"].alias("source"), y["source"].alias("item"), (distance(x["p"], y["p"]) - distance(x["p"], y["p0"]) - distance(x["p0"], y["p"]) + distance(x["p0"], y["p0"])).alias("rest")
    )
    pairs = F.flatten(F.transform("at", lambda x, i: F.transform(F.slice("at", i + 2, F.size("at")), lambda y: both(x, y))))
    two = held.groupBy("vid", "lang", "m").agg(member.alias("at")).select("lang", "m", F.explode(pairs).alias("x")).select("lang", "x.source", "x.item", (F.col("m") * F.col("x.rest")).alias("value"))
    two = two.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    one = one.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    back = lambda x: x.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    parts = none.union(one).union(back(one)).union(two).union(back(two))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: how a source parts from the others, and by which terms.

    part 'pair': item is each other source of the language, value the sum over its kept terms.
    part 'term': item is a term that the source holds more of than its language does, value its
    distance to the language, the `top` first. rank counts from 1 by value, then item.
    """
    since = written()
    read = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    docs = docs.select(read(lang_col, "lang"), read(source_col, "source"), read(text_col, "text"))
    terms = materialize(term_vectors(docs, min_docs), "terms")
    total = F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    distinct = materialize(terms.groupBy("lang", "vec").agg(F.count(F.lit(1)).alias("m")).select(F.monotonically_increasing_id().alias("vid"), "lang", "vec", "m", total.alias("whole")), "vectors")

    langs = distinct.groupBy("lang").agg(F.sum("m").alias("kept"), F.sum(F.col("m") * F.col("whole")).alias("lang_total"))
    cells = distinct.select("vid", "lang", "m", "whole", F.explode("vec").alias("x")).select("vid", "lang", "m", "whole", "x.source", "x.n")
    sums = cells.groupBy("lang", "source").agg(F.sum(F.col("m") * F.col("n")).alias("total"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
    groups = materialize(groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("kept"))), "sources")

    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("whole"), F.col("lang_total"), F.col("kept"))
    held = materialize(cells.join(groups, ["lang", "source"]).select("vid", "lang", "m", "source", "p0", p.alias("p"), q.alias("q")), "shares")

    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    ahead = held.where("p > q").select("vid", "lang", "source", distance(F.col("p"), F.col("q")).alias("value"))
    ahead = ahead.withColumn("r", F.rank().over(first)).where(F.col("r") <= top).select("vid", "lang", "source", "value")
    named = ahead.join(distinct.select("vid", "vec"), "vid").join(terms, ["lang", "vec"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    ordered = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    named = named.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= top)
    pairs = _pair_values(held, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ordered))
    return only_read(pairs.unionByName(named), since)

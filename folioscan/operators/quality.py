"""Gates and audits over a corpus of pages and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import fixed
from folioscan.functions.text import empty


def stop_word_ratio(text: Column | str) -> Column:
    """Share of common words among tokens of two letters or more; null for tables and short texts."""
    text = empty(text)
    tokens = F.regexp_extract_all(text, F.lit("[A-Za-z]{2,}"), F.lit(0))
    known = F.filter(tokens, lambda t: F.array_contains(F.array(*map(F.lit, fixed.QUALITY_STOP_WORDS)), F.lower(t)))
    bars = F.length(text) - F.length(F.translate(text, "|", ""))
    table = F.ltrim(text).startswith("Table") | (bars / F.greatest(F.length(text), F.lit(1)) > fixed.TABLE_BAR_SHARE)
    return F.when(~table & (F.size(tokens) >= fixed.MIN_TOKENS), F.size(known) / F.size(tokens))


def garble_audit(chunks: DataFrame, doc: str, text: str) -> DataFrame:
    """doc, judged, flagged: chunks long enough to judge, and those with hardly a common word."""
    rated = chunks.select(doc, stop_word_ratio(text).alias("ratio"))
    return rated.groupBy(doc).agg(F.count("ratio").alias("judged"), F.count(F.when(F.col("ratio") < fixed.STOP_WORD_MIN, 1)).alias("flagged"))


def running_lines(lines: DataFrame, doc: str, page: str, text: str, share: float = fixed.RUNNING_SHARE, least: int = fixed.RUNNING_LEAST) -> DataFrame:
    """doc, key, pages: lines that stand on `share` of a document's pages, `least` at minimum.

    Lines are the same if they differ in white space only; keys of 3 to 120 characters count.
    """
    low, high = fixed.RUNNING_KEY_CHARS
    keyed = lines.select(doc, page, F.regexp_replace(empty(text), r"\s+", "").alias("key")).where(F.char_length("key").between(low, high))
    counts = keyed.groupBy(doc, "key").agg(F.countDistinct(page).alias("pages"))
    sizes = lines.groupBy(doc).agg(F.countDistinct(page).alias("of"))
    return counts.join(sizes, doc).where(F.col("pages") >= F.greatest(F.lit(least), F.floor(F.col("of") * share))).select(doc, "key", "pages")


def without_running_lines(lines: DataFrame, running: DataFrame, doc: str, text: str) -> DataFrame:
    keyed = lines.withColumn("key", F.regexp_replace(empty(text), r"\s+", ""))
    return keyed.join(running.select(doc, "key"), [doc, "key"], "left_anti").drop("key")


def lines_on_all_pages(lines: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """doc, line: trimmed lines that stand on every page of a document.

    Sizes have one row a document, so a partition's are hashed and neither side of their join is sorted.
    """
    rows = lines.select(doc, page, F.trim(empty(text)).alias("line")).where("line <> ''")
    sizes = lines.groupBy(doc).agg(F.countDistinct(page).alias("of"))
    return rows.groupBy(doc, "line").agg(F.countDistinct(page).alias("pages")).join(sizes.hint("shuffle_hash"), doc).where("pages = of").select(doc, "line")


def canary_counts(chunks: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """canary, matches: how often each pattern occurs in the whole corpus, in one pass."""
    counted = chunks.agg(*(F.coalesce(F.sum(F.regexp_count(empty(text), F.lit(p))), F.lit(0)).cast("long").alias(name) for name, p in patterns.items()))
    return counted.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, patterns)), F.array(*map(F.col, patterns)))).alias("canary", "matches"))


def validation(chunks: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """rule, broken: rows that break each rule, and keys that are not unique."""
    counted = chunks.agg(*(F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias(name) for name, ok in rules.items()))
    broken = counted.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*map(F.col, rules)))).alias("rule", "broken"))
    repeated = chunks.groupBy(key).count().where("count > 1").agg(F.count(F.lit(1)).alias("broken")).select(F.lit("unique_key").alias("rule"), "broken")
    return broken.union(repeated)


def rates(chunks: DataFrame, text: str, patterns: dict[str, tuple[str, float]]) -> DataFrame:
    """name, rate, bound, passed: matches per chunk against a bound."""
    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    one = chunks.agg(*((F.coalesce(F.sum(F.regexp_count(empty(text), F.lit(p))), F.lit(0)) / total).alias(n) for n, (p, _) in patterns.items()))
    listed = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.round(n, 6).alias("rate"), F.lit(b).alias("bound")) for n, (_, b) in patterns.items()))).alias("x")).select("x.*")
    return listed.withColumn("passed", F.col("rate") <= F.col("bound"))


def shrunk(old: DataFrame, new: DataFrame, doc: str) -> DataFrame:
    """doc, old_chunks, new_chunks of documents that lost over half of at least SHRINK_LEAST_CHUNKS chunks."""
    before = old.groupBy(doc).agg(F.count(F.lit(1)).alias("old_chunks"))
    after = new.groupBy(doc).agg(F.count(F.lit(1)).alias("new_chunks"))
    joined = before.join(after, doc, "left").withColumn("new_chunks", F.coalesce("new_chunks", F.lit(0)))
    return joined.where((F.col("new_chunks") < F.col("old_chunks") * fixed.SHRINK_DOCUMENT) & (F.col("old_chunks") >= fixed.SHRINK_LEAST_CHUNKS))


def total_shrink(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_chunks, new_chunks, passed: whether the corpus kept all but SHRINK_TOTAL of its chunks."""
    counts = old.select(F.lit(1).alias("a"), F.lit(0).alias("b")).union(new.select(F.lit(0), F.lit(1))).agg(F.coalesce(F.sum("a"), F.lit(0)).alias("old_chunks"), F.coalesce(F.sum("b"), F.lit(0)).alias("new_chunks"))
    return counts.withColumn("passed", F.col("new_chunks") >= F.col("old_chunks") * (1 - fixed.SHRINK_TOTAL))


def orphans(register: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """key, side: registered without chunks ('empty'), chunks without a registration ('unregistered')."""
    has, known = chunks.select(key).distinct(), register.select(key).distinct()
    return known.join(has, key, "left_anti").withColumn("side", F.lit("empty")).union(has.join(known, key, "left_anti").withColumn("side", F.lit("unregistered")))


def histogram(rows: DataFrame, value: Column, most: int = 25) -> DataFrame:
    """value, n of the `most` most frequent values."""
    return rows.select(value.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(most)


def missing_vectors(chunks: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Distinct keys of chunks without a cached vector."""
    return chunks.select(key).distinct().join(cache.select(key), key, "left_anti")


def system_canaries(chunks: DataFrame, system: str, text: str, wanted: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """system, canary, matches of the wanted (system, canary, pattern): counted in the system's own chunks, in one pass.

    A canary of a system that the corpus doesn't have is inactive: its matches are null.
    """
    own = lambda s: F.col(system) == s
    one = chunks.agg(*(F.sum(F.when(own(s), F.regexp_count(empty(text), F.lit(p)))).cast("long").alias(f"c{i}") for i, (s, _, p) in enumerate(wanted)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(s).alias("system"), F.lit(name).alias("canary"), F.col(f"c{i}").alias("matches")) for i, (s, name, _) in enumerate(wanted)))).alias("x")).select("x.*")


def thin_documents(chunks: DataFrame, doc: str, section: str, least: int = 20) -> DataFrame:
    """doc, sections of the documents with fewer than `least` different sections: their headings were probably lost."""
    return chunks.groupBy(doc).agg(F.countDistinct(section).alias("sections")).where(F.col("sections") < least)

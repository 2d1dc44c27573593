"""A second ranking of the first rows by where a question's words stand in them: rare words, close together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.operators.retrieval import reordered

WINDOW_WORDS, POOL, UNIT = 16, 30, 1_000_000


def word_list(text: Column | str) -> Column:
    """The words of a text in their order: runs of two letters a-z or more, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{2,}"), F.lit(0))


def rarities(chunks: DataFrame, id_col: str, text: str, asked: DataFrame) -> DataFrame:
    """term, weight of the asked terms: ln(1 + chunks / chunks with the term) in millionths, over all chunks.

    asked: term. Only asked terms are counted; a term that no chunk has has no row.
    """
    every = chunks.select(F.col(id_col).alias("chunk_id"), word_list(text).alias("words"))
    counted = every.select("chunk_id", F.explode(F.array_distinct("words")).alias("term")).join(asked.select("term").distinct(), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    size = every.agg(F.count(F.lit(1)).alias("size"))
    return counted.crossJoin(F.broadcast(size)).select("term", F.round(UNIT * F.log(1 + F.col("size") / F.col("n"))).cast("long").alias("weight"))


def place_scores(pool: DataFrame, terms: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """query_id, chunk_id, score of pool rows that have a weighted term: the weights of all its terms, and of the best window's.

    pool: query_id, chunk_id, text; terms: query_id, term, weight. A term counts once in a text
    and once in a window of `window` words. Places are lists by row in the order of the words;
    a window holds no more places than words, so each place looks at that many next ones.
    """
    words = pool.select("query_id", "chunk_id", F.posexplode(word_list("text")).alias("place", "term"))
    placed = words.join(terms, ["query_id", "term"]).groupBy("query_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("place", "term", "weight"))).alias("at"))
    own = lambda xs: F.array_distinct(F.transform(xs, lambda x: F.struct(x["term"], x["weight"])))
    total = lambda xs: F.aggregate(own(xs), F.lit(0).cast("long"), lambda a, x: a + x["weight"])
    near = F.transform("at", lambda first, i: total(F.filter(F.slice("at", i + 1, window), lambda x: x["place"] < first["place"] + window)))
    return placed.select("query_id", "chunk_id", (total(F.col("at")) + F.array_max(near)).alias("score"))


def reranked(ranked: DataFrame, questions: DataFrame, chunks: DataFrame, id_col: str, text: str, pool: int = POOL, window: int = WINDOW_WORDS) -> DataFrame:
    """ranked (query_id, chunk_id, rank) with new_rank: its first `pool` rows by score, equals as they stood.

    questions: query_id, question. Rows of the pool without any of the question's words follow
    those with some, in their order; rows beyond the pool, and questions without a word that any
    chunk has, keep their order: nothing that goes missing here loses a row.
    """
    asked = questions.select("query_id", F.explode(F.array_distinct(word_list("question"))).alias("term"))
    terms = asked.join(rarities(chunks, id_col, text, asked), "term")
    head = ranked.where(F.col("rank") <= pool)
    texts = head.join(chunks.select(F.col(id_col).alias("chunk_id"), F.col(text).alias("text")), "chunk_id")
    scored = place_scores(texts, terms, window).join(head.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank"))
    return reordered(ranked, scored.select("query_id", "chunk_id", place.alias("place")), pool)

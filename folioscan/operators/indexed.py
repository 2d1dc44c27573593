"""Keyword top-k over a posting index that is written once, reading long lists only where they can matter.

A chunk's hits are how many of a question's terms it has. Once eight chunks, say, are known to
have `floor` hits each, and to fit under the cap of their documents, no chunk with fewer can be
shown. So the floor - 1 most frequent terms of the question needn't be looked up: a chunk that
has none of the others has too few hits. They are only counted for chunks that others brought up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.operators.retrieval import postings, top_per_query

SEED_SHARE = 3


def write_index(chunks: DataFrame, id_col: str, text: str, doc: str, path: str) -> None:
    """path/postings: term, chunk_id, doc, dealt and sorted by term; path/lists: term, chunks. Null texts have no terms."""
    posted = postings(chunks, id_col, text).join(chunks.select(F.col(id_col).alias("chunk_id"), F.col(doc).alias("doc")), "chunk_id")
    posted.repartition(F.col("term"), F.pmod(F.xxhash64("chunk_id"), F.lit(8))).sortWithinPartitions("term", "chunk_id").write.parquet(f"{path}/postings")
    spark = chunks.sparkSession
    spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("chunks")).write.parquet(f"{path}/lists")


def _non_held(hits: DataFrame, k: int, cap: int) -> DataFrame:
    """The first k chunks of each question of which none is over the cap of its document."""
    own = Window.partitionBy("query_id", "doc").orderBy(F.desc("hits"), "chunk_id")
    return top_per_query(hits.withColumn("_own", F.row_number().over(own)).where(F.col("_own") <= cap), k, F.desc("hits"), F.asc("chunk_id"))


def floors(terms: DataFrame, posted: DataFrame, k: int, cap: int) -> DataFrame:
    """query_id, floor: a count of hits that k chunks of the question have for certain, no more than `cap` of a document; else 0.

    terms: query_id, term, rarity (1: the rarest), terms. The rarest third of a question's terms
    brings up k chunks; all its terms are counted for these.
    """
    seeds = terms.where(F.col("rarity") <= F.greatest(F.lit(1), F.ceil(F.col("terms") / SEED_SHARE)))
    partial = seeds.join(posted, "term").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("hits"), F.first("doc").alias("doc"))
    chosen = _non_held(partial, k, cap).select("query_id", "chunk_id")
    asked = chosen.join(terms.select("query_id", "term"), "query_id")
    full = asked.join(posted.select("term", "chunk_id"), ["term", "chunk_id"]).groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("hits"))
    return full.groupBy("query_id").agg(F.min("hits").alias("least"), F.count(F.lit(1)).alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("least")).otherwise(0).alias("floor"))


def indexed_hits(spark: SparkSession, path: str, terms: DataFrame, k: int, cap: int) -> DataFrame:
    """query_id, chunk_id, doc, hits, terms: all chunks that k shown ones, `cap` of a document, can come from.

    terms: query_id, term, terms (how many the question has). A question of which fewer than k
    chunks are certain looks up all its terms.
    """
    posted, lists = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lists")
    by_rarity = Window.partitionBy("query_id").orderBy(F.asc_nulls_first("chunks"), "term")
    ranked = terms.join(lists, "term", "left").withColumn("rarity", F.row_number().over(by_rarity))
    known = ranked.join(floors(ranked, posted, k, cap), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
    looked = F.col("rarity") <= F.col("terms") - F.greatest(F.col("floor") - 1, F.lit(0))
    found = known.where(looked).join(posted, "term").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("own"), F.first("doc").alias("doc"), F.first("terms").alias("terms"))
    more = found.select("query_id", "chunk_id").join(known.where(~looked).select("query_id", "term"), "query_id").join(posted.select("term", "chunk_id"), ["term", "chunk_id"])
    more = more.groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("more"))
    joined = found.join(more, ["query_id", "chunk_id"], "left").join(known.select("query_id", "floor").distinct(), "query_id")
    return joined.select("query_id", "chunk_id", "doc", (F.col("own") + F.coalesce("more", F.lit(0))).alias("hits"), "terms", "floor").where("hits >= floor").drop("floor")

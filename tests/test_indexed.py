"""The posting index gives the rows of plain counting, from fewer postings."""

import random

from pyspark.sql import functions as F

from folioscan.operators import indexed as D
from folioscan.operators import retrieval as R


def test_rows_equal_plain_counting_for_any_cap(spark, tmp_path):
    r = random.Random(6)
    weights = [1000 / (i + 1) for i in range(400)]
    pool = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(400)]
    rows = [(i, " ".join(r.choices(pool, weights, k=r.randint(0, 40))), r.choice("aaab") if i < 300 else f"s{i % 9}") for i in range(600)] + [(900, None, "a"), (901, "", None)]
    chunks = spark.createDataFrame(rows, "id long, text string, doc string").withColumn("term", F.lit("clash")).withColumn("hits", F.lit(1))
    questions = [(i, " ".join(r.choices(pool, weights, k=r.randint(1, 12)))) for i in range(50)] + [(60, rows[5][1]), (61, "unknown words only"), (62, ""), (63, None), (64, pool[0])]
    terms = R.query_terms(spark.createDataFrame(questions, "id long, text string"), "id", "text").cache()
    D.write_index(chunks, "id", "text", "doc", str(tmp_path))
    plain = R.posting_hits(terms, R.postings(chunks, "id", "text")).join(chunks.select(F.col("id").alias("chunk_id"), F.col("doc")), "chunk_id").cache()
    for k, cap in ((8, 3), (3, 1), (60, 2)):
        shown = lambda hits: sorted(map(tuple, R.diversified(hits.withColumn("score", F.col("hits") / F.col("terms")), k, cap, "doc").select("query_id", "rank", "chunk_id", "doc", "hits").collect()))  # noqa: B023, E731
        found = D.indexed_hits(spark, str(tmp_path), terms, k, cap).cache()
        assert shown(found) == shown(plain)
        if k == 8:
            assert found.count() < plain.count()


def test_empty_tables(spark, tmp_path):
    chunks = spark.createDataFrame([], "id long, text string, doc string")
    D.write_index(chunks, "id", "text", "doc", str(tmp_path))
    terms = R.query_terms(spark.createDataFrame([(1, "some words")], "id long, text string"), "id", "text")
    assert D.indexed_hits(spark, str(tmp_path), terms, 8, 3).collect() == []

"""Queries on the first keyword hits: what they shuffle doesn't grow with documents times questions."""

import pytest

from folioscan.plans import registry

DOCS, ASKED = 3_000, 20
#: How many rows each query returns of the tables below: a question has 8 to 40 first rows, three sources, two languages.
ROWS = {
    "snippets": 160,
    "passage_overlap": 200,
    "pool_ambiguity": 20,
    "proximity_order": 800,
    "rerank_order": 600,
    "row_relevance": 160,
    "amendment_pairs": 160,
    "build_context": 20,
    "citation_dedupe": 120,
    "clarify_span": 20,
    "context_trim": 400,
}


@pytest.fixture(scope="module")
def hot(spark, tmp_path_factory):
    """Every document has a word of every question; only the first sixty have two."""
    at = str(tmp_path_factory.mktemp("hot"))
    text = "CASE WHEN id < 60 THEN 'common rare' ELSE 'common other' END"
    docs = spark.range(DOCS, numPartitions=2).selectExpr("id AS doc_id", f"{text} AS text", "element_at(array('en', 'de'), cast(id % 2 AS int) + 1) AS lang", "concat('s', id % 3) AS source", "cast(length(text) AS bigint) AS n_chars")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.range(ASKED, numPartitions=1).selectExpr("id AS item_id", "'Common rare' AS text").write.parquet(f"{at}/benchmark.parquet")
    return at


def shuffled(spark, since):
    """The most rows that one stage after `since` wrote to a shuffle, and the last stage's number."""
    context, lists = spark.sparkContext._jsc.sc(), spark._jvm.java.util.ArrayList
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(lists(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), lists())
    found = [(s.stageId(), s.shuffleWriteRecords()) for s in (stages.apply(i) for i in range(stages.size()))]
    return max((n for i, n in found if i > since), default=0), max((i for i, _ in found), default=-1)


@pytest.mark.parametrize("name", ROWS)
def test_no_stage_shuffles_the_pairs(name, spark, hot):
    since = shuffled(spark, -1)[1]
    rows = registry.QUERIES[name](spark, hot).collect()
    most, last = shuffled(spark, since)
    assert len(rows) == ROWS[name] and last > since
    assert most < DOCS * ASKED / 10
    if rows and "chunk_id" in rows[0]:
        assert {r.chunk_id for r in rows} <= set(range(60))

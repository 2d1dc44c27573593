"""Retrieval queries: documents are chunks, their source is the document, benchmark items are questions.

Language stands for the coach, a toxic label for a superseded document, n_chars % 25 for the
year of issue; documents and vectors with the same number are one chunk. Vector questions
are the rows whose id is divisible by 100, hybrid questions pair item i with vector i.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import fixed
from folioscan.functions.scoring import coach_factor, document_cap, recency_factor, supersession_factor
from folioscan.functions.text import overlap_ratio, overlap_tokens
from folioscan.operators import indexed as D
from folioscan.operators import rerank as K
from folioscan.operators import retrieval as R
from folioscan.operators import supersession as S
from folioscan.plans.base import ORACLES, Tables, query
from folioscan.sources.files import shared_folder

_TERMS = """
    p AS (SELECT doc_id AS chunk_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}'))) AS term FROM documents),
    l AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{2,}')) AS list FROM benchmark),
    q AS (SELECT query_id, len(list) AS terms, unnest(list) AS term FROM l),
    h AS (SELECT query_id, chunk_id, count(*) AS hits, any_value(terms) AS terms FROM q JOIN p USING (term) GROUP BY ALL)
"""
_TERMS = _TERMS.replace("GROUP BY ALL", "GROUP BY query_id, chunk_id")
_DOT = "round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


def _top(t: Tables, k: int) -> DataFrame:
    """query_id, chunk_id, hits, terms, rank of each item's first k documents."""
    return R.keyword_top(t.documents, "doc_id", "text", R.query_terms(t.benchmark, "item_id", "text"), k)


def _hits_by_source(t: Tables, k: int) -> DataFrame:
    """query_id, chunk_id, hits, terms, doc_id (the source): k of each item and source at least."""
    return R.keyword_hits(t.documents, "doc_id", "text", R.query_terms(t.benchmark, "item_id", "text"), k, group="source")


@query("WITH p AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}'))) AS term FROM documents) SELECT term, count(*) AS chunks FROM p GROUP BY term HAVING count(*) > 1")
def posting_counts(t: Tables) -> DataFrame:
    """Terms of more than one chunk and how many chunks have them."""
    return R.postings(t.documents, "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("chunks")).where("chunks > 1")


@query(f"""WITH {_TERMS},
    s AS (SELECT query_id, chunk_id, source AS doc_id, round(hits / CAST(terms AS DOUBLE), 6) AS score FROM h JOIN documents d ON d.doc_id = chunk_id),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id) > 3 AS held FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY held, score DESC, chunk_id) AS rank FROM c)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, doc_id, score FROM r WHERE rank <= 8""")
def keyword_topk(t: Tables) -> DataFrame:
    """Eight chunks per question by share of terms hit, three of a source at most unless others lack."""
    hits = _hits_by_source(t, fixed.TOP_K_FINAL)
    scored = hits.withColumn("score", F.round(F.col("hits") / F.col("terms"), 6))
    return R.diversified(scored, fixed.TOP_K_FINAL, fixed.PER_DOC_CAP).select("query_id", "rank", "chunk_id", "doc_id", "score")


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {_DOT} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM s)
    SELECT query_id, chunk_id, similarity, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 60""")
def cosine_topk(t: Tables) -> DataFrame:
    """The 60 nearest vectors of every query vector."""
    v = t.embeddings.select("vec_id", "embedding")
    return R.vector_topk(v, v.where("vec_id % 100 = 0"))


@query("""WITH n AS (SELECT vec_id, embedding, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings)
    SELECT vec_id, round(norm, 6) AS norm, round(CAST(embedding[1] AS DOUBLE) / CASE WHEN norm = 0 THEN 1 ELSE norm END, 6) AS first FROM n""")
def normalized_vectors(t: Tables) -> DataFrame:
    """Vectors brought to length 1: their norm before and their first component after."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return t.embeddings.select("vec_id", F.round(norm, 6).alias("norm"), F.round(R.normalized("embedding")[0], 6).alias("first"))


def _arms(t: Tables) -> DataFrame:
    v = t.embeddings.select("vec_id", "embedding")
    asked = t.benchmark.select(F.col("item_id").alias("vec_id")).join(v, "vec_id")
    semantic = R.vector_topk(v, asked, fixed.TOP_K_SEMANTIC).drop("rank")
    keyword = _top(t, 2 * fixed.TOP_K_SEMANTIC).drop("rank")
    return R.fused(semantic, keyword)


_FUSED = f"""{_TERMS},
    s0 AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {_DOT} AS similarity FROM (SELECT e.* FROM embeddings e JOIN benchmark ON item_id = vec_id) a CROSS JOIN embeddings b),
    s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rn FROM s0) WHERE rn <= 60),
    k1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rn FROM h) WHERE rn <= 120),
    f0 AS (SELECT coalesce(s1.query_id, k1.query_id) AS query_id, coalesce(s1.chunk_id, k1.chunk_id) AS chunk_id, similarity, hits, terms
           FROM s1 FULL JOIN k1 ON s1.query_id = k1.query_id AND s1.chunk_id = k1.chunk_id),
    f AS (SELECT query_id, chunk_id, similarity, hits, max(similarity) OVER (PARTITION BY query_id) AS top, max(terms) OVER (PARTITION BY query_id) AS terms FROM f0),
    b AS (SELECT *, 0.55 * coalesce(coalesce(similarity, 0.0) / greatest(coalesce(top, 0.01), 0.01), 0.0) + 0.45 * (coalesce(hits, 0) / CAST(greatest(coalesce(terms, 1), 1) AS DOUBLE)) AS base FROM f)
"""


@query(f"WITH {_FUSED} SELECT query_id, chunk_id, similarity, coalesce(hits, 0) AS hits, terms, round(base, 9) AS base FROM b")
def keyword_semantic_union(t: Tables) -> DataFrame:
    """Both arms' candidates per question and their base score."""
    from folioscan.functions.scoring import hybrid_base

    base = hybrid_base("similarity", F.coalesce("top_similarity", F.lit(0.01)), "hits", F.coalesce("terms", F.lit(1)))
    return _arms(t).select("query_id", "chunk_id", "similarity", F.coalesce("hits", F.lit(0)).alias("hits"), "terms", F.round(base, 9).alias("base"))


def _features(t: Tables) -> DataFrame:
    toxic = t.labels.select("doc_id", (F.col("toxic") == 1).alias("superseded"))
    year = (F.lit(2005) + F.col("n_chars") % 25).cast("string")
    kind = F.when(F.col("n_chars") % 2 == 0, "circular").otherwise("report")
    none = F.lit(None).cast("string")
    docs = t.documents.join(toxic, "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.array("source").alias("tags"), F.substring("text", 1, 80).alias("section"), none.alias("maker"),
        F.array("lang").alias("coaches"), none.alias("system"), year.alias("issue_date"), kind.alias("doc_type"), F.coalesce("superseded", F.lit(False)).alias("superseded"),
    )


def _asked(t: Tables) -> DataFrame:
    coach = F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr"), F.lit("es")), (F.col("item_id") % 4 + 1).cast("int"))
    none = F.lit(None).cast("string")
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.lit(False).alias("procedural"), none.alias("asked_maker"), coach.alias("asked_coach"), none.alias("asked_system"), R.words("text", 3).alias("query_words"))


_SCORED = f"""{_FUSED},
    x AS (SELECT b.*, d.source AS doc_id, d.lang, 2005 + n_chars % 25 AS year, n_chars, coalesce(toxic = 1, false) AS old, ['en', 'de', 'fr', 'es'][CAST(query_id % 4 AS INTEGER) + 1] AS asked,
               list_distinct(regexp_extract_all(lower(substr(d.text, 1, 80)), '[a-z]{{3,}}')) AS sw, contains(lower(substr(d.text, 1, 80)), 'abbreviation') AS abbr,
               list_distinct(regexp_extract_all(lower(coalesce(m.text, '')), '[a-z]{{3,}}')) AS qw
        FROM b JOIN documents d ON d.doc_id = b.chunk_id LEFT JOIN labels l ON l.doc_id = d.doc_id JOIN benchmark m ON m.item_id = query_id),
    y AS (SELECT query_id, chunk_id, doc_id, round(base * 1.0
            * (CASE WHEN abbr THEN 0.4 ELSE 1.0 END * (1.0 + 0.15 * len(list_intersect(sw, qw)))) * 1.0
            * (CASE WHEN lang = asked THEN 1.5 ELSE 0.4 END) * 1.0
            * ((1.0 + greatest(0, least(year - 2010, 20)) * CAST(0.004 AS DOUBLE)) + CASE WHEN n_chars % 2 = 0 THEN CAST(0.03 AS DOUBLE) ELSE 0.0 END)
            * (CASE WHEN old THEN 0.85 ELSE 1.0 END), 9) AS score FROM x)
"""


@query(f"WITH {_SCORED} SELECT query_id, chunk_id, doc_id, score FROM y")
def hybrid_scores(t: Tables) -> DataFrame:
    """Scores of all candidates with every factor."""
    return R.hybrid_scores(_arms(t), _features(t), _asked(t)).select("query_id", "chunk_id", "doc_id", "score")


@query(f"""WITH {_SCORED},
    z AS (SELECT query_id, chunk_id, doc_id, score FROM y),
    n AS (SELECT source AS doc_id, count(*) AS n FROM documents GROUP BY source),
    c AS (SELECT z.*, row_number() OVER (PARTITION BY query_id, z.doc_id ORDER BY score DESC, chunk_id) > greatest(3, floor(floor(sqrt(n)) / 4)) AS held FROM z JOIN n USING (doc_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY held, score DESC, chunk_id) AS rank FROM c)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, doc_id, score FROM r WHERE rank <= 8""")
def hybrid_topk(t: Tables) -> DataFrame:
    """The final eight of each question: hybrid scores, capped by the size of a source."""
    sizes = t.documents.groupBy(F.col("source").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    scored = R.hybrid_scores(_arms(t), _features(t), _asked(t)).join(sizes, "doc_id")
    return R.diversified(scored, fixed.TOP_K_FINAL, document_cap("n")).select("query_id", "rank", "chunk_id", "doc_id", "score")


@query(f"""WITH {_TERMS},
    s AS (SELECT query_id, chunk_id, source AS doc_id, round(hits / CAST(terms AS DOUBLE), 6) AS score FROM h JOIN documents d ON d.doc_id = chunk_id),
    c AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, chunk_id) > 6 AS held FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY held, score DESC, chunk_id) AS rank FROM c)
    SELECT query_id, doc_id, count(*) AS slots, CAST(min(rank) AS INTEGER) AS best_rank FROM r WHERE rank <= 20 GROUP BY query_id, doc_id""")
def diversified_slots(t: Tables) -> DataFrame:
    """Slots of each source among the twenty of an enumeration, six at most unless others lack."""
    hits = _hits_by_source(t, fixed.TOP_K_ENUMERATE)
    top = R.diversified(hits.withColumn("score", F.round(F.col("hits") / F.col("terms"), 6)), fixed.TOP_K_ENUMERATE, 6)
    return top.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("slots"), F.min("rank").alias("best_rank"))


@query("SELECT source AS doc_id, count(*) AS chunks, CAST(greatest(3, floor(floor(sqrt(count(*))) / 4)) AS INTEGER) AS cap, CAST(greatest(3, floor(floor(sqrt(count(*))) / 4)) * 2 AS INTEGER) AS cap_enumerate FROM documents GROUP BY source")
def doc_cap(t: Tables) -> DataFrame:
    """How many slots each source may take among 8 and among 20."""
    sizes = t.documents.groupBy(F.col("source").alias("doc_id")).agg(F.count(F.lit(1)).alias("chunks"))
    return sizes.select("doc_id", "chunks", document_cap("chunks").alias("cap"), document_cap("chunks", fixed.TOP_K_ENUMERATE).alias("cap_enumerate"))


@query(f"""WITH {_TERMS},
    r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank FROM h),
    t AS (SELECT * FROM r WHERE rank <= 30),
    x AS (SELECT t.*, CASE WHEN d.n_chars % 3 = 0 THEN d.n_chars END AS place FROM t JOIN documents d ON d.doc_id = chunk_id)
    SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank > 20 THEN 2 WHEN place IS NOT NULL THEN 0 ELSE 1 END, CASE WHEN rank > 20 THEN 0 ELSE coalesce(place, 0) END, rank) AS INTEGER) AS new_rank
    FROM x""")
def rerank_order(t: Tables) -> DataFrame:
    """The first twenty of thirty rows in a scorer's order; the scorer lists every third text by length."""
    ranked = _top(t, 30)
    size = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("n_chars").alias("place"))
    listed = ranked.where("rank <= 20").select("query_id", "chunk_id").join(size, "chunk_id").where("place % 3 = 0")
    return R.reordered(ranked.select("query_id", "chunk_id", "rank"), listed, 20).select("query_id", "chunk_id", "rank", "new_rank")


@query(f"""WITH {_TERMS},
    r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank FROM h),
    x AS (SELECT query_id, lang, source FROM r JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 15)
    SELECT query_id, (count(DISTINCT lang) >= 2 OR count(DISTINCT source) >= 3) AS ambiguous FROM x GROUP BY query_id""")
def pool_ambiguity(t: Tables) -> DataFrame:
    """Whether the first fifteen rows span several languages or three sources."""
    ranked = _top(t, 15)
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), F.array("lang").alias("coaches"), F.lit(None).cast("string").alias("maker"), F.col("source").alias("subsystem"))
    return R.ambiguous_pools(ranked.join(docs, "chunk_id"))


@query(f"""WITH {_TERMS},
    r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank FROM h),
    x AS (SELECT query_id, lang, source FROM r JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 3),
    g AS (SELECT query_id, list_sort(list(DISTINCT lang)) AS langs, count(DISTINCT source) AS docs FROM x GROUP BY query_id)
    SELECT query_id, 'To give you the correct values, please tell me the coach type (' || array_to_string(langs, ' / ') || ') for your equipment.' AS message
    FROM g WHERE len(langs) >= 2 AND docs >= 2""")
def clarify_span(t: Tables) -> DataFrame:
    """What to ask back where the first three rows are in several languages from several sources."""
    ranked = _top(t, 3)
    none = F.lit(None).cast("string")
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.array("lang").alias("coaches"), none.alias("maker"), none.alias("system"))
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), none.alias("asked_coach"), none.alias("asked_maker"), none.alias("asked_system"))
    return R.clarifications(ranked.join(docs, "chunk_id"), asked)


@query("SELECT doc_id, round((1.0 + greatest(0, least(2005 + n_chars % 25 - 2010, 20)) * CAST(0.004 AS DOUBLE)) + CASE WHEN n_chars % 2 = 0 THEN CAST(0.03 AS DOUBLE) ELSE 0.0 END, 6) AS recency, CASE WHEN lang = 'de' THEN 1.5 ELSE 0.4 END::DOUBLE AS coach FROM documents")
def recency_and_coach(t: Tables) -> DataFrame:
    """The date factor of every chunk, and the coach factor of a question about 'de'."""
    year = (F.lit(2005) + F.col("n_chars") % 25).cast("string")
    kind = F.when(F.col("n_chars") % 2 == 0, "circular").otherwise("report")
    return t.documents.select("doc_id", F.round(recency_factor(year, kind), 6).alias("recency"), coach_factor(F.array("lang"), F.lit("de")).alias("coach"))


@query("""WITH o AS (SELECT *, o_orderkey AS pos FROM orders)
    SELECT o_custkey AS old_doc_id, arg_max(o_orderkey, (strftime(o_orderdate, '%Y-%m-%d'), -pos)) AS doc_id, max(strftime(o_orderdate, '%Y-%m-%d')) AS issue_date FROM o GROUP BY o_custkey""")
def newest_superseder(t: Tables) -> DataFrame:
    """The newest order of each customer, as a document that supersedes the customer's number."""
    orders = t.orders.select(F.col("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("issue_date"), F.array("o_custkey").alias("supersedes"), F.col("o_orderkey").alias("position"))
    return S.newest_superseder(orders)


@query("""SELECT d.doc_id, coalesce(toxic = 1, false) AS superseded, CASE WHEN toxic = 1 THEN 0.85 ELSE 1.0 END::DOUBLE AS factor FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def supersession_penalty(t: Tables) -> DataFrame:
    """Chunks with whether a newer document supersedes them, and the factor."""
    newest = t.labels.where("toxic = 1").select(F.col("doc_id").alias("old_doc_id"), (-F.col("doc_id")).alias("doc_id"))
    marked = S.mark_superseded(t.documents.select("doc_id"), newest)
    return marked.select("doc_id", "superseded", supersession_factor("superseded").alias("factor"))


@query(f"""WITH {_TERMS},
    r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank FROM h),
    x AS (SELECT r.*, list_distinct(regexp_extract_all(lower(text), '[a-z]{{2,}}|[0-9]+(?:\\.[0-9]+)?')) AS tokens FROM r JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 5)
    SELECT a.query_id, a.chunk_id, b.chunk_id AS other_id, round(len(list_intersect(a.tokens, b.tokens)) / CAST(nullif(len(a.tokens), 0) AS DOUBLE), 6) AS overlap
    FROM x a JOIN x b ON a.query_id = b.query_id AND a.rank < b.rank""")
def passage_overlap(t: Tables) -> DataFrame:
    """Share of a passage's tokens in each lower-ranked one of the same question's five."""
    top = _top(t, 5).select("query_id", "chunk_id", "rank")
    rows = top.join(t.documents.select(F.col("doc_id").alias("chunk_id"), overlap_tokens("text").alias("tokens")), "chunk_id")
    other = rows.select("query_id", F.col("chunk_id").alias("other_id"), F.col("rank").alias("other_rank"), F.col("tokens").alias("other_tokens"))
    pairs = rows.join(other, "query_id").where("rank < other_rank")
    return pairs.select("query_id", "chunk_id", "other_id", F.round(overlap_ratio("tokens", "other_tokens"), 6).alias("overlap"))


@query(f"""WITH RECURSIVE {_TERMS},
    r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank FROM h),
    x AS (SELECT r.*, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) AS doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{2,}}|[0-9]+(?:\\.[0-9]+)?')) AS tokens FROM r JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 40),
    f AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN doc_id + 1 END AS newer FROM x WHERE rank <= 8),
    c AS (SELECT f.query_id, f.rank, list_sort(list({{'s': -len(list_intersect(f.tokens, x.tokens)), 'r': x.rank, 'c': x.chunk_id}})) AS able FROM f JOIN x ON x.query_id = f.query_id AND x.doc_id = f.newer GROUP BY f.query_id, f.rank),
    g AS (SELECT f.query_id, f.rank, f.chunk_id, len(tokens) AS n, coalesce(able, []) AS able FROM f LEFT JOIN c ON c.query_id = f.query_id AND c.rank = f.rank),
    z AS (
        SELECT query_id, CAST(0 AS BIGINT) AS i, list(chunk_id) AS present, CAST([] AS STRUCT(c BIGINT, b BIGINT)[]) AS seats FROM f GROUP BY query_id
        UNION ALL
        SELECT query_id, i + 1, CASE WHEN seated THEN list_append(present, best.c) ELSE present END, CASE WHEN seated THEN list_append(list_append(seats, {{'c': chunk_id, 'b': NULL::BIGINT}}), {{'c': best.c, 'b': chunk_id}}) ELSE list_append(seats, {{'c': chunk_id, 'b': NULL::BIGINT}}) END
        FROM (SELECT *, n > 0 AND best IS NOT NULL AND coalesce(-best.s, 0) >= {fixed.AMENDMENT_MIN_OVERLAP} * n AS seated FROM (SELECT z.query_id, i, present, seats, chunk_id, n, list_filter(able, lambda a: NOT list_contains(present, a.c))[1] AS best FROM z JOIN g ON g.query_id = z.query_id AND g.rank = i + 1))
    ),
    e AS (SELECT query_id, arg_max(seats, i) AS seats FROM z GROUP BY query_id),
    s AS (SELECT query_id, len(seats) AS n, unnest(range(len(seats))) AS pos, unnest(seats) AS seat, list_transform(seats, lambda q: q.b) AS pulled FROM e),
    o AS (SELECT *, CASE WHEN seat.b IS NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY seat.b IS NOT NULL, list_contains(pulled, seat.c), pos DESC) END AS turn FROM s)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS rank, seat.c AS chunk_id, seat.b AS pulled_by FROM o WHERE coalesce(turn > n - 8, true)""")
def amendment_pairs(t: Tables) -> DataFrame:
    """Final rows with restatements seated behind superseded ones; the next source supersedes a source."""
    pool = _top(t, 40).select("query_id", "chunk_id", "rank")
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), F.regexp_extract("source", "[0-9]+", 0).cast("long").alias("doc_id"), overlap_tokens("text").alias("tokens"))
    rows = pool.join(docs, "chunk_id")
    finals = rows.where("rank <= 8").withColumn("newer_doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") + 1))
    return S.with_amendments(finals, rows)


@query(f"SELECT query_id, rank, chunk_id, coalesce(pulled_by, -1) AS pulled_by FROM ({ORACLES['amendment_pairs'].replace(f'{fixed.AMENDMENT_MIN_OVERLAP} * n', '0.15 * n')})")
def seated_amendments(t: Tables) -> DataFrame:
    """The same with a lower bound on what a restatement shares, so that many are seated."""
    pool = _top(t, 40).select("query_id", "chunk_id", "rank")
    docs = t.documents.select(F.col("doc_id").alias("chunk_id"), F.regexp_extract("source", "[0-9]+", 0).cast("long").alias("doc_id"), overlap_tokens("text").alias("tokens"))
    rows = pool.join(docs, "chunk_id")
    finals = rows.where("rank <= 8").withColumn("newer_doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") + 1))
    return S.with_amendments(finals, rows, least=0.15).withColumn("pulled_by", F.coalesce("pulled_by", F.lit(-1).cast("long")))


@query(ORACLES["keyword_topk"])
def indexed_topk(t: Tables) -> DataFrame:
    """The rows of keyword_topk from a posting index that is written once, long lists read only where they can matter."""
    spark = t.documents.sparkSession
    path = shared_folder(spark, "index")
    D.write_index(t.documents, "doc_id", "text", "source", path)
    hits = D.indexed_hits(spark, path, R.query_terms(t.benchmark, "item_id", "text"), fixed.TOP_K_FINAL, fixed.PER_DOC_CAP)
    scored = hits.withColumnRenamed("doc", "doc_id").withColumn("score", F.round(F.col("hits") / F.col("terms"), 6))
    return R.diversified(scored, fixed.TOP_K_FINAL, fixed.PER_DOC_CAP).select("query_id", "rank", "chunk_id", "doc_id", "score")


@query(f"""WITH {_TERMS},
    f AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank FROM h),
    ranked AS (SELECT * FROM f WHERE rank <= 40),
    docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{2,}}') AS ws FROM documents),
    a AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{2,}}')) AS term FROM benchmark),
    n AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(ws)) AS term FROM docs) WHERE term IN (SELECT term FROM a) GROUP BY term),
    wt AS (SELECT query_id, a.term, CAST(round(1000000 * ln(1 + (SELECT count(*) FROM documents) / n)) AS BIGINT) AS weight FROM a JOIN n ON n.term = a.term),
    o AS (SELECT query_id, chunk_id, unnest(ws) AS term, unnest(range(len(ws))) AS place FROM ranked JOIN docs ON doc_id = chunk_id WHERE rank <= 30),
    p2 AS (SELECT o.query_id, chunk_id, place, o.term, weight FROM o JOIN wt ON wt.query_id = o.query_id AND wt.term = o.term),
    whole AS (SELECT query_id, chunk_id, sum(weight) AS w FROM (SELECT DISTINCT query_id, chunk_id, term, weight FROM p2) GROUP BY ALL),
    near AS (SELECT query_id, chunk_id, max(w) AS w FROM (SELECT query_id, chunk_id, place, sum(weight) AS w FROM (
        SELECT DISTINCT x.query_id, x.chunk_id, x.place, y.term, y.weight FROM p2 x JOIN p2 y ON y.query_id = x.query_id AND y.chunk_id = x.chunk_id AND y.place >= x.place AND y.place < x.place + 16) GROUP BY ALL) GROUP BY ALL),
    s AS (SELECT ranked.*, whole.w + near.w AS score FROM ranked LEFT JOIN whole ON whole.query_id = ranked.query_id AND whole.chunk_id = ranked.chunk_id AND rank <= 30 LEFT JOIN near ON near.query_id = ranked.query_id AND near.chunk_id = ranked.chunk_id AND rank <= 30)
    SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank > 30, score IS NULL, score DESC, rank) AS INTEGER) AS new_rank FROM s""")
def proximity_order(t: Tables) -> DataFrame:
    """The first forty keyword hits of every question, thirty of them ranked anew by rare words close together."""
    hits = _top(t, 40).select("query_id", "chunk_id", "rank")
    return K.reranked(hits, t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), t.documents, "doc_id", "text")

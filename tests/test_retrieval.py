import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscan.functions import scoring
from folioscan.operators import evaluate as E
from folioscan.operators import intent as I
from folioscan.operators import retrieval as R
from folioscan.operators import supersession as S


def plain_diversified(rows, k, cap):
    """Walks the rows in score order, as a reader would fill the slots."""
    kept, held, count = [], [], {}
    for score, chunk, doc in sorted(rows, key=lambda x: (-x[0], x[1])):
        if count.get(doc, 0) < cap:
            count[doc] = count.get(doc, 0) + 1
            kept.append(chunk)
        else:
            held.append(chunk)
    return (kept + held)[:k] if len(kept) < k else kept[:k]


def test_diversified_equals_a_walk(spark):
    r = random.Random(3)
    rows = [(q, c, r.choice(["a", "b", "c"]), round(r.random(), 1)) for q in range(60) for c in range(r.randint(1, 25))]
    df = spark.createDataFrame(rows, "query_id long, chunk_id long, doc_id string, score double")
    for k, cap in ((8, 3), (4, 1), (20, 5)):
        got = {}
        for x in R.diversified(df, k, cap).collect():
            got.setdefault(x.query_id, []).append((x["rank"], x.chunk_id))
        for q in range(60):
            want = plain_diversified([(s, c, d) for i, c, d, s in rows if i == q], k, cap)
            assert [c for _, c in sorted(got[q])] == want


@pytest.mark.parametrize("block", [1, 3, 100])
def test_vector_topk_equals_brute_force(spark, block):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(500, None)], "id long, e array<float>")
    got = {}
    for r in R.vector_topk(df, df.where("id < 9"), 5, block_rows=block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    f = np.float32(v).astype(np.float64)
    for q in range(9):
        scores = np.round(f @ f[q], 6)
        want = sorted(range(120), key=lambda i: (-scores[i], i))[:5]
        assert [c for _, c in sorted(got[q])] == want


def test_reordered_and_ambiguous(spark):
    ranked = spark.createDataFrame([(1, c, c) for c in range(1, 8)] + [(2, 1, 1)], "query_id long, chunk_id long, rank int")
    listed = spark.createDataFrame([(1, 5, 0), (1, 2, 1), (1, 7, 2)], "query_id long, chunk_id long, place int")
    got = [(r.query_id, r.chunk_id) for r in R.reordered(ranked, listed, 5).orderBy("query_id", "new_rank").collect()]
    assert got == [(1, 5), (1, 2), (1, 1), (1, 3), (1, 4), (1, 6), (1, 7), (2, 1)]
    rows = [(1, 1, ["LHB", "common"], "", "x"), (1, 2, ["LHB"], None, "x"), (2, 1, ["LHB"], "A", "x"), (2, 2, ["ICF"], "A", "x"), (3, 1, None, "A", "x"), (3, 20, ["ICF"], "B", "y")]
    df = spark.createDataFrame(rows, "query_id long, rank int, coaches array<string>, maker string, subsystem string")
    assert {r.query_id: r.ambiguous for r in R.ambiguous_pools(df).collect()} == {1: False, 2: True, 3: False}


def test_factors(spark):
    rows = [("2024-10-01", "circular"), ("1999", "report"), ("", "x"), (None, None), ("2040", "correction_slip"), ("ab12", "y")]
    df = spark.createDataFrame(rows, "d string, t string")
    got = [round(r.x, 4) for r in df.select(scoring.recency_factor("d", "t").alias("x")).collect()]
    assert got == [1.086, 1.0, 1.0, 1.0, 1.11, 1.0]
    sizes = spark.createDataFrame([(826,), (358,), (116,), (2,), (None,)], "n int")
    assert [r.c for r in sizes.select(scoring.document_cap("n").alias("c")).collect()] == [7, 4, 3, 3, 3]
    assert [r.c for r in sizes.select(scoring.document_cap("n", 20).alias("c")).collect()] == [14, 8, 6, 6, 6]
    c = spark.createDataFrame([(["LHB"], "LHB"), (["ICF"], "LHB"), (["common"], "LHB"), ([], "LHB"), (None, "LHB"), (["ICF"], None)], "c array<string>, a string")
    assert [r.x for r in c.select(scoring.coach_factor("c", "a").alias("x")).collect()] == [1.5, 0.4, 1.0, 1.0, 1.0, 1.0]
    m = spark.createDataFrame([("A", "A"), ("B", "A"), ("", "A"), (None, "A"), ("B", None)], "m string, a string")
    assert [r.x for r in m.select(scoring.maker_factor("m", "a").alias("x")).collect()] == [1.8, 0.3, 1.0, 1.0, 1.0]
    s = spark.createDataFrame([("Wheel Slide", None), ("Fire", None), (None, ["fdss"]), ("x", ["wsp"]), (None, None)], "s string, t array<string>")
    assert [r.x for r in s.select(scoring.system_of("s", "t").alias("x")).collect()] == ["WSP", "FSDS", "FSDS", "WSP", None]
    p = spark.createDataFrame([(True, ["procedure"]), (True, ["overview"]), (True, ["testing", "overview"]), (False, ["procedure"]), (True, None)], "p boolean, t array<string>")
    assert [r.x for r in p.select(scoring.procedural_factor("p", "t").alias("x")).collect()] == [1.3, 0.5, 0.65, 1.0, 1.0]


def test_supersession(spark):
    rows = [("n1", "2024", ["old"], 0), ("n2", "2024-05", ["old", "x"], 1), ("n3", "2024-05", ["old"], 2), ("n4", None, ["y"], 3)]
    newest = S.newest_superseder(spark.createDataFrame(rows, "doc_id string, issue_date string, supersedes array<string>, position int"))
    assert {r.old_doc_id: r.doc_id for r in newest.collect()} == {"old": "n2", "x": "n2", "y": "n4"}


def seated(spark, cases, least=0.5):
    """Chunks and what pulled them, of each (finals, pool, k) case; a plain walk gives the same."""
    out = []
    for k in sorted({c[2] for c in cases}):
        own = [(i, c) for i, c in enumerate(cases) if c[2] == k]
        finals = [(i, r, c, d, n, list(t)) for i, (f, _, _) in own for r, (c, d, n, t) in enumerate(f, 1)]
        pool = [(i, r, c, d, list(t)) for i, (_, p, _) in own for r, (c, d, t) in enumerate(p, 1)]
        rows = S.with_amendments(spark.createDataFrame(finals, "query_id long, rank int, chunk_id long, doc_id long, newer_doc_id long, tokens array<string>"), spark.createDataFrame(pool, "query_id long, rank int, chunk_id long, doc_id long, tokens array<string>"), k, least)
        found = {i: [] for i, _ in own}
        for r in rows.orderBy("query_id", "rank").collect():
            found[r.query_id].append((r.chunk_id, r.pulled_by))
        out += found.items()
    return [x for _, x in sorted(out)]


def plain_seats(finals, pool, k, least=0.5):
    taken, seats = {f[0] for f in finals}, []
    for chunk, _, newer, tokens in finals:
        seats.append([chunk, None])
        ranked = sorted((-len(set(tokens) & set(t)), i, c) for i, (c, d, t) in enumerate(pool) if d == newer and c not in taken)
        if ranked and set(tokens) and -ranked[0][0] >= least * len(set(tokens)):
            taken.add(ranked[0][2])
            seats.append([ranked[0][2], chunk])
    while len(seats) > k:
        olds = {by for _, by in seats if by is not None}
        able = [i for i, (c, by) in enumerate(seats) if by is None and c not in olds] or [i for i, (_, by) in enumerate(seats) if by is None]
        if not able:
            break
        del seats[able[-1]]
    return [tuple(s) for s in seats]


def test_counterparts_equal_a_plain_walk(spark):
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefg", k=r.randint(0, 5)))
    cases = []
    for _ in range(80):
        chunks = r.sample(range(100), 24)
        cases.append(([(c, r.randint(1, 4), r.choice([None, 2, 3, 4]), word()) for c in chunks[:8]], [(c, r.randint(1, 4), word()) for c in chunks[6:]], r.choice([3, 8])))
    assert seated(spark, cases) == [plain_seats(*c) for c in cases]


def test_counterparts(spark):
    pool = [(10, 2, "abcd"), (11, 2, "abcz"), (12, 3, "abcd"), (20, 1, "abcd")]
    seats = lambda *case: [c for c, _ in seated(spark, [case])[0]]
    assert seats([(1, 1, 2, "abcd"), (5, 9, None, "q")], pool, 8) == [1, 10, 5]
    assert seats([(1, 1, 2, "abxy"), (5, 9, None, "q")], pool, 8) == [1, 10, 5]
    assert seats([(1, 1, 2, "axyz12"), (5, 9, None, "q")], pool, 8) == [1, 5]
    assert seats([(1, 1, 2, "abcd"), (10, 2, None, "abcd")], pool[:1], 8) == [1, 10]
    assert seats([(1, 1, 2, "abcd"), (2, 1, 2, "abcd"), (5, 9, None, "q")], pool, 3) == [1, 10, 11]
    assert seats([(1, 1, 2, ""), (2, 1, 4, "abcd")], pool, 8) == [1, 2]


def test_intents(spark):
    rows = [("list all activities in SS-2",), ("How to reset the LHB fire panel?",), ("vande  bharat dump valve",), ("how many circulars for ICF",), ("smoke and wheel slip",), (None,), ("",)]
    got = I.signals(spark.createDataFrame(rows, "q string").withColumn("id", F.monotonically_increasing_id()), "id", "q").orderBy("query_id").collect()
    assert [r.k for r in got] == [20, 8, 8, 8, 8, 8, 8]
    assert [r.asked_coach for r in got] == [None, "LHB", "Vande Bharat", "ICF", None, None, None]
    assert [r.asked_system for r in got] == [None, "FSDS", "WSP", None, None, None, None]
    assert got[1].procedural and not got[5].procedural
    count = spark.createDataFrame(rows, "q string").select(I.is_corpus_count("q").alias("c"), I.asked_doc_type("q").alias("t")).collect()
    assert count[3].c and count[3].t == "circular" and not count[1].c


def test_refold_bare_answers(spark):
    turns = [(1, 0, "user", "torque of axle bolts"), (1, 1, "assistant", "Please tell me the coach type"), (1, 2, "user", "LHB"), (1, 3, "user", "what about the ICF one in full detail please"), (2, 0, "user", "LHB")]
    got = {(r.conv_id, r.turn): r.retrieval_query for r in I.refolded(spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")).collect()}
    assert got[1, 2] == "torque of axle bolts LHB" and got[1, 3].startswith("what about") and got[2, 0] == "LHB"


def test_expansion(spark):
    lexicon = spark.createDataFrame([("wsp", "wheel slide protection"), ("kya", "")], "term string, expansion string")
    q = spark.createDataFrame([(1, "WSP, kya  wsp?"), (2, ""), (3, None)], "id int, q string")
    assert {r.query_id: r.expanded for r in I.expand(q, lexicon, "id", "q").collect()} == {1: "wsp, kya wsp? wheel slide protection wheel slide protection", 2: "", 3: ""}


def test_retrieval_text(spark):
    mixed = spark.createDataFrame([("kaise", "how"), ("nahi", "not no failure"), ("hai", "")], "term string, expansion string")
    q = spark.createDataFrame([(1, "WSP kaise  kare?"), (2, "valve kaam nahi kar raha hai"), (3, None)], "id int, q string")
    got = {r.query_id: r.full for r in I.retrieval_text(q, I.default_lexicon(spark), mixed, "id", "q").collect()}
    assert got[1] == "wsp kaise kare? wheel slide protection anti-skid braking wsp how to procedure steps? how"
    assert got[2] == "valve kaam nahi kar raha hai valve not working failure hai not no failure"


def test_metrics_and_drafts(spark):
    cases = spark.createDataFrame([(1, ["a", "b"], False), (2, ["c"], None), (3, [], True), (4, ["z"], False)], "case_id int, expect_doc array<string>, expect_absent boolean")
    found = spark.createDataFrame([(1, 1, "x"), (1, 2, "b"), (1, 3, "a"), (2, 1, "c"), (3, 1, "q")], "case_id int, rank int, doc_id string")
    m = E.metrics(E.first_relevant(cases, found)).first()
    assert (m.cases, m.scored, m.hits, m.recall, m.mrr) == (4, 3, 2, 0.666667, 0.5)
    empty = E.metrics(E.first_relevant(cases.limit(0), found)).first()
    assert (empty.cases, empty.recall, empty.mrr) == (0, 0.0, 0.0)
    rows = [("r1", "", "down", "t", "bad", "", "", None, "q?", "doc p.3; e p.1"), ("", "m2", "up", "t", "", "", "n", "p", "q2", "docs p.9"), ("r3", "", "down", "t", "", "", "", "", " ", ""), ("r1", "", "down", "t", "bad", "", "", None, "q?", "doc p.3; e p.1")]
    fb = spark.createDataFrame(rows, "request_id string, message_id string, rating string, timestamp string, reasons string, correction string, note string, provider string, question string, sources string")
    drafts = {r.id: r for r in E.draft_cases(fb, also_up=True).collect()}
    assert set(drafts) == {"fb-r1", "fb-m2"} and drafts["fb-m2"].expect_doc == "docs" and drafts["fb-r1"].expect_doc is None
    assert {r.id for r in E.draft_cases(fb, seen=spark.createDataFrame([("fb-r1",)], "id string"), also_up=True).collect()} == {"fb-m2"}


def test_a_vector_scan_holds_a_tile_of_scores_and_k_rows_a_query():
    rng = np.random.default_rng(3)
    rows, queries = rng.integers(-4, 5, (12_345, 8)).astype(np.float32), rng.integers(-4, 5, (1_500, 8)).astype(np.float64)
    own = rng.permutation(len(rows)).astype(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(own), pa.array(list(rows))], names=["id", "v"])
    shared = SimpleNamespace(value=(list(range(100, 1_600)), queries))
    tracemalloc.start()
    got = pa.Table.from_batches(R._block_scan(shared, 7)(iter([batch]))).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # all scores at once are 148 MB, and their order as much again
    assert len(got) == 7 * 1_500
    for q in (0, 103, 104, 1_499):  # bounds of tiles; whole numbers make many equal scores
        scores = rows.astype(np.float64) @ queries[q]
        best = np.lexsort((own, -scores))[:7]
        found = got[got.query_id == q + 100].sort_values(["similarity", "chunk_id"], ascending=[False, True])
        assert found.chunk_id.tolist() == own[best].tolist() and found.similarity.tolist() == scores[best].tolist()


@pytest.mark.parametrize("block", [50_000, 40])
def test_keyword_hits_counted_in_the_row_equal_the_join(spark, block, monkeypatch):
    monkeypatch.setattr(R, "TILE_SCORES", 300)
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "straße", "x"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    chunks = spark.createDataFrame([(i * 11 % 301, None if i % 50 == 0 else text(6), rng.choice(["a", "b", None])) for i in range(301)], "id long, text string, source string").repartition(3)
    terms = R.query_terms(spark.createDataFrame([(i, text(9) + " nowhere") for i in range(30)] + [(99, None)], "id long, text string"), "id", "text")
    pairs = R.posting_hits(terms, R.postings(chunks, "id", "text")).join(chunks.select(F.col("id").alias("chunk_id"), F.col("source").alias("doc_id")), "chunk_id").collect()
    key = lambda r: (-r.hits, r.chunk_id)
    rows = lambda found: {(r.query_id, r.chunk_id, r.hits, r.terms) for r in found}
    want = [r for q in range(30) for r in sorted((p for p in pairs if p.query_id == q), key=key)[:5]]
    assert rows(R.keyword_top(chunks, "id", "text", terms, 5).collect()) == rows(want)
    got = R.keyword_hits(chunks, "id", "text", terms, 2, group="source", block_terms=block).collect()
    assert rows(got) <= rows(pairs) and len(got) < len(pairs)
    for q in range(30):
        for s in ("a", "b", None):
            best = sorted((p for p in pairs if p.query_id == q and p.doc_id == s), key=key)[:2]
            assert rows(best) <= rows(g for g in got if g.doc_id == s)


def test_keyword_top_builds_no_table_of_pairs(spark):
    words = spark.range(3_000).selectExpr("id", "'common word here' AS text")
    terms = R.query_terms(spark.range(50).selectExpr("id", "'common word' AS text"), "id", "text")
    found = R.keyword_top(words, "id", "text", terms, 4)
    assert [(r.chunk_id, r.hits) for r in found.where("query_id = 7").orderBy("rank").collect()] == [(0, 2), (1, 2), (2, 2), (3, 2)]
    hits = R.keyword_hits(words, "id", "text", terms, 4)
    assert hits.count() <= 4 * 50 * hits.rdd.getNumPartitions()
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan

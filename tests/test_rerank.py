"""The second ranking against a plain walk, and what it does where nothing can be said."""

import math
import random
import re

from folioscan.operators import rerank as K


def plain(ranked, questions, chunks, pool, window):
    words = {c: re.findall("[a-z]{2,}", (t or "").lower()) for c, t in chunks}
    df = {}
    for own in words.values():
        for w in set(own):
            df[w] = df.get(w, 0) + 1
    out = []
    for q, text in questions:
        weight = {t: int(math.floor(1e6 * math.log(1 + len(chunks) / df[t]) + 0.5)) for t in set(re.findall("[a-z]{2,}", (text or "").lower())) if t in df}
        rows = sorted((r, c) for q2, c, r in ranked if q2 == q)
        scored = []
        for r, c in rows:
            own, score = words[c], None
            places = [i for i, w in enumerate(own) if w in weight]
            if places and r <= pool:
                score = sum(weight[w] for w in set(own) & set(weight)) + max(sum(weight[w] for w in set(own[i : i + window]) & set(weight)) for i in places)
            scored.append((r > pool, score is None, -(score or 0), r, c))
        out += [(q, c, r, k) for k, (_, _, _, r, c) in enumerate(sorted(scored), 1)]
    return sorted(out)


def test_order_equals_a_plain_walk(spark):
    r = random.Random(4)
    pool = ["pump", "valve", "Brake", "the", "of", "of", "axle", "x", "door-leaf", "42", "wheel"]
    chunks = [(i, " ".join(r.choices(pool, k=r.randint(0, 40)))) for i in range(60)] + [(90, None), (91, "")]
    questions = [(i, " ".join(r.choices(pool, k=r.randint(0, 5)))) for i in range(20)] + [(30, None), (31, "unknown words")]
    ranked = [(q, c, k) for q, _ in questions for k, c in enumerate(r.sample([c for c, _ in chunks], 20), 1)]
    frames = spark.createDataFrame(ranked, "query_id long, chunk_id long, rank int"), spark.createDataFrame(questions, "query_id long, question string"), spark.createDataFrame(chunks, "id long, body string")
    for most, window in ((12, 6), (30, 3)):
        got = K.reranked(*frames, "id", "body", most, window).select("query_id", "chunk_id", "rank", "new_rank").collect()
        assert sorted(map(tuple, got)) == plain(ranked, questions, chunks, most, window)
    assert K.reranked(frames[0].limit(0), *frames[1:], "id", "body").collect() == []

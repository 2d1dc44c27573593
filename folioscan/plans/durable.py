"""Queries on durable tables, chains of providers and streams' joins; inputs are made by expressions that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import text as X
from folioscan.operators import providers as P
from folioscan.operators import register as G
from folioscan.operators import retrieval as R
from folioscan.plans.base import Shared, Tables, query
from folioscan.sources import local as K
from folioscan.sources import versions as V
from folioscan.sources.files import shared_folder
from folioscan.streaming import usage as U

_ASKED = Shared("events", user_id="user_id", ts="ts", event_id="event_id", event_type="event_type")


@query(f"""WITH e AS ({_ASKED.sql}), u AS (SELECT * FROM e WHERE event_type = 'view'), f AS (SELECT * FROM e WHERE event_type <> 'view'),
    j AS (SELECT u.event_id, arg_max(f.event_type, (f.ts, f.event_id)) AS answer, arg_max(f.event_id, (f.ts, f.event_id)) AS answered_by FROM u LEFT JOIN f ON f.user_id = u.user_id AND f.ts >= u.ts AND f.ts <= u.ts + INTERVAL 6 HOUR GROUP BY u.event_id)
    SELECT event_id, answer, answered_by FROM j""")
def feedback_in_time(t: Tables) -> DataFrame:
    """Every view with the last other event of its user in the six hours after it; a test holds the stream to the same rows."""
    rows = _ASKED.of(t)
    views, others = rows.where("event_type = 'view'"), rows.where("event_type <> 'view'").withColumnRenamed("event_type", "answer").withColumnRenamed("event_id", "answered_by")
    joined = U.feedback_in_time(views, others, "user_id", "ts", "answered_by", within="6 hours")
    return joined.select("event_id", "feedback.answer", "feedback.answered_by")


@query("""WITH v AS (SELECT vec_id AS key, round(CAST(embedding[1] AS DOUBLE), 6) AS x FROM embeddings)
    SELECT key, CASE WHEN key % 3 = 0 THEN x * 2 ELSE x END AS x, CASE WHEN key % 3 = 0 THEN 'second' ELSE 'first' END AS written FROM v WHERE key % 2 = 0 OR key % 3 = 0""")
def vector_versions(t: Tables) -> DataFrame:
    """A table of vectors in two versions: the even keys, then every third replaced or added; the newest is read."""
    rows = t.embeddings.select(F.col("vec_id").alias("key"), F.round(F.col("embedding")[0].cast("double"), 6).alias("x"))
    path = shared_folder(rows.sparkSession, "vectors")
    V.merge(path, rows.where("key % 2 = 0").withColumn("written", F.lit("first")), "key", parts=4)
    V.merge(path, rows.where("key % 3 = 0").withColumn("x", F.col("x") * 2).withColumn("written", F.lit("second")), "key")
    return V.read_version(rows.sparkSession, path)


_SIDES = "CASE label WHEN 1 THEN CASE WHEN vec_id % 7 = 0 THEN NULL ELSE vec_id END WHEN 2 THEN CASE WHEN vec_id % 7 = 0 THEN vec_id + 1000000 ELSE vec_id END WHEN 4 THEN NULL WHEN 5 THEN vec_id - vec_id % 2 ELSE vec_id END"
_DIM = "CASE WHEN label = 3 AND vec_id % 5 = 0 THEN 8 ELSE 16 END"


@query(f"""WITH c AS (SELECT label, vec_id AS key FROM embeddings), v AS (SELECT * FROM (SELECT label, {_SIDES} AS key, {_DIM} AS dim FROM embeddings) WHERE key IS NOT NULL),
    g AS (SELECT DISTINCT label FROM c),
    m AS (SELECT g.label, CASE WHEN (SELECT count(*) FROM v WHERE v.label = g.label) = 0 THEN 'words'
                 WHEN (SELECT count(*) FROM v WHERE v.label = g.label) = (SELECT count(*) FROM c WHERE c.label = g.label) AND (SELECT count(*) FROM v WHERE v.label = g.label AND dim <> 16) = 0
                      AND NOT EXISTS (SELECT key FROM v WHERE v.label = g.label EXCEPT ALL SELECT key FROM c WHERE c.label = g.label) THEN 'hybrid' ELSE 'rebuild' END AS mode FROM g)
    SELECT label, mode FROM m""")
def search_modes(t: Tables) -> DataFrame:
    """How each label's index can be searched: vectors lack a key, have a strange one, a short one, a double one, or none."""
    vectors = t.embeddings.selectExpr("label", f"{_SIDES} AS key", f"{_DIM} AS dim", "embedding").where("key is not null")
    vectors = vectors.select("label", "key", F.expr("slice(embedding, 1, dim)").alias("embedding"))
    return R.search_modes(vectors, t.embeddings.select("label", F.col("vec_id").alias("key")), "key", 16, "label")


@query(f"""WITH v AS (SELECT * FROM (SELECT label, {_SIDES} AS key, {_DIM} AS dim FROM embeddings) WHERE key IS NOT NULL),
    bad AS (SELECT label FROM v WHERE dim <> 16 UNION SELECT v.label FROM v LEFT JOIN embeddings c ON c.label = v.label AND c.vec_id = v.key WHERE c.vec_id IS NULL
            UNION SELECT c.label FROM embeddings c LEFT JOIN v ON v.label = c.label AND v.key = c.vec_id WHERE v.key IS NULL)
    SELECT label, key, CAST(dim AS INTEGER) AS dim FROM v WHERE label NOT IN (SELECT label FROM bad)""")
def usable_vectors(t: Tables) -> DataFrame:
    """The vectors of labels whose vectors are one for each key, of the right size, and no other; other labels go by words alone."""
    vectors = t.embeddings.selectExpr("label", f"{_SIDES} AS key", f"{_DIM} AS dim", "embedding").where("key is not null")
    vectors = vectors.select("label", "key", F.expr("slice(embedding, 1, dim)").alias("embedding"))
    return R.usable_vectors(vectors, t.embeddings.select("label", F.col("vec_id").alias("key")), "key", 16, "label").select("label", "key", F.size("embedding").alias("dim"))


def _short(prompt: str) -> str:
    return prompt.upper() if len(prompt) % 3 == 0 else " "


def _broken(prompt: str) -> str:
    if len(prompt) % 2:
        raise RuntimeError("503 overloaded")
    return prompt[:10]


@query("""SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 AND length(trim(text)) > 0 THEN 'short' WHEN length(text) % 2 = 0 AND length(trim(text[:10])) > 0 THEN 'broken' ELSE 'last' END AS provider,
    CASE WHEN length(text) % 3 = 0 AND length(trim(text)) > 0 THEN 'cooling,ok' WHEN length(text) % 2 = 0 AND length(trim(text[:10])) > 0 THEN 'cooling,empty,ok' WHEN length(text) % 2 = 0 THEN 'cooling,empty,empty,ok' ELSE 'cooling,empty,error,ok' END AS statuses
    FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user')""")
def answers_by_chain(t: Tables) -> DataFrame:
    """Every user turn answered by a chain of four providers, the first of which rests by the shared table."""
    turns = t.conversations.where("role = 'user'").select(F.struct("conv_id", "turn").alias("key"), "text")
    resting = t.region.agg(F.lit("resting").alias("pool"), F.lit(1 << 50).cast("long").alias("until_ms"))
    chain = [("resting", lambda p: "never"), ("short", _short), ("broken", _broken), ("last", lambda p: "see the source")]
    rows = P.answered(turns, chain, "key", "text", resting=resting)
    return rows.select("key.conv_id", "key.turn", "provider", F.array_join(F.transform("attempts", lambda a: a["status"]), ",").alias("statuses"))


_N, _DAY = "(o_custkey % 80 + 10)", "(o_orderkey % 18 + 10)"
_FILES = Shared(
    "orders", no="o_orderkey", kind="o_orderkey % 6", n=_N, d=_DAY,
    path=f"CASE o_orderkey % 6 WHEN 0 THEN 'in/VB_SMI_B_' || {_N} || ' ' || {_DAY} || '.07.2024.pdf' WHEN 1 THEN 'in/CAI a-2024-' || {_N} || ' Door 2024-03-' || {_DAY} || '.pdf' WHEN 2 THEN 'in/VB_SMI_B_' || {_N} || ' ' || {_DAY} || '.07.2024.pdf' WHEN 3 THEN 'in/wheel marking.pdf' WHEN 4 THEN 'in/scan_' || {_N} || '.pdf' ELSE 'in/x.pdf' END",
    first_page=f"CASE o_orderkey % 6 WHEN 0 THEN 'VB / SMI / B / ' || {_N} || chr(10) || 'Date: ' || {_DAY} || '.7.2024' || chr(10) || 'Sub: Refurbish pump ' || {_N} WHEN 1 THEN NULL WHEN 2 THEN 'VB / SMI / C / ' || {_N} || chr(10) || 'Date: ' || {_DAY} || '.8.2024' || chr(10) || 'Sub: Bearing of axle ' || {_N} WHEN 3 THEN 'plain text' WHEN 4 THEN 'Sub: xqzv kkjq wwzz qqpp xxvv bbnn mmkk zzxx qqww jjkk vvbb nnmm ttrr ppqq' ELSE 'MC/WA/' || {_N} || chr(10) || 'Dated - ' || {_DAY} || '/9/2023' || chr(10) || 'Subject: Door leaf number ' || {_N} END",
    pages="CASE WHEN o_orderkey % 6 = 3 THEN NULL ELSE 4 END", scans="CASE WHEN o_orderkey % 6 = 4 THEN 2 ELSE 0 END", text_chars="CASE o_orderkey % 6 WHEN 4 THEN 400 ELSE 9000 END",
)
_SUBSYSTEMS = (("bearings", r"\bbearing"), ("wheels", r"\bwheel"), ("doors", r"\bdoor\b"))


@query(f"""SELECT no, CASE kind WHEN 0 THEN '2024-07-' || d WHEN 1 THEN '2024-03-' || d WHEN 2 THEN '2024-08-' || d WHEN 5 THEN '2023-09-' || d ELSE '' END AS issue_date,
    CASE kind WHEN 0 THEN 'VB / SMI / B / ' || n WHEN 1 THEN 'CAI A-2024/' || n WHEN 2 THEN 'VB / SMI / C / ' || n WHEN 5 THEN 'MC/WA/' || n ELSE '' END AS letter_no,
    CASE kind WHEN 0 THEN 'Refurbish pump ' || n WHEN 1 THEN 'CAI a-2024-' || n || ' Door 2024-03-' || d WHEN 2 THEN 'Bearing of axle ' || n WHEN 3 THEN 'wheel marking' WHEN 4 THEN 'xqzv kkjq wwzz qqpp xxvv bbnn mmkk zzxx qqww jjkk vvbb nnmm ttrr ppqq' ELSE 'Door leaf number ' || n END AS title,
    CASE kind WHEN 1 THEN 'doors' WHEN 2 THEN 'bearings' WHEN 3 THEN 'wheels' WHEN 5 THEN 'doors' ELSE '' END AS subsystem, kind = 4 AS force_ocr,
    CASE kind WHEN 0 THEN 'page,page,page' WHEN 1 THEN 'name,name,name' WHEN 2 THEN 'page,page,page' WHEN 3 THEN 'none,none,name' WHEN 4 THEN 'none,none,page' ELSE 'page,page,page' END AS origin,
    CASE kind WHEN 1 THEN 'no ''Sub:'' line, title taken from filename' WHEN 2 THEN 'date: filename=2024-07-' || d || ' vs page=2024-08-' || d || '; letter_no: filename=''VB/SMI/B/' || n || ''' vs page=''VB / SMI / C / ' || n || ''''
        WHEN 3 THEN 'no date found; no letter_no found; no ''Sub:'' line, title taken from filename' WHEN 4 THEN 'no date found; no letter_no found; 2/4 pages are scans, look again when they have been read; page 1 text is mojibake' ELSE '' END AS review
    FROM ({_FILES.sql})""")
def register_entries(t: Tables) -> DataFrame:
    """Register rows of every order's file: name and page agree, one is missing, both, or they contradict each other."""
    files = _FILES.of(t)
    keyed = G.register_entries(files.withColumn("path", F.concat(F.lit("d/"), F.col("no").cast("string"), F.lit("/"), "path")), X.DOC_TYPES, _SUBSYSTEMS)
    return keyed.select(F.regexp_extract("path", r"^d/(-?\d+)/", 1).cast("long").alias("no"), "issue_date", "letter_no", "title", "subsystem", "force_ocr", F.concat_ws(",", "origin.issue_date", "origin.letter_no", "origin.title").alias("origin"), F.array_join("review", "; ").alias("review"))


@query("""WITH s AS (SELECT conv_id, turn, coalesce(length(text), 0) AS chars FROM conversations), r AS (SELECT *, sum(chars) OVER o AS held, row_number() OVER o AS place FROM s WINDOW o AS (PARTITION BY conv_id ORDER BY turn DESC, chars ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, turn, CAST(chars AS INTEGER) AS chars FROM r WHERE held <= 1500 OR place <= 2""")
def shed_history(t: Tables) -> DataFrame:
    """The newest turns of every conversation within 1500 characters, two at least."""
    return K.shed_to_budget(t.conversations.select("conv_id", "turn", F.coalesce(F.char_length("text"), F.lit(0)).alias("chars")), "conv_id", "turn", "chars", "chars", 1500, 2)

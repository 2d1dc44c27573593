"""Queries on answers, their guards, traces, scores and cases; inputs are made by expressions that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import fixed, scoring
from folioscan.functions import text as X
from folioscan.operators import assemble as A
from folioscan.operators import evaluate as E
from folioscan.operators import excerpts as P
from folioscan.operators import guards as G
from folioscan.operators import intent as I
from folioscan.operators import quality as Q
from folioscan.operators import retrieval as R
from folioscan.plans.base import Shared, Tables, query

_HOLD, _CLAIM = f"'{fixed.VALUE_PLACEHOLDER}'", f"'{fixed.CLAIM_PLACEHOLDER}'"
_NO, _N, _M = "o_orderkey", "(o_orderkey % 90 + 10)", "(o_custkey % 90 + 10)"

_VALUES = Shared(
    "orders", no=_NO, kind="o_orderkey % 6", n=_N, m=_M,
    answer=f"CASE o_orderkey % 6 WHEN 0 THEN 'Tighten to ' || {_N} || ' Nm now.' WHEN 1 THEN 'Set ' || {_N} || '-' || ({_N} + 3) || ' mm now.' WHEN 2 THEN 'Keep 3,' || {_N} || ' bar now.' WHEN 3 THEN 'Fault code ' || {_N} || ' shows.' WHEN 4 THEN 'Fit FT00' || {_N} || '-003 now.' ELSE 'Do it in SS-2 and POH. **Reference:** ' || {_N} || ' Nm' END",
    context=f"CASE o_orderkey % 6 WHEN 0 THEN 'torque is ' || {_M} || 'Nm' WHEN 1 THEN 'gap ' || ({_M} + 3) || ' mm' WHEN 2 THEN 'at 3.' || {_M} || ' BAR' WHEN 3 THEN 'fault code ' || {_M} WHEN 4 THEN 'part FT00' || {_M} || '/003' ELSE 'none' END",
)


@query(f"""SELECT no, CASE kind
        WHEN 0 THEN CASE WHEN contains('torqueis' || m || 'nm', n || 'nm') THEN answer ELSE 'Tighten to ' || {_HOLD} || ' now.' END
        WHEN 1 THEN CASE WHEN contains('gap' || (m + 3) || 'mm', n || 'mm') OR contains('gap' || (m + 3) || 'mm', (n + 3) || 'mm') THEN answer ELSE 'Set ' || {_HOLD} || ' now.' END
        WHEN 2 THEN CASE WHEN contains('at3.' || m || 'bar', '3.' || n || 'bar') THEN answer ELSE 'Keep ' || {_HOLD} || ' now.' END
        WHEN 3 THEN CASE WHEN contains('faultcode' || m, CAST(n AS STRING)) THEN answer ELSE 'Fault code ' || {_HOLD} || ' shows.' END
        WHEN 4 THEN CASE WHEN n = m THEN answer ELSE 'Fit ' || {_HOLD} || ' now.' END ELSE answer END AS clean FROM ({_VALUES.sql})""")
def guarded_values(t: Tables) -> DataFrame:
    """Answers with a value, a range, a decimal comma, a fault code, a part number or only schedule names, held against a context."""
    return _VALUES.of(t).select("no", G.values_guard("answer", "context")["clean"].alias("clean"))


_FORMS = Shared("orders", no=_NO, answer=f"'Use ' || {_N} || '-' || ({_N} + 4) || ' V, 5' || {_M} || ' kPa, part AB' || {_M} || '-7 and error code E' || {_N} || '.'")


@query(f"SELECT no, ({_N}) || '-' || ({_N} + 4) || ' V;5' || {_M} || ' kPa;AB' || {_M} || '-7;E' || {_N} AS stripped, 'value,value,part-number,fault-code' AS kinds FROM ({_FORMS.sql.replace('SELECT', 'SELECT o_orderkey, o_custkey,', 1)})")
def stripped_spans(t: Tables) -> DataFrame:
    """All values, part numbers and fault codes of answers, held against a context that has none of them."""
    g = _FORMS.of(t).select("no", G.values_guard("answer", F.lit("nothing of that"))["stripped"].alias("s"))
    listed = lambda f: F.transform("s", lambda x: x[f])
    return g.select("no", F.array_join(listed("text"), ";").alias("stripped"), F.array_join(listed("kind"), ",").alias("kinds"))


_SAID = ("There are no limits.", "In the provided context there is no such value.", "Fine.", "These are all the steps!", "No such procedure is known.", "The complete list is below.")
_CLAIMS = Shared("orders", no=_NO, wide="o_custkey % 4 = 0", first=f"o_orderkey % {len(_SAID)}", second=f"o_custkey % {len(_SAID)}")
_ARRAY = "[" + ", ".join(f"'{s}'" for s in _SAID) + "]"
_HELD = "[" + ", ".join(_CLAIM if k in (0, 3, 4, 5) else f"'{s}'" for k, s in enumerate(_SAID)) + "]"


@query(f"SELECT no, CASE WHEN wide THEN {_ARRAY}[first + 1] || ' ' || {_ARRAY}[second + 1] ELSE {_HELD}[first + 1] || ' ' || {_HELD}[second + 1] END || chr(10) || 'Reference: there is no x' AS clean FROM ({_CLAIMS.sql})")
def guarded_claims(t: Tables) -> DataFrame:
    """Answers of two sentences, with the claims that nothing supports withheld, unless the search was wide."""
    said = F.array(*map(F.lit, _SAID))
    answer = F.concat(F.element_at(said, F.col("first").cast("int") + 1), F.lit(" "), F.element_at(said, F.col("second").cast("int") + 1), F.lit("\nReference: there is no x"))
    return _CLAIMS.of(t).select("no", G.claims_guard(answer, "wide")["clean"].alias("clean"))


_COUNTS = Shared("orders", no=_NO, n="o_orderkey % 12 + 2", m="o_custkey % 12 + 2", page="o_orderkey % 5 + 2", doc_type="CASE o_orderkey % 3 WHEN 0 THEN 'circular' WHEN 1 THEN 'maintenance_manual' END")
_NOUN = "CASE WHEN doc_type = 'circular' THEN 'circulars' WHEN doc_type IS NULL THEN 'documents' ELSE 'OEM manuals' END"


@query(f"SELECT no, 'We hold ' || CASE WHEN n = m OR n = page THEN CAST(n AS STRING) ELSE {_HOLD} END || ' ' || {_NOUN} || ' and 99 bolts.' AS clean FROM ({_COUNTS.sql})")
def guarded_counts(t: Tables) -> DataFrame:
    """Answers that state a number of documents, held against the register's and a page's."""
    noun = F.when(F.col("doc_type") == "circular", "circulars").when(F.col("doc_type").isNull(), "documents").otherwise("OEM manuals")
    answer = F.concat(F.lit("We hold "), F.col("n").cast("string"), F.lit(" "), noun, F.lit(" and 99 bolts."))
    return _COUNTS.of(t).select("no", G.counts_guard(answer, "doc_type", F.col("m").cast("long"), F.concat(F.lit("see page "), F.col("page").cast("string"), F.lit(" here")))["clean"].alias("clean"))


_MATHS = Shared("part", no="p_partkey", kind="p_partkey % 3", n="p_size")


@query(f"SELECT no, CASE kind WHEN 0 THEN 'gap ' || n || 'µm at Nm' WHEN 1 THEN 'costs $' || n || ' and $10 now' ELSE 'turn ' || n || '° or ± ' || n END AS text FROM ({_MATHS.sql})")
def plain_mathematics(t: Tables) -> DataFrame:
    """Inline mathematics as plain text; money amounts stay."""
    n = F.col("n").cast("string")
    text = F.when(F.col("kind") == 0, F.concat(F.lit("gap $"), n, F.lit(r"\,\mu m$ at $\text{Nm}$"))).when(F.col("kind") == 1, F.concat(F.lit("costs $"), n, F.lit(" and $10 now"))).otherwise(F.concat(F.lit("turn $"), n, F.lit(r"^{\circ}$ or $\pm "), n, F.lit("$")))
    return _MATHS.of(t).select("no", G.mathematics(text).alias("text"))


_REPLIES = Shared("events", no="event_id", reply="CASE event_id % 3 WHEN 0 THEN 'Here it is: {\"a\": ' || user_id || ', \"b\": \"' || event_type || '\"} ok' WHEN 1 THEN '{\"a\": ' || user_id || '}' ELSE event_type END")


@query("SELECT event_id AS no, CASE WHEN event_id % 3 < 2 THEN 'a' || user_id || coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, '-') ELSE 'a-' END AS parsed FROM events")
def model_replies(t: Tables) -> DataFrame:
    """The JSON objects in models' replies."""
    j = P.model_json("reply", "a long, b string")
    return _REPLIES.of(t).select("no", F.concat(F.lit("a"), F.coalesce(j["a"].cast("string"), F.lit("")), F.coalesce(j["b"], F.lit("-"))).alias("parsed"))


@query("""SELECT event_id AS no, 'event_type=' || event_type || ';' || CASE WHEN user_id % 5 <> 0 THEN 'k=' || user_id % 5 || ';' ELSE '' END || 'rerank_fired=' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ';' AS entry FROM events""")
def trace_entries(t: Tables) -> DataFrame:
    """Log entries of retrieval traces without empty and reserved names."""
    pairs = {"event_type": F.col("event_type"), "k": (F.col("user_id") % 5).cast("string"), "note": F.lit(""), "rerank_fired": (F.col("event_id") % 2 == 0).cast("string"), "type": F.lit("x")}
    trace = F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v)))
    kept = F.array_sort(F.map_entries(P.trace_entry(trace, ["type"])))
    return t.events.select(F.col("event_id").alias("no"), F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit(";"))), "").alias("entry"))


_CHUNKS = Shared(
    "part", chunk_id="p_partkey", doc_id="p_brand", tags="CASE p_partkey % 5 WHEN 0 THEN array('procedure', 'WSP') WHEN 1 THEN array('overview') WHEN 2 THEN array('fsds') WHEN 3 THEN array('testing', 'general information') END",
    section="CASE p_partkey % 4 WHEN 0 THEN 'List of Abbreviations' WHEN 1 THEN 'The ' || p_name ELSE p_type END", maker="CASE p_partkey % 3 WHEN 0 THEN 'SKF' WHEN 1 THEN 'NEI' ELSE '' END",
    coaches="CASE p_size % 4 WHEN 0 THEN array('LHB') WHEN 1 THEN array('common') WHEN 2 THEN array('ICF', 'EMU') END", subsystem="CASE p_size % 5 WHEN 0 THEN 'Wheel Slide' WHEN 1 THEN 'fire detection' ELSE 'doors' END",
    issue_date="CASE WHEN p_partkey % 7 = 0 THEN '' ELSE (2001 + p_partkey % 30) || '-05' END", doc_type="CASE p_partkey % 4 WHEN 0 THEN 'circular' WHEN 1 THEN 'correction_slip' ELSE 'report' END", superseded="p_size % 6 = 0",
)
_ARRAYS = _CHUNKS.sql.replace("array('", "list_value('")
_SYSTEM = "CASE WHEN contains(lower(subsystem), 'wheel slide') OR contains(lower(subsystem), 'wsp') THEN 'WSP' WHEN contains(lower(subsystem), 'fire') THEN 'FSDS' WHEN list_contains(tags, 'WSP') THEN 'WSP' WHEN list_contains(tags, 'fsds') THEN 'FSDS' END"


@query(f"SELECT chunk_id, {_SYSTEM} AS system FROM ({_ARRAYS})")
def chunk_systems(t: Tables) -> DataFrame:
    """The system of each chunk by its subsystem, else by its tags."""
    return _CHUNKS.of(t).select("chunk_id", scoring.system_of("subsystem", "tags").alias("system"))


_ASKED = Shared(
    "nation", query_id="n_nationkey", procedural="n_nationkey % 2 = 0", asked_maker="CASE n_nationkey % 3 WHEN 0 THEN 'SKF' END", asked_coach="CASE n_nationkey % 4 WHEN 0 THEN 'LHB' WHEN 1 THEN 'ICF' END",
    asked_system="CASE n_nationkey % 5 WHEN 0 THEN 'WSP' WHEN 1 THEN 'FSDS' END",
)
_FACTORS = """CASE WHEN procedural THEN (CASE WHEN list_has_any(coalesce(tags, []), ['procedure', 'testing']) THEN 1.3 ELSE 1.0 END)::DOUBLE * (CASE WHEN list_has_any(coalesce(tags, []), ['overview', 'general information']) THEN 0.5 ELSE 1.0 END)::DOUBLE ELSE 1.0 END
    * {section} * (CASE WHEN coalesce(asked_maker, '') = '' THEN 1.0 WHEN maker = asked_maker THEN 1.8 WHEN maker <> '' THEN 0.3 ELSE 1.0 END)::DOUBLE
    * (CASE WHEN coalesce(asked_coach, '') = '' THEN 1.0 WHEN list_contains(coalesce(coaches, []), asked_coach) THEN 1.5 WHEN len(coalesce(coaches, [])) > 0 AND NOT list_contains(coaches, 'common') THEN 0.4 ELSE 1.0 END)::DOUBLE
    * (CASE WHEN asked_system IS NOT NULL AND system <> asked_system THEN 0.3 ELSE 1.0 END)::DOUBLE
    * (CASE WHEN issue_date = '' THEN 1.0 ELSE 1.0 + greatest(0, least(CAST(issue_date[1:4] AS INTEGER) - 2010, 20)) * 0.004::DOUBLE + (CASE WHEN doc_type IN ('circular', 'correction_slip') THEN 0.03 ELSE 0.0 END)::DOUBLE END)
    * (CASE WHEN superseded THEN 0.85 ELSE 1.0 END)::DOUBLE"""
_PAIRED = f"""p AS (SELECT c.*, {_SYSTEM} AS system, q.*, c.chunk_id % 7 AS hits, 9 AS terms, (q.query_id * 31 + c.chunk_id * 17) % 100 / 100.0::DOUBLE AS sim, ['the', 'hot', 'widget', 'economy'] AS words FROM ({_ARRAYS}) c, ({_ASKED.sql}) q WHERE c.chunk_id % 25 = q.query_id),
    m AS (SELECT *, max(sim) OVER (PARTITION BY query_id) AS top FROM p)"""
_SECTION = "(CASE WHEN contains(lower(section), 'abbreviation') THEN 0.4 ELSE 1.0 END)::DOUBLE * (1.0 + 0.15::DOUBLE * len(list_intersect(list_distinct(regexp_extract_all(lower(section), '[a-z]{3,}')), words)))"


def _paired(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates (each question asks for every 25th chunk), features and signals."""
    chunks = _CHUNKS.of(t)
    features = chunks.withColumn("system", scoring.system_of("subsystem", "tags")).drop("subsystem")
    signals = _ASKED.of(t).withColumn("query_words", F.array(*map(F.lit, ("the", "hot", "widget", "economy"))))
    asked = chunks.select((F.col("chunk_id") % 25).cast("long").alias("query_id"), "chunk_id", (F.col("chunk_id") % 7).alias("hits"), F.lit(9).alias("terms"))
    return asked, features, signals


@query(f"""WITH {_PAIRED} SELECT CAST(query_id AS BIGINT) AS query_id, chunk_id, round(({fixed.SEMANTIC_WEIGHT}::DOUBLE * (sim / greatest(top, 0.01)) + {fixed.KEYWORD_WEIGHT}::DOUBLE * (hits / 9.0::DOUBLE)) * {_FACTORS.format(section=_SECTION)}, 9) AS score FROM m""")
def all_factors(t: Tables) -> DataFrame:
    """Scores of both arms' candidates with every factor in play."""
    asked, features, signals = _paired(t)
    arm = asked.withColumn("similarity", (F.col("query_id") * 31 + F.col("chunk_id") * 17) % 100 / F.lit(100.0)).select("query_id", "chunk_id", "similarity")
    fused = R.fused(arm, asked)
    return R.hybrid_scores(fused, features, signals).select("query_id", "chunk_id", "score")


@query(f"WITH {_PAIRED} SELECT CAST(query_id AS BIGINT) AS query_id, chunk_id, round(hits / 9.0::DOUBLE * {_FACTORS.format(section='1.0')}, 9) AS score FROM m")
def keyword_factors(t: Tables) -> DataFrame:
    """Scores without vectors, with every factor that they have."""
    return R.keyword_scores(*_paired(t)).select("query_id", "chunk_id", "score")


_RANKED = Shared(
    "orders", query_id="o_custkey", rank="o_orderkey", doc_id="o_orderkey % 5", title="CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'Manual [' || o_orderkey % 6 || ']' END", section="CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Part ' || o_orderstatus END",
    section_num="CASE WHEN o_orderkey % 2 = 0 THEN '5.' || o_orderkey % 3 ELSE '' END", page_num="CAST(o_orderkey % 9 AS INT)", printed_page="CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 4 AS STRING) ELSE '' END", issue_date="CASE WHEN o_orderkey % 3 = 0 THEN '2024-05' ELSE '' END",
    letter_no="CASE WHEN o_orderkey % 5 < 2 THEN 'L/' || o_orderkey % 7 ELSE '' END", download_url="CASE WHEN o_orderkey % 2 = 0 THEN 'https://x.example/a.pdf' ELSE '' END",
)


@query(f"""WITH r AS (SELECT *, coalesce(title, CAST(doc_id AS STRING)) AS name FROM ({_RANKED.sql})),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id, name, section_num, section ORDER BY rank) AS n FROM r),
    c AS (SELECT *, CASE WHEN letter_no <> '' AND issue_date <> '' THEN letter_no || ', dt. 05.2024' WHEN letter_no <> '' THEN letter_no WHEN issue_date <> '' THEN 'dt. 05.2024' ELSE '' END AS ref,
        CASE WHEN printed_page <> '' AND printed_page <> CAST(page_num AS STRING) THEN 'p.' || printed_page || ' (PDF p.' || page_num || ')' WHEN page_num <> 0 THEN 'p.' || page_num ELSE '' END AS label, trim(CASE WHEN section_num <> '' THEN 'Clause ' || section_num ELSE '' END || ' ' || section) AS place FROM f WHERE n = 1),
    l AS (SELECT query_id, rank, '- ' || CASE WHEN download_url = '' THEN '**' || name || '**' ELSE '[**' || translate(name, '[]', '()') || '**](' || download_url || '#page=' || page_num || ')' END
        || CASE WHEN place <> '' THEN ' → ' || place ELSE '' END || CASE WHEN label <> '' THEN ' (' || label || ')' ELSE '' END || CASE WHEN ref <> '' THEN ' — ' || ref ELSE '' END AS line FROM c)
    SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS sources FROM l GROUP BY query_id""")
def citation_lists(t: Tables) -> DataFrame:
    """Citations of each question as a markdown list."""
    return A.citation_markdown(_RANKED.of(t)).select("query_id", "sources")


_TOLD = Shared("events", message_id="'m' || event_id", request_id="CASE WHEN event_id % 2 = 0 THEN 'req' || event_id % 400 || '-tail' ELSE '' END", rating="CASE WHEN event_type = 'error' THEN 'down' ELSE event_type END", question="CASE WHEN user_id % 7 = 0 THEN ' ' ELSE ' why ' || event_id || ' ' END", sources="''", timestamp="''", reasons="''", correction="''", note="''", provider="''")


@query(f"""WITH d AS (SELECT 'fb-' || left(CASE WHEN request_id <> '' THEN request_id ELSE message_id END, 10) AS id, trim(question) AS question FROM ({_TOLD.sql}) WHERE rating = 'down' AND trim(question) <> '')
    SELECT id, min(question) AS question FROM d WHERE id NOT IN (SELECT DISTINCT 'fb-m' || event_id FROM events WHERE event_id % 3 = 0) GROUP BY id""")
def unseen_drafts(t: Tables) -> DataFrame:
    """Drafts of cases from feedback, without those that are known."""
    seen = t.events.where("event_id % 3 = 0").select(F.concat(F.lit("fb-m"), F.col("event_id").cast("string")).alias("id"))
    return E.draft_cases(_TOLD.of(t), seen).select("id", "question")


_AREAS = (("doors-and-ramps", "Doors and Ramps", ("door handle",)), ("tools", "Cold & Hot Tools of the Widget", ("gear", "rod")), ("plates", "Plates", ("large plate", "bolt")))


@query(f"""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '\\b(doors and ramps|doors|ramps|door|handle)\\b') THEN 'doors-and-ramps' WHEN regexp_matches(lower(p_name), '\\b(tools|cold|hot|widget|gear|rod)\\b') THEN 'tools' WHEN regexp_matches(lower(p_name), '\\b(plates|large|plate|bolt)\\b') THEN 'plates' END AS area FROM part""")
def question_areas(t: Tables) -> DataFrame:
    """The first area that a question names, by the words of the areas' names and parts."""
    return t.part.select("p_partkey", I.asked_area("p_name", I.area_words(_AREAS)).alias("area"))


_MIXED = Shared("events", no="event_id", question="CASE event_id % 5 WHEN 0 THEN 'Pump  kaise kare ' || event_type WHEN 1 THEN 'display aa raha hai?' WHEN 2 THEN 'valve band hai, kya kare' WHEN 3 THEN 'MCB kaam nahi kar raha' ELSE event_type END")
_MIXED_WORDS = (("band", "stuck closed"), ("hai", ""), ("pump", "compressor"))


@query("""SELECT event_id AS no, CASE event_id % 5 WHEN 0 THEN 'pump how to procedure steps ' || event_type || ' compressor' WHEN 1 THEN 'display aa raha hai?' WHEN 2 THEN 'valve band hai, what to do procedure stuck closed' WHEN 3 THEN 'mcb not working failure' ELSE event_type END AS enriched FROM events"""
       .replace("'display aa raha hai?'", "'display showing displaying?'"))
def mixed_questions(t: Tables) -> DataFrame:
    """Code-mixed questions in English, with the meanings of their known words behind them."""
    words = t.events.sparkSession.createDataFrame(list(_MIXED_WORDS), "term string, expansion string")
    return I.enriched(_MIXED.of(t), words, "no", "question").select(F.col("query_id").alias("no"), "enriched")


_CASES = Shared("orders", case_id="o_orderkey", gold=f"'5' || {_N} || ' kg'", wrong=f"'7' || {_M} || ' bar'", context=f"'at 5' || {_M} || ' KG ' || repeat('x', CAST(o_custkey % 30 AS INT))", expect_absent="o_orderkey % 4 = 0", best_rank="CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 END")


@query(f"""WITH c AS (SELECT *, contains(lower(replace(context, ' ', '')), replace(gold, ' ', '')) AS got, length(context) AS chars FROM ({_CASES.sql}))
    SELECT count(*) AS cases, round(count(*) FILTER (NOT expect_absent AND best_rank IS NOT NULL) / CAST(count(*) FILTER (NOT expect_absent) AS DOUBLE), 6) AS recall, round(sum(CASE WHEN NOT expect_absent THEN 1.0::DOUBLE / best_rank END) / count(*) FILTER (NOT expect_absent), 6) AS mrr,
        round(count(*) FILTER (NOT expect_absent AND got) / CAST(count(*) FILTER (NOT expect_absent) AS DOUBLE), 6) AS value_retrieved, round(count(*) FILTER (NOT expect_absent AND got) / CAST(nullif(count(*) FILTER (NOT expect_absent AND got), 0) AS DOUBLE), 6) AS guard,
        1.0::DOUBLE AS absence, round(avg(chars), 6) AS ctx_chars_mean FROM c""")
def evaluation_metrics(t: Tables) -> DataFrame:
    """All figures of an evaluation over cases with gold values and absence cases."""
    return E.all_metrics(_CASES.of(t))




_FILES = Shared("orders", o_orderkey="o_orderkey", name="CASE o_orderkey % 5 WHEN 0 THEN 'VB_SMI_B_' || o_custkey % 90 || '.pdf' WHEN 1 THEN 'CAI a-2024-' || (o_custkey % 12 + 1) || ' Door.pdf' WHEN 2 THEN 'Report on bearing guidelines.pdf' WHEN 3 THEN 'No. letter.pdf' ELSE 'wheel marking.pdf' END")
_SUBSYSTEMS = (("bearings", r"\bbearing"), ("wheels", r"\bwheel"), ("doors", r"\bdoor\b"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'VB/SMI/B/' || lpad(CAST(o_custkey % 90 AS STRING), 2, '0') WHEN 1 THEN 'CAI A-2024/' || lpad(CAST(o_custkey % 12 + 1 AS STRING), 2, '0') ELSE '' END AS letter_no,
    CASE o_orderkey % 5 WHEN 0 THEN 'special_maintenance_instruction' WHEN 1 THEN 'coach_alteration_instruction' WHEN 2 THEN 'report' ELSE 'circular' END AS doc_type, CASE o_orderkey % 5 WHEN 1 THEN 'doors' WHEN 2 THEN 'bearings' WHEN 4 THEN 'wheels' ELSE 'REVIEW' END AS subsystem FROM orders""")
def register_drafts(t: Tables) -> DataFrame:
    """Letter number, type and subsystem that a file's name gives."""
    name = F.col("name")
    return _FILES.of(t).select("o_orderkey", X.letter_of_filename(name).alias("letter_no"), X.classified(name, X.DOC_TYPES, "circular").alias("doc_type"), X.classified(name, _SUBSYSTEMS, "REVIEW").alias("subsystem"))


_HEADS = Shared("part", p_partkey="p_partkey", head="CASE p_partkey % 5 WHEN 0 THEN 'No. MC/WA/' || p_size || chr(10) || 'Dated: ' || (p_size % 28 + 1) || '.7.2024' || chr(10) || 'Sub: Refurbish  the *' || p_name || '* .' WHEN 1 THEN 'VB / SMI / B / ' || p_size || ' x Date - 31/12/1999' WHEN 2 THEN 'No: ABC/12/' || p_size || '-X. text' WHEN 3 THEN 'letter dated 17.07.2025' ELSE p_name END")


@query(f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '2024-07-' || lpad(CAST(p_size % 28 + 1 AS STRING), 2, '0') ELSE '' END AS issue_date,
    CASE p_partkey % 5 WHEN 0 THEN 'MC/WA/' || p_size WHEN 1 THEN 'VB / SMI / B / ' || p_size WHEN 2 THEN 'ABC/12/' || p_size || '-X' ELSE '' END AS letter_no,
    CASE WHEN p_partkey % 5 = 0 THEN 'Refurbish the ' || p_name ELSE 'file name' END AS title FROM ({_HEADS.sql.replace('SELECT', 'SELECT p_size, p_name,', 1)})""")
def letterheads(t: Tables) -> DataFrame:
    """Date, letter number and title that a first page gives."""
    return _HEADS.of(t).select("p_partkey", X.letterhead_date("head").alias("issue_date"), X.letter_of_text("head").alias("letter_no"), X.title_of_text("head", F.lit("file name")).alias("title"))


_CANARY = Shared("part", p_partkey="p_partkey", system="CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END", text="p_name")


@query("SELECT 'A' AS system, 'gears' AS canary, count(*) FILTER (p_partkey % 2 = 0 AND contains(p_name, 'gear'))::STRING AS matches FROM part UNION ALL SELECT 'C', 'rods', NULL")
def active_canaries(t: Tables) -> DataFrame:
    """Canaries of the systems that the corpus has; those of others are inactive (null)."""
    wanted = (("A", "gears", "gear"), ("C", "rods", "rod"))
    return Q.system_canaries(_CANARY.of(t), "system", "text", wanted).withColumn("matches", F.col("matches").cast("string"))


_OCR = Shared("lineitem", doc="l_suppkey", page="l_orderkey * 10 + l_linenumber", native="CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'native  ' || l_partkey END", ocr="CASE WHEN l_partkey % 4 = 0 THEN 'Subject: read ' || l_partkey WHEN l_partkey % 4 = 1 THEN '' END", title="'Registered'")


@query(f"""SELECT doc, page, text, CASE WHEN text LIKE 'Subject:%' THEN trim(text[9:]) ELSE 'Registered' END AS section, count(*) AS n FROM (SELECT doc, page, CASE WHEN coalesce(ocr, '') <> '' THEN ocr ELSE replace(native, '  ', ' ') END AS text FROM ({_OCR.sql})) WHERE text <> '' GROUP BY doc, page, text""")
def read_pages(t: Tables) -> DataFrame:
    """Documents whose native text isn't to be trusted: a section per page from what was read."""
    from folioscan.operators import layout as L

    pages = L.read_sections(_OCR.of(t), "native", "ocr", "title", "page").select("doc", "page", "text", "section")
    return pages.groupBy("doc", "page", "text", "section").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT l_orderkey AS doc, count(DISTINCT l_linenumber) FILTER (l_returnflag = 'R') AS sections, count(DISTINCT l_partkey) AS pages FROM lineitem GROUP BY l_orderkey)
    SELECT doc FROM s WHERE sections < 3 AND pages >= 4""")
def heading_failures(t: Tables) -> DataFrame:
    """Documents that get a section per page because hardly a heading was found."""
    from folioscan.operators import layout as L

    sections = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("section_no"))
    return L.per_page(sections, t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("page")), "doc")


_PATHS = Shared("part", p_partkey="p_partkey", path="'Man uals' || chr(92) || p_type || '/' || p_name || ' ' || p_brand || '.pdf'")


@query("SELECT p_partkey, 'https://store.example/Man%20uals/' || p_type || '/' || replace(p_name, ' ', '%20') || '%20' || replace(p_brand, '#', '%23') || '.pdf' AS url FROM part")
def download_urls(t: Tables) -> DataFrame:
    """Addresses of all parts' documents."""
    return _PATHS.of(t).select("p_partkey", X.download_url("https://store.example", "path").alias("url"))


_SENT = Shared(
    "events", message_id="'m' || event_id", request_id="CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'r' || event_id END", rating="CASE event_id % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE event_type END", reasons="CASE WHEN event_id % 4 = 0 THEN NULL ELSE array(event_type, repeat('x', 50), 'c', 'd', 'e', 'f', 'g', 'h', 'i') END",
    sources="array('Book p.' || event_id, repeat(event_type, 40))", note="repeat('n', CAST(event_id % 1500 AS INT))", correction="CASE WHEN event_id % 2 = 0 THEN event_type END", question="'why ' || event_id", answer="CASE WHEN event_id % 5 = 0 THEN '' ELSE repeat('a', CAST(event_id % 5000 AS INT)) END", answer_preview="'short'", provider="event_type",
)


@query(f"""SELECT coalesce(request_id, '') AS request_id, message_id, CASE WHEN rating IN ('up', 'down') THEN rating ELSE 'unknown' END AS rating, array_to_string(list_transform(coalesce(reasons, [])[1:8], lambda x: left(x, 40)), ', ') AS reasons, left(note, 1000) AS note,
    coalesce(correction, '') AS correction, question, provider, left(CASE WHEN answer = '' THEN answer_preview ELSE answer END, 4000) AS answer, array_to_string(list_transform(sources, lambda x: left(x, 120)), '; ') AS sources FROM ({_SENT.sql.replace("array(", "list_value(")})""")
def webhook_rows(t: Tables) -> DataFrame:
    """Feedback as the rows that a sheet gets."""
    from folioscan.sources import tables as S

    return S.webhook_rows(_SENT.of(t))


@query("SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '[0-9]')")
def value_chunks(t: Tables) -> DataFrame:
    """Chunks that cases about values can be drawn from."""
    return t.documents.where(X.value_bearing("text")).select("doc_id")


@query("SELECT source, count(DISTINCT lang) AS sections FROM documents GROUP BY source HAVING count(DISTINCT lang) < 5")
def thin_documents(t: Tables) -> DataFrame:
    """Sources with few languages, as documents with few sections."""
    return Q.thin_documents(t.documents, "source", "lang", 5)


_RECORDS = Shared("documents", doc_id="doc_id", source="CASE WHEN doc_id % 50 = 7 THEN NULL ELSE source END", n_chars="n_chars + CASE WHEN doc_id % 60 = 8 THEN 1 ELSE 0 END", text="CASE WHEN doc_id % 70 = 9 THEN text || '\uf0b7' WHEN doc_id % 80 = 10 THEN '' ELSE text END", tags="CASE WHEN doc_id % 90 = 11 THEN NULL ELSE lang END")


@query(f"""WITH r AS ({_RECORDS.sql}) SELECT * FROM (SELECT 'required' AS rule, count(*) FILTER (doc_id IS NULL OR source IS NULL OR text IS NULL) AS broken FROM r UNION ALL SELECT 'not_empty', count(*) FILTER (coalesce(text, '') = '') FROM r UNION ALL SELECT 'size', count(*) FILTER (coalesce(length(text), 4001) > 4000) FROM r
    UNION ALL SELECT 'counted', count(*) FILTER (n_chars IS DISTINCT FROM length(text) OR text IS NULL) FROM r UNION ALL SELECT 'glyphs', count(*) FILTER (text IS NULL OR regexp_matches(text, '[\\x{{E000}}-\\x{{F8FF}}]')) FROM r UNION ALL SELECT 'tags', count(*) FILTER (tags IS NULL) FROM r
    UNION ALL SELECT 'unique_key', (SELECT count(*) FROM (SELECT doc_id FROM r GROUP BY doc_id HAVING count(*) > 1)))""")
def record_rules(t: Tables) -> DataFrame:
    """How many documents break each rule of a knowledge base: keys, sizes, counts, glyphs, lists."""
    text = F.col("text")
    rules_ = {
        "required": F.col("doc_id").isNotNull() & F.col("source").isNotNull() & text.isNotNull(), "not_empty": text != "", "size": F.char_length(text) <= 4000, "counted": F.col("n_chars") == F.char_length(text),
        "glyphs": ~text.rlike("[\\x{E000}-\\x{F8FF}]"), "tags": F.col("tags").isNotNull(),
    }
    return Q.validation(_RECORDS.of(t), rules_, "doc_id")

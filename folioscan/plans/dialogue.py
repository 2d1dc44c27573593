"""Dialogue queries: conversations as chats, their texts as questions and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import fixed
from folioscan.functions import text as X
from folioscan.operators import evaluate as E
from folioscan.operators import guards as G
from folioscan.operators import intent as I
from folioscan.plans.base import Tables, query

_WEAK = "[" + ", ".join(f"'{w}'" for w in fixed.WEAK_MARKERS) + "]"
_STRONG = "[" + ", ".join(f"'{w}'" for w in fixed.STRONG_MARKERS) + "]"
_SIGNALS = " OR ".join(f"contains(lower(text), '{s}')" for s in fixed.PROCEDURAL_SIGNALS)


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant') AND trim(text, ' ') <> '')
    SELECT conv_id, turn, role, CAST(back AS INTEGER) AS back FROM s WHERE back <= 4""")
def recent_history(t: Tables) -> DataFrame:
    """The last two pairs of spoken turns of each conversation."""
    return I.recent_history(t.conversations, pairs=2).select("conv_id", "turn", "role", "back")


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 'Please tell me the coach type' ELSE text END AS text, role FROM conversations),
    w AS (SELECT *, lag(role) OVER o = 'assistant' AND contains(lower(lag(text) OVER o), 'please tell me the') AS fold,
                 last_value(CASE WHEN role = 'user' AND trim(text, ' ') <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
          FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, CASE WHEN coalesce(fold, false) AND prior IS NOT NULL THEN prior || ' ' || text ELSE text END AS retrieval_query FROM w WHERE role = 'user'""")
def refold_query(t: Tables) -> DataFrame:
    """User turns behind a clarifying prompt get the question before it; every other answer is made one."""
    asked = (F.col("role") == "assistant") & (F.col("turn") % 4 == 1)
    return I.refolded(t.conversations.withColumn("text", F.when(asked, "Please tell me the coach type").otherwise(F.col("text"))))


@query("""SELECT conv_id, substr(trim(regexp_replace(arg_min(text, turn), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' '), 1, 60) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id""".replace("\\\\", "\\"))
def thread_title(t: Tables) -> DataFrame:
    """The beginning of each conversation's first question."""
    first = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", X.thread_title("text").alias("title"))


@query("""WITH w AS (SELECT *, lead(role) OVER o AS next_role, lead(n) OVER o AS next_n FROM (SELECT *, length(text) AS n FROM conversations) WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn FROM w WHERE NOT (role = 'assistant' AND n < 400) AND NOT (role = 'user' AND next_role = 'assistant' AND next_n < 400) OR (role = 'user' AND next_role IS NULL)""")
def retry_filter(t: Tables) -> DataFrame:
    """Turns without failed answers (here: short ones) and the questions before them."""
    return I.retried(t.conversations, F.char_length("text") < 400).select("conv_id", "turn")


@query(f"""WITH w AS (SELECT conv_id, turn, list_distinct(string_split(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' ')), ' ')) AS ws FROM conversations)
    SELECT conv_id, turn, CASE WHEN len(list_intersect(ws, {_STRONG})) > 0 OR len(list_intersect(ws, {_WEAK})) >= 2 THEN 'hi' ELSE 'en' END AS lang FROM w""")
def language_detect(t: Tables) -> DataFrame:
    """The reply language of every turn, by marker words."""
    return t.conversations.select("conv_id", "turn", X.question_language("text").alias("lang"))


@query(f"SELECT conv_id, turn, ({_SIGNALS}) AS procedural, CAST(CASE WHEN regexp_matches(lower(text), 'list all|complete list') THEN 20 ELSE 8 END AS INTEGER) AS k FROM conversations WHERE text IS NOT NULL")
def intent_signals(t: Tables) -> DataFrame:
    """Whether a turn asks for a procedure, and how many rows it gets."""
    rows = t.conversations.where("text is not null").withColumn("id", F.struct("conv_id", "turn"))
    return I.signals(rows, "id", "text").select("query_id.conv_id", "query_id.turn", "procedural", "k")


def _detected(part: DataFrame) -> DataFrame:
    """Detectors over a question generated for each part."""
    k = F.col("p_partkey")
    pick = lambda n, *words: F.element_at(F.array(*map(F.lit, words)), (k % n + 1).cast("int"))
    text = F.concat_ws(" ", pick(3, "Smoke alarm", "dump valve test", "door"), pick(4, "on LHB", "in vande  bharat", "now", "again"), pick(5, "by Knorr", "x", "y", "z", "w"), pick(2, "how many circulars", "how many bolts"))
    rows = part.withColumn("q", text)
    return rows.select("p_partkey", I.asked_system("q").alias("system"), I.asked_coach("q").alias("coach"), I.asked_maker("q").alias("maker"), I.asked_doc_type("q").alias("doc_type"), I.is_corpus_count("q").alias("counting"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 <> 0 THEN 'FSDS' WHEN p_partkey % 3 = 1 OR p_partkey % 3 = 2 AND p_partkey % 5 = 0 THEN 'WSP' END AS system, CASE p_partkey % 4 WHEN 0 THEN 'LHB' WHEN 1 THEN 'Vande Bharat' END AS coach,
    CASE p_partkey % 5 WHEN 0 THEN 'KNORR BREMSE' END AS maker, CASE p_partkey % 2 WHEN 0 THEN 'circular' END AS doc_type, p_partkey % 2 = 0 AS counting FROM part""")
def detectors_all(t: Tables) -> DataFrame:
    """The same of all questions: Knorr is a sign of wheel slide too, and with one of fire there is no system."""
    return _detected(t.part)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'LHB brakes' WHEN p_partkey % 4 = 1 THEN 'brakes' WHEN p_partkey % 4 = 2 THEN 'brakes of ICF' ELSE 'brakes' END AS scoped FROM part""")
def scoped_question(t: Tables) -> DataFrame:
    """The chosen coach before questions that name none."""
    k = F.col("p_partkey") % 4
    coach = F.when(k == 0, "LHB").when(k == 1, "all").when(k == 2, "LHB").otherwise("unknown")
    return t.part.select("p_partkey", I.scoped_question(F.when(k == 2, "brakes of ICF").otherwise("brakes"), coach).alias("scoped"))


@query("""WITH m AS (SELECT min(string_split(lower(p_name), ' ')[1]) AS m FROM part), w AS (SELECT p_partkey, list_filter(string_split(lower(p_name), ' '), lambda x: x <> '') AS ws, m FROM part, m)
    SELECT p_partkey, array_to_string(ws, ' ') || repeat(' expanded words', len(ws) - len(list_filter(ws, lambda x: x <> m))) AS expanded FROM w""")
def expanded_questions(t: Tables) -> DataFrame:
    """Names as questions; the first word of all is the one that the lexicon knows."""
    lexicon = t.part.agg(F.min(F.split(F.lower("p_name"), " ")[0]).alias("term")).withColumn("expansion", F.lit("expanded words"))
    return I.expand(t.part, lexicon, "p_partkey", "p_name").withColumnRenamed("query_id", "p_partkey")


@query("SELECT o_orderkey, (o_orderkey % 7) || ',' || ((o_orderkey + 3) % 7) AS places FROM orders")
def order_parse(t: Tables) -> DataFrame:
    """Orders of a reranker's reply: distinct members in range, in place."""
    k = F.col("o_orderkey").cast("int")
    reply = F.concat(F.lit("best first: ["), (k % 7).cast("string"), F.lit(", 99, "), (k % 7).cast("string"), F.lit(", "), ((k + 3) % 7).cast("string"), F.lit("] done [1]"))
    return t.orders.select("o_orderkey", F.array_join(X.index_order(reply, 8), ",").alias("places"))


@query("""SELECT event_id, 'fb-' || substr(CAST(event_id + 100000 AS VARCHAR), 1, 10) AS id, 'FEEDBACK ' || CASE event_type WHEN 'error' THEN 'down' ELSE 'up' END || ' ' || strftime(ts, '%Y-%m-%d') || ' | reasons: ' || event_type || ' | retrieved: doc' || user_id || ' p.4; other p.1 | CANDIDATE — set expect_doc/expect_page/gold_value from the manual.' AS notes,
    CASE event_type WHEN 'error' THEN NULL ELSE 'doc' || user_id END AS expect_doc FROM events WHERE event_type IN ('error', 'purchase')""")
def feedback_draft(t: Tables) -> DataFrame:
    """Errors and purchases as thumbs down and up, drafted as evaluation cases."""
    kind = F.when(F.col("event_type") == "error", "down").when(F.col("event_type") == "purchase", "up").otherwise("none")
    rows = t.events.select(
        (F.col("event_id") + 100_000).cast("string").alias("request_id"), F.lit("").alias("message_id"), kind.alias("rating"), F.date_format("ts", "yyyy-MM-dd").alias("timestamp"), F.col("event_type").alias("reasons"),
        F.lit("").alias("correction"), F.lit(" ").alias("note"), F.lit(None).cast("string").alias("provider"), F.lit("why?").alias("question"), F.concat(F.lit("doc"), F.col("user_id").cast("string"), F.lit(" p.4; other p.1")).alias("sources"),
    )
    drafts = E.draft_cases(rows, also_up=True)
    return drafts.select((F.substring("id", 4, 10).cast("long") - 100_000).alias("event_id"), "id", "notes", "expect_doc")


@query("""SELECT p_partkey, p_size || '.' || p_partkey % 10 || 'nm' AS squeezed, 'ft' || (p_partkey + 1000) || substr(CAST(p_size + 100 AS VARCHAR), 2) AS part, p_size % 3 <> 0 OR p_partkey % 10 = p_size % 10 AS present FROM part""")
def compact_values(t: Tables) -> DataFrame:
    """Every part's size as a value and its key as a designation, without spacing, signs and separators; whether a text has the value."""
    digit, size = F.col("p_partkey") % 10, F.col("p_size")
    value = F.concat(F.lit("\u00b1 "), size, F.lit(","), digit, F.lit(" Nm"))
    name = F.concat(F.lit("FT"), F.col("p_partkey") + 1000, F.lit("/"), F.substring((size + 100).cast("string"), 2, 2))
    context = F.concat(F.lit("torque "), size, F.lit("."), F.when(size % 3 == 0, size % 10).otherwise(digit), F.lit(" NM"))
    return t.part.select("p_partkey", X.compact(value).alias("squeezed"), X.compact_designation(name).alias("part"), X.value_in_context(F.concat(size, F.lit("."), digit, F.lit(" Nm")), context).alias("present"))


@query()
def spoken_all(t: Tables) -> DataFrame:
    """All turns as they are read aloud, every second one as the direct answer of a reply with steps and sources."""
    reply = F.concat(F.lit("**Direct Answer:** Use `M8` bolts.\n**Step-by-step Action:**\n1. Lift\n- "), "text", F.lit("\n---\n[Source 1]"))
    return t.conversations.select("conv_id", "turn", X.spoken(F.when(F.col("turn") % 2 == 1, reply).otherwise(F.col("text"))).alias("spoken"))


def _answers(t: Tables) -> DataFrame:
    """Each assistant turn with made-up claims, and the turn before it as its context."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.conversations.withColumn("context", F.lag("text").over(own)).where("role = 'assistant'")
    claim = F.concat("text", F.lit(" Torque is 85 Nm, use FT-9999. There are no limits. We hold 12 manuals.\n**Reference:** 85 Nm"))
    return rows.withColumn("answer", claim).withColumn("context", F.concat("context", F.when(F.col("turn") % 2 == 1, " 85 NM").otherwise("")))


@query()
def guard_values(t: Tables) -> DataFrame:
    """Answers without the values that their context lacks."""
    return _answers(t).withColumn("g", G.values_guard("answer", "context")).select("conv_id", "turn", "g.clean", F.size("g.stripped").alias("stripped"))


@query()
def guard_claims(t: Tables) -> DataFrame:
    """Answers without unscoped claims of absence."""
    return _answers(t).withColumn("g", G.claims_guard("answer", F.col("turn") % 4 == 1)).select("conv_id", "turn", "g.clean", F.size("g.stripped").alias("stripped"))


@query()
def guard_counts(t: Tables) -> DataFrame:
    """Answers without numbers of manuals that the register doesn't give."""
    count = F.when(F.col("turn") % 4 == 1, 12).otherwise(3).cast("long")
    return _answers(t).withColumn("g", G.counts_guard("answer", F.lit("maintenance_manual"), count, "context")).select("conv_id", "turn", "g.clean", F.size("g.stripped").alias("stripped"))

"""Page geometry, excerpts, transcripts and table-level queries.

Lines of orders stand for words on a page (order as page, numbers as coordinates), return
flags for table strategies, events for recordings and log lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import rules
from folioscan.functions import text as X
from folioscan.operators import excerpts as P
from folioscan.operators import grids as B
from folioscan.operators import layout as L
from folioscan.operators import pages as H
from folioscan.operators import providers as V
from folioscan.operators import quality as Q
from folioscan.operators import retrieval as R
from folioscan.operators import tagging as G
from folioscan.operators import transcripts as N
from folioscan.plans.base import Shared, Tables, query
from folioscan.plans.retrieval import _TERMS, _top
from folioscan.sources import tables as S

_SKIPPED = "[" + ", ".join(f"'{w}'" for w in rules.SNIPPET_STOP_WORDS) + "]"
_FOLDED = "trim(regexp_replace({}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
_BOX = "l_orderkey AS page, l_linenumber AS n, l_quantity AS x0, l_tax * 100 AS y0, l_quantity + 4 AS x1, l_tax * 100 + 2 AS y1"


def _boxes(t: Tables) -> DataFrame:
    q, y = F.col("l_quantity").cast("double"), F.col("l_tax") * 100
    return t.lineitem.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), q.alias("x0"), y.alias("y0"), (q + 4).alias("x1"), (y + 2).alias("y1"), F.col("l_returnflag").alias("flag"))


@query("SELECT l_orderkey AS page, l_linenumber AS n, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY round(l_tax * 100, 1), l_quantity, l_linenumber) AS INTEGER) AS place FROM lineitem")
def reading_order_all(t: Tables) -> DataFrame:
    """Words of all pages in reading order; those at one spot by their numbers."""
    return L.reading_order(_boxes(t), "page", "x0", "y0", "n").select("page", "n", "place")


@query("""WITH s AS (SELECT l_suppkey AS doc, round(l_quantity * 2) / 2 AS s, sum(l_linenumber) AS n FROM lineitem GROUP BY 1, 2) SELECT doc, arg_max(s, (n, s)) AS body_size FROM s GROUP BY doc""")
def body_size(t: Tables) -> DataFrame:
    """The size that most characters have, per document."""
    return L.body_size(t.lineitem.withColumn("doc", F.col("l_suppkey")).withColumn("size", F.col("l_quantity").cast("double")), "doc", "size", "l_linenumber")


@query("""WITH s AS (SELECT l_suppkey AS page, l_returnflag AS strategy, sum(l_orderkey % 3) AS unnamed, sum(l_orderkey % 2) AS clipped, sum(l_linenumber % 2) AS swallowed, sum(l_linenumber) AS covered, count(*) AS columns FROM lineitem GROUP BY 1, 2)
    SELECT page, arg_min(strategy, (unnamed, clipped, swallowed, -covered, columns, strategy)) AS strategy FROM s GROUP BY page""")
def table_strategy(t: Tables) -> DataFrame:
    """The strategy whose tables lose the least, per page."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = t.lineitem.select(F.col("l_suppkey").alias("page"), F.col("l_returnflag").alias("strategy"), (k % 3).alias("unnamed"), (k % 2).alias("clipped"), (n % 2).alias("swallowed"), n.alias("covered"), F.lit(1).alias("columns"))
    return L.best_strategy(rows, "page")


@query(f"""WITH b AS (SELECT {_BOX} FROM lineitem WHERE l_returnflag <> 'R'), r AS (SELECT {_BOX} FROM lineitem WHERE l_returnflag = 'R')
    SELECT page, n FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.page = b.page AND (b.x0 + b.x1) / 2 BETWEEN r.x0 AND r.x1 AND (b.y0 + b.y1) / 2 BETWEEN r.y0 AND r.y1)""")
def outside_regions(t: Tables) -> DataFrame:
    """Boxes whose centre lies in none of their page's regions."""
    boxes = _boxes(t)
    return L.outside_regions(boxes.where("flag <> 'R'"), boxes.where("flag = 'R'"), "page").select("page", "n")


@query(f"""WITH c AS (SELECT {_BOX} FROM lineitem WHERE l_returnflag = 'R'), l AS (SELECT {_BOX}, l_returnflag = 'A' AS running FROM lineitem WHERE l_returnflag <> 'R'),
    j AS (SELECT c.page, c.n, c.x0, c.y0, (l.x0 + l.x1) / 2 BETWEEN c.x0 AND c.x1 AS within, running FROM c LEFT JOIN l ON l.page = c.page AND (l.y0 + l.y1) / 2 BETWEEN c.y0 AND c.y1)
    SELECT page, n, count(*) FILTER (within AND NOT running) AS covered, count(*) FILTER (NOT within AND NOT running) AS clipped, count(*) FILTER (within AND running) AS swallowed FROM j GROUP BY page, n, x0, y0""")
def table_measures(t: Tables) -> DataFrame:
    """Lines that each table covers, clips and swallows."""
    boxes = _boxes(t)
    lines = boxes.where("flag <> 'R'").withColumn("running", F.col("flag") == "A")
    return L.table_measures(boxes.where("flag = 'R'").select("page", "n", "x0", "y0", "x1", "y1"), lines, "page").select("page", "n", "covered", "clipped", "swallowed")


@query()
def page_sections(t: Tables) -> DataFrame:
    """Visible lines of every web page under the heading that stands before them."""
    from folioscan.operators.chunking import section_numbers

    return section_numbers(L.html_lines(t.pages), "page_id", F.col("heading"), "place").select("page_id", "place", "section_no", "section", "text")


@query("""WITH n AS (SELECT source, count(DISTINCT doc_id) AS n FROM documents WHERE doc_id < 40 GROUP BY source), l AS (SELECT source, doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents WHERE doc_id < 40)
    SELECT source, line FROM l JOIN n USING (source) WHERE line <> '' GROUP BY source, line, n HAVING count(DISTINCT doc_id) = n""".replace(" WHERE doc_id < 40", ""))
def lines_on_all_pages(t: Tables) -> DataFrame:
    """Lines that stand in every document of a source."""
    lines = t.documents.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return Q.lines_on_all_pages(lines, "source", "doc_id", "line")


@query("SELECT p_partkey, p_brand AS a, p_type AS b, 4 AS cells, 1 AS unnamed FROM part")
def table_cells(t: Tables) -> DataFrame:
    """Cells of rows, their labels and the placeholders among them."""
    row = F.concat(F.lit("|**"), "p_brand", F.lit("**||"), "p_type", F.lit("|Col4|"))
    cells = X.table_columns(row)
    return t.part.select("p_partkey", cells[0].alias("a"), cells[1].alias("b"), F.size(X.markdown_cells(row)).alias("cells"), X.unnamed_columns(row).alias("unnamed"))


@query()
def rule_tags(t: Tables) -> DataFrame:
    """Tags and maker of every document that has any."""
    maker = G.chunk_maker("text", F.lit("WSP"), F.lit(None).cast("string"))
    return t.documents.select("doc_id", F.array_join(G.tags("text", "source", F.lit("WSP"), maker), ",").alias("tags"), maker.alias("maker"))


@query(f"""WITH {_TERMS},
    r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank FROM h),
    w AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{3,}}')) AS ws FROM benchmark),
    x AS (SELECT r.query_id, chunk_id, len(list_filter(ws, lambda v: contains(lower(text), v))) AS hits, regexp_matches(text, '[0-9]+(\\.[0-9]+)?[ \\t\\n]*[A-Za-z%°/]') AS num FROM r JOIN documents d ON d.doc_id = chunk_id JOIN w ON w.query_id = r.query_id WHERE rank <= 8)
    SELECT query_id, chunk_id, CASE WHEN hits > 0 THEN hits + CASE WHEN num THEN 0.5 ELSE 0.0 END ELSE 0.0 END::DOUBLE AS relevance FROM x""")
def row_relevance(t: Tables) -> DataFrame:
    """How much each of a question's eight rows says about it."""
    top = _top(t, 8).select("query_id", "chunk_id")
    rows = top.join(t.documents.select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id").join(t.benchmark.select(F.col("item_id").alias("query_id"), R.words("text", 3).alias("terms")), "query_id")
    return rows.select("query_id", "chunk_id", P.row_relevance("text", "terms").alias("relevance"))


@query(f"""WITH {_TERMS},
    r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank FROM h),
    x AS (SELECT query_id, chunk_id, coalesce(d.text, '') AS text, list_filter(list_distinct(regexp_extract_all(lower(coalesce(b.text, '')), '[a-z0-9]{{3,}}')), lambda w: NOT list_contains({_SKIPPED}, w)) AS terms FROM r JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id WHERE rank <= 8),
    t1 AS (SELECT *, list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0B\\f]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')) AS ls FROM x),
    k AS (SELECT *, list_filter(list_transform(range(1, len(ls) + 1), lambda i: CASE WHEN NOT (regexp_matches(ls[i], '^\\|?[\\s|:-]*$') OR regexp_matches(ls[i], '^Table —.*:$') OR (starts_with(ls[i], '|') AND coalesce(ls[i + 1], '') <> '' AND regexp_matches(ls[i + 1], '^\\|?[\\s|:-]*$')))
        THEN trim(regexp_replace(replace(ls[i], '▸', ''), '\\s*(?:<br>|\\|)\\s*', ' ', 'g'), ' |') END), lambda s: coalesce(s, '') <> '') AS ks FROM t1),
    h2 AS (SELECT *, list_transform(ks, lambda s: len(list_filter(terms, lambda w: contains(lower(s), w)))) AS hs FROM k),
    o AS (SELECT *, list_sort(list_transform(range(1, len(ks) + 1), lambda i: {{'m': CASE WHEN hs[i] > 0 THEN -(hs[i] + CASE WHEN regexp_matches(ks[i], '[0-9]+(?:\\.[0-9]+)?\\s*[A-Za-z%°/]') THEN 0.5 ELSE 0 END) ELSE 0 END::DOUBLE, 'i': i, 'c': length(ks[i]) + 1}})) AS ord FROM h2),
    g AS (SELECT *, CASE WHEN len(ord) = 0 THEN '0|' ELSE list_reduce(list_transform(ord, lambda s: s.i || ':' || s.c), lambda a, s: CASE WHEN CAST(string_split(a, '|')[1] AS INT) = 0 OR (CAST(string_split(a, '|')[1] AS INT) < 320 AND CAST(string_split(a, '|')[1] AS INT) + CAST(string_split(s, ':')[2] AS INT) <= 320)
        THEN (CAST(string_split(a, '|')[1] AS INT) + CAST(string_split(s, ':')[2] AS INT)) || '|' || string_split(a, '|')[2] || string_split(s, ':')[1] || ',' ELSE a END, '0|') END AS state FROM o),
    c AS (SELECT *, CASE WHEN len(terms) > 0 THEN list_transform(list_sort(list_transform(list_filter(string_split(string_split(state, '|')[2], ','), lambda s: s <> ''), lambda s: CAST(s AS BIGINT))), lambda i: ks[i]) ELSE ks END AS chosen FROM g)
    SELECT query_id, chunk_id, coalesce(nullif(left({_FOLDED.format("array_to_string(chosen, ' ')")}, 320), ''), left({_FOLDED.format("text")}, 320)) AS snippet FROM c""")
def snippets(t: Tables) -> DataFrame:
    """What a reranker reads of each of a question's eight rows."""
    top = _top(t, 8).select("query_id", "chunk_id")
    rows = top.join(t.documents.select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id").join(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), "query_id")
    return rows.select("query_id", "chunk_id", P.snippets("text", "query", F.lit(320)).alias("snippet"))


@query("SELECT user_id AS recording, arg_max(event_type, (coalesce(value, 0), -event_id)) AS text, max(coalesce(value, 0)) AS confidence FROM events GROUP BY user_id")
def best_transcripts(t: Tables) -> DataFrame:
    """The most confident pass over each recording."""
    passes = t.events.select(F.col("user_id").alias("recording"), F.col("event_id").alias("pass"), F.col("event_type").alias("text"), F.coalesce("value", F.lit(0.0)).alias("confidence"))
    return N.best_transcripts(passes, "recording")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN '' WHEN 'click' THEN 'press ok' ELSE event_type END AS repaired FROM events")
def repaired_transcripts(t: Tables) -> DataFrame:
    """Event types as transcripts, with one noise phrase and one correction."""
    said = F.concat(F.upper(F.substring("event_type", 1, 1)), F.substring("event_type", 2, 20), F.when(F.col("event_type") == "click", " ok").otherwise(""))
    return t.events.select("event_id", N.repaired(said, ["Error."], {"click": "press"}).alias("repaired"))


_ADJECTIVES, _NOUNS = "small red blue hot cold large green old".split(), "ring widget bolt gear plate valve pump spring".split()


@query()
def alternatives(t: Tables) -> DataFrame:
    """Readings to offer for every part's misheard name and every event's type, with confidence; tests hold them to the plain walk."""
    terms, forms = [f"{a} {n}" for a in _ADJECTIVES for n in _NOUNS] + ["clock", "purse", "review", "sign up now"], {"click": "press button", "bolt": "screw thread"}
    heard = t.part.select(F.col("p_partkey").alias("id"), F.concat(F.substring("p_name", 2, 40), F.lit(" "), F.lower(F.substring("p_type", 1, 3))).alias("heard"), F.col("p_name").alias("said"))
    events = t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("heard"), F.concat("event_type", F.lit(" review now")).alias("said"))
    rows = heard.union(events)
    return rows.select("id", "heard", F.array_join(N.alternatives_of(forms, terms)("heard"), ";").alias("offers"), N.confidence("heard", "said", terms).alias("confidence"))


@query("""SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS value FROM events""")
def event_json(t: Tables) -> DataFrame:
    """Log lines without the names that the log uses itself."""
    rows = t.events.select("event_id", "event_type", F.lit("x").alias("type"))
    return S.event_json(rows, ["type"]).select(F.get_json_object("value", "$.event_id").cast("long").alias("event_id"), "value")


@query("SELECT doc_id, toxic IS NOT NULL AS ocr_attempted FROM documents LEFT JOIN labels USING (doc_id)")
def ocr_state(t: Tables) -> DataFrame:
    """Documents with whether the cache knows them."""
    cache = t.labels.select("doc_id", F.lit("").alias("text"))
    return S.ocr_state(t.documents.select("doc_id"), cache, ["doc_id"]).select("doc_id", "ocr_attempted")


@query("SELECT doc_id AS row_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM documents JOIN embeddings ON vec_id = doc_id")
def assembled_vectors(t: Tables) -> DataFrame:
    """Vectors of the documents that have one, in row order."""
    keys = t.documents.select(F.col("doc_id").alias("row_id"), F.col("doc_id").alias("key")).join(t.embeddings.select(F.col("vec_id").alias("key")), "key", "left_semi")
    return S.assembled_vectors(keys, t.embeddings.select(F.col("vec_id").alias("key"), "embedding")).select("row_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@query()
def filled_cache(t: Tables) -> DataFrame:
    """The vectors' cache with the documents that it lacked, embedded locally."""
    chunks = t.documents.select(F.col("doc_id").alias("key"), "text")
    filled = V.fill_cache(chunks, t.embeddings.select(F.col("vec_id").alias("key"), "embedding"), "key", "text", V.hashing_embedder())
    return filled.select("key", F.size("embedding").alias("dim"))


@query(f"""WITH s AS (SELECT conv_id || '-' || turn AS id, text || chr(10) || '**Direct Answer:** ' || role || chr(10) || '**Reference:**' || chr(10) || turn AS said FROM conversations WHERE role = 'assistant'),
    m AS (SELECT id, string_split(regexp_replace(coalesce(said, ''), '{rules.ANSWER_HEADER}', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM s),
    r AS (SELECT id, len(p) AS n, unnest(range(len(p))) AS place, unnest(p) AS part FROM m),
    b AS (SELECT *, trim(regexp_replace(string_split(part, chr(2))[-1], '^\\s+|\\s+$', '', 'g')) AS body FROM r WHERE n > 2)
    SELECT id, CAST(place AS INTEGER) AS place, CASE WHEN contains(part, chr(2)) THEN trim(string_split(part, chr(2))[1]) ELSE 'answer' END AS label, body FROM b WHERE body <> ''""")
def answer_parts(t: Tables) -> DataFrame:
    """Parts of answers that two bold headers divide."""
    said = F.concat("text", F.lit("\n**Direct Answer:** "), "role", F.lit("\n**Reference:**\n"), F.col("turn").cast("string"))
    rows = t.conversations.where("role = 'assistant'").withColumn("said", said).withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return P.answer_parts(rows, "id", "said")


@query("SELECT p_partkey, 'manuals/a%20b/' || replace(p_name, ' ', '%20') || '.pdf' AS path FROM part WHERE regexp_matches(p_name, '^[A-Za-z0-9 ]*$')")
def url_paths(t: Tables) -> DataFrame:
    """Paths of documents as they stand in an address."""
    rows = t.part.where(F.col("p_name").rlike("^[A-Za-z0-9 ]*$"))
    return rows.select("p_partkey", X.url_path(F.concat(F.lit("manuals/a b/"), "p_name", F.lit(".pdf"))).alias("path"))


_WORDS = Shared(
    "lineitem", page="l_suppkey", n="l_orderkey * 10 + l_linenumber", flag="l_returnflag",
    x0="CAST(CASE WHEN l_orderkey % 60 % 9 = 0 THEN 0 ELSE l_partkey % 5 * 60 + l_partkey % 3 END AS DOUBLE)", y0="CAST(l_orderkey % 60 * 12 AS DOUBLE)",
    x1="CAST(CASE WHEN l_orderkey % 60 % 9 = 0 THEN 0 ELSE l_partkey % 5 * 60 + l_partkey % 3 END + CASE WHEN l_suppkey % 4 = 0 AND l_discount > 0.09 THEN 75 ELSE 20 END AS DOUBLE)", y1="CAST(l_orderkey % 60 * 12 + 10 AS DOUBLE)",
)  # fmt: skip
_CANDIDATES = f"""w AS ({_WORDS.sql}),
    l AS (SELECT *, sum(o) OVER (PARTITION BY page ORDER BY y0, n ROWS UNBOUNDED PRECEDING) AS line FROM (
        SELECT *, CASE WHEN y0 < max(y1) OVER (PARTITION BY page ORDER BY y0, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM w)),
    c AS (SELECT *, sum(p) OVER (PARTITION BY page, line ORDER BY x0, n ROWS UNBOUNDED PRECEDING) AS cell FROM (
        SELECT *, CASE WHEN x0 < 8 + max(x1) OVER (PARTITION BY page, line ORDER BY x0, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS p FROM l)),
    b AS (SELECT page, line, cell, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM c GROUP BY ALL),
    r AS (SELECT page, line, line - row_number() OVER (PARTITION BY page ORDER BY line) AS run FROM b GROUP BY page, line HAVING count(*) > 1),
    v AS (SELECT page, line, min(line) OVER (PARTITION BY page, run) AS band, count(*) OVER (PARTITION BY page, run) AS n FROM r),
    h AS (SELECT b.*, band FROM b JOIN v ON v.page = b.page AND v.line = b.line WHERE n >= 2),
    g AS (SELECT page, band, k, min(x0) AS from_x FROM (SELECT *, sum(o) OVER (PARTITION BY page, band ORDER BY x0, line, cell ROWS UNBOUNDED PRECEDING) AS k FROM (
        SELECT *, CASE WHEN x0 < 8 + max(x1) OVER (PARTITION BY page, band ORDER BY x0, line, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM h)) GROUP BY ALL),
    e AS (SELECT page, band, k, min(x0) AS from_x FROM (SELECT *, sum(o) OVER (PARTITION BY page, band ORDER BY x0, line, cell ROWS UNBOUNDED PRECEDING) AS k FROM (
        SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page, band ORDER BY x0, line, cell) <= 3 THEN 0 ELSE 1 END AS o FROM h)) GROUP BY ALL),
    s AS (SELECT page, band, 'gaps' AS strategy, from_x FROM g UNION ALL SELECT page, band, 'edges', from_x FROM e UNION ALL SELECT page, band, 'head', x0 FROM h WHERE line = band),
    t AS (SELECT *, lead(from_x) OVER (PARTITION BY page, band, strategy ORDER BY from_x) AS to_x FROM s),
    u AS (SELECT page, band, strategy, count(*) AS columns, count(*) FILTER (NOT EXISTS (SELECT 1 FROM h WHERE h.page = t.page AND h.band = t.band AND h.line = h.band AND h.x0 >= from_x AND (to_x IS NULL OR h.x0 < to_x))) AS unnamed FROM t GROUP BY ALL),
    x AS (SELECT page, band, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM h GROUP BY ALL),
    candidates AS (SELECT u.page, u.band AS table_id, strategy, x0, y0, x1, y1, columns, unnamed FROM u JOIN x ON x.page = u.page AND x.band = u.band)"""


@query(f"WITH {_CANDIDATES} SELECT page, CAST(table_id AS BIGINT) AS table_id, strategy, x0, y0, x1, y1, columns, unnamed FROM candidates")
def table_candidates(t: Tables) -> DataFrame:
    """Bands of lines in cells on every supplier's page, with the columns that three strategies see."""
    return B.table_candidates(_WORDS.of(t).drop("flag"))


@query(f"""WITH {_CANDIDATES},
    m AS (SELECT c.page, table_id, strategy, columns, unnamed, count(*) FILTER (flag <> 'R' AND (w.x0 + w.x1) / 2 BETWEEN c.x0 AND c.x1) AS covered, count(*) FILTER (flag <> 'R' AND NOT (w.x0 + w.x1) / 2 BETWEEN c.x0 AND c.x1) AS clipped,
                 count(*) FILTER (flag = 'R' AND (w.x0 + w.x1) / 2 BETWEEN c.x0 AND c.x1) AS swallowed
          FROM candidates c JOIN w ON w.page = c.page AND (w.y0 + w.y1) / 2 BETWEEN c.y0 AND c.y1 GROUP BY ALL),
    z AS (SELECT page, strategy, row_number() OVER (PARTITION BY page ORDER BY sum(unnamed), sum(clipped), sum(swallowed), -sum(covered), sum(columns), strategy) AS rn FROM m GROUP BY page, strategy)
    SELECT m.page, CAST(table_id AS BIGINT) AS table_id, m.strategy, columns, unnamed, covered, clipped, swallowed FROM m JOIN z ON z.page = m.page AND z.strategy = m.strategy WHERE rn = 1""")
def chosen_tables(t: Tables) -> DataFrame:
    """The candidates of each page's best strategy; returned rows stand for running lines."""
    words = _WORDS.of(t)
    return B.chosen_tables(words, F.col("flag") == "R").drop("x0", "y0", "x1", "y1")


_LISTS = "replace(replace(replace(replace(html, '<ul>', '<table>'), '</ul>', '</table>'), '<li>', '<tr><td>'), '</li>', '</td></tr>')"


@query(r"""WITH n AS (SELECT page_id, regexp_extract_all(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1), '(?s)<li>.*?</li>') AS items FROM pages),
    c AS (SELECT page_id, list_transform(items, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '[ 	

]+', ' ', 'g'))) AS cells FROM n WHERE len(items) > 0)
    SELECT page_id AS page, CAST(len(cells) AS BIGINT) AS n_rows, '|' || replace(cells[1], '|', '\|') || '|' || chr(10) || '|---|' || array_to_string(list_transform(cells[2:], lambda x: chr(10) || '|' || replace(x, '|', '\|') || '|'), '') AS table_text FROM c""")
def page_tables(t: Tables) -> DataFrame:
    """The navigation list of every page, marked as a table, read as one and written as markdown."""
    blocks = H.page_blocks(t.pages.selectExpr("page_id", f"{_LISTS} AS html"))
    return blocks.where("kind = 'table'").select("page", F.size("rows").cast("long").alias("n_rows"), F.col("text").alias("table_text"))


@query()
def document_sections(t: Tables) -> DataFrame:
    """The pages of every host as one document: lines, headings and lists as tables under their sections; tests hold blocks to a plain walk."""
    blocks = H.page_blocks(t.pages.selectExpr("page_id", f"{_LISTS} AS html"))
    places = t.pages.select(F.col("page_id").alias("page"), F.regexp_extract("url", r"//([^/]*)", 1).alias("doc"), F.col("page_id").alias("page_no"))
    return H.document_sections(blocks, places)

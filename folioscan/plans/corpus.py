"""Corpus queries: documents as pages and chunks, their lines as page lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import fixed
from folioscan.functions import text as X
from folioscan.operators import assemble as A
from folioscan.operators import chunking as K
from folioscan.operators import evaluate as E
from folioscan.operators import quality as Q
from folioscan.operators import retrieval as R
from folioscan.plans.base import Tables, query
from folioscan.plans.retrieval import _TERMS, _top
from folioscan.sources import tables as T

_STOP = "[" + ", ".join(f"'{w}'" for w in fixed.QUALITY_STOP_WORDS) + "]"
_RATIO = f"""t AS (SELECT doc_id, source, text, regexp_extract_all(text, '[A-Za-z]{{2,}}') AS tokens FROM documents),
    r AS (SELECT doc_id, source, CASE WHEN NOT starts_with(ltrim(text), 'Table') AND (length(text) - length(replace(text, '|', ''))) / CAST(greatest(length(text), 1) AS DOUBLE) <= 0.03 AND len(tokens) >= 12
          THEN len(list_filter(tokens, lambda x: list_contains({_STOP}, lower(x)))) / CAST(len(tokens) AS DOUBLE) END AS ratio FROM t)"""


@query(f"WITH {_RATIO} SELECT doc_id, round(ratio, 6) AS ratio FROM r WHERE ratio IS NOT NULL")
def stopword_ratio(t: Tables) -> DataFrame:
    """Share of common words in every text that can be judged."""
    return t.documents.select("doc_id", F.round(Q.stop_word_ratio("text"), 6).alias("ratio")).where("ratio is not null")


@query(f"WITH {_RATIO} SELECT source, count(ratio) AS judged, count(*) FILTER (ratio < 0.08) AS flagged FROM r GROUP BY source")
def garble_audit(t: Tables) -> DataFrame:
    """Judged and garbled chunks of each source."""
    return Q.garble_audit(t.documents, "source", "text")


_LINES = "l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)"


def _lines(t: Tables) -> DataFrame:
    return t.documents.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))


@query(f"""WITH {_LINES}, k AS (SELECT source, doc_id, regexp_replace(line, '[ \\t\\n\\r\\f\\x0B]+', '', 'g') AS key FROM l),
    c AS (SELECT source, key, count(DISTINCT doc_id) AS pages FROM k WHERE length(key) BETWEEN 3 AND 120 GROUP BY source, key),
    n AS (SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY source)
    SELECT source, key, pages FROM c JOIN n USING (source) WHERE pages >= greatest(3, floor(n * 0.1))""")
def running_lines(t: Tables) -> DataFrame:
    """Lines on a tenth of a source's documents, three at least."""
    return Q.running_lines(_lines(t), "source", "doc_id", "line", share=0.1)


@query(f"""WITH {_LINES}, k AS (SELECT source, doc_id, regexp_replace(line, '[ \\t\\n\\r\\f\\x0B]+', '', 'g') AS key FROM l),
    c AS (SELECT source, key FROM k WHERE length(key) BETWEEN 3 AND 120 GROUP BY source, key
          HAVING count(DISTINCT doc_id) >= greatest(3, floor(0.1 * (SELECT count(DISTINCT doc_id) FROM documents d WHERE d.source = k.source))))
    SELECT doc_id, count(*) AS lines FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.source = k.source AND c.key = k.key) GROUP BY doc_id""")
def without_running_lines(t: Tables) -> DataFrame:
    """How many lines of each document are left without the running ones."""
    lines = _lines(t)
    running = Q.running_lines(lines, "source", "doc_id", "line", share=0.1)
    return Q.without_running_lines(lines, running, "source", "line").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"))


@query("""WITH r AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source, trim(text, ' ') ORDER BY doc_id) AS n FROM documents WHERE trim(text, ' ') <> '') SELECT doc_id, source FROM r WHERE n = 1""")
def exact_dedupe(t: Tables) -> DataFrame:
    """The first document of each text within a source."""
    return K.deduplicated(t.documents, "source", "text", "doc_id").select("doc_id", "source")


@query("""SELECT 'the' AS canary, CAST(sum(len(regexp_extract_all(text, 'the'))) AS BIGINT) AS matches FROM documents
    UNION ALL SELECT 'number', CAST(sum(len(regexp_extract_all(text, '[0-9]+'))) AS BIGINT) FROM documents
    UNION ALL SELECT 'license', CAST(sum(len(regexp_extract_all(text, 'licensed under'))) AS BIGINT) FROM documents""")
def canary_counts(t: Tables) -> DataFrame:
    """Occurrences of patterns that the corpus must hold."""
    return Q.canary_counts(t.documents, "text", {"the": "the", "number": "[0-9]+", "license": "licensed under"})


@query("""SELECT 'char_count' AS rule, count(*) FILTER (n_chars IS DISTINCT FROM length(text)) AS broken FROM documents
    UNION ALL SELECT 'not_empty', count(*) FILTER (coalesce(trim(text, ' '), '') = '') FROM documents
    UNION ALL SELECT 'size', count(*) FILTER (length(text) > 4000 OR text IS NULL) FROM documents
    UNION ALL SELECT 'unique_key', count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)""")
def kb_validation(t: Tables) -> DataFrame:
    """Rows that break each rule of the chunk table."""
    rules = {"char_count": F.col("n_chars") == F.char_length("text"), "not_empty": F.trim("text") != "", "size": F.char_length("text") <= 4000}
    return Q.validation(t.documents, rules, "doc_id")


@query("""WITH c AS (SELECT count(*) AS n, sum(len(regexp_extract_all(text, '[|]'))) AS bars, sum(len(regexp_extract_all(text, '[0-9]+'))) AS numbers FROM documents)
    SELECT 'bars' AS name, round(bars / CAST(n AS DOUBLE), 6) AS rate, CAST(1.15 AS DOUBLE) AS bound, bars / CAST(n AS DOUBLE) <= 1.15 AS passed FROM c
    UNION ALL SELECT 'numbers', round(numbers / CAST(n AS DOUBLE), 6), CAST(0.14 AS DOUBLE), numbers / CAST(n AS DOUBLE) <= 0.14 FROM c""")
def rate_bounds(t: Tables) -> DataFrame:
    """Matches per chunk against bounds."""
    return Q.rates(t.documents, "text", {"bars": ("[|]", 1.15), "numbers": ("[0-9]+", 0.14)})


_SECTIONS = f"""{_LINES.replace("unnest(string_split(text, chr(10))) AS line", "string_split(text, chr(10)) AS ls")},
    e AS (SELECT source, doc_id, unnest(ls) AS text, unnest(range(len(ls))) AS place FROM l),
    s AS (SELECT *, sum(CAST(length(text) < 60 AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY place) AS section_no FROM e)"""


def _sections(t: Tables) -> DataFrame:
    lines = _lines(t).withColumnRenamed("line", "text")
    return K.section_numbers(lines, "doc_id", F.char_length("text") < 60, "place")


@query(f"WITH {_SECTIONS} SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars FROM s GROUP BY doc_id, section_no")
def section_running_sum(t: Tables) -> DataFrame:
    """Sections that short lines open, with their lines and characters."""
    return _sections(t).groupBy("doc_id", "section_no").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.char_length("text")).alias("chars"))


@query(f"""WITH {_SECTIONS}, g AS (SELECT doc_id, section_no, sum(length(text)) AS chars FROM s GROUP BY doc_id, section_no),
    b AS (SELECT *, CASE WHEN chars >= 250 THEN section_no END AS big FROM g)
    SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, CAST(coalesce(min(big) OVER (PARTITION BY doc_id ORDER BY section_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
           max(big) OVER (PARTITION BY doc_id ORDER BY section_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS BIGINT) AS host_no FROM b""")
def tiny_sections(t: Tables) -> DataFrame:
    """The section that takes each section's lines."""
    sections = _sections(t).groupBy("doc_id", "section_no").agg(F.sum(F.char_length("text")).alias("chars"))
    return K.merge_tiny_sections(sections, "doc_id", "section_no", "chars").select("doc_id", "section_no", "host_no")


@query(f"""WITH {_LINES.replace("unnest(string_split(text, chr(10))) AS line", "string_split(text, chr(10)) AS ls")},
    e AS (SELECT source, doc_id, unnest(ls) AS text, unnest(range(len(ls))) AS place FROM l)
    SELECT doc_id, CAST(place AS INTEGER) AS place, CAST(row_number() OVER (PARTITION BY source, doc_id ORDER BY place) - 1 AS INTEGER) AS chunk_index, count(*) OVER (PARTITION BY source, doc_id) AS total,
        substr(md5(source || '|' || doc_id || '|' || (row_number() OVER (PARTITION BY source, doc_id ORDER BY place) - 1) || '|' || trim(text, ' ')), 1, 12) AS chunk_id FROM e""")
def chunk_numbers(t: Tables) -> DataFrame:
    """Lines as chunks of their document: place, total and id."""
    rows = _lines(t).withColumnRenamed("line", "text").withColumn("section", F.col("doc_id").cast("string"))
    return K.numbered(rows, "source", "section", "place").select("doc_id", "place", "chunk_index", F.col("total_chunks_in_section").alias("total"), "chunk_id")


@query("SELECT doc_id, substr(md5(source || '|' || lang || '|0|' || text), 1, 12) AS chunk_id, sha1('local|64|document|' || text) AS cache_key FROM documents")
def chunk_id(t: Tables) -> DataFrame:
    """Content ids of every document as chunk and as vector cache entry."""
    return t.documents.select("doc_id", X.chunk_id("source", "lang", F.lit(0), "text").alias("chunk_id"), X.cache_key("local", 64, "document", "text").alias("cache_key"))


@query("SELECT doc_id, trim(translate(text, '|][' || chr(10) || chr(13) || chr(9), '/)(   '), ' ') AS safe FROM documents")
def header_escape(t: Tables) -> DataFrame:
    """Whole texts as header fields."""
    return t.documents.select("doc_id", X.header_field("text").alias("safe"))


@query(f"""WITH {_TERMS},
    r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank FROM h),
    x AS (SELECT r.query_id, r.rank, d.source AS title, d.lang AS clause, d.doc_id FROM r JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 20),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id, title, clause ORDER BY rank) AS n FROM x)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, title, clause FROM k WHERE n = 1""")
def citation_dedupe(t: Tables) -> DataFrame:
    """One citation per source and language among twenty rows."""
    return A.citations(_ranked(t, 20)).select("query_id", "rank", "title", "clause")


def _ranked(t: Tables, k: int) -> DataFrame:
    top = _top(t, k).select("query_id", "rank", F.col("chunk_id").alias("doc_id"))
    none = F.lit("")
    docs = t.documents.select("doc_id", F.col("source").alias("title"), F.col("lang").alias("section_num"), none.alias("section"), (F.col("n_chars") % 9).alias("page_num"), none.alias("printed_page"), F.array("lang").alias("coach_type"), none.alias("oem"), none.alias("letter_no"), none.alias("issue_date"), none.alias("superseded_by"), none.alias("status"), none.alias("download_url"), "text")
    return top.join(docs, "doc_id")


@query(f"""WITH {_TERMS},
    r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank FROM h),
    x AS (SELECT r.*, d.*, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' ') AS flat, trim(coalesce(text, ''), ' ') AS raw FROM r JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 8),
    y AS (SELECT *, CASE WHEN contains(raw, '|') AND contains(raw, chr(10)) THEN regexp_replace(raw, '[ \\t]+', ' ', 'g') ELSE flat END AS txt FROM x),
    z AS (SELECT query_id, rank, '[Source ' || rank || ': ' || source || ' | Clause ' || lang || CASE WHEN n_chars % 9 = 0 THEN '' ELSE ' | p.' || (n_chars % 9) END || ' | Coach: ' || lang || ']' || chr(10)
          || CASE WHEN length(txt) > 2500 THEN substr(txt, 1, 2500) || ' …' ELSE txt END AS s FROM y)
    SELECT query_id, string_agg(s, chr(10) || chr(10) ORDER BY rank) AS context FROM z GROUP BY query_id""")
def build_context(t: Tables) -> DataFrame:
    """The context of each question from its eight rows."""
    return A.build_context(_ranked(t, 8))


@query(f"""WITH {_TERMS},
    r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank FROM h),
    x AS (SELECT query_id, rank, chunk_id, n_chars FROM r JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 20),
    u AS (SELECT *, sum(n_chars + CASE WHEN rank > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM x)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, CAST(used AS BIGINT) AS used FROM u WHERE used <= 12000 OR rank = 1""")
def context_trim(t: Tables) -> DataFrame:
    """Leading rows of each question within 12,000 characters."""
    ranked = _top(t, 20).select("query_id", "rank", "chunk_id")
    sized = ranked.join(t.documents.select(F.col("doc_id").alias("chunk_id"), "n_chars"), "chunk_id")
    return A.within_budget(sized, 12_000, "n_chars").select("query_id", "rank", "chunk_id", "used")


@query(f"""WITH {_TERMS},
    r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, chunk_id) AS rank FROM h),
    b AS (SELECT item_id, min(rank) AS best FROM benchmark m JOIN r ON query_id = item_id AND rank <= 8 JOIN documents d ON d.doc_id = chunk_id WHERE contains(d.text, m.text) GROUP BY item_id),
    a AS (SELECT m.item_id, NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, m.text)) AS absent FROM benchmark m),
    x AS (SELECT a.*, best FROM a LEFT JOIN b USING (item_id))
    SELECT count(*) AS cases, count(*) FILTER (NOT absent) AS scored, count(*) FILTER (NOT absent AND best IS NOT NULL) AS hits,
        round(count(*) FILTER (NOT absent AND best IS NOT NULL) / CAST(count(*) FILTER (NOT absent) AS DOUBLE), 6) AS recall,
        round(coalesce(sum(CASE WHEN NOT absent THEN 1.0::DOUBLE / best END), 0) / count(*) FILTER (NOT absent), 6) AS mrr FROM x""")
def eval_recall_mrr(t: Tables) -> DataFrame:
    """Recall and reciprocal rank at 8; a document that holds an item whole is its right answer."""
    ranked = _top(t, 8).select(F.col("query_id").alias("case_id"), "rank", F.col("chunk_id").alias("doc_id"))
    held = _holders(t)
    cases = t.benchmark.select(F.col("item_id").alias("case_id")).join(held.select("case_id").distinct().withColumn("found", F.lit(True)), "case_id", "left")
    return E.metrics(E.best_ranks(cases.select("case_id", F.col("found").isNull().alias("expect_absent")), held, ranked))


def _holders(t: Tables) -> DataFrame:
    """case_id, doc_id: documents that hold an item, found by the rarest of its inner words first.

    The first and last word may be glued to a document's letters; items without another word
    are held against all texts.
    """
    items = t.benchmark.where("text is not null").select(F.col("item_id").alias("query_id"), F.col("text").alias("item"))
    inner = items.withColumn("inner", F.regexp_replace("item", "^[^A-Za-z]*[A-Za-z]*|[A-Za-z]*[^A-Za-z]*$", " "))
    posted = R.postings(t.documents, "doc_id", "text")
    rarity = posted.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    terms = R.query_terms(inner, "query_id", "inner").where(F.length("term") >= 3)
    rarest = terms.join(rarity, "term", "left").groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), "term")).alias("term"))
    texts = t.documents.select(F.col("doc_id").alias("chunk_id"), "text")
    near = rarest.join(posted, "term").join(texts, "chunk_id").join(items, "query_id").where(F.contains("text", "item"))
    rest = items.join(rarest, "query_id", "left_anti")
    plain = texts.join(rest, F.contains("text", "item"))
    return near.select(F.col("query_id").alias("case_id"), F.col("chunk_id").alias("doc_id")).union(plain.select("query_id", "chunk_id")).distinct()


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?।])[ \\t\\n\\r\\f\\x0B]+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda s: trim(s)), lambda s: s <> '') AS s FROM documents WHERE text IS NOT NULL),
    u AS (SELECT doc_id, flatten(list_transform(s, lambda x: list_transform(range(0, CAST((length(x) - 1) // {fixed.HARD_MAX} AS BIGINT) + 1), lambda i: x[i * {fixed.HARD_MAX} + 1 : (i + 1) * {fixed.HARD_MAX}]))) AS p FROM s),
    w AS (
        SELECT doc_id, 0 AS i, CAST([] AS VARCHAR[]) AS cur, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS closed FROM u
        UNION ALL
        SELECT doc_id, i, CASE WHEN shut THEN list_append(kept, s) ELSE list_append(cur, s) END, CASE WHEN shut THEN CAST(coalesce(list_sum(list_transform(kept, lambda x: length(x))), 0) AS BIGINT) ELSE n END + length(s) + 1, CASE WHEN shut THEN array_to_string(cur, ' ') END
        FROM (SELECT *, n + length(s) + 1 > CASE WHEN n >= {fixed.TARGET_LOW} THEN {fixed.TARGET_HIGH} ELSE {fixed.HARD_MAX} END AND len(cur) > 0 AS shut,
                  cur[len(cur) - list_max(list_filter(range(0, len(cur) + 1), lambda k: coalesce(list_sum(list_transform(cur[len(cur) - k + 1 :], lambda x: length(x))), 0) <= {fixed.OVERLAP_CHARS})) + 1 :] AS kept
              FROM (SELECT w.doc_id, i + 1 AS i, cur, n, p[i + 1] AS s FROM w JOIN u ON u.doc_id = w.doc_id WHERE i < len(p)))
    ),
    f AS (SELECT doc_id, i, closed AS text FROM w WHERE closed IS NOT NULL UNION ALL SELECT w.doc_id, i + 1, array_to_string(cur, ' ') FROM w JOIN u ON u.doc_id = w.doc_id WHERE i = len(p) AND len(cur) > 0 AND n > {fixed.LEAST_PIECE})
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS piece, text, 1 AS page FROM f""")
def pack_chunks(t: Tables) -> DataFrame:
    """Every text packed into pieces of whole sentences with a short overlap."""
    blocks = F.array(F.struct("text", F.lit(1).alias("page")))
    return t.documents.select("doc_id", F.posexplode(K.packed(blocks)).alias("piece", "x")).select("doc_id", "piece", F.col("x.text").alias("text"), "x.page")


@query(f"""WITH RECURSIVE d AS (SELECT doc_id AS k, 'Table — ' || coalesce(source, '') || ':' || chr(10) AS lead, list_transform(string_split(translate(text, '|', '/'), chr(10)), lambda x: x) AS ls FROM documents WHERE text IS NOT NULL),
    t AS (SELECT *, '|text|' || chr(10) || '|---|' || chr(10) AS head, array_to_string(list_transform(ls, lambda x: '|' || x || '|'), chr(10)) AS body, {fixed.TABLE_MAX} - length(lead) - 13 AS room FROM d),
    w AS (
        SELECT k, 0 AS i, CAST([] AS VARCHAR[]) AS held, CAST(0 AS BIGINT) AS used, CAST(NULL AS VARCHAR) AS closed, CAST([] AS VARCHAR[]) AS cut FROM t WHERE length(lead) + length(head) + length(body) > {fixed.TABLE_MAX}
        UNION ALL
        SELECT k, i, CASE WHEN wide THEN [] WHEN full_ THEN [r] ELSE list_append(held, r) END, CASE WHEN wide THEN 0 WHEN full_ THEN length(r) + 1 ELSE used + length(r) + 1 END, CASE WHEN (wide OR full_) AND len(held) > 0 THEN array_to_string(held, chr(10)) END,
            CASE WHEN NOT wide THEN [] WHEN n > room THEN list_append(list_transform(range(0, (n - 1) // room), lambda j: l[j * room + 1 : (j + 1) * room]), CASE WHEN n - (n - 1) // room * room + 2 > room THEN l[(n - 1) // room * room + 1 :] ELSE l[(n - 1) // room * room + 1 :] || '|' END) WHEN n = room - 2 THEN ['|' || l] ELSE [l] END
        FROM (SELECT *, '|' || l || '|' AS r, length(l) AS n, length(l) + 3 > room AS wide, used > 0 AND used + length(l) + 3 > room AS full_ FROM (SELECT w.k, i + 1 AS i, held, used, room, ls[i + 1] AS l FROM w JOIN t ON t.k = w.k WHERE i < len(ls)))
    ),
    p AS (
        SELECT k, i, 0 AS o, closed AS part FROM w WHERE closed IS NOT NULL
        UNION ALL SELECT k, i, 1 + o, part FROM (SELECT k, i, unnest(range(len(cut))) AS o, unnest(cut) AS part FROM w) WHERE trim(part, ' |') <> ''
        UNION ALL SELECT w.k, i + 1, 0, array_to_string(held, chr(10)) FROM w JOIN t ON t.k = w.k WHERE i = len(ls) AND len(held) > 0
        UNION ALL SELECT k, 0, 0, body FROM t WHERE length(lead) + length(head) + length(body) <= {fixed.TABLE_MAX}
    )
    SELECT p.k AS table_id, CAST(row_number() OVER (PARTITION BY p.k ORDER BY i, o) - 1 AS INTEGER) AS piece, lead || head || part AS text, '' AS group_label FROM p JOIN t ON t.k = p.k""")
def split_tables(t: Tables) -> DataFrame:
    """Documents as one-column tables, split into pieces that repeat the header."""
    lines = F.transform(F.split(F.translate("text", "|", "/"), "\n"), lambda s: F.concat(F.lit("|"), s, F.lit("|")))
    markdown = F.concat_ws("\n", F.lit("|text|"), F.lit("|---|"), lines)
    return K.split_tables(t.documents.select(F.col("doc_id").alias("table_id"), markdown.alias("markdown"), F.col("source").alias("section"), F.lit("").alias("intro")))


@query("""WITH d AS (SELECT doc_id, n_chars, n_chars % 40 AS a, n_chars % 90 AS b, n_chars % 50 + 1 AS p FROM documents),
    l AS (SELECT *, least(greatest(a, 1), greatest(p, 1)) AS low FROM d) SELECT doc_id, low AS first_page, greatest(low, least(b, p)) AS last_page FROM l""")
def page_spans(t: Tables) -> DataFrame:
    """Page ranges clamped to the document."""
    n = F.col("n_chars")
    low, high = T.page_span(n % 40, n % 90, n % 50 + 1)
    return t.documents.select("doc_id", low.alias("first_page"), high.alias("last_page"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, length(html) AS chars, len(regexp_extract_all(html, '<a ')) AS links FROM pages")
def page_stats(t: Tables) -> DataFrame:
    """Host, size and links of every page."""
    return t.pages.select("page_id", F.regexp_extract("url", r"^https?://([^/?#]*)", 1).alias("host"), F.char_length("html").cast("long").alias("chars"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"))

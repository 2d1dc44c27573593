"""Queries on lines, headings, tables and tags; inputs are made by expressions that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.functions import fixed, rules
from folioscan.functions import text as X
from folioscan.operators import chunking as K
from folioscan.operators import excerpts as P
from folioscan.operators import layout as L
from folioscan.operators import quality as Q
from folioscan.operators import tagging as G
from folioscan.plans.base import ORACLES, Shared, Tables, query
from folioscan.sources.files import written


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _plain(c: str) -> str:
    return f"trim(regexp_replace({c}, '[*]+', '', 'g'))"


def _cells(c: str) -> str:
    return f"list_transform(string_split(regexp_replace(trim({c}), '^[|]|[|]$', '', 'g'), '|'), lambda c: trim(c))"


_FOLD = "trim(regexp_replace({}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
_LINES = "SELECT doc_id, unnest(range(len(l))) AS place, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH l AS (SELECT doc_id, place, {_FOLD.format("line")} AS t, length(line) % 7 = 0 AS bold, 10.0 + length(line) % 3 AS size FROM ({_LINES}))
    SELECT doc_id, place, t AS heading FROM l WHERE length(t) BETWEEN 3 AND 120 AND NOT regexp_matches(t, '\\.{{4,}}|…')
       AND (regexp_matches(t, '^\\d+(\\.\\d+)*[.)]?\\s+\\p{{Lu}}') OR (regexp_matches(t, '\\p{{Lu}}.*\\p{{Lu}}.*\\p{{Lu}}') AND NOT regexp_matches(t, '\\p{{Ll}}')) OR ((bold OR size > 11.5) AND len(string_split(t, ' ')) <= 12))""")
def headings(t: Tables) -> DataFrame:
    """Lines of all documents that open a section; lengths stand for weight and size of the type."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    n = F.char_length("line")
    return lines.where(P.heading_like("line", n % 7 == 0, 10.0 + n % 3, F.lit(10.0))).select("doc_id", F.col("place").cast("long").alias("place"), X.whitespace_folded("line").alias("heading"))


_PAGES = Shared("lineitem", doc="l_orderkey", page="l_linenumber", chars="l_partkey % 120", image_area="CAST(l_quantity * 2 AS DOUBLE)", page_area="CAST(CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE 60 END AS DOUBLE)", tried="CASE WHEN l_returnflag = 'R' THEN true WHEN l_returnflag = 'A' THEN false END")


@query(f"SELECT doc, page FROM ({_PAGES.sql}) WHERE (coalesce(image_area / nullif(page_area, 0), 0) >= 0.9 OR chars < 50) AND NOT coalesce(tried, false)")
def ocr_pages(t: Tables) -> DataFrame:
    """Pages that are scans or nearly empty and that nobody tried to read."""
    return L.ocr_needed(_PAGES.of(t).withColumnRenamed("tried", "ocr_attempted")).select("doc", "page")


_FEET = Shared("orders", o_orderkey="o_orderkey", o_custkey="o_custkey", line="CASE o_orderkey % 7 WHEN 0 THEN ' Page ' || o_custkey || ' of ' || o_orderkey WHEN 1 THEN 'page ' || o_custkey WHEN 2 THEN o_custkey || '/' || o_orderkey WHEN 3 THEN 'PAGE ' || o_custkey || ' / ' || o_orderkey || ' ' WHEN 4 THEN 'see page ' || o_custkey WHEN 5 THEN o_custkey || ' of ' ELSE o_orderpriority END")


@query(f"""SELECT o_orderkey, o_orderkey % 7 IN (0, 2, 3) AS footer, CASE WHEN o_orderkey % 7 IN (0, 1) THEN CAST(o_custkey AS STRING) END AS printed FROM ({_FEET.sql})""")
def page_footers(t: Tables) -> DataFrame:
    """Whether lines are page footers, and the page number that is printed in them."""
    return _FEET.of(t).select("o_orderkey", X.page_footer("line").alias("footer"), X.printed_page("line").cast("string").alias("printed"))


_TABLES = Shared(
    "orders", doc="o_custkey % 20", id="o_orderkey", page="o_orderkey * 31 % 97",
    header="CASE o_custkey % 3 WHEN 0 THEN '|' || o_orderstatus || ' item|' || o_orderpriority || '|' WHEN 1 THEN '|a b|lower case|' ELSE '|' || lower(o_orderstatus) || '|x|' || o_orderstatus || 'y|' END",
)
_LABEL = f"({_plain('c')} <> '' AND NOT regexp_matches({_plain('c')}, '^Col\\d+$') AND length({_plain('c')}) <= {fixed.LABEL_MAX} AND regexp_matches({_plain('c')}, '^(\\p{{Lu}}|\\p{{Nd}})'))"
_QUALITY = f"len(list_filter(cells, lambda c: {_LABEL})) / CAST(greatest(len(cells), 1) AS DOUBLE)"


@query(f"""WITH t AS (SELECT *, {_cells("header")} AS cells FROM ({_TABLES.sql})),
    q AS (SELECT *, len(cells) AS n, {_QUALITY} >= 0.5 AS good FROM t),
    b AS (SELECT *, good OR coalesce(page - lag(page) OVER (PARTITION BY doc, n ORDER BY page, id), 99) > 1 AS brk FROM q),
    r AS (SELECT *, sum(brk::INT) OVER (PARTITION BY doc, n ORDER BY page, id ROWS UNBOUNDED PRECEDING) AS run FROM b)
    SELECT id, coalesce(first(CASE WHEN good THEN header END) OVER (PARTITION BY doc, n, run ORDER BY page, id), header) AS used_header FROM r""")
def carried_headers(t: Tables) -> DataFrame:
    """The header that each table's rows stand under: its own, or one from the pages before."""
    return L.carried_headers(_TABLES.of(t), "doc", "id", "page", "header").select("id", "used_header")


_ROWS = Shared("part", p_partkey="p_partkey", row="'|**' || p_brand || '**|' || p_name || '|Col' || p_size || '||' || p_type || '|'", grid="replace(p_name, ' ', '|') || '|' || replace(p_name, 'e', '|e') || '|'")


@query(f"""WITH r AS (SELECT p_partkey, row, grid, {_cells("row")} AS cells FROM ({_ROWS.sql})),
    g AS (SELECT *, list_filter(range(1, length(grid) + 1), lambda i: grid[i] = '|') AS bars FROM r),
    h AS (SELECT *, len(list_filter(bars, lambda i: regexp_matches(grid[i - 1], '^[a-z]$') AND regexp_matches(grid[i + 1], '^[a-z]$'))) AS hits, len(list_filter(bars, lambda i: i > 1 AND i < length(grid) AND grid[i - 1] <> '|' AND grid[i + 1] <> '|')) AS bounds FROM g)
    SELECT p_partkey, round({_QUALITY}, 6) AS quality, 1 AS unnamed, bounds >= {fixed.SHATTER_MIN_BOUNDARIES} AND hits >= {fixed.SHATTER_MIN_HITS} AND hits >= bounds * {fixed.SHATTER_MAX} AS shattered FROM h""")
def header_quality(t: Tables) -> DataFrame:
    """How much rows read like headers, their placeholders, and whether they are prose under a grid."""
    return _ROWS.of(t).select("p_partkey", F.round(L.header_quality("row"), 6).alias("quality"), X.unnamed_columns("row").alias("unnamed"), X.shattered("grid").alias("shattered"))


_FOLDS = Shared(
    "part", p_partkey="p_partkey", header="CASE p_size % 3 WHEN 0 THEN '|Item|Col2|Periodicity|' WHEN 1 THEN '|**Item**||' || p_type || '|' ELSE '|Item|' || p_brand || '|' END",
    labels="CASE p_partkey % 3 WHEN 0 THEN '|Item no|' || p_brand || '|' || p_type || '|' WHEN 1 THEN '|Part item|M|' || lower(p_type) || '|' ELSE '||' || p_name || '||' END",
)
_NAMED = "({0} <> '' AND NOT regexp_matches({0}, '^Col\\d+$'))"
_FLAT = "lower(regexp_replace({}, '[\\s|*_`]+', '', 'g'))"


def _within(a: str, b: str) -> str:
    return f"(length({_FLAT.format(b)}) >= 3 AND contains({_FLAT.format(a)}, {_FLAT.format(b)}))"


@query(f"""WITH r AS (SELECT p_partkey, header, list_transform({_cells("header")}, lambda x: {_plain("x")}) AS h, list_transform({_cells("labels")}, lambda x: {_plain("x")}) AS f FROM ({_FOLDS.sql})),
    m AS (SELECT *, len(h) = len(f) AND len(list_filter(f, lambda x: {_NAMED.format("x")})) > len(list_filter(h, lambda x: {_NAMED.format("x")})) AS more FROM r)
    SELECT p_partkey, CASE WHEN more THEN '|' || array_to_string(list_transform(range(1, len(h) + 1), lambda i: CASE WHEN NOT {_NAMED.format("h[i]")} OR {_within("f[i]", "h[i]")} THEN f[i] WHEN f[i] = '' OR {_within("h[i]", "f[i]")} THEN h[i] ELSE h[i] || ' ' || f[i] END), '|') || '|' ELSE header END AS folded FROM m""")
def folded_headers(t: Tables) -> DataFrame:
    """Two-level headers as one row."""
    return _FOLDS.of(t).select("p_partkey", L.folded_header("header", "labels").alias("folded"))


_SPANS = Shared("part", p_partkey="p_partkey", row="CASE p_partkey % 4 WHEN 0 THEN '|**' || p_name || '**|' || p_name || '||' WHEN 1 THEN '|' || p_name || '<br> x|' || p_name || ' x|' WHEN 2 THEN '|' || p_size || '|' || p_size || '|' ELSE '|' || p_name || '|' || p_type || '|' END")


@query(f"""WITH c AS (SELECT p_partkey, list_transform({_cells("row")}, lambda c: {_FOLD.format("regexp_replace(regexp_replace(c, '[*]+', '', 'g'), '\\s*<br>\\s*', ' ', 'g')")}) AS cells FROM ({_SPANS.sql})),
    f AS (SELECT *, list_distinct(list_filter(cells, lambda c: c <> '')) AS filled FROM c)
    SELECT p_partkey, CASE WHEN len(cells) >= 2 AND len(filled) = 1 AND length(filled[1]) BETWEEN 3 AND 140 AND length(regexp_replace(filled[1], '[^\\p{{L}}]', '', 'g')) >= 3 THEN filled[1] ELSE '' END AS label FROM f""")
def group_labels(t: Tables) -> DataFrame:
    """Labels of rows that span a table."""
    return _SPANS.of(t).select("p_partkey", L.group_label("row").alias("label"))


_EQUIPMENT = Shared("orders", table_no="o_custkey", place="o_orderkey", value="CASE WHEN o_orderkey % 5 = 0 THEN 'Bogie ' || o_orderstatus WHEN o_orderkey % 7 = 0 THEN 'Axle<br>box' WHEN o_orderkey % 17 = 0 THEN 'Note: see below' WHEN o_orderkey % 19 = 0 THEN '_ruled_' WHEN o_orderkey % 23 = 0 THEN 'Equipment' END")


@query(f"""WITH v AS (SELECT table_no, place, {_FOLD.format("regexp_replace(coalesce(value, ''), '\\s*<br>\\s*', ' ', 'g')")} AS v FROM ({_EQUIPMENT.sql})),
    n AS (SELECT *, CASE WHEN length(v) BETWEEN 3 AND 140 AND length(regexp_replace(v, '[^\\p{{L}}]', '', 'g')) >= 3
        AND NOT (starts_with(v, '_') OR starts_with(lower(v), 'note') OR len(string_split(v, ' ')) > 10 OR (regexp_matches(v, {_quoted(rules.EQUIPMENT_COLUMN)}) AND len(string_split(v, ' ')) <= 4)) THEN v END AS own FROM v),
    e AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY table_no ORDER BY place ROWS UNBOUNDED PRECEDING) AS equipment,
        last_value(own IGNORE NULLS) OVER (PARTITION BY table_no ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM n),
    o AS (SELECT *, own IS NOT NULL AND own IS DISTINCT FROM before AS opens FROM e),
    a AS (SELECT *, sum(opens::INT) OVER (PARTITION BY table_no) <= greatest(1, floor(count(*) OVER (PARTITION BY table_no) / 3)) AS able FROM o)
    SELECT place, opens AND able AS opens, CASE WHEN able THEN equipment END AS equipment FROM a""")
def equipment_runs(t: Tables) -> DataFrame:
    """Equipment names carried down a merged column, and where they begin."""
    return L.equipment_runs(_EQUIPMENT.of(t), "table_no", "place", "value").select("place", "opens", "equipment")


_CONTINUED = Shared(
    "orders", doc="o_custkey % 30", id="o_orderkey", page="o_orderkey * 31 % 97",
    header="CASE WHEN o_custkey % 7 < 3 THEN '|Item|Check|Period|' WHEN o_custkey % 7 < 6 THEN '|Item|**Check**|Remark|' ELSE '|Part|Torque|' END", last_label="CASE WHEN o_orderkey % 5 = 0 THEN 'Group ' || o_orderstatus END",
)
_NAMES = f"list_distinct(list_filter(list_transform(list_filter({_cells('header')}, lambda c: {_NAMED.format(_plain('c'))}), lambda c: {_FLAT.format('c')}), lambda c: c <> ''))"


@query(f"""WITH t AS (SELECT *, {_NAMES} AS names FROM ({_CONTINUED.sql})),
    l AS (SELECT *, lag(names) OVER w AS p_names, lag(page) OVER w AS p_page FROM t WINDOW w AS (PARTITION BY doc ORDER BY page, id)),
    s AS (SELECT *, coalesce(page - p_page <= 1 AND len(names) > 0 AND len(p_names) > 0 AND (len(list_intersect(names, p_names)) >= 3 OR len(list_intersect(names, p_names)) >= 0.5 * least(len(names), len(p_names))), false) AS goes_on FROM l),
    r AS (SELECT *, sum((NOT goes_on)::INT) OVER (PARTITION BY doc ORDER BY page, id ROWS UNBOUNDED PRECEDING) AS run FROM s)
    SELECT id, coalesce(last_value(last_label IGNORE NULLS) OVER (PARTITION BY doc, run ORDER BY page, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS carried_label FROM r""")
def carried_labels(t: Tables) -> DataFrame:
    """The group label that is still open where a table goes on from the page before."""
    return L.carried_labels(_CONTINUED.of(t), "doc", "id", "page", "header", "last_label").select("id", "carried_label")


_SUBJECTS = Shared(
    "part", p_partkey="p_partkey", page="p_size", title="CASE WHEN p_partkey % 2 = 0 THEN ' Registered ' || p_name || ' ' ELSE '' END",
    body="CASE p_partkey % 5 WHEN 0 THEN 'No. 7' || chr(10) || '**Sub:** Wheel _' || p_name || '_ .' || chr(10) || 'text' WHEN 1 THEN '> Subject - ' || p_type WHEN 2 THEN 'x' || chr(10) || '  ' || p_name || '  ' || chr(10) || p_type WHEN 3 THEN 'y' ELSE p_name || ' sub: none' END",
)


@query(f"""WITH s AS (SELECT *, trim(regexp_replace(regexp_extract(body, {_quoted(rules.SUBJECT)}, 1), '[*_`]', '', 'g'), ' .:-') AS subject, list_filter(list_transform(string_split(body, chr(10)), lambda s: trim(s)), lambda s: length(s) BETWEEN 3 AND 80) AS lines FROM ({_SUBJECTS.sql}))
    SELECT p_partkey, coalesce(CASE WHEN length(subject) BETWEEN 3 AND 120 THEN subject END, nullif(left(trim(title), 120), ''), lines[1], 'Page ' || page) AS section FROM s""")
def section_titles(t: Tables) -> DataFrame:
    """Titles of pages that were read: subject line, registered title, a short line or the page."""
    return _SUBJECTS.of(t).select("p_partkey", L.subject_title("body", "title", "page").alias("section"))


_LETTERS = Shared("orders", o_orderkey="o_orderkey", doc_type="CASE o_orderkey % 4 WHEN 0 THEN 'circular' WHEN 1 THEN 'instruction_letter' WHEN 2 THEN 'report' ELSE 'special_maintenance_instruction' END", pages="o_custkey % 20", title="CASE WHEN o_custkey % 3 = 0 THEN ' ' ELSE ' ' || o_orderpriority || ' ' END", section="o_orderstatus")


@query(f"SELECT o_orderkey, CASE WHEN doc_type <> 'report' AND pages <= {rules.LETTER_MAX_PAGES} AND trim(title) <> '' THEN trim(title) ELSE section END AS section FROM ({_LETTERS.sql})")
def letter_titles(t: Tables) -> DataFrame:
    """Sections of short letters under the letter's title."""
    return L.letter_sections(_LETTERS.of(t), F.col("pages")).select("o_orderkey", "section")


_LISTED = Shared("nation", gid="'6.' || (n_regionkey + 1)", number="CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER)", name="n_name", low="n_regionkey * 10 + 5", high="n_regionkey * 10 + 5 + n_regionkey + 2")


@query(f"""WITH n AS ({_LISTED.sql}), s AS (SELECT gid, count(*) AS items FROM n GROUP BY gid)
    SELECT gid, number, name, CASE WHEN items = high - low + 1 THEN low + number - 1 ELSE low END AS page, items = high - low + 1 AS exact FROM n JOIN s USING (gid)""")
def drawing_items(t: Tables) -> DataFrame:
    """A drawing index written from the nations, read back: numbers, names and proven pages."""
    listed = _LISTED.of(t)
    items = listed.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("number", "name"))).alias("i"))
    line = F.concat(F.lit(" "), "gid", F.lit(". Group of drawings "), F.array_join(F.transform("i", lambda x: F.concat(x["number"].cast("string"), F.lit(". "), x["name"])), " "))
    index = items.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("gid", line.alias("l")))), lambda x: x["l"]), "").alias("text"))
    return L.drawing_items(index, listed.select("gid", "low", "high").distinct())


_BLOCKS = Shared("orders", doc="o_custkey", place="o_orderkey", type="CASE WHEN o_orderstatus = 'O' THEN 'table' ELSE 'text' END", page="o_orderkey % 2", text="repeat(o_orderstatus, CAST(o_orderkey % 9 * 90 + 1 AS INT))")


@query(f"""WITH b AS (SELECT *, lag(type) OVER w = 'text' AND lag(page) OVER w = page AND length(lag(text) OVER w) <= 600 AS fits, lag(text) OVER w AS above FROM ({_BLOCKS.sql}) WINDOW w AS (PARTITION BY doc ORDER BY place))
    SELECT doc, place, CASE WHEN fits THEN above ELSE '' END AS intro FROM b WHERE type = 'table'""")
def table_intros(t: Tables) -> DataFrame:
    """The short text right above each table."""
    return K.table_intros(_BLOCKS.of(t), "doc", "place").select("doc", "place", "intro")


_NUMBERED = Shared("orders", doc="o_custkey % 25", place="o_orderkey", num="CASE o_orderkey % 5 WHEN 1 THEN CAST(o_custkey % 4 + 1 AS STRING) WHEN 2 THEN (o_custkey % 4 + 1) || '.' || (o_custkey % 3 + 1) WHEN 3 THEN (o_custkey % 4 + 1) || '.' || (o_custkey % 3 + 1) || '.' || (o_custkey % 2 + 1) WHEN 4 THEN 'A' ELSE '' END", title="o_orderstatus || ' part  ' || o_custkey")


@query(f"""WITH r AS (SELECT doc, place, num, left({_FOLD.format("title")}, 80) AS title, regexp_matches(num, '^\\d+(\\.\\d+)*$') AS numbered, string_split(num, '.') AS p FROM ({_NUMBERED.sql})),
    a AS (SELECT doc, place, unnest(range(1, len(p) + 1)) AS depth, unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '.'))) AS want FROM r WHERE numbered),
    s AS (SELECT a.doc, a.place, depth, arg_max(num || ' ' || title, r.place) AS step FROM a JOIN r ON r.doc = a.doc AND r.num = a.want AND r.numbered AND r.place <= a.place GROUP BY a.doc, a.place, depth),
    f AS (SELECT doc, place, string_agg(step, ' › ' ORDER BY depth) AS path FROM s GROUP BY doc, place),
    j AS (SELECT r.*, path, last_value(path IGNORE NULLS) OVER (PARTITION BY r.doc ORDER BY r.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS under FROM r LEFT JOIN f ON f.doc = r.doc AND f.place = r.place)
    SELECT place, CASE WHEN numbered THEN path WHEN under IS NOT NULL THEN under || ' › ' || title ELSE '' END AS section_path FROM j""")
def breadcrumbs(t: Tables) -> DataFrame:
    """The path of numbered headings above each section."""
    return K.breadcrumbs(_NUMBERED.of(t), "doc", "place", "num", "title").select("place", "section_path")


_SYMBOLS = Shared("part", p_partkey="p_partkey", text="replace(p_name, ' ', '\uf020') || '\uf0b7' || p_size || '\uea60'")


@query("SELECT p_partkey, replace(p_name, ' ', ' ') || '•' || p_size AS plain FROM part")
def symbol_fonts(t: Tables) -> DataFrame:
    """Symbol-font characters as plain ones; unknown ones go."""
    return _SYMBOLS.of(t).select("p_partkey", X.symbols("text", "\uf020\uf0b7", " •").alias("plain"))


@query("""WITH c AS (SELECT doc_id, regexp_replace(translate(lower(coalesce(text, '')), '–—~±', '---'), '([0-9]),([0-9])', '\\1.\\2', 'g') AS a FROM documents),
    d AS (SELECT doc_id, regexp_replace(regexp_replace(a, '([0-9]),([0-9])', '\\1.\\2', 'g'), '[ \\t\\n\\r\\f\\x0B]+', '', 'g') AS s FROM c)
    SELECT doc_id, md5(s) AS compact, md5(translate(s, '-/', '')) AS designation, contains(s, '12.5kg') OR contains(s, 'theof') AS confirmed FROM d""")
def compact_texts(t: Tables) -> DataFrame:
    """Whole texts as guards compare them, with and without separators, and whether two values stand there."""
    held = X.value_in_context(F.lit("12,5 kg"), "text") | X.value_in_context(F.lit("The of"), "text")
    return t.documents.select("doc_id", F.md5(X.compact("text")).alias("compact"), F.md5(X.compact_designation("text")).alias("designation"), held.alias("confirmed"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?।])[ \\t\\n\\r\\f\\x0B]+', '\\1' || chr(1), 'g'), chr(1) || '|\\n+'), lambda s: trim(s)), lambda s: s <> '') AS s FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, flatten(list_transform(s, lambda x: list_transform(range(0, CAST((length(x) - 1) // 1600 AS BIGINT) + 1), lambda i: x[i * 1600 + 1 : (i + 1) * 1600]))) AS p FROM s)
    SELECT doc_id, len(p) AS sentences, md5(array_to_string(p, chr(1))) AS content FROM p""")
def sentence_splits(t: Tables) -> DataFrame:
    """The sentences of every text, long ones cut."""
    parts = t.documents.where("text is not null").select("doc_id", K.sentences("text").alias("p"))
    return parts.select("doc_id", F.size("p").cast("long").alias("sentences"), F.md5(F.array_join("p", "\x01")).alias("content"))


@query("""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])[ \\t\\n\\r\\f\\x0B]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS s FROM conversations WHERE text IS NOT NULL),
    p AS (SELECT conv_id, turn, flatten(list_transform(s, lambda x: list_transform(range(0, CAST((length(x) - 1) // 450 AS BIGINT) + 1), lambda i: x[i * 450 + 1 : (i + 1) * 450]))) AS p FROM s),
    r AS (SELECT conv_id, turn, CASE WHEN len(p) = 0 THEN '' ELSE list_reduce(p, lambda a, x: CASE WHEN length(string_split(a, chr(2))[-1]) + 1 + length(x) <= 450 THEN a || ' ' || x ELSE a || chr(2) || x END) END AS r FROM p)
    SELECT conv_id, turn, CASE WHEN r = '' THEN 0 ELSE len(string_split(r, chr(2))) END AS parts, md5(r) AS content FROM r""")
def speech_parts(t: Tables) -> DataFrame:
    """Turns in parts that a voice reads at once."""
    rows = t.conversations.where("text is not null").select("conv_id", "turn", P.sentence_parts("text").alias("p"))
    return rows.select("conv_id", "turn", F.size("p").cast("long").alias("parts"), F.md5(F.array_join("p", "\x02")).alias("content"))


@query("""WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS page, unnest([l_linestatus, l_returnflag, ' ' || (l_quantity > 5), '']) AS line FROM lineitem),
    n AS (SELECT doc, count(DISTINCT page) AS n FROM p GROUP BY doc)
    SELECT doc, trim(line) AS line FROM p JOIN n USING (doc) WHERE trim(line) <> '' GROUP BY doc, trim(line), n HAVING count(DISTINCT page) = n""")
def lines_on_every_page(t: Tables) -> DataFrame:
    """Values that all lines of an order share, as lines on all pages of a document."""
    values = F.array("l_linestatus", "l_returnflag", F.concat(F.lit(" "), (F.col("l_quantity") > 5).cast("string")), F.lit(""))
    return Q.lines_on_all_pages(t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.explode(values).alias("line")), "doc", "page", "line")


def _tag_sql() -> str:
    """The tag rules as SQL, from the same table of rules."""
    hit = lambda c, p: f"regexp_matches(coalesce({c}, ''), {_quoted(p)})"
    cases = ", ".join(f"CASE WHEN {' OR '.join(hit(c, p) for c, p in (('text', x), ('source', y)) if p)} THEN {_quoted(tag)} END" for tag, x, y in rules.TAG_RULES)
    makers = rules.MAKERS["WSP"]
    counts = ", ".join(f"len(regexp_extract_all(coalesce(text, ''), {_quoted(p)}))" for p in makers.values())
    names = ", ".join(map(_quoted, makers))
    return f"""WITH b AS (SELECT doc_id, list_filter([{cases}], lambda x: x IS NOT NULL)[1:{rules.MAX_RULE_TAGS}] AS base, [{counts}] AS n, [{names}] AS names FROM documents),
        m AS (SELECT *, CASE WHEN list_max(n) > 0 THEN names[list_position(n, list_max(n))] END AS maker, CASE WHEN list_contains(base, 'WSP') THEN base ELSE list_prepend('WSP', base) END AS led FROM b)
        SELECT doc_id, array_to_string((CASE WHEN maker IS NOT NULL AND NOT list_contains(led, maker) AND len(led) < {rules.MAX_TAGS} THEN list_append(led, maker) ELSE led END)[1:{rules.MAX_TAGS}], ',') AS tags, maker FROM m"""


# Word bounds are those of Unicode's letters in Spark, of ASCII's in the other engine: accented letters become plain ones there.
_ASCII = "regexp_replace(text, '[\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}]', 'x', 'g')"
ORACLES["rule_tags"] = _tag_sql().replace("FROM documents", f"FROM (SELECT doc_id, {_ASCII} AS text, source FROM documents)")

_MANUALS = Shared("part", p_partkey="p_partkey", text="CASE p_partkey % 6 WHEN 0 THEN 'Step 2: check the relay and battery cable of ' || p_name WHEN 1 THEN 'faiveley wabtec knorr brake cylinder fault code K05' WHEN 2 THEN 'Test 110 V power supply, MCB and Knorr ESRA wiring; visual check' WHEN 3 THEN 'maintenance overhaul install inspect warning connector spares relay wsp test fault battery CTRB' ELSE p_name END", source="CASE WHEN p_size % 2 = 0 THEN 'General overview' ELSE 'Testing of ' || p_type END")


@query(_tag_sql().replace("FROM documents", f"FROM (SELECT p_partkey AS doc_id, text, source FROM ({_MANUALS.sql}))"))
def manual_tags(t: Tables) -> DataFrame:
    """Tags and maker of sentences from manuals, one for each part."""
    maker = G.chunk_maker("text", F.lit("WSP"), F.lit(None).cast("string"))
    return _MANUALS.of(t).select(F.col("p_partkey").alias("doc_id"), F.array_join(G.tags("text", "source", F.lit("WSP"), maker), ",").alias("tags"), maker.alias("maker"))


def _documents(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sections, blocks and register of the web pages: heading lines open sections, each third line with a digit is a table row."""
    lines = written(K.section_numbers(L.html_lines(t.pages), "page_id", F.col("heading"), "place").withColumnRenamed("page_id", "doc_id"), "lines")
    sections = lines.groupBy("doc_id", "section_no").agg(F.max(F.coalesce("section", F.lit(""))).alias("section"), (F.min("place") / 40).cast("int").alias("page_start")).withColumn("section_num", F.regexp_extract("section", r"^\d+(?:\.\d+)*", 0))
    row = F.concat(F.lit("|Line|Text|\n|---|---|\n|"), F.col("place").cast("string"), F.lit("|"), "text", F.lit("|"))
    table = (F.col("place") % 3 == 0) & F.col("text").rlike("[0-9]")
    blocks = lines.where("not heading").select("doc_id", "section_no", "place", F.when(table, "table").otherwise("text").alias("type"), F.when(table, row).otherwise(F.col("text")).alias("text"), (F.col("place") / 40).cast("int").alias("page"), F.lit(None).cast("int").alias("table_index"))
    register = t.pages.select(F.col("page_id").alias("doc_id"), F.col("url").alias("source"), F.when(F.col("page_id") % 2 == 0, "Web manual").otherwise("").alias("context_header"), F.when(F.col("page_id") % 3 == 0, "WSP").otherwise("").alias("system"))
    return sections, blocks, register


@query()
def chunked_documents(t: Tables) -> DataFrame:
    """All web pages as chunk rows (tests hold this to a plain walk over each page)."""
    from folioscan.operators.documents import chunk_documents

    return chunk_documents(*_documents(t)).select("chunk_id", "doc_id", "section", "section_path", "page_num", "chunk_index", "total_chunks_in_section", "chunk_type", "table_id", F.array_join("tags", ",").alias("tags"), "text", "char_count")


_HEADED = Shared(
    "part", p_partkey="p_partkey", header="CASE p_size % 2 WHEN 0 THEN '|Item|Col2|Periodicity|' ELSE '|**Item**||' || p_type || '|' END",
    first_row="CASE p_partkey % 4 WHEN 0 THEN '|**Item no**|**' || p_brand || '**|' || p_type || '|' WHEN 1 THEN '|Part|M|' || p_type || '|' WHEN 2 THEN '|**' || repeat(p_name, 9) || '**|**M**|**Q**|' ELSE '|**A**||**' || p_name || '**|' END",
)
_BOLD = f"list_filter({_cells('first_row')}, lambda c: {_plain('c')} <> '')"


@query(f"""WITH b AS (SELECT p_partkey, header, first_row, {_BOLD} AS cells FROM ({_HEADED.sql})),
    l AS (SELECT *, len(cells) > 0 AND list_max(list_transform(cells, lambda c: length({_plain('c')}))) <= 60 AND len(list_filter(cells, lambda c: starts_with(c, '**'))) >= greatest(1, len(cells) // 2) AS labels FROM b),
    r AS (SELECT *, list_transform({_cells("header")}, lambda x: {_plain("x")}) AS h, list_transform({_cells("first_row")}, lambda x: {_plain("x")}) AS f FROM l),
    m AS (SELECT *, labels AND len(h) = len(f) AND len(list_filter(f, lambda x: {_NAMED.format("x")})) > len(list_filter(h, lambda x: {_NAMED.format("x")})) AS more FROM r)
    SELECT p_partkey, labels AS label_row, CASE WHEN more THEN '|' || array_to_string(list_transform(range(1, len(h) + 1), lambda i: CASE WHEN NOT {_NAMED.format("h[i]")} OR {_within("f[i]", "h[i]")} THEN f[i] WHEN f[i] = '' OR {_within("h[i]", "f[i]")} THEN h[i] ELSE h[i] || ' ' || f[i] END), '|') || '|' ELSE header END AS repaired FROM m""")
def repaired_headers(t: Tables) -> DataFrame:
    """Headers with the labels of the row below them, where that row names columns."""
    return L.repaired_headers(_HEADED.of(t), "header", "first_row").select("p_partkey", L.label_row("first_row").alias("label_row"), "repaired")


_SPREAD = Shared("part", p_partkey="p_partkey", row="CASE p_partkey % 3 WHEN 0 THEN '|Maintenance|Manual of **Co|aches**|Col4|' WHEN 1 THEN '|Maintenance manual|of coaches ' || p_name || '|' ELSE '|' || p_name || '|x|' END")


@query(f"SELECT p_partkey, p_partkey % 3 < 2 AS running FROM ({_SPREAD.sql})")
def running_rows(t: Tables) -> DataFrame:
    """Table rows that are a running header spread over the columns."""
    return _SPREAD.of(t).select("p_partkey", L.running_row("row", F.array(F.lit("Maintenance Manual of Coaches"), F.lit("short"))).alias("running"))

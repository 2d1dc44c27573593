"""Catalog queries: lineitem rows are chunks, parts are documents, brands are areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.functions import text as X
from folioscan.operators import catalog as C
from folioscan.operators import evaluate as E
from folioscan.operators import quality as Q
from folioscan.plans.base import Tables, query
from folioscan.streaming import usage as U


def _chunks(t: Tables) -> DataFrame:
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))


def _shelf(t: Tables) -> DataFrame:
    """Parts as documents with the columns that filters use."""
    return t.part.select(
        F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"), F.col("p_type").alias("doc_type"), F.col("p_brand").alias("system"),
        F.when(F.col("p_size") % 5 == 0, F.array(F.lit("common"))).otherwise(F.array(F.col("p_size").cast("string"))).alias("coach_type"),
    )


@query("SELECT p_brand AS area, count(*) AS chunks, count(DISTINCT p_partkey) AS documents FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def systems_nav(t: Tables) -> DataFrame:
    """Chunks and documents of each area with content."""
    return C.area_counts(_chunks(t), "p_brand", "p_partkey")


@query("""SELECT r_name AS region, n_name AS area, count(*) AS chunks, count(DISTINCT c_custkey) AS documents
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name""")
def two_level_nav(t: Tables) -> DataFrame:
    """Orders and customers by nation within region."""
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("area")).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("c_custkey").alias("documents"))


@query("""SELECT l_partkey AS doc_id, arg_min(strftime(l_shipdate, '%Y-%m-%d'), (l_orderkey, l_linenumber)) AS issue_date, arg_min(l_returnflag, (l_orderkey, l_linenumber)) AS status,
    count(*) AS chunks, count(DISTINCT l_suppkey) AS pages FROM lineitem GROUP BY l_partkey""")
def document_shelf(t: Tables) -> DataFrame:
    """A row per part with its first line's fields, its lines and its distinct suppliers."""
    rows = t.lineitem.withColumn("issue_date", F.date_format("l_shipdate", "yyyy-MM-dd")).withColumnRenamed("l_returnflag", "status").withColumnRenamed("l_partkey", "doc_id")
    return C.newest_first(C.document_shelf(rows, "doc_id", F.struct("l_orderkey", "l_linenumber"), ["issue_date", "status"], "l_suppkey").withColumn("title", F.col("doc_id").cast("string")), "issue_date", "title").drop("title")


@query("SELECT p_type AS doc_type, count(*) AS documents FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND (p_size % 5 = 0 OR p_size = 7) GROUP BY p_type")
def corpus_count(t: Tables) -> DataFrame:
    """Documents of one area that serve coach '7', also as common ones, by type."""
    first = t.part.agg(F.min("p_brand").alias("system"))
    shelf = C.filtered(_shelf(t).join(first, "system"), coach="7")
    return shelf.groupBy("doc_type").agg(F.count(F.lit(1)).alias("documents"))


@query("SELECT p_partkey AS doc_id, p_name AS title FROM part WHERE p_size % 5 <> 0 AND p_size = 7 AND (contains(lower(p_name), 'a') OR contains(lower(p_type), 'a') OR contains(lower(p_brand), 'a'))")
def shelf_filter(t: Tables) -> DataFrame:
    """The reader's filter: exactly coach '7' and an 'a' in some column."""
    return C.shelf_filter(_shelf(t), "7", None, " A ", ["title", "doc_type", "system"]).select("doc_id", "title")


@query("SELECT DISTINCT 'coach' AS facet, CASE WHEN p_size % 5 = 0 THEN 'common' ELSE CAST(p_size AS VARCHAR) END AS value FROM part UNION SELECT DISTINCT 'type', p_type FROM part WHERE p_type <> ''")
def facets(t: Tables) -> DataFrame:
    """Distinct coaches and types."""
    return C.facets(_shelf(t))


@query("""SELECT p_type AS doc_type, '  - ' || p_brand || ' (' || strftime(d, '%d.%m.%Y') || ') — ' || p_name AS line
    FROM part JOIN (SELECT l_partkey, min(l_shipdate) AS d FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey""")
def facts_lines(t: Tables) -> DataFrame:
    """A line per document for the block of counted facts."""
    dates = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("issue_date"))
    rows = t.part.join(dates, "p_partkey").select(F.col("p_type").alias("doc_type"), F.col("p_brand").alias("letter_no"), "issue_date", F.col("p_name").alias("title"))
    return C.facts_lines(rows).select("doc_type", "line")


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS documents, count(DISTINCT lang) AS coaches FROM documents")
def health(t: Tables) -> DataFrame:
    """Chunks, documents and coaches of the corpus."""
    return t.documents.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("source").alias("documents"), F.countDistinct("lang").alias("coaches"))


@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, value LIMIT 25")
def histogram_topn(t: Tables) -> DataFrame:
    """The 25 most frequent types (a report of that length)."""
    return Q.histogram(t.part, F.col("p_type"))


@query("""WITH b AS (SELECT l_partkey, count(*) AS old_chunks FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY l_partkey),
    a AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY l_partkey)
    SELECT b.l_partkey, old_chunks, coalesce(n, 0) AS new_chunks FROM b LEFT JOIN a USING (l_partkey) WHERE coalesce(n, 0) < 0.5 * old_chunks AND old_chunks >= 4""")
def shrink_gate(t: Tables) -> DataFrame:
    """Parts that lost over half of their lines between two snapshots."""
    edge = F.lit("1999-01-01").cast("timestamp_ntz")
    return Q.shrunk(t.lineitem.where(F.col("l_shipdate") < edge), t.lineitem.where(F.col("l_shipdate") >= edge), "l_partkey")


@query("""SELECT count(*) FILTER (l_shipdate < TIMESTAMP '1999-01-01') AS old_chunks, count(*) FILTER (l_shipdate >= TIMESTAMP '1999-01-01') AS new_chunks,
    count(*) FILTER (l_shipdate >= TIMESTAMP '1999-01-01') >= 0.9 * count(*) FILTER (l_shipdate < TIMESTAMP '1999-01-01') AS passed FROM lineitem""")
def total_shrink(t: Tables) -> DataFrame:
    """Whether the later snapshot kept nine tenths of the earlier one's lines."""
    edge = F.lit("1999-01-01").cast("timestamp_ntz")
    return Q.total_shrink(t.lineitem.where(F.col("l_shipdate") < edge), t.lineitem.where(F.col("l_shipdate") >= edge))


@query("""SELECT c_custkey AS key, 'empty' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    UNION ALL SELECT DISTINCT o_custkey, 'unregistered' FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def orphans(t: Tables) -> DataFrame:
    """Customers without orders in progress and orders' customers without a row."""
    return Q.orphans(t.customer.select(F.col("c_custkey").alias("key")), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("key")), "key")


@query("SELECT DISTINCT doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(t: Tables) -> DataFrame:
    """Documents without a vector."""
    return Q.missing_vectors(t.documents.select(F.col("doc_id").alias("key")), t.embeddings.select(F.col("vec_id").alias("key")), "key")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders)
    SELECT o_custkey, o_orderkey, CAST(place AS INTEGER) AS place FROM r WHERE place <= 40""")
def recent_threads(t: Tables) -> DataFrame:
    """Each customer's newest forty orders, as threads kept."""
    return C.recent_threads(t.orders, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "place")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT o_orderkey, 'upserted' FROM orders WHERE o_orderstatus = 'O'")
def upserted_threads(t: Tables) -> DataFrame:
    """Open orders written over the table of all orders."""
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    return C.upsert(rows, t.orders.where("o_orderstatus = 'O'").select("o_orderkey", F.lit("upserted").alias("o_orderpriority")), "o_orderkey")


@query("""WITH d AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders), e AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN iso WHEN 1 THEN substr(iso, 1, 7) ELSE substr(iso, 1, 4) END AS cut FROM d)
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN strftime(o_orderdate, '%m.%Y') ELSE strftime(o_orderdate, '%Y') END AS dotted,
        o_orderpriority || ', dt. ' || CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN strftime(o_orderdate, '%m.%Y') ELSE strftime(o_orderdate, '%Y') END AS ref,
        CASE WHEN o_orderkey % 2 = 0 THEN 'p.' || (o_orderkey % 7) || ' (PDF p.' || (o_orderkey % 7 + 1) || ')' ELSE 'p.' || (o_orderkey % 7 + 1) END AS page FROM e""")
def fmt_date(t: Tables) -> DataFrame:
    """Dates of three precisions in citation form, with reference and page label."""
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    cut = F.when(F.col("o_orderkey") % 3 == 0, iso).when(F.col("o_orderkey") % 3 == 1, F.substring(iso, 1, 7)).otherwise(F.substring(iso, 1, 4))
    page = F.col("o_orderkey") % 7 + 1
    printed = F.when(F.col("o_orderkey") % 2 == 0, page - 1).otherwise(page)
    return t.orders.select("o_orderkey", X.dotted_date(cut).alias("dotted"), X.citation("o_orderpriority", cut).alias("ref"), X.page_label(page, printed).alias("page"))


@query("""WITH d AS (SELECT o_orderkey, o_orderdate + INTERVAL 12 YEAR AS d, regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g') AS p FROM orders)
    SELECT o_orderkey, strftime(d, '%Y-%m-%d') AS a, strftime(d, '%Y-%m-%d') AS b, strftime(d, '%Y') AS c, 'X_' || o_orderkey || '_' || p AS slug FROM d""")
def filename_dates(t: Tables) -> DataFrame:
    """Dates read back from file names in three layouts, and a document id from a name."""
    later = F.add_months("o_orderdate", 144)
    make = lambda f: F.concat(F.lit("letter "), F.date_format(later, f), F.lit(" final.pdf"))
    name = F.concat(F.col("o_orderkey").cast("string"), F.lit("(3) - "), "o_orderpriority", F.lit(".pdf"))
    return t.orders.select("o_orderkey", X.filename_date(make("yyyy_MM_dd")).alias("a"), X.filename_date(make("dd.MM.yyyy")).alias("b"), X.filename_date(make("yyyy")).alias("c"), X.document_slug(name, "X_").alias("slug"))


@query("""WITH r AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS line, row_number() OVER (PARTITION BY l_partkey ORDER BY md5('7|' || (l_orderkey * 10 + l_linenumber)), l_orderkey * 10 + l_linenumber) AS draw FROM lineitem)
    SELECT l_partkey, line FROM r WHERE draw <= 3""")
def stratified_sample(t: Tables) -> DataFrame:
    """Three lines of each part, drawn by a hash (a sampling operator)."""
    rows = t.lineitem.withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return E.stratified_sample(rows, "l_partkey", "line", 3).select("l_partkey", "line")


@query("""WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 429 WHEN 'view' THEN 401 ELSE 200 END AS status, CASE WHEN value > 20 THEN 'quota Per_Day' ELSE 'slow down' END AS body FROM events),
    s AS (SELECT *, CASE WHEN status = 429 AND body LIKE 'quota%' THEN 3600 WHEN status = 429 THEN 90 WHEN status = 401 THEN 3600 ELSE 0 END AS s FROM e),
    l AS (SELECT user_id, arg_max(ts, (ts, event_id)) AS seen, arg_max(s, (ts, event_id)) AS rest, arg_max(CAST(status AS VARCHAR), (ts, event_id)) AS reason FROM s WHERE s > 0 GROUP BY user_id),
    n AS (SELECT user_id, reason, CAST(floor(rest - (epoch_us((SELECT max(ts) FROM events)) - epoch_us(seen)) / 1000000.0) AS BIGINT) AS seconds_left FROM l)
    SELECT * FROM n WHERE seconds_left > 0""")
def cooldown_status(t: Tables) -> DataFrame:
    """Users as providers, errors and views as failed replies: who rests at the time of the last event."""
    status = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "view", 401).otherwise(200)
    body = F.when(F.col("value") > 20, "quota Per_Day").otherwise("slow down")
    rows = t.events.withColumn("status", status).withColumn("body", body)
    now = t.events.agg(F.max("ts")).first()[0]
    return U.cooldown_status(rows, "user_id", "ts", "event_id", F.col("status"), "body", F.lit(now).cast("timestamp"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(t: Tables) -> DataFrame:
    """Events by hour and type."""
    return U.event_counts(t.events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type = 'error')
    SELECT e.event_id, f.event_id AS feedback_id FROM events e LEFT JOIN f ON f.user_id = e.user_id AND rn = 1 WHERE e.event_type = 'signup' AND f.event_id IS NOT NULL""")
def usage_feedback(t: Tables) -> DataFrame:
    """Sign-ups with the user's last error, as usage lines with feedback."""
    feedback = t.events.where("event_type = 'error'").withColumn("_n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("_n = 1")
    last = feedback.select(F.col("user_id").alias("request_id"), "ts", F.lit("").alias("reasons"), F.col("event_id").alias("rating"), F.col("ts").alias("timestamp"))
    usage = t.events.where("event_type = 'signup'").select("event_id", F.col("user_id").alias("request_id"))
    return U.conversations_with_feedback(usage, last).where("rating is not null").select("event_id", F.col("rating").alias("feedback_id"))

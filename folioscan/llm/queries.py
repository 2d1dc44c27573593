"""The operators' queries over the driver tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.cdc import repeated_passages
from folioscan.llm.chat import format_conversations, loss_text, parse
from folioscan.llm.decontaminate import find_contamination
from folioscan.llm.divergence import source_divergence
from folioscan.llm.fingerprints import edit_check
from folioscan.llm.langid import identify
from folioscan.llm.minhash import near_duplicates
from folioscan.llm.mixing import mix_sources
from folioscan.llm.phrases import collocations
from folioscan.llm.quality import classify_quality
from folioscan.llm.secrets import KINDS, find_secrets
from folioscan.llm.tokens import apply_edits, leaf_count, token_trees
from folioscan.llm.warc import archived_pages, read_archives, write_archives


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds, with the edits and the place."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, with likenesses; group_id follows."""
    return edit_check(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7 rendered and read back; loss_* are cut out of the rendering by the mask."""
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = format_conversations(turns).withColumn("turns", parse(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text; bits_per_byte follows."""
    return identify(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading order of all documents under weights that repeat no source more than four times."""
    return mix_sources(table(spark, sf_dir, "documents"), max_repeats=4.0).withColumn("weight", F.round("weight", 9))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text is counted, then edited in its middle and at three quarters, and counted on."""
    n = F.char_length("text").cast("long")
    one = F.struct(F.floor(n / 2).alias("at"), F.lit(40).cast("long").alias("removed"), F.concat(F.lit(" edited passage "), F.col("doc_id").cast("string")).alias("added"))
    two = F.struct(F.floor(n * 3 / 4).alias("at"), F.lit(0).cast("long").alias("removed"), F.lit(" and a note").alias("added"))
    docs = table(spark, sf_dir, "documents").withColumn("edits", F.array(one, two))
    return apply_edits(token_trees(docs, keep=("edits",))).select("doc_id", "tokens_before", "n_tokens", "n_chars", "chars_encoded", "nodes_written", leaf_count(F.col("tree_chars")).alias("leaves"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more of every text that stand in another document too."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text; base_sha256 is over the spans of the patterns, n_crf counts those that the field adds."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != KINDS[3]), name), ",")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans"), count(KINDS[3]))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies over all texts: four words, 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back; n_chunks follows."""
    return archived_pages(read_archives(write_archives(table(spark, sf_dir, "pages"))))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language over all texts."""
    return collocations(table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every text, learned from the labels outside the held-out fifth."""
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of sources of a language, and the ten terms by which each source parts from it."""
    return source_divergence(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_fingerprints, op3_chat_format, op4_language_id, op5_mix_sources, op6_token_counts, op7_substring_dedup, op8_secret_scan, op9_minhash, op10_warc,
        op11_collocations, op12_quality, op13_source_divergence, pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op3_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
               CAST(sum(4 + length(role) + 2 + length(regexp_replace(text, '(\\*)(###|</turn>)', '\\\1\2', 'g')) + 9) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    "op10_warc": """
        WITH d AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to,
               CASE WHEN first_id <> page_id OR payload_bytes = 0 THEN 1 ELSE CAST(ceil(payload_bytes / 65536.0) AS BIGINT) END AS n_chunks
        FROM f
    """,
    # For a repetition limit the exponent has a closed form, which the bisection reaches to 2**-40.
    "op5_mix_sources": r"""
        WITH t AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n FROM documents),
        s AS (SELECT source, CAST(sum(n) AS BIGINT) AS tokens FROM t GROUP BY source),
        g AS (SELECT CAST(sum(tokens) AS DOUBLE) AS total, CAST(max(tokens) AS DOUBLE) AS hi, CAST(min(tokens) FILTER (tokens > 0) AS DOUBLE) AS lo FROM s),
        a AS (SELECT total, hi, CASE WHEN hi / lo <= 4 THEN 0.0::DOUBLE ELSE 1 - ln(4.0::DOUBLE) / ln(hi / lo) END AS alpha FROM g),
        p AS (SELECT source, tokens, total, hi, alpha, CASE WHEN tokens > 0 THEN exp(alpha * ln(tokens / total)) ELSE 0 END AS e FROM s, a),
        z AS (SELECT *, sum(e) OVER () AS z FROM p),
        w AS (SELECT source, tokens, e / z AS weight, greatest(CAST(floor(e / z * (total * z * exp((1 - alpha) * ln(hi / total))) + 0.000001) AS BIGINT), tokens) AS budget, CAST(greatest(1, ceil(tokens / 65536.0)) AS BIGINT) AS blocks FROM z),
        v AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM w),
        d AS (SELECT doc_id, t.source, n, weight, whole, rest, CAST('0x' || substr(md5('5:' || doc_id), 1, 15) AS BIGINT) % blocks AS block FROM t JOIN v ON v.source IS NOT DISTINCT FROM t.source),
        c AS (SELECT *, CAST('0x' || substr(md5('5:' || whole || ':' || coalesce(source, '-') || ':' || block), 1, 15) AS BIGINT) AS bk, CAST('0x' || substr(md5('5:' || whole || ':' || doc_id), 1, 15) AS BIGINT) AS dk FROM d WHERE rest > 0),
        b AS (SELECT source, block, bk, rest, sum(n) AS size FROM c GROUP BY source, block, bk, rest),
        f AS (SELECT *, rest - coalesce(sum(size) OVER (PARTITION BY source ORDER BY bk, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM b),
        i AS (SELECT c.*, room, size, sum(n) OVER (PARTITION BY c.source, c.block ORDER BY dk, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM c JOIN f ON f.source IS NOT DISTINCT FROM c.source AND f.block = c.block WHERE room > 0),
        r AS (SELECT doc_id, source, n, unnest(range(whole)) AS pass, block, weight FROM d UNION ALL SELECT doc_id, source, n, whole, block, weight FROM i WHERE room >= size OR upto <= room)
        SELECT doc_id, source, n AS n_tokens, pass, block, CAST('0x' || substr(md5('5:' || pass || ':' || coalesce(source, '-') || ':' || block), 1, 15) AS BIGINT) AS block_key,
               CAST('0x' || substr(md5('5:' || pass || ':' || doc_id), 1, 15) AS BIGINT) AS doc_key, round(weight, 9) AS weight FROM r
    """,
    "op9_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                     ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END AS l FROM w),
        s AS (SELECT DISTINCT doc_id, hash(x) AS h FROM (SELECT doc_id, unnest(l) AS x FROM g)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        k AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 80 * (x.n + y.n - i)),
        e AS (SELECT u, v FROM k UNION ALL SELECT v, u FROM k),
        r AS (SELECT doc_id AS node, doc_id AS label FROM documents UNION SELECT e.v, r.label FROM r JOIN e ON e.u = r.node)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.label AS component_id, c.label = d.doc_id AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(label) AS label FROM r GROUP BY node) c ON c.node = d.doc_id
    """,
    "op11_collocations": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
        s AS (SELECT id, lang, unnest(pieces) AS piece, unnest(range(len(pieces))) AS k FROM d),
        w AS (SELECT id, lang, k, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM s),
        o AS (SELECT id, lang, k, unnest(ws) AS w1, unnest(range(len(ws))) AS i FROM w),
        t AS (SELECT lang, w1, lead(w1) OVER q AS w2, lead(w1, 2) OVER q AS w3 FROM o WINDOW q AS (PARTITION BY id, k ORDER BY i)),
        f1 AS (SELECT lang, w1, CAST(count(*) AS HUGEINT) AS f FROM t GROUP BY ALL),
        f2 AS (SELECT lang, w1, w2, CAST(count(*) AS HUGEINT) AS f FROM t WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        f3 AS (SELECT lang, w1, w2, w3, CAST(count(*) AS HUGEINT) AS f FROM t WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
        inside AS (SELECT lang, w1, w2, max(f) AS longer FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
        c AS (
            SELECT f2.lang, f2.w1 || ' ' || f2.w2 AS phrase, f2.f AS a, 1 AS k, x.f AS l, y.f AS r
            FROM f2 JOIN f1 x ON x.lang = f2.lang AND x.w1 = f2.w1 JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
                 LEFT JOIN inside ON inside.lang = f2.lang AND inside.w1 = f2.w1 AND inside.w2 = f2.w2
            WHERE longer IS NULL OR 100 * longer < 50 * f2.f
            UNION ALL
            SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 1, x.f, y.f
            FROM f3 JOIN f1 x ON x.lang = f3.lang AND x.w1 = f3.w1 JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
            UNION ALL
            SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3, f3.f, 2, x.f, y.f
            FROM f3 JOIN f2 x ON x.lang = f3.lang AND x.w1 = f3.w1 AND x.w2 = f3.w2 JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3
        ),
        e AS (SELECT *, 1000000 * a * a // (l * r) AS score FROM c),
        b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
        SELECT z.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
    """,
    "op13_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
            FROM documents
        ),
        t AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
        k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
        c AS (SELECT t.lang, source, t.term, count(*) AS n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
        lt AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
        lc AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
        p AS (
            SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (coalesce(s.total, 0) + 2 * v.v) AS BIGINT) AS p
            FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
        ),
        q AS (SELECT lc.lang, lc.term, CAST(1 + CAST(1000000000 AS HUGEINT) * (lc.n + 2) // (lt.total + 2 * v.v) AS BIGINT) AS q FROM lc JOIN lt ON lt.lang = lc.lang JOIN v ON v.lang = lc.lang),
        pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
        every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
        terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM every UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
    """,
}

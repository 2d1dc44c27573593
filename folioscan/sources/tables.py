"""Readers and writers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SCHEMA = (
    "chunk_id string, doc_id string, doc_type string, title string, source string, section string, section_num string, section_path string, "
    "page_num int, printed_page string, status string, chunk_index int, total_chunks_in_section int, tags array<string>, oem string, chunk_type string, "
    "table_id string, columns array<string>, coach_type array<string>, subsystem string, issue_date string, revision string, letter_no string, "
    "supersedes array<string>, download_url string, text string, char_count int"
)
REGISTER_DEFAULTS = {"doc_type": "", "title": "", "source": "", "system": "", "subsystem": "", "issue_date": "", "revision": "", "letter_no": "", "context_header": "", "status": ""}
FEEDBACK_LIMITS = {"note": 500, "correction": 500, "question": 500, "answer": 2000}
LEDGER = ["timestamp", "commit", "k", "rerank", "recall", "mrr", "value_retrieved", "guard", "ctx_chars_mean", "cases", "status", "description"]


def read_jsonl(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, a missing path is an empty table."""
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header, also behind a byte order mark; fields may hold line ends."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8")
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*(c.lstrip("\ufeff") for c in df.columns))


def register(rows: DataFrame) -> DataFrame:
    """Register rows with the defaults of missing or null fields; arrays become empty."""
    for name, default in REGISTER_DEFAULTS.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(default)) if name in rows.columns else F.lit(default))
    for name in ("coach_type", "supersedes"):
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.array().cast("array<string>")) if name in rows.columns else F.array().cast("array<string>"))
    return rows


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; using the result fails if there is none."""
    found = rows.where(F.col(key) == value)
    n = found.agg(F.count(F.lit(1)).alias("n")).select(F.assert_true(F.col("n") > 0, F.lit(f"unknown {key}: {value}")).isNull().alias("ok"))
    return found.join(F.broadcast(n), F.col("ok")).drop("ok")


def page_span(first: Column, last: Column, pages: Column) -> tuple[Column, Column]:
    """A registered page range clamped to the document: never empty, never outside."""
    low = F.least(F.greatest(F.coalesce(first, F.lit(1)), F.lit(1)), F.greatest(pages, F.lit(1)))
    return low, F.greatest(low, F.least(F.coalesce(last, pages), pages))


def ocr_state(pages: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """pages with ocr_text and ocr_attempted: never tried (null), tried and empty (''), or text."""
    return pages.join(cache.select(*keys, F.col("text").alias("ocr_text")), keys, "left").withColumn("ocr_attempted", F.col("ocr_text").isNotNull())


def event_json(df: DataFrame, reserved: list[str] = ()) -> DataFrame:
    """One JSON text per row; reserved names are left out, nulls too."""
    return df.select(F.to_json(F.struct(*(c for c in df.columns if c not in reserved))).alias("value"))


def feedback_rows(df: DataFrame) -> DataFrame:
    """Feedback with each free field cut to its limit and nulls as ''."""
    for name, most in FEEDBACK_LIMITS.items():
        df = df.withColumn(name, F.substring(F.coalesce(F.col(name), F.lit("")), 1, most))
    return df


def append_ledger(row: DataFrame, path: str) -> None:
    """Appends evaluation rows to a tab-separated ledger; each part file has the header."""
    row.select(*LEDGER).write.mode("append").option("sep", "\t").option("header", True).csv(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a ledger as text columns; header lines aren't rows."""
    return spark.read.option("sep", "\t").schema(", ".join(f"{c} string" for c in LEDGER)).csv(path).where("timestamp <> 'timestamp'")


def missing_objects(wanted: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """What an upload still has to do: keys that the store doesn't list."""
    return wanted.join(listing.select(key), key, "left_anti")


def assembled_vectors(keys: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """row_id, embedding in row order; using the result fails where the cache lacks a key."""
    joined = keys.join(cache.select(key, "embedding"), key, "left")
    return joined.select("row_id", F.when(F.col("embedding").isNotNull(), F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("no vector for "), F.col(key)))).alias("embedding")).orderBy("row_id")


def webhook_rows(feedback: DataFrame) -> DataFrame:
    """Feedback as the rows of a sheet: ratings checked, fields cut to their limits, lists joined, nulls as ''.

    feedback: message_id, request_id, rating, reasons and sources (arrays), note, correction,
    question, answer, answer_preview, provider.
    """
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    listed = lambda c, most, n, by: F.array_join(F.transform(F.slice(F.coalesce(F.col(c), F.array().cast("array<string>")), 1, most), lambda x: cut(x, n)), by)
    answer = F.coalesce(F.nullif(F.col("answer"), F.lit("")), F.col("answer_preview"))
    rating = F.when(F.col("rating").isin("up", "down"), F.col("rating")).otherwise("unknown")
    short = {"note": 1000, "correction": 1000, "question": 1000, "provider": 60}
    return feedback.select(cut(F.col("request_id"), 200).alias("request_id"), cut(F.col("message_id"), 200).alias("message_id"), rating.alias("rating"), listed("reasons", 8, 40, ", ").alias("reasons"), *(cut(F.col(c), n).alias(c) for c, n in short.items()), cut(answer, 4000).alias("answer"), listed("sources", 20, 120, "; ").alias("sources"))

"""Canonical exact document fingerprints (operator 2).

A text's canonical form is NFKC, case folding, NFKC again and white space runs folded to one
space; its fingerprint is the 128-bit xxhash of that form's UTF-8 bytes. Documents with equal
fingerprints are grouped by comparing the bytes themselves, so a collision parts again.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import materialize, only_read, small_batches, written

ROWS_PER_RANGE, MOST_RANGES = 4_000, 20_000


def canonical(text: str) -> bytes:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        return " ".join(text.split()).encode()
    return " ".join(text.lower().split()).encode()


def fingerprint(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text or ""))


def _printer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.string())], names=["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row; a null text counts as empty. Nothing is shuffled."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(_printer, "doc_id long, fingerprint string")


def likeness(a: str, b: str):
    """Of two fingerprint columns: 1 if the canonical texts are the same, else 0."""
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.lit(0.0))


def groups_of(rows: DataFrame) -> DataFrame:
    """doc_id, group_id from doc_id, fingerprint, packed (compressed canonical bytes): byte comparison inside equal buckets.

    Equal bytes compress to equal bytes, so grouping by (fingerprint, packed) compares them.
    The minimum is taken per task before anything moves; a hot group is one row per task. It
    is written before rows meet it: both sides of that join are plain shuffles, which adaptive
    execution can split.
    """
    same = materialize(rows.groupBy("fingerprint", "packed").agg(F.min("doc_id").alias("group_id")), "groups")
    return rows.join(same, ["fingerprint", "packed"]).select("doc_id", "group_id", F.col("fingerprint").alias("g_fingerprint"))


def _shared(printed: DataFrame) -> DataFrame:
    """The fingerprints that more than one row has, written: see groups_of."""
    return materialize(printed.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint"), "shared")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, group_id (smallest doc_id with the same canonical bytes) of every row.

    Null and empty texts are one group. Rows that repeat are each in the same group; a row
    without id gets its group's id (null if no member has one). Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    printed = materialize(fingerprints(rows), "prints")
    shared = _shared(printed)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            forms = [canonical(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_hexdigest(f) for f in forms]), pa.array([squeeze.compress(f) for f in forms], pa.binary())], names=["doc_id", "fingerprint", "packed"])

    packed = materialize(small_batches(rows).mapInArrow(pack, "doc_id long, fingerprint string, packed binary").join(shared, "fingerprint", "left_semi"), "packed")
    grouped = groups_of(packed).distinct()
    return printed.join(grouped, (printed["fingerprint"] == grouped["g_fingerprint"]) & printed["doc_id"].eqNullSafe(grouped["doc_id"]), "left").select(printed["doc_id"], "fingerprint", F.coalesce("group_id", printed["doc_id"]).alias("group_id"))


def _bounds(ids: DataFrame) -> np.ndarray:
    """Ascending ids that cut the rows into ranges of about ROWS_PER_RANGE; their number is bounded."""
    rows = ids.count()
    ranges = min(MOST_RANGES, -(-rows // ROWS_PER_RANGE))
    if ranges < 2:
        return np.zeros(0, np.int64)
    cuts = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * MOST_RANGES // 100)).first()[0]
    return np.unique(np.array([x for x in cuts or [] if x is not None], np.int64))


def _packer(bounds: np.ndarray, tails: dict[int, list[int]]):
    """Text rows by range, newest id first; the first of a range also ends the range before it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            part, tail, own, text = [], [], [], []
            for i, x in zip(ids, batch.column(1), strict=True):
                sort = i if i is not None else np.iinfo(np.int64).min
                packed = squeeze.compress((x.as_py() or "").encode())
                for p, is_tail in [(int(np.searchsorted(bounds, sort, "right")), False), *((p, True) for p in tails.get(sort, ()))]:
                    part.append(p)
                    tail.append(is_tail)
                    own.append(i)
                    text.append(packed)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(tail, pa.bool_()), pa.array(own, pa.int64()), pa.array(text, pa.binary())], names=["part", "tail", "doc_id", "packed"])

    return pack


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, canonical binary"


def _editor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task in order: each text is edited with the row behind it."""
    unpack, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
    held = None  # (part, doc_id, text, fingerprint, canonical bytes if asked for) that waits for the next row
    asked: set = set()
    done: list[tuple] = []

    def out() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _EDITED.split(", ")])
        done.clear()
        return batch

    for batch in batches:
        for row in batch.to_pylist():
            if row["packed"] is None:  # a mark: this document shares its fingerprint
                asked = {row["doc_id"]}
                continue
            text = unpack.decompress(row["packed"]).decode()
            form = canonical(text)
            own = xxhash.xxh3_128_hexdigest(form)
            if held is not None and held[0] == row["part"]:
                done.append(_edited(held, text, own))
            held = None
            if not row["tail"]:
                held = (row["part"], row["doc_id"], text, own, squeeze.compress(form) if row["doc_id"] in asked else None)
        if done:
            yield out()
    if done:
        yield out()


def _edited(held: tuple, following: str, next_print: str) -> tuple:
    _, doc_id, text, own, form = held
    n = len(text)
    edited = text[: n - n // 3] + following[: n // 3]
    return doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), own, fingerprint(edited), next_print, form


def edit_check(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts, and of each text whose last third is the next document's beginning.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    group_id. The next document is the one before it by doc_id; after the smallest comes the
    largest. Rows that repeat an id follow each other by their texts; a null id is the
    smallest. Null texts are empty. Texts move once, compressed, dealt by ranges of the id.
    """
    since = written()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = rows.select("doc_id")
    bounds = _bounds(ids)
    least = F.lit(int(np.iinfo(np.int64).min))
    part = F.size(F.filter(F.array(*map(F.lit, bounds.tolist())), lambda b: b <= F.coalesce("doc_id", least))) if len(bounds) <= 500 else None
    found = _range_heads(ids, bounds) if part is None else {r[0]: r[1] for r in ids.groupBy(part.alias("p")).agg(F.max(F.coalesce("doc_id", least))).collect()}
    order = sorted(found, reverse=True)
    tails: dict[int, list[int]] = {}
    for p, behind in zip(order, [*order[1:], *order[:1]], strict=True):
        tails.setdefault(found[behind], []).append(p)

    printed = materialize(fingerprints(rows), "prints")
    shared = _shared(printed)
    marked = printed.join(shared, "fingerprint").select("doc_id").distinct()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0)
            at = [int(np.searchsorted(bounds, i if i is not None else np.iinfo(np.int64).min, "right")) for i in own.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([False] * len(at)), own, pa.nulls(len(at), pa.binary())], names=["part", "tail", "doc_id", "packed"])

    shape = "part int, tail boolean, doc_id long, packed binary"
    dealt = small_batches(rows).mapInArrow(_packer(bounds, tails), shape).union(small_batches(marked).mapInArrow(mark, shape))
    dealt = dealt.repartition("part").sortWithinPartitions("part", "tail", F.desc_nulls_last("doc_id"), F.asc_nulls_first("packed"))
    done = only_read(materialize(small_batches(dealt).mapInArrow(_editor, _EDITED), "edited"), since)
    grouped = groups_of(done.where("canonical is not null").select("doc_id", "fingerprint", F.col("canonical").alias("packed"))).distinct().withColumnRenamed("doc_id", "g_doc_id")
    result = done.join(grouped, F.col("doc_id").eqNullSafe(F.col("g_doc_id")) & (F.col("fingerprint") == F.col("g_fingerprint")), "left")
    return result.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"), F.coalesce("group_id", "doc_id").alias("group_id"))


def _range_heads(ids: DataFrame, bounds: np.ndarray) -> dict[int, int]:
    """The largest id of each range, for more ranges than an expression should list."""
    least = int(np.iinfo(np.int64).min)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).fill_null(least)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, own.to_numpy(), "right"), pa.int32()), own], names=["p", "doc_id"])

    return {r[0]: r[1] for r in small_batches(ids).mapInArrow(place, "p int, doc_id long").groupBy("p").agg(F.max("doc_id")).collect()}

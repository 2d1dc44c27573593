"""Substring dedup by content-defined chunking with a gear rolling hash (operator 7).

Cuts: a gear hash rolls over the words. In every passage of `length` words the places where it
is least (all of equal ones) are cuts, so that equal passages are cut at the same places,
whatever was inserted before them; periodic text is cut like any other.

Chunks run from cut to cut, so their lengths vary, and are deduplicated by digest. Chunks
shorter than a passage only name the places to look at: around cuts whose rolling hash occurs
twice every passage is hashed by itself and compared as a whole. This is spared where a chunk
of a passage's length or more is known by its digest to stand in an earlier document.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import doc_groups, materialize, only_read, small_batches, text_buffers, written
from folioscan.llm.shingles import PIECE, SEPARATOR, mix, power_sums, stream, words

PASSAGE_WORDS = 50
OPEN, SHARED, LATER = range(3)
PLACES = "row long, doc_id long, word int, words int, window long, byte_start int, byte_end int, kind int"
NO_ID = -(1 << 63)
_GEAR = stream(1, 31)[0]


def gear(hashed: np.ndarray, size: int) -> np.ndarray:
    """At each word the gear hash of at most `size` words up to it: h = (h << shift) + table[word].

    The shift moves a word out of the 64 bits before `size` further ones came. The table of
    a word is its mixed hash.
    """
    shift = -(-64 // size)
    with np.errstate(over="ignore"):
        h = mix(hashed + _GEAR)
        span = 1
        while span * shift < 64:
            h[span:] = h[span:] + (h[:-span] << np.uint64(span * shift))
            span *= 2
    return h


def cuts(hashed: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, rolling hash) of the windows before whose first word a row is cut.

    A window has length - length // 2 words, so that `length` words in a row hold
    length // 2 + 1 of them; those with the least hash among them count.
    """
    size, many = length - length // 2, length // 2 + 1
    n = len(hashed) - length + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rolling = gear(hashed, size)[size - 1 :]
    whole = row[length - 1 :] == row[:n]
    least = np.where(whole, _sliding(np.minimum, rolling, many), np.uint64(0))
    none = np.zeros(many - 1, np.uint64)
    most = _sliding(np.maximum, np.concatenate([none, least, none]), many)
    inside = np.concatenate([np.zeros(many - 1, bool), whole, np.zeros(many - 1, bool)])
    at = np.flatnonzero(_sliding(np.logical_or, inside, many) & (rolling == most))
    return at, rolling[at]


def chunks(data: np.ndarray, offsets: np.ndarray, length: int = PASSAGE_WORDS) -> tuple[np.ndarray, ...]:
    """(row, digest, first word, words, start, end) of every chunk of the rows; bytes from the row's start."""
    low, high = int(offsets[0]), int(offsets[-1])
    hashed, row = words(data, offsets)
    n = len(hashed)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    solid = ~SEPARATOR[data[low:high]]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1] - low
    inner = inner[(inner > 0) & (inner < len(solid))]
    first[inner], last[inner - 1] = solid[inner], solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    fresh = np.ones(n, bool)
    fresh[1:] = row[1:] != row[:-1]
    fresh[cuts(hashed, row, length)[0]] = True
    at = np.flatnonzero(fresh)
    stop = np.append(at[1:], n)
    digest = power_sums(hashed)(at, stop - at)
    base = offsets[:-1][row[at]] - low
    return row[at], digest.view(np.int64), at - np.searchsorted(row, row[at]), stop - at, start[at] - base, end[stop - 1] - base


def _chunker(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        ids = batch.column(0)
        for i, j in doc_groups(offsets, PIECE):
            row, digest, word, n, start, end = chunks(data, offsets[i : j + 1])
            columns = (digest, word, n, start, end)
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(pa.array(row)), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "digest", "word", "words", "byte_start", "byte_end"])


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, word (place of its first), words, byte_start, byte_end of every chunk of every row.

    Digests are over words in A-Z-insensitive form, white space aside. Null, empty and blank
    texts have no chunks. Offsets are UTF-8 bytes, end exclusive.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return small_batches(rows).mapInArrow(_chunker, "doc_id long, digest long, word long, words long, byte_start long, byte_end long")


def _sliding(best: np.ufunc, x: np.ndarray, size: int) -> np.ndarray:
    """best of x[i : i + size] at each i that has so many."""
    span = 1
    while 2 * span <= size:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - (size - span)], x[size - span :]) if size > span else x


def marks(hashed: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, rolling hash, digest, first word, words of the chunk) of the cuts of the rows' words.

    The chunk goes from the cut over the next ones to the end of the first window that makes it
    `length` words or longer; 0 words: there is none.
    """
    size = length - length // 2
    at, rolling = cuts(hashed, row, length)
    if not len(at):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    span = power_sums(hashed)
    to = np.searchsorted(at, at + (length - size))
    last = at[np.minimum(to, len(at) - 1)]
    linked = (to < len(at)) & (row[last] == row[at])
    words_ = np.where(linked, last + size - at, 0)
    digest = np.where(linked, span(at, words_), mix(rolling))
    return row[at], rolling, digest, at - np.searchsorted(row, row[at]), words_


def _marker(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            ids = batch.column(0)
            for i, j in doc_groups(offsets, PIECE):
                row, rolling, digest, word, n = marks(*words(data, offsets[i : j + 1]), length)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i).take(pa.array(row)), pa.array(rolling.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(word << 32 | n, pa.int64())],
                    names=["doc_id", "rolling", "digest", "place"],
                )

    return run


def _repeated(rows: DataFrame, key: str, across: bool, **more: Column) -> DataFrame:
    """key, first_id, twice (it stands in two documents, or else in two places), more. Counted per task before it moves."""
    last = F.max("doc_id") if across else F.count(F.lit(1))
    counts = rows.groupBy(key).agg(F.min("doc_id").alias("first_id"), last.alias("last"), *(c.alias(n) for n, c in more.items()))
    return counts.select(key, "first_id", F.expr("first_id < last" if across else "last > 1").alias("twice"), *more)


def _covered(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the ranges, high exclusive."""
    low, high = np.clip(low, 0, n), np.clip(high, 0, n)
    some = low < high
    turns = np.bincount(low[some], minlength=n + 1) - np.bincount(high[some], minlength=n + 1)
    return np.cumsum(turns[:n]) > 0


def _window_hasher(length: int):
    """The windows of `length` words of a text that may be repeated, by the cuts in them.

    A row for each: OPEN if nothing else is known of it, SHARED if it is known to stand in two
    places. Windows known to stand in an earlier document are one LATER row for each run of
    them. `row` tells texts apart, whatever their ids.
    """
    size = length - length // 2

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            found: list[list] = [[] for _ in PLACES.split(",")]
            for doc_id, packed, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = np.frombuffer(unpack.decompress(packed), np.uint8)
                hashed, _ = words(text, np.array([0, len(text)]))
                n = len(hashed) - length + 1
                if n < 1:
                    continue
                solid = np.concatenate([[False], ~SEPARATOR[text], [False]])
                edge = np.flatnonzero(solid[1:] != solid[:-1])
                start, end = edge[::2], edge[1::2]
                place, digest, link = (ranges.values.field(k).to_numpy() for k in ("place", "digest", "link"))
                word, m = place >> 32, place & 0xFFFFFFFF
                span = power_sums(hashed)
                # Rows that share an id share their ranges: a chunk counts only where it stands.
                fits = (m > 0) & (word + m <= len(hashed))
                fits[fits] = span(word[fits], m[fits]).view(np.int64) == digest[fits]
                known = [_covered(n, word[k], (word + m)[k] - length + 1) for k in (fits & (link == kind) for kind in (SHARED, LATER))]
                open_ = _covered(n, word + size - length, word + 1) & ~known[1]
                at = np.flatnonzero(open_)
                turn = np.flatnonzero(np.diff(np.concatenate([[False], known[1], [False]]).astype(np.int8)))
                low, high = turn[::2], turn[1::2] - 1
                first, stop = np.concatenate([at, low]), np.concatenate([at, high]) + length
                window = np.concatenate([span(at, length).view(np.int64), np.zeros(len(low), np.int64)])
                kind = np.concatenate([np.where(known[0][at], SHARED, OPEN), np.full(len(low), LATER)])
                key = int.from_bytes(os.urandom(8), "little", signed=True)
                values = (np.full(len(first), key), np.full(len(first), doc_id), first, stop - first, window, start[first], end[stop - 1], kind)
                for column, v in zip(found, values, strict=True):
                    column.append(v)
            schema = [pair.split() for pair in PLACES.split(", ")]
            kinds = {"long": pa.int64(), "int": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64) if c else [], pa.int64()).cast(kinds[t]) for c, (_, t) in zip(found, schema, strict=True)], names=[name for name, _ in schema])

    return windows


def _packer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=6)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress(t.as_py().encode()) if t.is_valid else None for t in batch.column(1)], pa.binary())], names=["doc_id", "packed"])


def _ranges(found: DataFrame, across: bool) -> DataFrame:
    """doc_id, ranges (place, digest, link) of the cuts that stand in two places: what to look at in each document's text.

    link tells what is known of the chunk from the cut on: LATER if an earlier document has its
    digest, SHARED if only later places do, else OPEN. Counts are written before rows are
    joined to them: both sides of the join are plain shuffles, which adaptive execution can
    split where one key holds many rows.
    """
    twice = materialize(_repeated(found, "rolling", across).where("twice").select("rolling"), "cuts")
    shared = materialize(found.join(twice, "rolling").select("doc_id", "digest", "place"), "chunks")
    known = materialize(_repeated(shared, "digest", across).where("twice").select("digest", "first_id"), "digests")
    link = F.when(F.col("first_id") < F.col("doc_id"), LATER).when(F.col("first_id") == F.col("doc_id"), SHARED).otherwise(OPEN)
    linked = shared.join(known, "digest", "left").select("doc_id", F.struct("place", "digest", link.alias("link")).alias("r"))
    return linked.groupBy("doc_id").agg(F.collect_list("r").alias("ranges"))


def _joined(places: DataFrame, across: bool) -> DataFrame:
    """Repeated windows and stretches as passages; neighbouring ones are one.

    The first document that has a window never has it as LATER. So the smallest id among the
    other rows is the first of all, and a window of a document is repeated if another
    has a row for it, or if this one knows it as SHARED.
    """
    windows = places.where(F.col("kind") < LATER)
    counts = materialize(_repeated(windows, "window", across, shared=F.max("kind")).where(F.col("twice") | (F.col("shared") == SHARED)).drop("shared"), "windows")
    columns = ("row", "doc_id", "word", "words", "byte_start", "byte_end")
    repeated = windows.join(counts, "window").where(F.col("twice") | (F.col("kind") == SHARED)).select(*columns, (F.col("doc_id") > F.col("first_id")).alias("later"))
    rows = repeated.union(places.where(F.col("kind") == LATER).select(*columns, F.lit(True))).where(F.col("doc_id") != NO_ID)
    order = Window.partitionBy("row").orderBy("word", "words")
    past, end = order.rowsBetween(Window.unboundedPreceding, -1), F.col("word") + F.col("words")
    rows = rows.withColumn("gap", F.coalesce(F.col("word") > F.max(end).over(past), F.lit(True)).cast("int"))
    upto = F.coalesce(F.max(F.when(F.col("later"), end)).over(past), F.lit(0))
    rows = rows.withColumn("stale", F.when(F.col("later"), F.greatest(end - F.greatest("word", upto), F.lit(0))).otherwise(0))
    rows = rows.withColumn("run", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = (F.max(end) - F.min("word")).cast("long")
    passages = rows.groupBy("row", "run").agg(F.first("doc_id").alias("doc_id"), F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"), size.alias("words"), (size - F.sum("stale")).alias("fresh_words"))
    return passages.select("doc_id", F.col("byte_start").cast("long"), F.col("byte_end").cast("long"), "words", "fresh_words")


def repeated_passages(docs: DataFrame, length: int = PASSAGE_WORDS, across: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, byte_start, byte_end, words, fresh_words: passages of `length` words or more that stand in other documents too.

    With across=False a second place in the same document counts as well. A passage is what
    windows of `length` words cover that each stand, as a whole, in two documents.
    fresh_words counts the passage's words outside all windows that stand in a document of a
    smaller doc_id too: a passage with 0 is a later copy through and through. Rows that share an
    id are one document, reported for each row; rows without id take part in the counts, before
    all others, and aren't reported. Null, empty and blank texts have no passages; documents
    without one give no row; other columns are ignored.
    """
    since = written()
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = small_batches(rows).mapInArrow(_marker(length), "doc_id long, rolling long, digest long, place long")
    texts = small_batches(rows).mapInArrow(_packer, "doc_id long, packed binary").where("packed is not null")
    looked = texts.join(_ranges(found, across), "doc_id").select("doc_id", "packed", "ranges")
    places = only_read(materialize(looked.mapInArrow(_window_hasher(length), PLACES), "places"), since)
    return _joined(places, across)

"""WARC archives as a chunked record table (operator 10).

Writing: pages become rows of record identifier and chunk number, sorted by record, and each
task streams its rows into one archive of gzip members, a member per record, without holding a
whole payload. A record's identifier is made of its page's values and its number among equal
pages, so a task that runs again deals the same rows to the same archives. Of equal payloads of LEAST_BYTES or more the one with the smallest page id is
a response, the others are revisits that refer to it.

Reading: a task streams one archive and yields (record, chunk number) rows with the SHA-256
of the payload up to and including that chunk; no payload is held as a whole either.

Archives lie in the cluster's shared folder, under names that depend on the partition only;
a retried task replaces its file in one step.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import fresh_path, materialize, only_read, small_batches, written

CHUNK_BYTES = 65_536
LEAST_BYTES = 100
READ_BYTES = 1 << 18
BATCH_BYTES = 8 << 20
CRLF = b"\r\n"
ROWS = "page_id long, record_id string, record_type string, refers_to long, declared_digest string, declared_bytes long, chunk_no long, chunk binary, bytes_so_far long, digest_so_far string"


RECORD = ("page_id", "digest", "url", "copy")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One row per page: page_id, digest, url, copy, payload (binary), payload_bytes, record_type, refers_to.

    (page_id, digest, url, copy) tell records apart: copy numbers pages that are equal in all
    of the rest. The decision needs digests and ids only; payloads move once, by page id, to
    meet it, unless it is small enough to be broadcast. Pages that repeat in everything are
    one row with their number before the copies are made again from it.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    keys = rows.groupBy("page_id", "digest", "url", "payload_bytes").agg(F.count(F.lit(1)).alias("copies"))
    keys = materialize(keys, "keys")
    large = keys.where(F.col("payload_bytes") >= least_bytes)
    first = materialize(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("copies").alias("n")).where("n > 1").select("digest", "first"), "first")
    later = large.join(first, "digest").where("first is not null and not (page_id <=> first)").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    notes = keys.where("copies > 1").select("page_id", "digest", "url", "copies")
    noted = materialize(later.select(F.col("page_id").alias("l_page"), F.col("digest").alias("l_digest"), "refers_to"), "revisits")
    planned = rows.join(noted, F.col("page_id").eqNullSafe(F.col("l_page")) & (F.col("digest") == F.col("l_digest")), "left").drop("l_page", "l_digest")
    if not notes.isEmpty():
        notes = notes.select(F.col("page_id").alias("n_page"), F.col("digest").alias("n_digest"), F.col("url").alias("n_url"), "copies")
        same = F.col("page_id").eqNullSafe(F.col("n_page")) & (F.col("digest") == F.col("n_digest")) & (F.col("url") == F.col("n_url"))
        planned = planned.join(notes, same, "left").drop("n_page", "n_digest", "n_url")
        repeated = planned.where("copies is not null").groupBy("page_id", "digest", "url").agg(*(F.first(c).alias(c) for c in ("payload", "payload_bytes", "refers_to", "copies")))
        repeated = repeated.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
        planned = planned.where("copies is null").drop("copies").withColumn("copy", F.lit(0).cast("long")).unionByName(repeated)
    else:
        planned = planned.withColumn("copy", F.lit(0).cast("long"))
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return planned.withColumn("record_type", kind).select(*RECORD, "payload", "payload_bytes", "record_type", "refers_to")


def chunk_rows(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Records as rows per chunk: chunk_no and chunk in place of the payload; a revisit has one empty chunk."""
    pieces = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil(F.col("payload_bytes") / chunk_bytes) - 1)).cast("long")
    return (
        records.withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), pieces)))
        .withColumn("chunk", F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.expr(f"substring(payload, cast(chunk_no * {chunk_bytes} + 1 as int), {chunk_bytes})")))
        .drop("payload")
    )


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _head(row: dict) -> bytes:
    """The WARC and HTTP headers of a record, up to where its payload begins."""
    revisit = row["record_type"] == "revisit"
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % row["payload_bytes"], b"", b""])
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:page:{row['page_id']}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_clean(row['url'])}",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        f"WARC-Payload-Length: {row['payload_bytes']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (0 if revisit else row['payload_bytes'])}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    return "\r\n".join([*lines, "", ""]).encode() + http


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        draft, final = f"{base}/.part-{part:06d}-{uuid.uuid4().hex}", f"{base}/part-{part:06d}.warc.gz"
        out, member, last, records = None, None, None, 0
        for batch in batches:
            chunks = batch.column(batch.schema.get_field_index("chunk"))
            for i, row in enumerate(batch.drop_columns(["chunk"]).to_pylist()):
                if out is None:
                    out = store.open_output_stream(draft, compression=None)
                if (record := tuple(row[c] for c in RECORD)) != last:
                    if member is not None:
                        out.write(member.compress(CRLF * 2) + member.flush())
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(member.compress(_head(row)))
                    last, records = record, records + 1
                out.write(member.compress(chunks[i].as_buffer()))
        if out is not None:
            out.write(member.compress(CRLF * 2) + member.flush())
            out.close()
            store.move(draft, final)
            yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}.warc.gz"]), pa.array([records], pa.int64())], names=["name", "records"])

    return write


def write_archives(pages: DataFrame, folder: str | None = None, chunk_bytes: int = CHUNK_BYTES, **columns: str) -> DataFrame:
    """Writes the pages' records and returns the manifest (folder, name, records), a row per archive."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    since = written()
    rows = chunk_rows(plan_records(pages, **columns), chunk_bytes)
    dealt = rows.repartition(*RECORD).sortWithinPartitions(*RECORD, "chunk_no")
    dealt = dealt.select(*RECORD, "payload_bytes", "record_type", "refers_to", "chunk")
    manifest = materialize(small_batches(dealt).mapInArrow(_writer(folder), "name string, records long").select(F.lit(folder).alias("folder"), "name", "records"), "manifest")
    return only_read(manifest, since)


def _members(stream) -> Iterator[tuple[bool, bytes]]:
    """(whether a record begins, bytes) of an archive, in bounded pieces."""
    inflate, new, data = zlib.decompressobj(31), True, b""
    while True:
        if not data:
            data = stream.read(READ_BYTES)
            if not data:
                return
        piece = inflate.decompress(data, READ_BYTES)
        yield new, piece
        new = False
        if inflate.eof:
            data, inflate, new = inflate.unused_data, zlib.decompressobj(31), True
        else:
            data = inflate.unconsumed_tail


def _header(block: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.decode() for k, _, v in (line.partition(b": ") for line in block.split(CRLF)[1:])}


def records_of(stream, chunk_bytes: int = CHUNK_BYTES) -> Iterator[dict]:
    """Chunk rows of an open archive. At most a chunk and a read buffer are held at a time."""
    buffer, state, head, left, row, digest = bytearray(), "warc", {}, 0, {}, None

    def chunk(size: int) -> dict:
        data = bytes(buffer[:size])
        del buffer[:size]
        digest.update(data)
        row["chunk_no"] += 1
        row["bytes_so_far"] += size
        return row | {"chunk": data, "digest_so_far": digest.hexdigest()}

    for new, piece in _members(stream):
        if new:
            buffer.clear()
            state = "warc"
        buffer += piece
        if state == "warc" and (at := buffer.find(b"\r\n\r\n")) >= 0:
            head = _header(bytes(buffer[:at]))
            left, state = int(head["content-length"]), "http"
            del buffer[: at + 4]
        if state == "http" and (at := buffer.find(b"\r\n\r\n")) >= 0:
            left -= at + 4
            del buffer[: at + 4]
            page = head["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
            refers = head.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
            row = {"page_id": None if page == "None" else int(page), "record_id": head["warc-record-id"], "record_type": head["warc-type"], "refers_to": int(refers) if refers else None}
            row |= {"declared_digest": head["warc-payload-digest"].removeprefix("sha256:"), "declared_bytes": int(head["warc-payload-length"]), "chunk_no": -1, "bytes_so_far": 0}
            digest, state = hashlib.sha256(), "payload"
            if not left:
                yield chunk(0)
                state = "end"
        while state == "payload" and (len(buffer) >= chunk_bytes or len(buffer) >= left):
            size = min(chunk_bytes, left)
            left -= size
            yield chunk(size)
            if not left:
                state = "end"
    if state != "end":
        raise ValueError("the archive ends inside a record")


def _reader(chunk_bytes: int):
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared_digest", pa.string()), ("declared_bytes", pa.int64()), ("chunk_no", pa.int64()), ("chunk", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                store, base = fs.FileSystem.from_uri(entry["folder"])
                held, size, serial, last = [], 0, -1, None
                with store.open_input_stream(f"{base}/{entry['name']}", compression=None) as stream:
                    for row in records_of(stream, chunk_bytes):
                        if row["chunk_no"] == 0:
                            serial += 1
                        held.append(row | {"record_id": f"{row['record_id']}#{entry['name']}:{serial}"})
                        size += len(row["chunk"]) + 300
                        if size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return read


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of the archives that a manifest lists.

    page_id, record_id (with the archive and the record's place in it, so that repeated pages
    stay apart), record_type, refers_to, declared_digest and declared_bytes (of the header),
    chunk_no, chunk, bytes_so_far, digest_so_far. A record without payload has one empty
    chunk; a revisit's payload is in the record that it refers to.
    """
    files = manifest.count()
    return manifest.repartition(max(1, files), "name").mapInArrow(_reader(chunk_bytes), ROWS)


def archived_pages(chunks: DataFrame) -> DataFrame:
    """A row per record from its chunk rows: page_id, payload_bytes, payload_digest, record_type, refers_to, n_chunks.

    A response's figures are those of the payload that was read (its digest must be the
    declared one, else the job fails); a revisit's are those that it declares.
    """
    one = chunks.groupBy("record_id").agg(
        F.first("page_id").alias("page_id"),
        F.first("record_type").alias("record_type"),
        F.first("refers_to").alias("refers_to"),
        F.first("declared_digest").alias("declared_digest"),
        F.first("declared_bytes").alias("declared_bytes"),
        F.max("bytes_so_far").alias("bytes"),
        F.max_by("digest_so_far", "chunk_no").alias("digest"),
        F.count(F.lit(1)).alias("n_chunks"),
    )
    revisit = F.col("record_type") == "revisit"
    sound = revisit | ((F.col("digest") == F.col("declared_digest")) & (F.col("bytes") == F.col("declared_bytes")))
    digest = F.when(sound, F.when(revisit, F.col("declared_digest")).otherwise(F.col("digest"))).otherwise(F.raise_error(F.concat(F.lit("damaged record "), "record_id")))
    return one.select("page_id", F.when(revisit, F.col("declared_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to", "n_chunks")

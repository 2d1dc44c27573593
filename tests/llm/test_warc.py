import hashlib
import io
import zlib

import pytest
from pyspark.sql import functions as F

from folioscan.llm import warc as Wc

ROWS = [
    (1, "http://a.example/x y", "<p>" + "long " * 40 + "</p>"), (2, "http://b.example", "<p>" + "long " * 40 + "</p>"), (9, None, "short"), (8, "u", "short"), (5, "line\r\nbreak", None), (6, "u", ""),
    (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20), (3, "u", "é" * 200_000), (4, "u", "é" * 200_000), (None, "u", "n" * 150), (10, "u", "n" * 150),
]


def expected(rows, least=100):
    first = {}
    for i, _, html in rows:
        p = (html or "").encode()
        if len(p) >= least and i is not None:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        lead = first.get(p)
        revisit = lead is not None and lead != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", lead if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("row", F.lit(2)).withColumn("payload", F.lit(3))
    chunks = Wc.read_archives(Wc.write_archives(pages)).cache()
    found = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in Wc.archived_pages(chunks).collect()]
    assert sorted(found, key=str) == expected(ROWS)
    whole = {r.page_id: b"" for r in chunks.collect()}
    for r in sorted(chunks.collect(), key=lambda r: (str(r.record_id), r.chunk_no)):
        assert len(r.chunk) <= Wc.CHUNK_BYTES
        whole[r.page_id] += bytes(r.chunk)
        if r.record_type == "response":
            assert r.digest_so_far == hashlib.sha256(whole[r.page_id]).hexdigest()
    assert whole[3] == ("é" * 200_000).encode() and whole[7] == (ROWS[6][2]).encode()
    assert sum(r.page_id == 3 for r in chunks.collect()) == -(-400_000 // Wc.CHUNK_BYTES)


def test_repeats_and_empty(spark):
    twice = [ROWS[0], ROWS[0], ROWS[7], ROWS[7]]
    pages = spark.createDataFrame(twice, "page_id long, url string, html string")
    found = Wc.archived_pages(Wc.read_archives(Wc.write_archives(pages))).collect()
    assert sorted((r.page_id, r.record_type) for r in found) == [(1, "response"), (1, "response"), (3, "response"), (3, "response")]
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert Wc.archived_pages(Wc.read_archives(Wc.write_archives(none))).collect() == []


def archive(rows):
    out = b""
    for r in rows:
        member = zlib.compressobj(1, zlib.DEFLATED, 31)
        out += member.compress(Wc._head(r) + r["payload"] + b"\r\n\r\n") + member.flush()
    return out


@pytest.mark.parametrize("read", [1, 7, 4096])
def test_any_read_size_gives_the_same_rows(monkeypatch, read):
    rows = [{"page_id": i, "record_type": "response", "refers_to": None, "url": "u", "payload": p, "payload_bytes": len(p), "digest": hashlib.sha256(p).hexdigest()} for i, p in enumerate((b"", b"a", b"\r\n\r\n" * 9, b"x" * 100))]
    monkeypatch.setattr(Wc, "READ_BYTES", read)
    found = list(Wc.records_of(io.BytesIO(archive(rows)), 16))
    for r in rows:
        own = [f for f in found if f["page_id"] == r["page_id"]]
        assert b"".join(f["chunk"] for f in own) == r["payload"] and own[-1]["digest_so_far"] == r["digest"]
        assert [f["chunk_no"] for f in own] == list(range(len(own)))


def test_a_cut_archive_is_an_error():
    p = b"payload" * 30
    row = {"page_id": 1, "record_type": "response", "refers_to": None, "url": "u", "payload": p, "payload_bytes": 999, "digest": "0"}
    with pytest.raises(ValueError, match="inside a record"):
        list(Wc.records_of(io.BytesIO(archive([row])), 16))


def test_records_do_not_depend_on_the_order_of_arrival(spark):
    """A task that runs again may get its rows in another order: it has to write the same archives."""
    rows = [(i % 40, f"u{i % 3}", f"<p>{i % 7}</p>" * 30) for i in range(300)] + [(7, "u", "same")] * 50
    plans = []
    for seed in range(2):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").orderBy(F.rand(seed)).repartition(3 + seed)
        plans.append(sorted(tuple(r) for r in Wc.plan_records(pages).drop("payload").collect()))
    assert plans[0] == plans[1] and len(plans[0]) == len(rows)
    assert len({r[:4] for r in plans[0]}) == len(rows)
    records = Wc.archived_pages(Wc.read_archives(Wc.write_archives(pages))).count()
    assert records == len(rows)

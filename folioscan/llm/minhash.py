"""MinHash near-duplicate classes with b-bit signatures (operator 9).

Every text becomes its set of word shingles; 32 bands of 4 minima name the buckets in which
candidates meet; the low 2 bits of the 128 minima, packed in four longs, estimate similarity
by bit counts with the collision correction; surviving pairs are confirmed on the full sets.

Texts with equal sets form one node first. Then every member of a bucket is compared with the
bucket's best-connected member (its leader), which joins most of a group of near copies; for
what is left in buckets whose members are in different classes, another leader follows. What
still is left goes through an exact join: counts of the shingles that a set shares with any
other left-over set bound the similarity that it can reach and the sizes of the sets that it
can reach it with; sets meet on prefixes of rare shingles, within these sizes only, and
pairs that pass the bounds and the estimate are confirmed. A link is lost only if its pair
meets in no band, which at the similarity 0.8 has a chance of (1 - 0.8**4)**32 = 5e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import materialize, only_read, small_batches, written
from folioscan.llm.components import connected_components
from folioscan.llm.shingles import mix, shingle_sets, stream

ROWS, BANDS, BITS = 4, 32, 2
MINIMA = ROWS * BANDS
_A = stream(MINIMA, 11) | np.uint64(1)
_B = stream(MINIMA, 12)
_BAND = stream(BANDS, 13)
_CHUNK = 2048
#: Turns of further leaders before the exact join, and how much wider a size level is than the one below.
LEADER_TURNS, LEVEL = 1, 1.05


def minima(hashes: np.ndarray) -> np.ndarray:
    """The 32-bit minima of a non-empty set under MINIMA multiply-shift functions."""
    least = None
    with np.errstate(over="ignore"):
        for i in range(0, len(hashes), _CHUNK):
            part = ((hashes[None, i : i + _CHUNK] * _A[:, None] + _B[:, None]) >> np.uint64(32)).astype(np.uint32).min(axis=1)
            least = part if least is None else np.minimum(least, part)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = least.reshape(BANDS, ROWS).astype(np.uint64)
        key = _BAND.copy()
        for k in range(ROWS):
            key = mix(key ^ rows[:, k]) + _BAND
        return key.view(np.int64)


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of all minima in MINIMA * BITS / 64 longs."""
    low = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _signer(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, keys, signs = [], [], [], []
            for found in shingle_sets(batch.column(1), size):
                counts.append(len(found))
                if len(found):
                    least = minima(found)
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    keys.append(bands(least))
                    signs.append(packed(least))
                else:
                    digests.append(None)
                    keys.append(None)
                    signs.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(signs, pa.list_(pa.int64()))],
                names=["doc_id", "n", "digest", "bands", "sign"],
            )

    return sign


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [pack.compress(t.encode()) if t is not None else None for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "packed"])


def _sets(column: pa.Array, size: int) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    return list(shingle_sets(pa.array([unpack.decompress(x).decode() for x in column.to_pylist()], pa.string()), size))


def _confirmer(size: int, percent: int):
    """Keeps rows (u, v, u_packed, v_packed) with 100 * intersection >= percent * union."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                left = part.column(2).dictionary_encode()
                own, other = _sets(left.dictionary, size), _sets(part.column(3), size)
                keep = []
                for i, y in zip(left.indices.to_pylist(), other, strict=True):
                    x = own[i]
                    shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _exploder(size: int):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                found = _sets(part.column(1), size)
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], names=["doc_id", "shingle"])

    return explode


def similarity_estimate(a: str, b: str) -> Column:
    """Jaccard estimate of two packed signatures: the share of equal low bits, freed of chance hits."""
    differing = sum((F.bit_count(_fold(F.col(a)[i].bitwiseXOR(F.col(b)[i]))) for i in range(MINIMA * BITS // 64)), F.lit(0))
    chance = 2.0**-BITS
    return ((1 - differing / MINIMA) - chance) / (1 - chance)


def _fold(x: Column) -> Column:
    return x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))


def least_estimate(percent: int) -> float:
    """An estimate that a pair of at least `percent` falls below with a chance of about 1e-7."""
    e = percent / 100 + (1 - percent / 100) * 2.0**-BITS
    return (e - 5.2 * (e * (1 - e) / MINIMA) ** 0.5 - 2.0**-BITS) / (1 - 2.0**-BITS)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs.

    Rows link if their sets of `size`-word shingles have a Jaccard similarity of at least
    percent / 100; component_id is the smallest id that links lead to, kept marks it.
    Null, empty and blank texts have no shingles and link with nothing, texts of fewer words
    have one shingle. Rows that repeat an id form one node and all get its class. A row
    without id is never linked: its component_id is null and it is kept. Other columns of
    docs are ignored, so their names can't clash. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    since = written()
    signed = materialize(small_batches(rows).mapInArrow(_signer(size), "doc_id long, n long, digest binary, bands array<long>, sign array<long>"), "signed")
    nodes = materialize(signed.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "sign", "bands")).alias("x")).select("digest", "x.*"), "nodes")

    buckets = nodes.select("doc_id", F.explode("bands").alias("bucket"))
    # Counts are written before rows meet them: joins of plain shuffles can be split where a key is hot.
    shared = materialize(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "buckets")
    members = materialize(buckets.join(shared, "bucket"), "members")
    if members.isEmpty():
        links = members.select(F.col("doc_id").alias("u"), F.col("doc_id").alias("v"))
    else:
        links = _links(rows, nodes, members, size, percent)
    labels = connected_components(links)
    own = nodes.select("digest", F.col("doc_id").alias("node"))
    result = (
        signed.join(own, "digest", "left")
        .join(labels, "node", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "node", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )
    return only_read(result, since)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates keeps: one row of each class.

    It is rows that are told apart, not ids: rows that share an id, or have none, get numbers of
    their own above all ids, and such rows with one text are copies like any others. Of a class
    the row with the smallest id stays. Rows without words are all kept.
    """
    since, number = written(), F.col(id_col).cast("long")
    known = docs.groupBy(number.alias("id_")).agg(F.count(F.lit(1)).alias("n_"))
    shared = materialize(known.where("n_ > 1 or id_ is null").select("id_"), "shared")
    tagged = docs.withColumn("row_", number)
    if not shared.isEmpty():
        own = number.eqNullSafe(F.col("id_"))
        above = docs.agg(F.coalesce(F.max(number), F.lit(0))).first()[0]
        numbered = docs.join(shared, own, "left_semi").withColumn("row_", F.lit(above + 1) + F.monotonically_increasing_id())
        tagged = tagged.join(shared, own, "left_anti").unionByName(materialize(numbered, "numbered"))
    copies = near_duplicates(tagged, "row_", text_col, size, percent).where(~F.col("kept")).select(F.col("doc_id").alias("row_"))
    return only_read(tagged.join(copies, "row_", "left_anti").select(docs.columns), since)


def _links(rows: DataFrame, nodes: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    signs = nodes.select("doc_id", "n", "sign")
    needed = members.select("doc_id").distinct()
    # Texts move once, compressed. A repeated id may bring a text of its own: both count.
    texts = materialize(small_batches(rows).mapInArrow(_compress, "doc_id long, packed binary").join(needed, "doc_id"), "texts")

    degree = members.groupBy("doc_id").agg(F.sum("members").alias("degree"))
    leader = members.join(degree, "doc_id").groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("doc_id")).alias("first"))).alias("x")).select("bucket", (-F.col("x.first")).alias("leader"))
    pairs = members.join(materialize(leader, "leaders"), "bucket").where("doc_id <> leader").select(F.col("leader").alias("u"), F.col("doc_id").alias("v")).distinct()
    links = materialize(_confirmed(_estimated(pairs, signs, percent), texts, size, percent), "confirmed")

    labels = connected_components(links)
    labelled = members.where("members > 2").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    left = _unsettled(labelled.select("bucket", "doc_id", F.coalesce("label", "doc_id").alias("label")))
    for turn in range(LEADER_TURNS):
        if left.isEmpty():
            return links
        more = materialize(_confirmed(_estimated(_led(left, turn), signs, percent), texts, size, percent), "confirmed")
        if more.isEmpty():
            break
        links, left = links.union(more), _unsettled(_relabelled(left, more))
    if left.isEmpty():
        return links
    crossed = _crossed(left.select("doc_id", "label").distinct(), signs, texts, size, percent)
    return links.union(_confirmed(crossed, texts, size, percent))


def _unsettled(labelled: DataFrame) -> DataFrame:
    """Of bucket, doc_id, label those rows whose bucket holds more than one label."""
    labelled = materialize(labelled, "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    return materialize(labelled.join(materialize(mixed, "mixed"), "bucket", "left_semi"), "left")


def _led(left: DataFrame, turn: int) -> DataFrame:
    """(u, v): another leader of each bucket, drawn by a hash, and the members of other classes."""
    one = left.groupBy("bucket").agg(F.max(F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("h"), F.col("doc_id").alias("leader"), F.col("label").alias("own"))).alias("x")).select("bucket", "x.leader", "x.own")
    met = left.join(materialize(one, "leaders"), "bucket").where("label <> own")
    return met.select(F.least("leader", "doc_id").alias("u"), F.greatest("leader", "doc_id").alias("v")).distinct()


def _relabelled(left: DataFrame, links: DataFrame) -> DataFrame:
    """left with the classes that new links join as one."""
    label = left.select("doc_id", "label").distinct()
    met = links.join(label.select(F.col("doc_id").alias("u"), F.col("label").alias("a")), "u").join(label.select(F.col("doc_id").alias("v"), F.col("label").alias("b")), "v")
    classes = connected_components(met.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return left.join(classes.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("bucket", "doc_id", F.coalesce("new", "label").alias("label"))


def _level(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(LEVEL))).cast("int")


def _crossed(left: DataFrame, signs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs of left-over nodes of different classes that may still reach `percent`; loses none that does.

    A shingle that no other left-over set has can't be in an intersection of two of them: of
    n shingles at most `most` are shared, so a partner has at most
    most * (100 + percent) / percent - n. In the order of rarity, two sets that are similar
    enough meet within short prefixes, and what lies behind the place where they first meet
    bounds their intersection. A family whose members each have too much of their own for any
    other of its sizes meets nowhere.
    """
    ids = left.select("doc_id")
    held = texts.join(ids, "doc_id", "left_semi").mapInArrow(_exploder(size), "doc_id long, shingle long")
    common = materialize(held.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "common")
    placed = materialize(held.join(common, "shingle"), "shared")
    able = left.join(signs, "doc_id").join(placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("most")), "doc_id")
    able = materialize(able.where(F.col("most") * 100 >= F.col("n") * percent), "able")

    rarest = Window.partitionBy("doc_id").orderBy("c", "shingle")
    placed = placed.join(able, "doc_id").withColumn("place", F.row_number().over(rarest) + F.col("n") - F.col("most") - 1)
    placed = placed.where(F.col("place") <= F.col("n") - _ceil(F.col("n") * percent, 100)).select("shingle", "place", "doc_id", "label", "n", "most", "sign")
    placed = materialize(placed, "prefixes")
    largest = F.least(F.floor(F.col("n") * 100 / percent), F.floor(F.col("most") * (100 + percent) / percent) - F.col("n"))
    a = placed.where((F.col("place") <= F.col("n") - _ceil(F.col("n") * (2 * percent), 100 + percent)) & (largest >= F.col("n")))
    a = a.withColumn("level", F.explode(F.sequence(_level(F.col("n")), _level(largest))))
    b = placed.select(_level(F.col("n")).alias("level_"), F.col("shingle").alias("shingle_"), *(F.col(c).alias(f"{c}_") for c in ("place", "doc_id", "label", "n", "most", "sign")))
    need = _ceil((F.col("n") + F.col("n_")) * percent, 100 + percent)
    smaller = F.struct("n", "most", "doc_id") < F.struct(F.col("n_").alias("n"), F.col("most_").alias("most"), F.col("doc_id_").alias("doc_id"))
    behind = F.least(F.col("n") - F.col("place"), F.col("n_") - F.col("place_"))
    possible = smaller & (F.col("label") != F.col("label_")) & (F.least("most", "most_", behind) >= need) & (similarity_estimate("sign", "sign_") >= least_estimate(percent))
    met = a.join(b, (a["shingle"] == b["shingle_"]) & (a["level"] == b["level_"]) & possible)
    return met.select(F.col("doc_id").alias("u"), F.col("doc_id_").alias("v")).distinct()


def _ceil(x: Column, divisor: int) -> Column:
    return F.floor((x + (divisor - 1)) / divisor)


def _estimated(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    u = signs.select(F.col("doc_id").alias("u"), F.col("sign").alias("u_sign"), F.col("n").alias("u_n"))
    v = signs.select(F.col("doc_id").alias("v"), F.col("sign").alias("v_sign"), F.col("n").alias("v_n"))
    sizes = F.least("u_n", "v_n") * 100 >= F.greatest("u_n", "v_n") * percent
    return pairs.join(u, "u").join(v, "v").where(sizes & (similarity_estimate("u_sign", "v_sign") >= least_estimate(percent))).select("u", "v")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    u = texts.select(F.col("doc_id").alias("u"), F.col("packed").alias("u_packed"))
    v = texts.select(F.col("doc_id").alias("v"), F.col("packed").alias("v_packed"))
    both = pairs.join(v, "v").join(u, "u").select("u", "v", "u_packed", "v_packed")
    return small_batches(both).mapInArrow(_confirmer(size, percent), "u long, v long")

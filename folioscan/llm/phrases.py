"""Phrases by vertical positional lists (operator 11).

Texts, A-Z lower-cased, are cut into pieces at . , ; : ! ? and line ends, pieces into words at
spaces and tabs. Texts of a language are dealt to shards of some million bytes, cut only between
pieces; a shard's words are numbered through, with a free place between two pieces. For each
shard and word the index holds the list of its places: its length is the word's frequency.

A phrase of frequent words stands where the place after one of its occurrences is on the list
of the next word: in each shard the lists are merge-joined by place, which gives the lists of
pairs; frequent pairs are extended by the words that follow them in a frequent pair. List
lengths are summed over shards by phrase, in parts of bounded size that hold packed keys.
Nothing is broadcast; a task holds one shard or one part.

Odd input: null text is empty, null language is 'und' (as the language of that name). Repeated
rows count each. Without phrases there is no result. Other columns are not read. Word numbers
have 31 bits: 2 billion different words of `least` occurrences are the most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import materialize, only_read, small_batches, written
from folioscan.llm.shingles import mix

SHARD_BYTES, PART_KEYS, NUMBER_RANGES, SHARES = 8 << 20, 2_000_000, 4096, 16
_END = b".,;:!?\n\x0b\x0c\r"
#: Piece ends become full stops, tabs become spaces, A-Z become a-z.
PIECE_BYTES = bytes(46 if b in _END else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))

_LISTS = "shard long, lang string, word binary, n int, places binary"
_PARTED = "part long, shard long, keys binary, thirds binary, counts binary"
_PAIRS = "shard long, keys binary, pairs array<struct<pair:long,a:long>>"


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each value in them): seven bits a byte, the eighth says that more follow."""
    values = values.astype(np.uint64)
    width = 1 + sum((values >= np.uint64(1 << (7 * k))).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(width.max(initial=0))):
        has = width > k
        more = (width[has] > k + 1).astype(np.uint8) << 7
        out[(ends - width)[has] + k] = ((values[has] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128) + 1
    starts = np.concatenate([[0], ends[:-1]])
    out = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max(initial=0))):
        has = ends - starts > k
        out[has] |= (data[starts[has] + k] & 127).astype(np.int64) << (7 * k)
    return out


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of consecutive slices of data."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def _lists_of(shard: int, lang: str, texts: list[bytes]) -> pa.RecordBatch:
    """The shard's list of each word: first place, then steps, packed."""
    words = pa.array(b" . ".join(texts).replace(b".", b" . ").split(), pa.binary()).dictionary_encode()
    number, names = words.indices.to_numpy(), words.dictionary
    order = np.argsort(number, kind="stable")
    n = np.bincount(number, minlength=len(names))
    steps = np.diff(order, prepend=0)
    firsts = (np.cumsum(n) - n).astype(np.int64)
    steps[firsts] = order[firsts]
    data, ends = pack(steps)
    rows = pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(names), shard)), pa.array([lang] * len(names), pa.string()), names, pa.array(n.astype(np.int32)), _binaries(data, ends[np.cumsum(n) - 1] if len(n) else ends)], names=["shard", "lang", "word", "n", "places"]
    )
    return rows.filter(pc.not_equal(rows.column(2), pa.scalar(b".", pa.binary())))


def _indexer(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rest = text.as_py().translate(PIECE_BYTES)
                while rest:
                    cut = rest.find(b".", limit) + 1 or len(rest)
                    held.setdefault(lang, []).append(rest[:cut])
                    size[lang] = size.get(lang, 0) + cut
                    rest = rest[cut:]
                    if size[lang] >= limit:
                        yield _lists_of(task << 32 | made, lang, held.pop(lang))
                        size[lang], made = 0, made + 1
        for lang, texts in held.items():
            yield _lists_of(task << 32 | made, lang, texts)
            made += 1

    return index


def _words_at(lists: pa.Table) -> np.ndarray:
    """The number of the frequent word at each place of a shard, -1 where there is none: its lists, merged."""
    n, steps = lists["n"].to_numpy(), unpack(_bytes(lists["places"]))
    places, firsts = np.cumsum(steps), np.cumsum(n) - n
    places -= np.repeat(places[firsts] - steps[firsts], n)
    at = np.full(int(places.max(initial=-1)) + 2, -1, np.int64)
    at[places] = np.repeat(lists["id"].to_numpy(), n)
    return at


def _parts_of(keys: np.ndarray, thirds: np.ndarray | None, counts: np.ndarray, shard: int, parts: int) -> pa.Table:
    """Keys dealt to parts by their hash, a row a part; thirds: the third word of keys of three."""
    with np.errstate(over="ignore"):
        mixed = mix(keys.astype(np.uint64) + (0 if thirds is None else mix(thirds.astype(np.uint64))))
    part = (mixed % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    names, ends = np.unique(part[order], return_index=True)
    ends = np.append(ends[1:], len(order))[: len(names)]
    at = lambda width: _binaries(np.empty(0, np.uint8), ends * 0) if width is None else _binaries(width[order].view(np.uint8), ends * 8)
    data, byte_ends = pack(counts[order])
    packed = _binaries(data, byte_ends[ends - 1] if len(ends) else ends)
    return pa.table({"part": names, "shard": np.full(len(names), shard), "keys": at(keys), "thirds": at(thirds), "counts": packed})


def _pair_counter(parts: int) -> Callable[[pa.Table], pa.Table]:
    def count(lists: pa.Table) -> pa.Table:
        at = _words_at(lists)
        both = (at[:-1] >= 0) & (at[1:] >= 0)
        keys, counts = np.unique((at[:-1] << 32 | at[1:])[both], return_counts=True)
        return _parts_of(keys, None, counts, lists["shard"][0].as_py(), parts)

    return count


def _frequent_pairs(least: int) -> Callable[[pa.Table], pa.Table]:
    def sum_up(part: pa.Table) -> pa.Table:
        """Frequent pairs of the part with their sums, and, a row a shard, those of each shard."""
        keys, counts = _bytes(part["keys"]).view(np.int64), unpack(_bytes(part["counts"]))
        sizes = np.array([len(x) // 8 for x in part["keys"].to_pylist()], np.int64)
        shards, row = part["shard"].to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
        known, place = np.unique(keys, return_inverse=True)
        total = np.bincount(place, counts, len(known)).astype(np.int64)
        kept = total[place] >= least
        ends = np.cumsum(np.bincount(row[kept], minlength=len(shards))) * 8
        found = pa.StructArray.from_arrays([pa.array(known[total >= least]), pa.array(total[total >= least])], ["pair", "a"])
        pairs = pa.ListArray.from_arrays(pa.array([0] * (len(shards) + 1) + [len(found)], pa.int32()), found)
        own = pa.concat_arrays([_binaries(keys[kept].view(np.uint8), ends), pa.array([b""], pa.binary())])
        return pa.table({"shard": pa.array([*shards.tolist(), None], pa.int64()), "keys": own, "pairs": pairs})

    return sum_up


def _triple_counter(parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def count(lists: pa.Table, pairs: pa.Table) -> pa.Table:
        at, frequent = _words_at(lists) if len(lists) else np.full(2, -1), np.sort(_bytes(pairs["keys"]).view(np.int64))
        key = np.where((at[:-1] >= 0) & (at[1:] >= 0), at[:-1] << 32 | at[1:], -1)
        rank = np.searchsorted(frequent, key)
        held = np.flatnonzero(frequent[np.minimum(rank, len(frequent) - 1)] == key) if len(frequent) else np.zeros(0, np.int64)
        first = held[:-1][np.diff(held) == 1]  # a list of pairs, joined with itself one place on
        rows, counts = _counted(rank[first], at[first + 2])
        shard = (lists if len(lists) else pairs)["shard"][0].as_py()
        return _parts_of(frequent[rows[0]] if len(frequent) else rows[0], rows[1], counts, shard, parts)

    return count


def _counted(one: np.ndarray, two: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Distinct (one, two) and how often each stands there."""
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    new = np.flatnonzero(np.append(True, (np.diff(one) != 0) | (np.diff(two) != 0))[: len(one)])
    return (one[new], two[new]), np.diff(np.append(new, len(one)))


def _frequent_triples(least: int) -> Callable[[pa.Table], pa.Table]:
    def sum_up(part: pa.Table) -> pa.Table:
        keys, thirds, counts = _bytes(part["keys"]).view(np.int64), _bytes(part["thirds"]).view(np.int64), unpack(_bytes(part["counts"]))
        order = np.lexsort((thirds, keys))
        keys, thirds, counts = keys[order], thirds[order], counts[order]
        new = np.flatnonzero(np.append(True, (np.diff(keys) != 0) | (np.diff(thirds) != 0))[: len(keys)])
        total = np.add.reduceat(counts, new) if len(new) else counts
        kept = total >= least
        return pa.table({"pair": keys[new][kept], "third": thirds[new][kept], "a": total[kept]})

    return sum_up


def _parts(rows: int | None) -> int:
    return max(1, -(-int(rows or 0) // PART_KEYS))


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a a / (l r)), exact up to counts of 15 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def _numbered(counts: DataFrame) -> DataFrame:
    """counts with an id of each word, in ranges by hash, so that no task numbers them all."""
    by_range = Window.partitionBy("range").orderBy("lang", "word")
    ranged = counts.withColumn("range", F.pmod(F.xxhash64("lang", "word"), F.lit(NUMBER_RANGES)))
    return ranged.withColumn("id", (F.row_number().over(by_range) - 1).cast("long") * NUMBER_RANGES + F.col("range")).drop("range")


def phrase_counts(docs: DataFrame, least: int = 10, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, triples, sizes) of all phrases of 2 and 3 words that occur `least` times, by language.

    pairs: pair, lang, w1, w2, l, r, a (frequencies of w1, w2 and both); triples: pair, third,
    next (the pair of its last two words), a; sizes: lang, n of all its words.
    """
    read = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    index = materialize(small_batches(read).mapInArrow(_indexer(shard_bytes), _LISTS), "index")
    counts = index.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = materialize(_numbered(counts), "words")
    sizes = materialize(index.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    lists = materialize(index.join(words, ["lang", "word"]).select("shard", "id", "n", "places"), "lists")

    occurrences = words.agg(F.sum("f")).first()[0]
    parted = lists.groupBy("shard").applyInArrow(_pair_counter(_parts(occurrences)), _PARTED)
    pairs = materialize(parted.groupBy("part").applyInArrow(_frequent_pairs(least), _PAIRS), "pairs")
    named = pairs.where("shard is null").select(F.explode("pairs").alias("x")).select("x.pair", "x.a")
    one = words.select(F.col("id").alias("i1"), "lang", F.col("word").alias("w1"), F.col("f").alias("l"))
    two = words.select(F.col("id").alias("i2"), F.col("word").alias("w2"), F.col("f").alias("r"))
    keyed = named.withColumn("i1", F.shiftright("pair", 32)).withColumn("i2", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    named = materialize(keyed.join(one, "i1").join(two, "i2").select("pair", "lang", "w1", "w2", "l", "r", "a"), "named")

    held = pairs.where("shard is not null and length(keys) > 0").select("shard", "keys")
    parted = lists.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(_triple_counter(_parts(named.agg(F.sum("a")).first()[0])), _PARTED)
    triples = parted.groupBy("part").applyInArrow(_frequent_triples(least), "pair long, third long, a long")
    after = F.shiftleft(F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)), 32).bitwiseOR(F.col("third"))
    return named, materialize(triples.withColumn("next", after), "triples"), sizes


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, cover_percent: int = 50, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language.

    score is the least over a phrase's cuts, of which the first of equals counts. A phrase goes
    if a longer one that holds it has `cover_percent` of its occurrences or more.
    """
    since = written()
    pairs, triples, sizes = phrase_counts(docs, least, text_col, lang_col, shard_bytes)
    longest = triples.select(F.explode(F.array("pair", "next")).alias("pair"), "a").groupBy("pair").agg(F.max("a").alias("longer"))
    open_ = pairs.join(longest, "pair", "left").where(f"longer is null or 100 * longer < {cover_percent} * a")
    text = lambda *c: F.concat_ws(" ", *(F.col(x).cast("string") for x in c)).alias("phrase")
    short = open_.select("lang", text("w1", "w2"), "a", "l", "r", cut_score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    last = pairs.select(F.col("pair").alias("next"), F.col("w2").alias("w3"), F.col("r").alias("f3"), F.col("a").alias("f23"))
    whole = triples.join(pairs.select("pair", "lang", "w1", "w2", F.col("l").alias("f1"), F.col("a").alias("f12")), "pair").join(last, "next")
    cut = lambda k, left, right: F.struct(cut_score(F.col("a"), F.col(left), F.col(right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    long = whole.select("lang", text("w1", "w2", "w3"), "a", F.array_min(F.array(cut(1, "f1", "f23"), cut(2, "f12", "f3"))).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # The first of each share of a language before the first of all: one task gets SHARES * top rows, however many tasks there are.
    order = (F.desc("score"), F.desc("a"), "phrase")
    dealt = short.unionByName(long).withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return only_read(ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), since)

"""Models behind callables: embedding, reading, generation. Defaults are local and deterministic."""

from __future__ import annotations

import hashlib
import math
import queue
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.sources import versions
from folioscan.sources.files import shared_folder

Embedder = Callable[[list[str]], list[list[float]]]
Generator = Callable[[str], str | None]


def hashing_embedder(dim: int = 64) -> Embedder:
    """Signed feature hashing of words, length 1; the same everywhere, without a network."""

    def embed(texts: list[str]) -> list[list[float]]:
        vectors = []
        for text in texts:
            v = [0.0] * dim
            for w in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            vectors.append([x / norm for x in v])
        return vectors

    return embed


def embedded(rows: DataFrame, key: str, text: str, embedder: Embedder, batch: int = 16) -> DataFrame:
    """key, embedding: texts go to the embedder in batches, on the executors; distinct keys only."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                yield pd.DataFrame({key: part[key], "embedding": embedder([t or "" for t in part[text]])})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).dropDuplicates([key]).mapInPandas(work, f"`{key}` {kind}, embedding array<float>")


class Refused(Exception):
    """A service said no: status is its code."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(f"{status} {message}".strip())
        self.status = status


class OutOfQuota(Exception):
    """A service refuses every try of a call: asking on can't help now."""


BUSY = (429, 500, 503)


def patient(embedder: Embedder, tries: int = 7, cap: float = 45.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[list[float] | None]]:
    """An embedder that waits and tries again while the service is busy, and finds the texts that it can't take.

    Busy codes are tried `tries` times with waits of 1, 2, 4 seconds up to `cap`, then OutOfQuota
    is raised. Any other failure halves the batch until the texts that cause it stand alone;
    these get None, so one bad text costs about two calls a halving and no other its vector.
    """

    def once(texts: list[str]) -> list[list[float] | None]:
        for attempt in range(tries):
            try:
                return list(embedder(texts))
            except Refused as no:
                if no.status not in BUSY:
                    raise
                if attempt + 1 < tries:
                    sleep(min(2.0**attempt, cap))
        raise OutOfQuota(f"refused {tries} times")

    def embed(texts: list[str]) -> list[list[float] | None]:
        if not texts:
            return []
        try:
            vectors = once(texts)
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
            return vectors
        except OutOfQuota:
            raise
        except Exception:  # whatever the service dislikes about a batch
            half = len(texts) // 2
            return embed(texts[:half]) + embed(texts[half:]) if half else [None]

    return embed


def embedded_as_far(rows: DataFrame, key: str, text: str, embedder: Callable[[list[str]], list[list[float] | None]], batch: int = 16) -> DataFrame:
    """key, embedding, status of every distinct key: 'done', 'bad' (a text that no call takes) or 'left' (quota ended before it).

    embedder: as patient() makes it. A task that meets the end of its quota asks no more; what
    it has done counts. Null texts are ''.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        over = False
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                vectors: list[list[float] | None] = [None] * len(part)
                if not over:
                    try:
                        vectors = embedder([t or "" for t in part[text]])
                    except OutOfQuota:
                        over = True
                yield pd.DataFrame({key: part[key], "embedding": vectors, "status": ["left" if over else "bad" if v is None else "done" for v in vectors]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).dropDuplicates([key]).mapInPandas(work, f"`{key}` {kind}, embedding array<float>, status string")


def fill_vectors(chunks: DataFrame, path: str, key: str, text: str, embedder: Callable[[list[str]], list[list[float] | None]], batch: int = 16, parts: int = 16, every: int = 4) -> DataFrame:
    """Brings the versioned vectors at `path` up to the chunks; key, status ('bad' or 'left') of those that still lack one.

    Only keys without a vector are asked for, `every` parts at a time, each of them a
    checkpoint; after quota ended, what is done is published, and a later call goes on.
    """
    spark = chunks.sparkSession
    notes = shared_folder(spark, "embedded")

    def work(rows: DataFrame) -> DataFrame:
        at = f"{notes}/{uuid.uuid4().hex}"
        embedded_as_far(rows, key, text, embedder, batch).write.parquet(at)
        return spark.read.parquet(at).where("status = 'done'").select(key, "embedding")

    before = versions.manifest(spark, path)
    version = versions.merge(path, chunks.select(key, text), key, work, only_missing=True, parts=parts, every=every)
    if version == (before or {"version": 0})["version"]:
        return chunks.sparkSession.createDataFrame([], T.StructType([chunks.schema[key], T.StructField("status", T.StringType())]))
    return spark.read.parquet(f"{notes}/*").where("status <> 'done'").select(key, "status")


def fill_cache(chunks: DataFrame, cache: DataFrame, key: str, text: str, embedder: Embedder) -> DataFrame:
    """The cache with what it lacked: only missing keys are embedded, so a run that stopped goes on."""
    missing = chunks.join(cache.select(key), key, "left_anti")
    return cache.select(key, "embedding").unionByName(embedded(missing, key, text, embedder))


class Late(Exception):
    """A call was given up when its time was over."""


def within(call: Callable[[], str | None], seconds: float | None) -> str | None:
    """What call returns or raises; Late after `seconds`. A call that is given up ends by itself, its result is dropped."""
    if seconds is None:
        return call()
    box: queue.SimpleQueue = queue.SimpleQueue()

    def run() -> None:
        try:
            box.put((call(), None))
        except Exception as problem:
            box.put((None, problem))

    threading.Thread(target=run, daemon=True).start()
    try:
        value, problem = box.get(timeout=seconds)
    except queue.Empty:
        raise Late from None
    if problem is not None:
        raise problem
    return value


ANSWERED = "provider string, answer string, attempts array<struct<provider:string,status:string>>, rests array<struct<pool:string,until_ms:bigint,reason:string>>"


def _resting_pools(resting: DataFrame, pools: list[str]) -> DataFrame:
    """One row: a map of the pools asked here to when their rest ends; at most one entry a pool."""
    last = resting.where(F.col("pool").isin(pools)).groupBy("pool").agg(F.max("until_ms").alias("until_ms"))
    return last.agg(F.map_from_entries(F.collect_list(F.struct("pool", "until_ms"))).alias("_resting"))


def answered(prompts: DataFrame, chain: list[tuple[str, Generator]], key: str, prompt: str, deadline: float | None = None, cooldown: Callable[[Exception], float] | None = None, resting: DataFrame | None = None, cap: float | None = None, least: float = 0.0) -> DataFrame:
    """key, provider, answer, attempts, rests: providers in turn until one answers; errors and blanks go on.

    attempts: 'ok', 'empty', 'error', 'cooling' or 'late' of each provider that was looked at.
    deadline: seconds that all providers of a prompt have together; a call is given up when they
    are over (or after `cap` seconds) and is 'late', as are providers that less than `least` is
    left for. cooldown: how long a provider isn't asked after an error (0: it is). resting: pool,
    until_ms (of the epoch) of providers that others found resting; on a stream of prompts it is
    a static side, read anew for each batch by answer_batches. rests: the rests that this row's
    errors began, for others to know. A null prompt is asked as ''.
    """
    names = [name for name, _ in chain]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asleep: dict[str, float] = {}
        for frame in frames:
            rows = []
            for k, text, known in zip(frame[key], frame[prompt], frame["_resting"], strict=True):
                asleep |= {p: u for p, u in (known or {}).items() if u > asleep.get(p, 0)}
                attempts, rests, answer, began = [], [], None, time.monotonic()
                for name, generate in chain:
                    left = None if deadline is None else deadline - (time.monotonic() - began)
                    if asleep.get(name, 0) > time.time() * 1000:
                        status = "cooling"
                    elif left is not None and left <= least:
                        status = "late"
                    else:
                        try:
                            answer = within(lambda g=generate, t=text: g("" if t is None else t), min((x for x in (left, cap) if x is not None), default=None))
                            status = "ok" if answer and answer.strip() else "empty"
                        except Late:
                            status = "late"
                        except Exception as problem:  # a provider may fail in any way; the next one is asked
                            status, rest = "error", cooldown(problem) if cooldown else 0.0
                            if rest > 0:
                                asleep[name] = time.time() * 1000 + rest * 1000
                                rests.append({"pool": name, "until_ms": int(asleep[name]), "reason": str(problem)[:200]})
                    attempts.append({"provider": name, "status": status})
                    if status == "ok":
                        break
                by = attempts[-1]["provider"] if attempts and attempts[-1]["status"] == "ok" else None
                rows.append((k, by, answer if by else None, attempts, rests))
            yield pd.DataFrame(rows, columns=[key, "provider", "answer", "attempts", "rests"])

    kind = prompts.schema[key].dataType.simpleString()
    rows = prompts.select(key, prompt)
    rows = rows.crossJoin(F.broadcast(_resting_pools(resting, names))) if resting is not None else rows.withColumn("_resting", F.lit(None).cast("map<string,bigint>"))
    return rows.mapInPandas(work, f"`{key}` {kind}, {ANSWERED}")


def note_rests(rests: DataFrame, cooldowns: str) -> None:
    """Puts pool, until_ms, reason into the shared table of rests at `cooldowns`; the latest end of a pool stays."""
    spark = rests.sparkSession
    for attempt in range(5):
        shown = versions.manifest(spark, cooldowns)
        every = rests.unionByName(versions.read_version(spark, cooldowns)) if shown else rests
        last = every.where("until_ms is not null").groupBy("pool").agg(F.max("until_ms").alias("until_ms"), F.max_by("reason", "until_ms").alias("reason"))
        try:
            versions.merge(cooldowns, last, "pool", parts=1)
            return
        except versions.Conflict:
            if attempt == 4:
                raise


def answer_batches(path: str, cooldowns: str, chain: list[tuple[str, Generator]], key: str, prompt: str, **limits) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: answers a batch of prompts and shares the rests of providers.

    Every batch reads the table of rests at `cooldowns` (which streaming.usage.rest_sink may
    fill as well) and notes its own, so what one task saw fail no task of a later batch asks.
    Answers are a versioned table by key at `path`; a batch that runs again asks nobody again.
    """

    def work(rows: DataFrame) -> DataFrame:
        spark = rows.sparkSession
        known = versions.read_version(spark, cooldowns) if versions.manifest(spark, cooldowns) else None
        return answered(rows, chain, key, prompt, resting=known, **limits)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = versions.manifest(spark, path)
        after = versions.merge(path, batch, key, work, only_missing=True, every=16)
        if after != (before or {"version": 0})["version"]:
            rests = versions.read_version(spark, path).join(batch.select(key), key, "left_semi").select(F.explode("rests").alias("x")).select("x.*")
            if not rests.isEmpty():
                note_rests(rests, cooldowns)

    return write


def answered_in_rounds(prompts: DataFrame, path: str, cooldowns: str, chain: list[tuple[str, Generator]], key: str, prompt: str, rounds: int = 8, **limits) -> DataFrame:
    """All prompts answered, dealt to rounds by key; rests that a round meets are known to all tasks of the next."""
    write = answer_batches(path, cooldowns, chain, key, prompt, **limits)
    for k in range(rounds):
        write(prompts.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == k), k)
    return versions.read_version(prompts.sparkSession, path)


def ladder(*readers: Callable[[bytes], str | None]) -> Callable[[bytes], str | None]:
    """A reader that asks the given ones in turn until one gives text.

    If none does, the last failure is raised, or '' is given if at least one read a blank page.
    """

    def read(image: bytes) -> str | None:
        problem, blank = None, False
        for reader in readers:
            try:
                text = reader(image)
            except Exception as e:
                problem = e
                continue
            if text and text.strip():
                return text
            blank = True
        if problem is not None and not blank:
            raise problem
        return ""

    return read


def banded(reader: Callable[[bytes], str | None], cut: Callable[[bytes], list[bytes]]) -> Callable[[bytes], str]:
    """A reader of a page's overlapping bands; lines that a band repeats from the one above come once."""

    def read(image: bytes) -> str:
        lines: list[str] = []
        for band in cut(image):
            own = [x.strip() for x in (reader(band) or "").splitlines() if x.strip()]
            shared = next((n for n in range(min(len(lines), len(own)), 0, -1) if lines[-n:] == own[:n]), 0)
            lines += own[shared:]
        return "\n".join(lines)

    return read


def read_pages(pages: DataFrame, cache: DataFrame, keys: list[str], reader: Callable[[bytes], str | None], image: str = "image", failures: int = 3) -> DataFrame:
    """keys, text of pages that the cache lacks. A task stops asking after `failures` failures in a row.

    A page that was read and is blank gives ''; a failed one gives no row and is tried again.
    """
    todo = pages.join(cache.select(*keys), keys, "left_anti")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row_failures = 0
        for frame in frames:
            done = []
            for *own, picture in zip(*(frame[k] for k in keys), frame[image], strict=True):
                if row_failures >= failures:
                    break
                try:
                    done.append((*own, reader(picture) or ""))
                    row_failures = 0
                except Exception:
                    row_failures += 1
            yield pd.DataFrame(done, columns=[*keys, "text"])

    kinds = ", ".join(f"`{k}` {todo.schema[k].dataType.simpleString()}" for k in keys)
    return todo.select(*keys, image).mapInPandas(work, f"{kinds}, text string")


def similarity_order(ranked: DataFrame, terms: DataFrame, pool: int = 30) -> DataFrame:
    """query_id, chunk_id, place: a local stand-in for a reranking model, by share of query words in the text.

    ranked: query_id, rank, chunk_id, text; terms: query_id, query_words.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    rows = ranked.where(F.col("rank") <= pool).join(terms, "query_id")
    hits = F.size(F.filter("query_words", lambda w: F.contains(low, w)))
    return rows.select("query_id", "chunk_id", (-hits * 1_000 + F.col("rank")).alias("place"))

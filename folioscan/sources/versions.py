"""Keyed tables in versions: parts are written where no reader looks, then one new name shows them all.

    path/data/v<n>/...           parts of version n, a folder a group of parts
    path/done/v<n>/<part>.json   which parts of version n are whole, and from which input
    path/versions/<n>.json       the manifest of version n; the highest number is the table

A row's part is the hash of its key, so new rows touch only parts with their keys; a manifest
takes the others over from the version before. A run that stopped anywhere is run again: parts
that are done from the same input aren't written again, and readers see the version before
until the manifest has its name. Creating that name is one rename that fails if another writer
was first. Digests don't depend on the order of rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscan.sources.files import Files

Step = Callable[[str], None]


class Conflict(RuntimeError):
    """Another writer published the version first."""


def set_digest(*columns: Column) -> Column:
    """Of a group: count, sum and exclusive or of its rows' hashes, as one text; equal sets have equal digests."""
    h = F.xxhash64(*columns)
    return F.concat_ws(":", F.count(F.lit(1)), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.bit_xor(h), F.lit(0)))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The manifest of a version, else of the newest; None before the first."""
    files = Files(spark)
    known = [int(n.removesuffix(".json")) for n in files.names(f"{path}/versions") if n.endswith(".json") and not n.startswith(".")]
    if not known:
        return None
    return json.loads(files.read(f"{path}/versions/{max(known) if version is None else version:010d}.json"))


def _rows(spark: SparkSession, shown: dict, parts: list[int] | None = None) -> DataFrame:
    paths = [p["path"] for k, p in shown["parts"].items() if p["path"] and (parts is None or int(k) in parts)]
    schema = T.StructType.fromJson(shown["schema"])
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default of the newest; parts that no manifest names aren't read."""
    shown = manifest(spark, path, version)
    if shown is None:
        raise ValueError(f"no version is published at {path}")
    return _rows(spark, shown)


def _dealt(rows: DataFrame, key: str, parts: int) -> DataFrame:
    return rows.withColumn("_part", F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int"))


def _digests(rows: DataFrame) -> dict[int, tuple[int, str]]:
    own = [F.col(c) for c in rows.columns if c != "_part"]
    return {r["_part"]: (r["n"], r["digest"]) for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), set_digest(*own).alias("digest")).collect()}


def merge(path: str, new: DataFrame, key: str, work: Callable[[DataFrame], DataFrame] | None = None, only_missing: bool = False, parts: int = 16, every: int = 4, after: Step = lambda step: None) -> int:
    """Publishes a version with the rows of `new`; returns its number, or the old one if nothing is new.

    A row replaces the one of its key; only_missing: rows whose key the table has are left out.
    Of rows of `new` with one key any counts, rows without key are left out. work turns rows
    of `new` into rows of the table, `every` parts at a time: after each such group what is done
    is recorded, so a run that stops loses one group. Rows that work leaves out (say, since a
    service refused them) are missing, and come with a later run. `parts` is fixed by the first
    version. `after` is told each step, for tests.
    """
    spark, files = new.sparkSession, Files(new.sparkSession)
    shown = manifest(spark, path) or {"version": 0, "of": parts, "parts": {}, "schema": None}
    version, parts = shown["version"] + 1, shown["of"]
    rows = _dealt(new.where(F.col(key).isNotNull()).dropDuplicates([key]), key, parts)
    if only_missing and shown["schema"]:
        touched = [r["_part"] for r in rows.select("_part").distinct().collect()]
        rows = rows.join(_rows(spark, shown, touched).select(key), key, "left_anti")
    inputs = _digests(rows)
    if not inputs:
        return shown["version"]

    done_at = f"{path}/done/v{version}"
    done = {int(n.split(".")[0]): json.loads(files.read(f"{done_at}/{n}")) for n in files.names(done_at) if n.endswith(".json") and not n.startswith(".")}
    todo = sorted(p for p, (_, digest) in inputs.items() if done.get(p, {}).get("input") != digest)
    schema = shown["schema"]
    for start in range(0, len(todo), every):
        group = todo[start : start + every]
        own = rows.where(F.col("_part").isin(group))
        worked = work(own.drop("_part")) if work else own.drop("_part")
        if schema:
            worked = _rows(spark, shown, group).join(own.select(key), key, "left_anti").unionByName(worked)
        folder = f"{path}/data/v{version}/{uuid.uuid4().hex}"
        _dealt(worked, key, parts).repartition("_part").write.partitionBy("_part").parquet(folder)
        after("written")
        kinds = T.StructType([f for f in worked.schema.fields])
        written = _digests(spark.read.schema(kinds.add("_part", T.IntegerType())).parquet(folder))
        for part in group:
            n, digest = written.get(part, (0, ""))
            record = {"input": inputs[part][1], "rows": n, "digest": digest, "path": f"{folder}/_part={part}" if n else None, "schema": worked.schema.jsonValue()}
            files.delete(f"{done_at}/{part}.json")
            files.create(f"{done_at}/{part}.json", json.dumps(record))
            done[part] = record
            after("recorded")
    named = {k: {n: p[n] for n in ("rows", "digest", "path")} for k, p in done.items() if k in inputs}
    schema = schema or next(done[k]["schema"] for k in inputs)
    text = json.dumps({"version": version, "of": parts, "schema": schema, "parts": {**shown["parts"], **{str(k): p for k, p in named.items()}}})
    after("before publishing")
    if not files.create(f"{path}/versions/{version:010d}.json", text):
        raise Conflict(f"version {version} of {path} was published by another writer")
    after("published")
    files.delete(done_at)
    return version


def damaged_parts(spark: SparkSession, path: str) -> list[int]:
    """Parts of the newest version whose rows aren't those that were written."""
    shown = manifest(spark, path)
    rows = _rows(spark, shown)
    if any(p["path"] for p in shown["parts"].values()):
        rows = rows.select("*", F.regexp_extract("_metadata.file_path", r"/_part=(\d+)/", 1).cast("int").alias("_part"))
        found = _digests(rows)
    else:
        found = {}
    return sorted(int(k) for k, p in shown["parts"].items() if found.get(int(k), (0, ""))[1] != p["digest"])


def expire(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes all but the newest `keep` versions and the data that none of these names."""
    files = Files(spark)
    known = [n for n in files.names(f"{path}/versions") if n.endswith(".json") and not n.startswith(".")]
    kept = [json.loads(files.read(f"{path}/versions/{n}")) for n in known[-keep:]]
    named = {p["path"].rsplit("/", 1)[0] for m in kept for p in m["parts"].values() if p["path"]}
    for n in known[:-keep]:
        files.delete(f"{path}/versions/{n}")
    for v in files.names(f"{path}/data"):
        for folder in files.names(f"{path}/data/{v}"):
            if f"{path}/data/{v}/{folder}" not in named and int(v[1:]) <= kept[-1]["version"]:
                files.delete(f"{path}/data/{v}/{folder}")


def version_sink(path: str, key: str, work: Callable[[DataFrame], DataFrame] | None = None, parts: int = 16, every: int = 4) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch that brings new keys publishes a version; one that runs again adds nothing.

    Of the table only the keys of parts that the batch touches are read.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        merge(path, batch, key, work, True, parts, every)

    return write

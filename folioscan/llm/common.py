"""Shared helpers: the cluster's shared folder, written tables, Arrow buffers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local session without the setting gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    with _making:
        if not (base := spark.conf.get("spark.checkpoint.dir", None)):
            folder = tempfile.mkdtemp(prefix="folioscan-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            base = f"file://{folder}"
            spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_making = threading.Lock()


class _Scratch(threading.local):
    """The tables that operators called by this thread wrote: an operator runs in one thread, so calls in others never see them."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_scratch = _Scratch()


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _scratch.paths.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what operators called by this thread wrote for themselves. Results that still read it are lost."""
    while _scratch.paths:
        _delete(spark, _scratch.paths.pop())


def written() -> int:
    """How many tables operators wrote in this thread so far: a mark for only_read."""
    return len(_scratch.paths)


def only_read(result: DataFrame, since: int) -> DataFrame:
    """result, after the tables that this thread wrote since a mark and that it doesn't read are deleted."""
    read, own = "\n".join(result.inputFiles()), _scratch.paths[since:]
    _scratch.paths[since:] = [path for path in own if path.rsplit("/", 1)[-1] in read]
    for path in set(own).difference(_scratch.paths[since:]):
        _delete(result.sparkSession, path)
    return result


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: a short lineage that outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame, limit: int = 4 << 20) -> DataFrame:
    """df, in a session whose Arrow batches are lowered from Spark's 64 MB to `limit` bytes.

    Rows are long texts here: a task then holds a few MB of them, in the JVM and in Python,
    instead of some hundred. A value that the session sets itself stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == "67108864b":
        conf.set(key, str(limit))
    return df


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; a null has no bytes."""
    kind = column.type
    if pa.types.is_null(kind):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(kind) or pa.types.is_large_string(kind) else b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_, offsets.astype(np.int64)


def doc_groups(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs [first, end) of consecutive rows with at most `limit` bytes each, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j

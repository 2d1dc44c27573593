"""Small text files and folders through Hadoop's file systems: what the cluster shares, not what the driver holds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_making = threading.Lock()


class Files:
    """Names, texts and atomic creation under paths of any file system that Spark reads."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        place = self._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self._conf), place

    def names(self, folder: str) -> list[str]:
        fs, place = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []

    def read(self, path: str) -> str:
        fs, place = self._at(path)
        stream = fs.open(place)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """The text under a name that nobody has, whole or not at all; False if the name is taken."""
        folder, name = path.rsplit("/", 1)
        (fs, draft), place = self._at(f"{folder}/.{name}.{uuid.uuid4().hex}"), self._at(path)[1]
        out = fs.create(draft, True)
        out.write(text.encode())
        out.close()
        if not fs.exists(place) and fs.rename(draft, place):
            return True
        fs.delete(draft, False)
        return False

    def delete(self, path: str) -> None:
        fs, place = self._at(path)
        fs.delete(place, True)


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a local session without it gets a temporary one."""
    with _making:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            own = tempfile.mkdtemp(prefix="folioscan-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            base = f"file://{own}"
            spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(rows: DataFrame, tag: str) -> DataFrame:
    """The rows, read from a new folder that they are written to: made once, however often they are used."""
    at = shared_folder(rows.sparkSession, tag)
    rows.write.parquet(at)
    return rows.sparkSession.read.parquet(at)

"""Tables derived once from source files and kept in the shared folder: found again while the files are the same."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Where what was derived stands, by session, name and state of its sources.
PLACES: dict[tuple, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only for a local master, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return PLACES.setdefault((spark.sparkContext.applicationId,), tempfile.mkdtemp(prefix="spark-"))


def state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table, by the file system that Spark reads it from."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found, stack = [], [files.getFileStatus(place)]
    while stack:
        status = stack.pop()
        if status.isDirectory():
            stack.extend(files.listStatus(status.getPath()))
        else:
            found.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(found))


def stored(spark: SparkSession, name: str, sources: list[str], build: Callable[[str], None]) -> str:
    """The folder that build(folder) has filled from the sources; it is built once for each state of their files."""
    key = (spark.sparkContext.applicationId, name, *(state(spark, s) for s in sources))
    if key not in PLACES:
        folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        build(folder)
        PLACES[key] = folder
    return PLACES[key]

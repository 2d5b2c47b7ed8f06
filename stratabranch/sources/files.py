"""Small files written by the driver to any store that Spark reaches."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path names a file or folder; a text that can't be a path names none."""
    try:
        store, place = _store(spark, path)
        return bool(store.exists(place))
    except IllegalArgumentException:
        return False


def write_text(spark: SparkSession, path: str, text: str, force: bool = False) -> None:
    """One file with the text; a FileExistsError if it is there, unless forced."""
    if not force and exists(spark, path):
        raise FileExistsError(f"{path} exists")
    store, place = _store(spark, path)
    out = store.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def remove(spark: SparkSession, pattern: str) -> None:
    """Remove what a pattern names."""
    store, place = _store(spark, pattern)
    for found in store.globStatus(place) or []:
        store.delete(found.getPath(), True)

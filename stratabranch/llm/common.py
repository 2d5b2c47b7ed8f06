"""What the operators share: reading tables, Arrow batch sizes, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python. Texts may be long, so batches are short.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession, rows: int = BATCH_ROWS) -> SparkSession:
    """Bound the memory of a Python worker: it holds one batch of whole texts at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):  # where workers share this machine
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which outlives executors. Where it is unset, one of our own on a
    local master; on a cluster that is a mistake, since no folder of this machine is seen by the others."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp("-checkpoints"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder; for narrow rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders that `stored` wrote and `release` hasn't removed.
_STORED: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """Written as Parquet to the shared folder and read again; for rows with texts."""
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    _STORED.append(folder)
    return df.sparkSession.read.parquet(folder)


def stored_folders() -> frozenset[str]:
    return frozenset(_STORED)


def release(spark: SparkSession, keep: DataFrame, before: frozenset[str]) -> None:
    """Remove the folders that `stored` wrote since it had written those of before, but for those that keep
    reads. For callers that know that nothing else reads them any more."""
    needed = keep.inputFiles()
    for folder in [x for x in _STORED if x not in before]:
        if not any(folder.rsplit("/", 1)[1] in x for x in needed):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            _STORED.remove(folder)


def over_batches(
    df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str
) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def text_bytes(column: str = "text") -> Column:
    """The text as UTF-8 bytes, a null one as null."""
    return F.col(column).cast("binary")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name

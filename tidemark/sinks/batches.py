"""Folders of micro-batches: one per run of a checkpoint and batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The run of what is written without a stream.
TABLE_RUN = "table"
_DONE = "_SUCCESS"


def run_of(batch: DataFrame) -> str:
    """The id that a stream's checkpoint carries. A new checkpoint counts its batches from zero again, but has a
    new id."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or TABLE_RUN


def batch_folder(run: str, batch_id: int) -> str:
    return f"run={run}/batch_id={batch_id}"


def _files(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was finished."""
    files, marker = _files(spark, f"{path}/{_DONE}")
    return files.exists(marker)


def complete_folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of the folders that match ``pattern`` and were written whole."""
    files, marker = _files(spark, f"{pattern}/{_DONE}")
    return sorted(found.getPath().getParent().toString() for found in files.globStatus(marker) or [])


def remove(spark: SparkSession, path: str) -> None:
    files, folder = _files(spark, path)
    files.delete(folder, True)

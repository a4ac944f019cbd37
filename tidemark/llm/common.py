"""Shared folder, Arrow batches and flat text buffers."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch between the JVM and Python; bounds the text held by a worker at once.
BATCH_ROWS = 1024
#: Bytes of text, about, that a worker takes apart at once; the arrays of its words or ids are some thirty times as large.
SLICE = 1 << 19


def prepare(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, and a checkpoint folder: the cluster's own, or a temporary one in local mode only."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-checkpoint-"))
    if not getattr(context, "_tidemark_shipped", False):
        context._tidemark_shipped = True
        context.addPyFile(_shared(spark, _package(), ".zip"))
    return spark


def _package() -> bytes:
    """The whole package as a zip file, for workers that don't have it installed."""
    root, out = Path(__file__).resolve().parent.parent, io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as file:
        for path in sorted(root.rglob("*.py")):
            file.write(path, path.relative_to(root.parent))
    return out.getvalue()


def _shared(spark: SparkSession, content: bytes, suffix: str) -> str:
    """A new file in the shared folder; its path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir(), f"{uuid.uuid4().hex}{suffix}")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        for at in range(0, len(content), 1 << 20):
            stream.write(bytearray(content[at:at + (1 << 20)]))
    finally:
        stream.close()
    return path.toString()


def publish(spark: SparkSession, content: bytes, suffix: str) -> str:
    """Put a file into the shared folder and let every executor fetch it; the name for ``SparkFiles.get``."""
    path = _shared(prepare(spark), content, suffix)
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def written(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: computed once, read again by whatever needs them, whole if an executor is lost."""
    spark = prepare(rows.sparkSession)
    folder = f"{spark.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def replaced(docs: DataFrame, new: dict[str, Column], row: str = "_row") -> list[Column]:
    """The columns of a packed row, some of them replaced, in their order."""
    return [new.get(c, F.col(row)[c]).alias(c) for c in docs.columns]


def clean(column: pa.Array) -> pa.LargeStringArray:
    """Nulls as empty texts; bytes that aren't UTF-8 as U+FFFD."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    try:
        out = column.cast(pa.large_string())
        out.validate(full=True)
        return out
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in column.to_pylist()], pa.large_string())


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs that have ``SLICE`` bytes in column ``text`` at most; a longer text is a run of its own.

    The runs are copies: pyarrow's text functions misread an array that begins inside its buffer.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, "right")))
        yield batch.take(pa.array(np.arange(a, b)))
        a = b


def flat(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, one after another, and where each text begins (with the end)."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def strings(data: np.ndarray, starts: np.ndarray) -> pa.LargeStringArray:
    """Slices of a flat text as an Arrow array, without a copy; starts with the end."""
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(np.ascontiguousarray(starts, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices ``values[s:s + n]``, one after another."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    before = np.cumsum(lengths) - lengths
    return values[np.repeat(starts - before, lengths) + np.arange(total)]

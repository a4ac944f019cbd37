"""Tumbling event-time windows built from partial sums."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import names
from tidemark.functions import clock


def tumble(df: DataFrame, measures: Mapping[str, Column], keys: Sequence[str] = (), size: str = names.WINDOW) -> DataFrame:
    """Aggregate ``rt`` in tumbling windows: ``window``, ``keys`` and ``measures``.

    Sums are combined on the map side, so a window over all rows is not bound to one task.
    """
    grouped = df.groupBy(F.window("rt", size).alias("window"), *keys)
    return grouped.agg(*[column.alias(name) for name, column in measures.items()])


def sum_parts(parts: Sequence[DataFrame], measures: Sequence[str], keys: Sequence[str] = (),
              size: str = names.WINDOW) -> DataFrame:
    """Window sums of measures that come from several row sets.

    Each part has ``rt``, the ``keys`` and some of the ``measures``; a measure it lacks counts as zero.
    Counting first-seen rows is thus an addition and needs no join back to the rows.
    """
    def padded(part: DataFrame) -> DataFrame:
        zeros = [F.col(m) if m in part.columns else F.lit(0).alias(m) for m in measures]
        return part.select("rt", *keys, *zeros)

    rows = reduce(lambda a, b: a.unionByName(b), [padded(p) for p in parts])
    return tumble(rows, {m: F.sum(m) for m in measures}, keys, size)


def stamped(df: DataFrame, columns: Sequence[str], emit_ts: Column | None = None) -> DataFrame:
    """Replace ``window`` by ``stt`` and ``edt`` text and put the result columns in order.

    ``ts`` is the wall clock in milliseconds unless given or already a column.
    """
    out = df.withColumns({"stt": clock.stamp(F.col("window.start")), "edt": clock.stamp(F.col("window.end"))})
    if emit_ts is not None or "ts" not in df.columns:
        out = out.withColumn("ts", clock.now_ms() if emit_ts is None else emit_ts)
    return out.select(*columns)

"""Running totals per key over an ordered table, without sorting a whole key in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import clock


def _starts(before: Column, time: Column, ttl_us: int) -> Column:
    """1 if a row opens a new day, or follows the previous row after ``ttl``, else 0."""
    other_day = clock.day_number(before) != clock.day_number(time)
    idle = F.unix_micros(time) - F.unix_micros(before) >= ttl_us
    return F.when(before.isNull() | other_day | idle, 1).otherwise(0).cast("bigint")


def dealt(df: DataFrame, keys: Sequence[str], time: str, chunk: str = "1 hour") -> DataFrame:
    """Rows with a time, dealt by ``_key``, a struct of the ``keys``, and ``_chunk``, the start of their chunk of time.

    Whatever aggregates them by both needs no other shuffle, and neither do ``running_totals`` of that.
    """
    # Null keys compare equal in a struct. The filter stands here because a join by the chunk would put it before the
    # shuffle on one side only, and two shuffles that differ are both written. Neither column is shuffled, only dealt by.
    key, slot = F.struct(*keys), clock.slot(F.col(time), clock.duration_us(chunk))
    return df.where(slot.isNotNull()).repartition(key, slot).withColumns({"_key": key, "_chunk": slot})


def running_totals(
    df: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], totals: Mapping[str, str],
    starts: str, ttl: str, chunk: str = "1 hour", before: DataFrame | None = None,
) -> DataFrame:
    """Add running sums per key in ``(time, *order)`` order.

    ``totals`` maps each output to the column it sums; ``starts`` names one more output, the running
    count of rows that are first of their day or come at least ``ttl`` after the row before them.
    ``before`` holds the last row of each key so far (``keys``, ``time``, outputs), from which sums go on.
    Rows that are ``dealt``, or made of such, keep their chunks.

    A prefix sum in two levels: inside (key, chunk of time), then over the chunk sums of a key, of which
    there are only as many as chunks in the data's time span. A hot key is spread over its chunks. A chunk's
    sums are those of its last row, so rows are summed once; only the small chunk table is joined to them.
    """
    ttl_us = clock.duration_us(ttl)
    at = F.col(time)
    columns = [c for c in df.columns if c not in ("_key", "_chunk")]
    rows = df if "_chunk" in df.columns else dealt(df, keys, time, chunk)
    inside = Window.partitionBy("_key", "_chunk").orderBy(time, *order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    sums = {**totals, starts: "_start"}
    local = (
        rows.withColumns({"_before": F.lag(time).over(inside), "_ends": F.lead(time).over(inside).isNull(), "_from": F.first(time).over(so_far)})
        # The first row of a chunk is decided below, from the last row of the chunk before.
        .withColumn("_start", F.when(F.col("_before").isNull(), F.lit(0).cast("bigint"))
                    .otherwise(_starts(F.col("_before"), at, ttl_us)))
        .withColumns({f"_local_{out}": F.sum(source).over(so_far) for out, source in sums.items()})
    )
    chunks = local.where("_ends").select("_key", "_chunk", "_from", at.alias("_to"), *[F.col(f"_local_{out}").alias(f"_sum_{out}") for out in sums])
    if before is not None:
        # What was before comes ahead of every chunk and matches no row.
        chunks = chunks.unionByName(before.select(
            F.struct(*keys).alias("_key"), F.lit(None).cast("bigint").alias("_chunk"), at.alias("_from"), at.alias("_to"),
            *[F.col(out).alias(f"_sum_{out}") for out in sums]))
    by_key = Window.partitionBy("_key").orderBy(F.asc_nulls_first("_chunk"))
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.when(F.col("_chunk").isNull(), F.lit(0)).otherwise(_starts(F.lag("_to").over(by_key), F.col("_from"), ttl_us))
    opened = chunks.withColumn("_opens", opens).withColumn(f"_sum_{starts}", F.col(f"_sum_{starts}") + F.col("_opens"))
    offsets = opened.select("_key", "_chunk", "_opens", *[
        F.sum(f"_sum_{out}").over(earlier).alias(f"_offset_{out}") for out in sums
    ])
    joined = local.join(offsets, ["_key", "_chunk"], "inner")
    # Either is null as long as it has only added up nulls.
    both = {name: (F.col(f"_local_{name}"), F.col(f"_offset_{name}")) for name in sums}
    out = {name: F.coalesce(local + offset, local, offset) for name, (local, offset) in both.items()}
    out[starts] = out[starts] + F.col("_opens")
    return joined.select(*columns, *[column.alias(name) for name, column in out.items()])


def last_totals(totals: DataFrame, keys: Sequence[str], time: str, order: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """The last row of each key with its running sums, as ``before`` takes it; combined on the map side."""
    last = F.max_by(F.struct(time, *outputs), F.struct(time, *order)).alias("_last")
    return totals.groupBy(*keys).agg(last).select(*keys, "_last.*")

"""Repair of the new-visitor flag of a device.

The first log of a device decides: if it says new, the flag stays on for that calendar day only;
if it does not, the device is known from before and the flag is never valid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import clock


#: What is remembered of a device: its first log, and the time of its last.
FIRST_LOG = "mid string, first struct<ts:bigint,is_new:string>, last bigint"


def first_logs(logs: DataFrame) -> DataFrame:
    """The first log of each device (``first``: time and claim) and the time of its last, from a narrow projection.

    A partial aggregate: a device leaves each map task as one row, however many logs it has.
    """
    return logs.select("mid", "ts", "is_new").groupBy("mid").agg(
        F.min(F.struct("ts", "is_new")).alias("first"), F.max("ts").alias("last"))


def with_known(found: DataFrame, known: DataFrame | None) -> DataFrame:
    """First logs of a micro-batch, as ``known`` has them for devices that were there before."""
    if known is None:
        return found
    before = known.select(F.col("mid").alias("_mid"), F.col("first").alias("_first"))
    return found.join(before, F.col("mid").eqNullSafe(F.col("_mid")), "left").select("mid", F.coalesce("_first", "first").alias("first"), "last")


def repair_new_flag(logs: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """``logs`` (columns ``mid``, ``is_new``, ``ts``) with ``is_new`` repaired.

    Only rows that claim to be new are joined, by device and day; the others pass untouched. ``first`` gives the
    first logs if they are known from elsewhere, as on a stream.
    """
    claim = F.col("is_new") == "1"
    claims = logs.filter(claim)
    others = logs.filter(~F.coalesce(claim, F.lit(False)))
    time = clock.ms_to_time(F.col("ts"))
    new_on = (
        (first_logs(logs) if first is None else first).filter(F.col("first.is_new") == "1")
        .select(F.col("mid").alias("_mid"), F.to_date(clock.ms_to_time(F.col("first.ts"))).alias("_new_day"))
    )
    same = (F.col("mid") == F.col("_mid")) & (F.to_date(time) == F.col("_new_day"))
    flag = F.when(F.col("_mid").isNull(), F.lit("0")).otherwise(F.lit("1"))
    repaired = claims.join(new_on, same, "left").withColumn("is_new", flag)
    return repaired.select(*logs.columns).unionByName(others)

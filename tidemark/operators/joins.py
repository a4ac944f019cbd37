"""Equi-joins between change streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, retention: str, counted: str | None = None) -> DataFrame:
    """Inner equi-join of two change sets; columns of ``left`` as they are, of ``right`` prefixed ``r_``.

    Bounded tables join on the key alone, and AQE splits a hot key. Streams need event time ``rt`` on
    both sides, the time of the change, and join partners at most ``retention`` apart, so that join state
    can be dropped.

    With ``counted``, rows of either side that find no partner are counted before they go, as ``unmatched_left``,
    ``unmatched_right`` and ``matched`` of an observation of that name. The join is then an outer one: on a stream a
    row is known to have no partner when its state is dropped.
    """
    there = "_there"
    if counted:
        left, right = left.withColumn(there, F.lit(True)), right.withColumn(there, F.lit(True))
    right = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    match = F.col(left_key) == F.col(f"r_{right_key}")
    if left.isStreaming and right.isStreaming:
        bound = F.expr(f"interval {retention}")
        match &= F.col("r_rt").between(F.col("rt") - bound, F.col("rt") + bound)
    if not counted:
        return left.join(right, match, "inner")
    in_left, in_right = F.col(there).isNotNull(), F.col(f"r_{there}").isNotNull()
    joined = left.join(right, match, "full_outer").observe(
        counted, F.count_if(~in_right).alias("unmatched_left"), F.count_if(~in_left).alias("unmatched_right"), F.count_if(in_left & in_right).alias("matched"))
    return joined.filter(in_left & in_right).drop(there, f"r_{there}")

"""Dimension lookups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def enrich(df: DataFrame, dim: DataFrame, key: str | Column, fields: Mapping[str, str], dim_key: str = "id") -> DataFrame:
    """Left join a dimension and copy ``fields`` (output name to dimension column).

    A row without a match is kept with nulls. Spark broadcasts the pruned dimension if its measured size
    allows. Call it after aggregation where the key survives: one lookup per group, not per row.
    """
    wanted = dim.select(F.col(dim_key).cast("string").alias("_dim_key"),
                        *[F.col(source).alias(f"_dim_{out}") for out, source in fields.items()])
    left = F.col(key) if isinstance(key, str) else key
    joined = df.join(wanted, left.cast("string") == F.col("_dim_key"), "left").drop("_dim_key")
    kept = [c for c in df.columns if c not in fields]
    return joined.select(*kept, *[F.col(f"_dim_{out}").alias(out) for out in fields])


def lookup_join(df: DataFrame, dim: DataFrame, key: Column, fields: Mapping[str, str], dim_key: str = "id") -> DataFrame:
    """Inner lookup against a keyed table: rows without a match are dropped."""
    wanted = dim.select(F.col(dim_key).alias("_dim_key"),
                        *[F.col(source).alias(f"_dim_{out}") for out, source in fields.items()])
    joined = df.join(wanted, key == F.col("_dim_key"), "inner").drop("_dim_key")
    return joined.select(*df.columns, *[F.col(f"_dim_{out}").alias(out) for out in fields])

"""Bounded table sources: dimensions and the routing configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions import documents


def jdbc_table(spark: SparkSession, url: str, table: str, split_on: str | None = None,
               bounds: tuple[int, int] | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A database table. With ``split_on`` and ``bounds`` the read is spread over ``parts`` tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if split_on and bounds:
        reader = (reader.option("partitionColumn", split_on).option("lowerBound", bounds[0])
                  .option("upperBound", bounds[1]).option("numPartitions", parts))
    return reader.load()


def config_snapshot(table: DataFrame) -> DataFrame:
    """The routing table as read at start-up, in the form of the change feed's ``read`` entries."""
    row = F.struct(*[F.col(c).cast("string").alias(c) for c in schemas.CONFIG_COLUMNS])
    none = F.lit(None).cast(f"struct<{', '.join(f'{c}:string' for c in schemas.CONFIG_COLUMNS)}>")
    return table.select(none.alias("before"), row.alias("after"), F.lit("r").alias("op"),
                        F.lit(0).cast("bigint").alias("ts_ms"))


def config_feed(values: DataFrame) -> DataFrame:
    """Changes of the routing table: JSON objects with ``op``, ``before`` and ``after``."""
    return documents.parse(values, schemas.CONFIG_FEED)

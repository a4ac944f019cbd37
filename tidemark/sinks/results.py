"""Window results: append per batch, read the row with the greatest ``ts`` per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.operators.latest import latest_by_key
from tidemark.sinks.batches import TABLE_RUN, batch_folder


def sink_row(df: DataFrame, table: str) -> DataFrame:
    """The columns of a result table in their order, working columns left out, amounts at sink precision."""
    def typed(name: str):
        column = F.col(name)
        return column.cast(schemas.SINK_AMOUNT).alias(name) if isinstance(df.schema[name].dataType, T.DecimalType) else column

    return df.select(*[typed(c) for c in schemas.RESULT_COLUMNS[table]])


class ResultTable:
    """Parquet table under ``folder``, split by batch; a batch covers little time, so files are skipped by their range of ``stt``.

    A repeated batch replaces itself, so a restarted stream leaves no doubles; ``run`` tells the batches of
    one checkpoint from those of another. Nothing is rewritten on append; ``read`` resolves versions, and
    ``compact`` writes the resolved rows to another folder.
    """

    def __init__(self, folder: str, table: str):
        self.path = f"{folder}/{table}"
        self.table = table
        self.keys = schemas.RESULT_KEYS[table]

    def append(self, df: DataFrame, batch_id: int = 0, run: str = TABLE_RUN) -> None:
        sink_row(df, self.table).write.mode("overwrite").parquet(f"{self.path}/{batch_folder(run, batch_id)}")

    def versions(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def read(self, spark: SparkSession, day: str | None = None) -> DataFrame:
        """Current rows; with ``day`` those whose window starts on it."""
        rows = self.versions(spark)
        if day is not None:
            rows = rows.filter(F.col("stt").startswith(day))
        if self.table in schemas.KEYED_BY_NAME:
            return self._last_batch(rows).select(*schemas.RESULT_COLUMNS[self.table])
        values = [c for c in schemas.RESULT_COLUMNS[self.table] if c not in self.keys and c != "ts"]
        current = latest_by_key(rows.drop("run"), self.keys, ["ts", "batch_id", *values])
        return current.select(*schemas.RESULT_COLUMNS[self.table])

    def _last_batch(self, rows: DataFrame) -> DataFrame:
        """All rows a key got in its last batch, since rows of one batch may share a name."""
        keyed = rows.withColumns({"_key": F.struct(*self.keys), "_at": F.struct("ts", "run", "batch_id")})
        last = keyed.groupBy("_key").agg(F.max("_at").alias("_at"))
        return keyed.join(last, ["_key", "_at"], "left_semi")

    def compact(self, spark: SparkSession, folder: str) -> "ResultTable":
        target = ResultTable(folder, self.table)
        target.append(self.read(spark))
        return target


def append_jdbc(df: DataFrame, table: str, url: str, batch_rows: int = 1000, **options: str) -> None:
    """Insert into a database table that itself keeps the latest row per key."""
    (sink_row(df, table).write.mode("append").format("jdbc").option("url", url).option("dbtable", table)
     .option("batchsize", batch_rows).options(**options).save())

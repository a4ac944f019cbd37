"""The change log, parsed once and kept by table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sinks.batches import TABLE_RUN, batch_folder, complete_folders, is_complete
from tidemark.sources.topics import change_rows

# The columns of a file; ``table`` is the name of its folder.
_STORED = "database string, type string, data variant, old variant, ts bigint, xid bigint, pt timestamp"
_PARTED = f"{_STORED}, run string, batch_id bigint, table string"


class ChangeLog:
    """Parsed changes under ``folder``, split by run, batch and table.

    The topic's text is parsed when it is written, whatever jobs read it; a job that asks for one table reads that
    table's files alone, since ``table`` is a folder. Rows stay whole, their values VARIANT.
    """

    def __init__(self, folder: str):
        self.path = folder

    def append(self, values: DataFrame, batch_id: int = 0, run: str = TABLE_RUN) -> "ChangeLog":
        """Parse the text of one batch and write it. One that was written whole is left as it is when repeated, as
        streams that read the folder would take new files for new changes."""
        path = f"{self.path}/{batch_folder(run, batch_id)}"
        if not is_complete(values.sparkSession, path):
            rows = change_rows(values).withColumn("table", F.coalesce("table", F.lit("")))
            (rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("table").parquet(path))
        return self

    def rows(self, spark: SparkSession) -> DataFrame:
        """Changes of all tables; a filter by ``table`` reads the folders of that table."""
        folders = complete_folders(spark, f"{self.path}/run=*/batch_id=*")
        if not folders:
            return spark.createDataFrame([], f"{_STORED}, table string")
        reader = spark.read.schema(_PARTED).option("basePath", self.path)
        return reader.parquet(*folders).drop("run", "batch_id")

    def stream(self, spark: SparkSession, *tables: str, **options: str) -> DataFrame:
        """Changes of some tables as they are written."""
        picked = f"{self.path}/run=*/batch_id=*/table={{{','.join(tables)}}}"
        reader = spark.readStream.schema(_PARTED).options(**options)
        return reader.option("basePath", self.path).parquet(picked).drop("run", "batch_id")


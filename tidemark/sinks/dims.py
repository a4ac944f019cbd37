"""Dimension store: upserts of configured dimension rows, all dimensions in one write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.latest import latest_by_key
from tidemark.sinks.batches import TABLE_RUN, batch_folder, complete_folders, remove

_ROW = ("pk", "data", "ts", "xid")
_STORED = "pk string, data map<string,string>, ts bigint, xid bigint, sink_table string"


def dim_schema(sink_columns: str) -> T.StructType:
    """Columns of a dimension from its configured list: text all of them, names as given."""
    return T.StructType([T.StructField(c, T.StringType()) for c in sink_columns.split(",")])


class DimStore:
    """Rows (``sink_table``, ``pk``, ``data``) under ``folder``, split by run, batch and dimension.

    Columns come from the configuration on reading, so a dimension exists as soon as it is configured
    and a changed column list needs no rewrite. A lookup that must see the latest rows reads again, in
    each micro-batch; there is no cache to refresh. ``compact`` folds old batches into a snapshot, so that
    a read costs the current rows and the batches since, not the whole history.

    Only folders written whole are read: a batch or a snapshot appears all at once.
    """

    def __init__(self, folder: str):
        self.path = folder

    def upsert(self, dims: DataFrame, batch_id: int = 0, run: str = TABLE_RUN) -> None:
        """Last row per dimension and key of one batch; a repeated batch replaces itself, whatever it held.

        A row without its key column fails the batch, as the configuration does not fit the table then.
        """
        pk = F.coalesce("pk", F.raise_error(F.concat(F.lit("no key in a row of "), "sink_table")))
        rows = dims.select("sink_table", pk.alias("pk"), "data", "ts", "xid")
        last = latest_by_key(rows, ["sink_table", "pk"], ["ts", "xid"])
        (last.write.mode("overwrite").option("partitionOverwriteMode", "static")
         .partitionBy("sink_table").parquet(f"{self.path}/{batch_folder(run, batch_id)}"))

    def _snapshot(self, spark: SparkSession) -> tuple[int, str | None, set[str]]:
        """Number and folder of the newest snapshot and the batch folders it covers."""
        done = [path.rpartition("/")[0] for path in complete_folders(spark, f"{self.path}/_snapshots/*/covers")]
        if not done:
            return 0, None, set()
        newest = max(done, key=lambda path: int(path.rpartition("/")[2]))
        covered = spark.read.schema("folder string").parquet(f"{newest}/covers").collect()
        return int(newest.rpartition("/")[2]), f"{newest}/rows", {r.folder for r in covered}

    def _batches(self, spark: SparkSession) -> list[str]:
        return complete_folders(spark, f"{self.path}/run=*/batch_id=*")

    def _stored(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        """Rows of some folders. Each is read with its own dimensions as partitions, all in one scan per root."""
        inside = [f for f in folders if "/_snapshots/" not in f]
        parts = [spark.read.schema(_STORED).parquet(f) for f in folders if f not in inside]
        if inside:
            base = {"basePath": inside[0].rpartition("/run=")[0]}
            parts.append(spark.read.schema(_STORED + ", run string, batch_id bigint").options(**base).parquet(*inside))
        rows = spark.createDataFrame([], _STORED + ", batch_id bigint")
        for part in parts:
            order = F.col("batch_id") if "batch_id" in part.columns else F.lit(-1).cast("bigint").alias("batch_id")
            rows = rows.unionByName(part.select("sink_table", *_ROW, order))
        return rows

    def read(self, spark: SparkSession, table: str, columns: Sequence[str] | str) -> DataFrame:
        """Current rows of one dimension; without any rows yet, an empty table of its columns."""
        schema = dim_schema(columns if isinstance(columns, str) else ",".join(columns))
        _, snapshot, covered = self._snapshot(spark)
        folders = [f for f in self._batches(spark) if f not in covered]
        stored = self._stored(spark, folders + [snapshot] * (snapshot is not None))
        rows = stored.filter(F.col("sink_table") == table).select(*_ROW, "batch_id")
        last = latest_by_key(rows, ["pk"], ["ts", "xid", "batch_id"])
        return last.select(*[F.col("data")[f.name].alias(f.name) for f in schema])

    def compact(self, spark: SparkSession) -> None:
        """Write the current rows of all batches but the last of each run, which may be repeated, as a snapshot.

        Readers turn to it once its list of covered batches is complete. Nothing is removed.
        """
        number, snapshot, covered = self._snapshot(spark)
        batches = self._batches(spark)
        last: dict[str, int] = {}
        for folder in batches:
            run, _, batch_id = folder.rpartition("/batch_id=")
            last[run] = max(last.get(run, -1), int(batch_id))
        old = [f for f in batches if int(f.rpartition("/batch_id=")[2]) < last[f.rpartition("/batch_id=")[0]]]
        new = [f for f in old if f not in covered]
        if not new:
            return
        target = f"{self.path}/_snapshots/{number + 1}"
        rows = self._stored(spark, new + [snapshot] * (snapshot is not None))
        current = latest_by_key(rows, ["sink_table", "pk"], ["ts", "xid", "batch_id"]).drop("batch_id")
        current.write.mode("overwrite").partitionBy("sink_table").parquet(f"{target}/rows")
        covers = spark.createDataFrame([(f,) for f in old], "folder string")
        covers.coalesce(1).write.mode("overwrite").parquet(f"{target}/covers")

    def vacuum(self, spark: SparkSession) -> None:
        """Remove batches that the newest snapshot covers, and older snapshots. Reads begun before it fail."""
        number, _, covered = self._snapshot(spark)
        for folder in covered:
            remove(spark, folder)
        for folder in complete_folders(spark, f"{self.path}/_snapshots/*/covers"):
            if int(folder.split("/")[-2]) < number:
                remove(spark, folder.rpartition("/")[0])

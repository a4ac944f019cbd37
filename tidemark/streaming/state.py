"""State of streams as versioned tables: what a key was last seen doing, one version per micro-batch.

A version holds the keys of its micro-batch alone; every ``SNAPSHOT_EVERY`` versions all that can still matter is
folded into a snapshot. A micro-batch reads the versions before its own and writes its own, so one that is repeated
after a failure reads what it read before and replaces what it wrote. State never leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import marks
from tidemark.operators.latest import latest_by_key
from tidemark.sinks.batches import batch_folder, complete_folders, remove

SNAPSHOT_EVERY = 32


@dataclass
class Versions:
    """One state table of one run of a checkpoint, under ``folder``; ``schema`` doesn't name the version."""

    folder: str
    run: str
    schema: str
    keys: tuple[str, ...]

    def _numbers(self, spark: SparkSession, kind: str) -> dict[int, str]:
        pattern = f"{self.folder}/{kind}/{batch_folder(self.run, 0).rpartition('=')[0]}=*"
        return {int(path.rpartition("=")[2]): path for path in complete_folders(spark, pattern)}

    def rows(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """All rows of the newest snapshot before ``batch_id`` and of the versions since, with ``version``; none at the start.

        A key may have a row in each of them.
        """
        snapshots = {n: p for n, p in self._numbers(spark, "snapshots").items() if n < batch_id}
        base = max(snapshots, default=-1)
        paths = [snapshots[base]] if snapshots else []
        paths += [p for n, p in sorted(self._numbers(spark, "versions").items()) if base < n < batch_id]
        return spark.read.schema(f"{self.schema}, version bigint").parquet(*paths) if paths else None

    def latest(self, spark: SparkSession, batch_id: int, only: DataFrame | None = None) -> DataFrame | None:
        """The last row of each key before ``batch_id``, or of the keys in ``only``: a large state is scanned and reduced
        to them, not shuffled."""
        rows = self.rows(spark, batch_id)
        if rows is None:
            return None
        if only is not None:
            wanted = only.select([F.col(k).alias(f"_{k}") for k in self.keys])
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]
            rows = rows.join(wanted, same, "left_semi")
        return latest_by_key(rows, self.keys, ["version"]).drop("version")

    def commit(self, changed: DataFrame, batch_id: int, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Write the changed rows, one per key, as the version of ``batch_id``; ``keep`` filters the rows of a snapshot."""
        spark = changed.sparkSession
        versioned = changed.withColumn("version", F.lit(batch_id).cast("bigint"))
        versioned.write.mode("overwrite").parquet(f"{self.folder}/versions/{batch_folder(self.run, batch_id)}")
        if batch_id % SNAPSHOT_EVERY == SNAPSHOT_EVERY - 1:
            kept = keep(latest_by_key(self.rows(spark, batch_id + 1), self.keys, ["version"]))
            kept.write.mode("overwrite").parquet(f"{self.folder}/snapshots/{batch_folder(self.run, batch_id)}")
            self._forget(spark, batch_id)

    def _forget(self, spark: SparkSession, batch_id: int) -> None:
        """Remove what neither a repetition of ``batch_id`` nor any later micro-batch reads."""
        older = [n for n in self._numbers(spark, "snapshots") if n < batch_id]
        base = max(older, default=-1)
        for kind, limit in (("versions", base + 1), ("snapshots", base)):
            for number, path in self._numbers(spark, kind).items():
                if number < limit:
                    remove(spark, path)


@dataclass
class BatchMemory:
    """``marks.Memory`` of one micro-batch, whose rows are at ``low`` (microseconds) or later: tables are read as they were before it, and
    written by ``commit``. Later micro-batches hold later rows, so what doesn't matter to this one is forgotten."""

    folder: str
    run: str
    batch_id: int
    spark: SparkSession
    low: int
    _pending: list[tuple[Versions, DataFrame, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)

    def _table(self, name: str, schema: str, keys: Sequence[str]) -> Versions:
        return Versions(f"{self.folder}/{name}", self.run, schema, tuple(keys))

    def seen(self, name: str, cells: DataFrame, of: Sequence[marks.Mark]) -> DataFrame:
        table = self._table(name, marks.SEEN, ("role", "key"))
        changed, matters = marks.last_seen(cells, of), marks.still_matters(of, F.timestamp_micros(F.lit(self.low)))
        self._pending.append((table, changed, lambda rows: rows.where(matters)))
        rows = table.latest(self.spark, self.batch_id, changed)
        return self.spark.createDataFrame([], marks.SEEN) if rows is None else rows.where(matters)

    def latest(self, name: str, schema: str, keys: Sequence[str]) -> DataFrame | None:
        return self._table(name, schema, keys).latest(self.spark, self.batch_id)

    def remember(self, name: str, schema: str, keys: Sequence[str], rows: DataFrame) -> None:
        self._pending.append((self._table(name, schema, keys), rows, lambda kept: kept))

    def commit(self) -> None:
        for table, rows, keep in self._pending:
            table.commit(rows, self.batch_id, keep)

"""Topic sinks: one fixed topic, or a topic named by each record; and a console sink."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tidemark.functions import documents
from tidemark.sinks.batches import TABLE_RUN, batch_folder, is_complete


@dataclass(frozen=True)
class TopicWriter:
    """Kafka ``servers``, or ``folder`` with one sub-folder of JSON lines per topic.

    Kafka takes records at least once; consumers of keyed topics read the latest record per key.
    """

    servers: str | None = None
    folder: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def kafka_options(self, topic: str | None = None) -> dict[str, str]:
        picked = {"kafka.bootstrap.servers": self.servers or "", **self.options}
        return {**picked, "topic": topic} if topic else picked

    def stream(self, values: DataFrame, topic: str, checkpoint: str) -> DataStreamWriter:
        """Unstarted writer of ``value`` (and ``key``) rows to one topic."""
        writer = values.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
        if self.servers:
            return writer.format("kafka").options(**self.kafka_options(topic))
        return writer.format("text").option("path", f"{self.folder}/{topic}")

    def write_batch(self, values: DataFrame, topic: str, batch_id: int, run: str = TABLE_RUN) -> None:
        """Rows of one micro-batch to one topic.

        In a folder a batch that was written whole is left as it is when repeated, as streams that read the
        folder would take new files for new records; one that was not is replaced. ``run`` tells the batches
        of one checkpoint from those of another.
        """
        if self.servers:
            values.write.format("kafka").options(**self.kafka_options(topic)).save()
            return
        path = f"{self.folder}/{topic}/{batch_folder(run, batch_id)}"
        if not is_complete(values.sparkSession, path):
            values.select("value").write.mode("overwrite").text(path)

    def write_routed(self, records: DataFrame, batch_id: int, run: str = TABLE_RUN) -> None:
        """Rows (``topic``, ``value``) to the topic each names, all topics in one job; repeats as ``write_batch``."""
        if self.servers:
            records.write.format("kafka").options(**self.kafka_options()).save()
            return
        path = f"{self.folder}/_routed/{batch_folder(run, batch_id)}"
        if not is_complete(records.sparkSession, path):
            (records.select("value", "topic").write.mode("overwrite").option("partitionOverwriteMode", "static")
             .partitionBy("topic").text(path))


def json_records(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows as JSON ``value``; with ``keys`` also a JSON ``key``, for topics read as latest per key."""
    return documents.render(df, *keys)


def print_stream(df: DataFrame, rows: int = 20) -> DataStreamWriter:
    return df.writeStream.outputMode("append").format("console").option("numRows", rows).option("truncate", "false")

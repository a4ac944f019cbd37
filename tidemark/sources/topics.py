"""Topic sources. The same reader serves a Kafka topic and, for replay or tests, a folder of JSON lines."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import names, schemas
from tidemark.functions import clock, documents


@dataclass(frozen=True)
class TopicReader:
    """Where topics live: Kafka ``servers``, or ``folder`` with one sub-folder of JSON lines per topic.

    In folder form ``routed`` topics are also looked for where the routing job puts all of its topics.
    """

    servers: str | None = None
    folder: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    routed: tuple[str, ...] = names.ROUTED_TOPICS

    def _files(self, reader, topic: str) -> DataFrame:
        reader = reader.options(**self.options)
        if topic not in self.routed:
            return reader.text(f"{self.folder}/{topic}").select("value")
        either = f"{self.folder}/{{{topic},_routed/run=*/batch_id=*/topic={topic}}}"
        return reader.option("recursiveFileLookup", "true").text(either).select("value")

    def kafka_options(self, topic: str, group: str | None = None, starting: str = "latest") -> dict[str, str]:
        picked = {"kafka.bootstrap.servers": self.servers or "", "subscribe": topic, "startingOffsets": starting}
        if group:
            picked["kafka.group.id"] = group
        return {**picked, **self.options}

    def stream(self, spark: SparkSession, topic: str, group: str | None = None, starting: str = "latest") -> DataFrame:
        """Unbounded ``value`` strings of a topic; a record without a value stays null."""
        if self.servers:
            options = self.kafka_options(topic, group, starting)
            records = spark.readStream.format("kafka").options(**options).load()
            return records.select(F.col("value").cast("string").alias("value"))
        return self._files(spark.readStream, topic)

    def table(self, spark: SparkSession, topic: str) -> DataFrame:
        """The same topic as a bounded table, from the earliest to the latest offset."""
        if self.servers:
            options = self.kafka_options(topic, starting="earliest")
            records = spark.read.format("kafka").options(**options).load()
            return records.select(F.col("value").cast("string").alias("value"))
        return self._files(spark.read, topic)


def change_rows(values: DataFrame, schema: str = schemas.CHANGE) -> DataFrame:
    """Change log rows plus ``pt``, the processing time of the batch; malformed text fails whatever its table."""
    rows = documents.parse(values, schema).withColumn("pt", F.current_timestamp())
    return rows.withColumns({c: documents.whole_number(F.col(c)) for c in ("ts", "xid") if c in rows.columns})


def log_rows(values: DataFrame) -> DataFrame:
    """Application log rows as the window jobs read them."""
    rows = documents.parse(values, schemas.LOG).withColumn("ts", documents.whole_number(F.col("ts")))
    for part, name in schemas.LOG_NUMBERS:
        number = documents.whole_number(F.col(part)[name])
        rows = rows.withColumn(part, F.when(F.col(part).isNotNull(), F.col(part).withField(name, number)))
    return rows


def log_records(values: DataFrame) -> DataFrame:
    """Whole application log records (VARIANT ``record``) with the fields that repair and split ask for.

    Other columns of ``values`` are kept. Text that is malformed or no object fails the job.
    """
    records, record = documents.parse_objects(values), F.col("record")
    return records.select(
        "*", documents.text_of(record, "common", "mid").alias("mid"),
        documents.text_of(record, "common", "is_new").alias("is_new"),
        F.try_variant_get(record, "$.ts", "bigint").alias("ts"))


def page_maps(values: DataFrame) -> DataFrame:
    """Page log with map columns and the event time ``rt``, watermarked on a stream."""
    rows = page_rows(values)
    return with_event_time(rows, clock.ms_to_time(F.col("ts")))


def page_rows(values: DataFrame) -> DataFrame:
    """Page log with map columns."""
    return documents.parse(values, schemas.PAGE_MAPS).withColumn("ts", documents.whole_number(F.col("ts")))


def with_event_time(rows: DataFrame, time: Column, lateness: str = names.LATENESS) -> DataFrame:
    """Add the event time ``rt``, unless rows have it; on a stream also the bound on out-of-order rows."""
    if "rt" in rows.columns:
        return rows
    timed = rows.withColumn("rt", time.cast("timestamp"))
    return timed.withWatermark("rt", lateness) if rows.isStreaming else timed


def event_time(rows: DataFrame) -> Column:
    """The event time of parsed records: ``ts`` in milliseconds, else ``create_time``."""
    return clock.ms_to_time(F.col("ts")) if "ts" in rows.columns else clock.text_to_time(F.col("create_time"))


def once(rows: DataFrame, unique: Sequence[str]) -> DataFrame:
    """Records without their repeats: the first of equal event time and ``unique`` columns stays. On a stream a record is
    remembered as long as a repeat can come in time. Records without an event time go."""
    timed = with_event_time(rows, event_time(rows)).filter(F.col("rt").isNotNull())
    keys = {f"_u{i}": F.col(c) for i, c in enumerate(unique)}
    keyed = timed.withColumns(keys)
    kept = keyed.dropDuplicatesWithinWatermark([*keys, "rt"]) if rows.isStreaming else keyed.dropDuplicates([*keys, "rt"])
    return kept.drop(*keys)

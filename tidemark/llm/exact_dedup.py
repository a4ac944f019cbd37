"""Exact duplicates: local dedup, salted merge, global merge of salt winners, whole texts compared at every stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty

#: White space that counts as one space in a comparison.
BLANKS = r"[\x20\x09-\x0D]+"
SALTS = 16


def _normalised(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    body = F.regexp_replace(text_or_empty(text_column), BLANKS, " ")
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), body.alias("body")).withColumn("digest", F.sha2("body", 256))


def _label() -> list[Column]:
    """What a row carries back to its group: the text itself has been compared by then."""
    return [F.col("digest"), F.length("body").alias("size"), F.xxhash64("body").alias("check")]


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    The text is a key of every aggregate, next to its digest, so equal digests of different texts never
    merge. The partial aggregate is the local stage: a hot text leaves each map task as one row. Salts
    (of the map task) spread those rows over reducers; the second aggregate merges the salt winners.
    Rows get their group by digest, length and a second hash, in a join that Spark can split.

    Null text counts as empty. Ties are impossible but for rows that repeat an id; such copies of the
    kept row all have ``kept`` true (``deduplicated`` returns one of them). A null id is never kept
    unless its whole group has none; then keep_id is null and kept is true. Other columns aren't read. An empty table gives no rows.
    """
    rows = _normalised(docs, id_column, text_column)
    merged = (rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
              .groupBy("digest", "salt", "body").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")))
    groups = merged.groupBy("digest", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    labels = groups.select(*_label(), "keep_id", "group_size")
    return (rows.select("doc_id", *_label()).join(labels, ["digest", "size", "check"])
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")))


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one per group of equal texts, the one with the smallest id."""
    kept = exact_groups(docs, id_column, text_column, salts).where("kept").select("doc_id", "text_sha256")
    body = F.regexp_replace(F.coalesce(F.col("_row")[text_column].cast("string"), F.lit("")), BLANKS, " ")
    packed = docs.select(F.struct("*").alias("_row")).select("_row", F.col("_row")[id_column].cast("long").alias("_id"), F.sha2(body, 256).alias("_digest"))
    stay = packed.join(kept, F.col("_id").eqNullSafe(kept.doc_id) & (F.col("_digest") == kept.text_sha256), "left_semi")
    return stay.groupBy("_id", "_digest").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM d"""

"""Fact tables from the change log. Every function serves tables and streams alike.

``changes`` is the change topic: its raw ``value`` text, or rows parsed by ``change_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import names, schemas
from tidemark.functions import documents
from tidemark.operators.joins import change_join
from tidemark.operators.latest import latest_by_key
from tidemark.operators.lookup import lookup_join
from tidemark.sources.topics import change_rows, with_event_time


def inserted(changes: DataFrame, database: str, table: str, where: Column | None = None, *extra: str) -> DataFrame:
    """Inserted rows of one table, its ``data`` keys as string columns, and the ``extra`` columns of the change."""
    rows = change_rows(changes, schemas.CHANGED_ROW) if "value" in changes.columns else changes
    rows = rows.filter(
        (F.col("database") == database) & (F.col("table") == table) & (F.col("type") == "insert")
    )
    if where is not None:
        rows = rows.filter(where)
    fields = ", ".join(f"{k}: string" for k in schemas.FACT_KEYS[table])
    row = F.try_variant_get("data", "$", f"struct<{fields}>").alias("_row")
    return rows.select(row, *extra).select("_row.*", *extra)


def _timed(changes: DataFrame, database: str, table: str, where: Column | None = None) -> DataFrame:
    """Inserted rows with ``rt``, the time of the change itself: partners are written close together, whatever
    business times they carry."""
    rows = inserted(changes, database, table, where, "ts")
    return with_event_time(rows, F.timestamp_seconds("ts")).drop("ts")


def cart_adds(changes: DataFrame, database: str) -> DataFrame:
    return inserted(changes, database, "cart_info", None, "pt")


def order_details(changes: DataFrame, database: str, retention: str = names.JOIN_RETENTION, counted: str | None = None) -> DataFrame:
    """Order lines with their order."""
    lines = _timed(changes, database, "order_detail")
    orders = _timed(changes, database, "order_info")
    return change_join(lines, orders, "order_id", "id", retention, counted).select(
        "id", "course_id", "course_name", "order_id", "user_id", "coupon_reduce", "final_amount", "create_time",
        F.col("r_origin_amount").alias("origin_amount"), F.col("r_order_status").alias("order_status"),
        F.col("r_trade_body").alias("trade_body"), F.col("r_session_id").alias("session_id"),
        F.col("r_province_id").alias("province_id"), F.col("r_expire_time").alias("expire_time"),
    )


def paid_details(changes: DataFrame, database: str, retention: str = names.JOIN_RETENTION, counted: str | None = None) -> DataFrame:
    """Order lines with their successful payment."""
    lines = _timed(changes, database, "order_detail")
    done = documents.text_of(F.col("data"), "payment_status") == names.PAYMENT_DONE
    payments = _timed(changes, database, "payment_info", done)
    return change_join(lines, payments, "order_id", "order_id", retention, counted).select(
        "id", "course_id", "course_name", "order_id", "user_id", "origin_amount", "coupon_reduce", "final_amount",
        "create_time", "update_time", F.col("r_total_amount").alias("total_amount"),
        F.col("r_trade_body").alias("trade_body"), F.col("r_payment_type").alias("payment_type"),
        F.col("r_payment_status").alias("payment_status"), F.col("r_callback_content").alias("callback_content"),
        F.col("r_callback_time").alias("callback_time"),
    )


def exams(changes: DataFrame, database: str, retention: str = names.JOIN_RETENTION, counted: str | None = None) -> DataFrame:
    """Finished exams, one row per answered question."""
    taken = _timed(changes, database, "test_exam")
    answers = _timed(changes, database, "test_exam_question")
    return change_join(taken, answers, "id", "exam_id", retention, counted).select(
        "id", "paper_id", "user_id", "score", "duration_sec", "create_time", "submit_time",
        F.col("r_question_id").alias("question_id"), F.col("r_answer").alias("answer"),
        F.col("r_is_correct").alias("is_correct"),
    )


def upserted(facts: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Keyed view of a fact table: one row per key, the last one by ``create_time`` and then by value."""
    rest = [c for c in facts.columns if c not in keys]
    return latest_by_key(facts, keys, ["create_time", *[c for c in rest if c != "create_time"]])


def exam_questions(changes: DataFrame, database: str, retention: str = names.SHORT_JOIN_RETENTION, counted: str | None = None) -> DataFrame:
    """Answered questions with the score and duration of their exam."""
    answers = _timed(changes, database, "test_exam_question")
    taken = _timed(changes, database, "test_exam")
    return change_join(answers, taken, "exam_id", "id", retention, counted).select(
        "id", "exam_id", "paper_id", "question_id", "user_id", "answer", "is_correct",
        F.col("score").alias("question_score"), F.col("r_score").alias("paper_score"),
        F.col("r_duration_sec").alias("duration_sec"), F.col("r_create_time").alias("create_time"),
    )


def test_papers(changes: DataFrame, database: str, papers: DataFrame) -> DataFrame:
    """Exams with their paper, looked up in the keyed table ``papers(id, paper_title, course_id)``."""
    taken = inserted(changes, database, "test_exam").drop("submit_time")
    paper_id = F.col("paper_id").try_cast("bigint")
    return lookup_join(taken, papers, paper_id, {"paper_title": "paper_title", "course_id": "course_id"})


def course_reviews(changes: DataFrame, database: str) -> DataFrame:
    return inserted(changes, database, "review_info")


def chapter_comments(changes: DataFrame, database: str) -> DataFrame:
    return inserted(changes, database, "comment_info")

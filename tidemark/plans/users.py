"""Window measures of users: logins, returning users, registrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import names, schemas
from tidemark.functions import clock
from tidemark.operators.marks import Mark, Memory, count_marks, mark_cells
from tidemark.operators.windows import stamped, tumble
from tidemark.sources.topics import with_event_time


def login_marks(return_days: int = names.RETURN_AFTER_DAYS, retention: str | None = None) -> tuple[Mark, ...]:
    """``retention`` bounds how long a stream remembers the last login of a user."""
    return (Mark("uuCt", ("uid",), returned="backCt", return_days=return_days, retention=retention),)


def login_cells(pages: DataFrame, size: str = names.WINDOW) -> DataFrame:
    """Cells of the users who log in."""
    rows = with_event_time(pages, clock.ms_to_time(F.col("ts"))).select(
        "rt", F.col("common.uid").alias("uid"), F.col("page.last_page_id").alias("last_page_id"))
    entered = F.col("last_page_id").isNull() | (F.col("last_page_id") == names.LOGIN_PAGE)
    return mark_cells(rows.filter(F.col("uid").isNotNull() & entered), login_marks(), size=size)


def login_windows(cells: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None, return_days: int = names.RETURN_AFTER_DAYS,
                  memory: Memory | None = None, retention: str | None = None) -> DataFrame:
    windows = count_marks(cells, login_marks(return_days, retention), (), size, memory)
    return stamped(windows, schemas.RESULT_COLUMNS["dws_user_user_login_window"], emit_ts)


def logins(pages: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None,
           return_days: int = names.RETURN_AFTER_DAYS) -> DataFrame:
    """Daily logged-in users, and among them those whose last login day is ``return_days`` or more back."""
    return login_windows(login_cells(pages, size), size, emit_ts, return_days)


def registrations(registered: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None) -> DataFrame:
    """Registered users per window; only ``create_time`` is read."""
    rows = with_event_time(registered, clock.text_to_time(F.col("create_time"))).filter(F.col("rt").isNotNull())
    counted = tumble(rows, {"registerCt": F.count(F.lit(1))}, size=size)
    return stamped(counted, schemas.RESULT_COLUMNS["dws_user_user_register_window"], emit_ts)

"""Window measures of carts and orders."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import names, schemas
from tidemark.functions import clock
from tidemark.operators.lookup import enrich
from tidemark.operators.marks import Mark, Memory, count_marks, firsts, mark_cells
from tidemark.operators.totals import dealt, last_totals, running_totals
from tidemark.operators.windows import stamped, tumble
from tidemark.sources.topics import with_event_time

DUPLICATE_IDLE = "5 seconds"
USER_IDLE = "1 day"


def _timed(rows: DataFrame) -> DataFrame:
    return with_event_time(rows, clock.text_to_time(F.col("create_time"))).filter(F.col("rt").isNotNull())


def _amount(column: str = "final_amount") -> Column:
    return F.col(column).try_cast(schemas.AMOUNT)


def _result(windows: DataFrame, table: str, emit_ts: Column | None) -> DataFrame:
    return stamped(windows, schemas.RESULT_COLUMNS[table], emit_ts)


CART_USERS = (Mark("cartAddUuCt", ("user_id",)),)
ORDER_USERS = (Mark("orderUniqueUserCount", ("user_id",)),)


def user_cells(marks: tuple[Mark, ...], rows: DataFrame, size: str = names.WINDOW) -> DataFrame:
    """Cells of daily unique users."""
    return mark_cells(_timed(rows), marks, size=size)


def cart_user_windows(cells: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None, memory: Memory | None = None) -> DataFrame:
    return _result(count_marks(cells, CART_USERS, (), size, memory), "dws_trade_cart_add_uu_window", emit_ts)


def cart_users(carts: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None) -> DataFrame:
    """Daily unique users who put something in the cart."""
    return cart_user_windows(user_cells(CART_USERS, carts, size), size, emit_ts)


def order_user_windows(cells: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None, memory: Memory | None = None) -> DataFrame:
    return _result(count_marks(cells, ORDER_USERS, (), size, memory), "dws_trade_order_window", emit_ts)


def order_users(details: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None) -> DataFrame:
    """Daily unique ordering users."""
    return order_user_windows(user_cells(ORDER_USERS, details, size), size, emit_ts)


#: ``userCount`` counts orders new on their day; by user it counts users, and ``orderCount`` the orders.
ORDER_TOTALS = (Mark("userCount", ("order_id",)),)
ORDER_TOTALS_BY_USER = (Mark("userCount", ("user_id",)), Mark("orderCount", ("order_id",)))


def order_cells(details: DataFrame, size: str = names.WINDOW, by_user: bool = False) -> DataFrame:
    """Cells of orders (and users) with the amount and number of lines."""
    sums = {"totalAmount": _amount(), **({} if by_user else {"orderCount": F.lit(1)})}
    rows = _timed(details).select("rt", "order_id", *(["user_id"] if by_user else []), "final_amount")
    return mark_cells(rows, ORDER_TOTALS_BY_USER if by_user else ORDER_TOTALS, (), sums, size)


def order_total_windows(cells: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None, by_user: bool = False,
                        memory: Memory | None = None) -> DataFrame:
    windows = count_marks(cells, ORDER_TOTALS_BY_USER if by_user else ORDER_TOTALS, (), size, memory)
    return _result(windows, "dws_trade_order_count_window", emit_ts)


def order_totals(details: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None) -> DataFrame:
    """Amount, orders new on their day (``userCount``) and order lines (``orderCount``) per window."""
    return order_total_windows(order_cells(details, size), size, emit_ts)


def order_totals_by_user(details: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None) -> DataFrame:
    """As ``order_totals``, but ``userCount`` counts daily unique users and ``orderCount`` daily unique orders."""
    return order_total_windows(order_cells(details, size, True), size, emit_ts, True)


#: Order lines cleaned of duplicates: only the first line of a run of one id (or one course) counts.
LINES = (Mark(None, ("id",), "idle", DUPLICATE_IDLE, ("order_id", "user_id", "province_id", "amount")),)
COURSE_LINES = (Mark(None, ("course_id",), "idle", DUPLICATE_IDLE, ("course_id", "course_name", "amount")),)
DETAIL_LINES = (Mark(None, ("id",), "idle", DUPLICATE_IDLE, ("course_id", "course_name", "amount")),)
#: Distinct orders of a province and window, and users first seen.
PROVINCE = (Mark("orderCount", ("province_id", "order_id"), "window"), Mark("userCount", ("user_id",), "idle", USER_IDLE))


def line_cells(marks: tuple[Mark, ...], details: DataFrame, size: str = names.WINDOW) -> DataFrame:
    """Cells of order lines by what they are cleaned by."""
    columns = dict.fromkeys([*marks[0].keys, *marks[0].carry])
    return mark_cells(_timed(details).select("rt", *[_amount().alias(c) if c == "amount" else F.col(c) for c in columns]), marks, size=size, ahead=True)


def _clean_lines(cells: DataFrame, marks: tuple[Mark, ...], size: str, memory: Memory | None) -> DataFrame:
    seen = memory.seen("lines", cells, marks) if memory else None
    return firsts(cells, marks, (), seen, size).withColumnRenamed("at", "rt")


def province_windows(cells: DataFrame, size: str = names.WINDOW, memory: Memory | None = None) -> DataFrame:
    """Distinct orders, first-seen users and amount per province, over lines cleaned of duplicates by id."""
    lines = _clean_lines(cells, LINES, size, memory)
    users = mark_cells(lines, PROVINCE, ["province_id"], {"orderAmount": F.col("amount")}, size, ahead=True)
    return count_marks(users, PROVINCE, ["province_id"], size, memory, "users")


def name_provinces(windows: DataFrame, provinces: DataFrame, emit_ts: Column | None = None) -> DataFrame:
    named = enrich(windows, provinces, "province_id", {"provinceName": "NAME"})
    return stamped(named.withColumnRenamed("province_id", "provinceId"),
                   schemas.RESULT_COLUMNS["dws_trade_province_order_window"], emit_ts)


def by_province(details: DataFrame, provinces: DataFrame, size: str = names.WINDOW,
                emit_ts: Column | None = None) -> DataFrame:
    """The measures of every province under its name."""
    return name_provinces(province_windows(line_cells(LINES, details, size), size), provinces, emit_ts)


#: Running totals of a subject, as remembered between micro-batches.
SUBJECT_TOTALS = "subjectId string, at timestamp, subOrderCt bigint, subOrderAmount decimal(38,6), subOrderUserCt bigint"
_TOTALS = {"subOrderCt": "one", "subOrderAmount": "courseOrderAmount"}


def _course_subjects(courses: DataFrame, subjects: DataFrame) -> DataFrame:
    """Subject and its name of each course, and how often the dimensions hold them."""
    named = enrich(courses.select(F.col("id").cast("string").alias("_course"), F.col("SUBJECT_ID").alias("subjectId")),
                   subjects, "subjectId", {"subjectName": "SUBJECT_NAME"})
    return named.groupBy("_course", "subjectId", "subjectName").agg(F.count(F.lit(1)).cast("int").alias("_copies"))


def course_windows(cells: DataFrame, courses: DataFrame, subjects: DataFrame, size: str = names.WINDOW, per_detail: bool = False,
                   memory: Memory | None = None) -> DataFrame:
    """Results per course and window from the cells of lines; subject totals go on from those remembered."""
    lines = _clean_lines(cells, DETAIL_LINES if per_detail else COURSE_LINES, size, memory)
    # The subject is looked up first: lines dealt by it and by chunks of whole windows are aggregated and summed up where they are.
    lines = lines.join(_course_subjects(courses, subjects), F.col("course_id") == F.col("_course"), "left")
    width = clock.duration_us(size)
    lines = dealt(lines, ["subjectId"], "rt", f"{width * math.ceil(clock.duration_us('1 hour') / width)} microseconds")
    windows = tumble(lines.withColumn("at", F.col("rt")), {
        "courseOrderUserCt": F.count(F.lit(1)),
        "courseOrderAmount": F.sum("amount"),
        "_first": F.min(F.struct("at", "course_name")),
        "_copies": F.max("_copies"),
    }, ["_key", "_chunk", "course_id", "subjectName"], size)
    rows = windows.select(
        "window", F.col("course_id").alias("courseId"), F.col("_first.course_name").alias("courseName"),
        "courseOrderUserCt", "courseOrderAmount", F.col("_key.subjectId").alias("subjectId"), "subjectName",
        F.col("_first.at").alias("at"), F.lit(1).cast("bigint").alias("one"), "_key", "_chunk",
        # A lookup gives a row for every row of the dimension.
        F.explode(F.array_repeat(F.lit(1), F.coalesce("_copies", F.lit(1)))).alias("_copy"),
    ).drop("_copy")
    before = memory.latest("subjects", SUBJECT_TOTALS, ("subjectId",)) if memory else None
    totals = running_totals(rows, ["subjectId"], "at", ["courseId"], _TOTALS, starts="subOrderUserCt", ttl=DUPLICATE_IDLE, before=before)
    if memory:
        last = last_totals(totals, ["subjectId"], "at", ["courseId"], [*_TOTALS, "subOrderUserCt"])
        last = last.withColumn("subOrderAmount", F.col("subOrderAmount").cast("decimal(38,6)"))
        memory.remember("subjects", SUBJECT_TOTALS, ("subjectId",), last)
    return stamped(totals.withColumn("ts", F.unix_millis("at")),
                   schemas.RESULT_COLUMNS["dws_trade_course_subject_order_window"])


def by_course_and_subject(details: DataFrame, courses: DataFrame, subjects: DataFrame, size: str = names.WINDOW,
                          per_detail: bool = False) -> DataFrame:
    """Orders per course and window, with running totals of the course's subject.

    Order lines are cleaned by course (only the first line of a run of one course counts), or with
    ``per_detail`` by their id. ``ts`` is the event time of the first line.
    """
    cells = line_cells(DETAIL_LINES if per_detail else COURSE_LINES, details, size)
    return course_windows(cells, courses, subjects, size, per_detail)

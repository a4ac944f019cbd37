"""Window measures over the page log (``common``, ``page``, ``ts``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import names, schemas
from tidemark.functions import clock, words
from tidemark.operators.lookup import enrich
from tidemark.operators.marks import Mark, Memory, count_marks, mark_cells
from tidemark.operators.windows import stamped, tumble
from tidemark.sources.topics import with_event_time

IDLE = "1 day"


def _timed(pages: DataFrame) -> DataFrame:
    return with_event_time(pages, clock.ms_to_time(F.col("ts")))


def keyword_counts(pages: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None,
                   splitter: Callable[[Column], Column] = words.split_words) -> DataFrame:
    """Searched words per window. ``ts`` is in seconds here."""
    searched = _timed(pages).select("rt", F.col("page.item").alias("item"), F.col("page.item_type").alias("kind"))
    searched = searched.filter(F.col("item").isNotNull() & (F.col("kind") == names.KEYWORD_ITEM))
    counted = tumble(words.explode_words(searched, "item", "keyword", splitter),
                     {"keyword_count": F.count(F.lit(1))}, ["keyword"], size)
    return stamped(counted, schemas.RESULT_COLUMNS["dws_traffic_keyword_page_view_window"],
                   clock.now_seconds() if emit_ts is None else emit_ts)


PAGE_VISITORS = (Mark(None, ("mid", "page_id"), carry=("homeUvCt", "goodDetailUvCt")),)


def page_visitor_cells(pages: DataFrame, size: str = names.WINDOW, home: str = names.HOME_PAGE, detail: str = names.DETAIL_PAGE) -> DataFrame:
    """Cells of the devices on the home page and on the detail page."""
    seen = _timed(pages).select("rt", F.col("common.mid").alias("mid"), F.col("page.page_id").alias("page_id"))
    on_home = F.col("page_id") == home
    seen = seen.filter(F.col("page_id").isin(home, detail)).withColumns({
        "homeUvCt": F.when(on_home, 1).otherwise(0), "goodDetailUvCt": F.when(on_home, 0).otherwise(1)})
    return mark_cells(seen, PAGE_VISITORS, size=size)


def page_visitor_windows(cells: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None, memory: Memory | None = None) -> DataFrame:
    return stamped(count_marks(cells, PAGE_VISITORS, (), size, memory), schemas.RESULT_COLUMNS["dws_traffic_page_view_window"], emit_ts)


def page_visitors(pages: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None,
                  home: str = names.HOME_PAGE, detail: str = names.DETAIL_PAGE) -> DataFrame:
    """Daily unique devices of the home page and of the detail page."""
    return page_visitor_windows(page_visitor_cells(pages, size, home, detail), size, emit_ts)


def _views(pages: DataFrame) -> DataFrame:
    page = F.col("page")
    return _timed(pages).select(
        "rt", F.col("common.mid").alias("mid"), F.col("common.sid").alias("sid"), F.col("common.sc").alias("sc"),
        F.col("common.is_new").alias("is_new"), page["during_time"].cast("bigint").alias("durSum"),
        # A session that opens on such a row counts as a single-page session.
        F.when(page["item_type"].isNull() & page["last_page_id"].isNull(), 1).otherwise(0).alias("pageOneCt"),
        F.lit(1).alias("pageCt"),
    )


_DEVICES = Mark("uvCt", ("mid",), "idle", IDLE)
VISITS = (_DEVICES, Mark("svCt", ("sid",), "idle", IDLE, ("pageOneCt",)))
PLAIN_VISITS = (_DEVICES, Mark("svCt", ("sid",), "idle", IDLE))


def source_cells(pages: DataFrame, size: str = names.WINDOW, by: str = "sc") -> DataFrame:
    """Cells of devices and sessions with pages and time spent, by traffic source (or another column)."""
    return mark_cells(_views(pages), VISITS, [by], {"pageCt": F.col("pageCt"), "durSum": F.col("durSum")}, size)


def source_windows(cells: DataFrame, size: str = names.WINDOW, memory: Memory | None = None, by: str = "sc") -> DataFrame:
    """Visitors, sessions, pages, single-page sessions and time spent per traffic source id."""
    return count_marks(cells, VISITS, [by], size, memory)


def name_sources(windows: DataFrame, sources: DataFrame, emit_ts: Column | None = None) -> DataFrame:
    named = enrich(windows, sources, "sc", {"sourceName": "SOURCE_SITE"})
    return stamped(named, schemas.RESULT_COLUMNS["dws_traffic_source_window"], emit_ts)


def by_source(pages: DataFrame, sources: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None) -> DataFrame:
    """The measures of every traffic source under its name."""
    return name_sources(source_windows(source_cells(pages, size), size), sources, emit_ts)


def time_cells(pages: DataFrame, size: str = names.WINDOW) -> DataFrame:
    """Cells of devices and sessions with pages."""
    return mark_cells(_views(pages), PLAIN_VISITS, (), {"pageCt": F.col("pageCt")}, size)


def time_windows(cells: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None, memory: Memory | None = None) -> DataFrame:
    return stamped(count_marks(cells, PLAIN_VISITS, (), size, memory), schemas.RESULT_COLUMNS["dws_traffic_time_window"], emit_ts)


def by_time(pages: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None) -> DataFrame:
    """Visitors, sessions and pages per window."""
    return time_windows(time_cells(pages, size), size, emit_ts)


def visitor_kind_windows(cells: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None, memory: Memory | None = None) -> DataFrame:
    windows = source_windows(cells, size, memory, "is_new")
    return stamped(windows, schemas.RESULT_COLUMNS["dws_traffic_visitor_kind_window"], emit_ts)


def by_visitor_kind(pages: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None) -> DataFrame:
    """The measures of ``by_source`` split by the new-visitor flag."""
    return visitor_kind_windows(source_cells(pages, size, "is_new"), size, emit_ts)

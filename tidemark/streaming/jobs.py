"""The streaming jobs: topic in, plan, topic or table out.

Each ``start_*`` function starts one query and returns it. State and offsets live under ``checkpoints``,
by default in the shared folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import names, schemas
from tidemark.functions import clock, documents
from tidemark.operators import routing, visitors
from tidemark.operators.latest import latest_by_key
from tidemark.operators.logsplit import split_logs
from tidemark.plans import facts, study, trade, traffic, users
from tidemark.session import shared_folder
from tidemark.sinks.batches import run_of
from tidemark.sinks.changes import ChangeLog
from tidemark.sinks.dims import DimStore
from tidemark.sinks.results import ResultTable
from tidemark.sinks.topics import TopicWriter, json_records
from tidemark.sources.topics import TopicReader, change_rows, log_records, log_rows, once, page_maps
from tidemark.streaming.state import BatchMemory, Versions

# Reads a dimension by name with the columns wanted.
DimReader = Callable[[str, tuple[str, ...]], DataFrame]

SOURCE_DIM = ("dim_base_source", ("id", "source_site"))
PROVINCE_DIM = ("dim_base_province", ("id", "name"))
COURSE_DIM = ("dim_course_info", ("id", "course_name", "subject_id"))
SUBJECT_DIM = ("dim_base_subject_info", ("id", "subject_name"))
VIDEO_DIM = ("dim_video_info", ("id", "chapter_id"))
CHAPTER_DIM = ("dim_chapter_info", ("id", "chapter_name"))

_DETAIL = schemas.strings(("id", "course_id", "course_name", "order_id", "user_id", "coupon_reduce", "final_amount",
                           "create_time", "origin_amount", "order_status", "trade_body", "session_id", "province_id",
                           "expire_time"))
_PAPER = schemas.strings(("id", "paper_id", "user_id", "score", "duration_sec", "create_time", "paper_title", "course_id"))
_REVIEW = schemas.strings(("course_id", "user_id", "id", "review_stars", "create_time"))


def _rows(schema: str) -> Callable[[DataFrame], DataFrame]:
    return lambda values: documents.parse(values, schema)


def _as_they_are(windows: DataFrame, dims: DimReader, memory: BatchMemory) -> DataFrame:
    return windows


@dataclass(frozen=True)
class MeasureJob:
    """``cells`` runs on the stream and is its only stateful operator: rows of closed windows, complete. ``results`` turns
    those of a micro-batch into rows of ``table``, with the dimensions as they are then and what earlier ones left in
    ``memory``."""

    topic: str
    table: str
    parse: Callable[[DataFrame], DataFrame]
    cells: Callable[[DataFrame], DataFrame]
    results: Callable[..., DataFrame] = _as_they_are


def _marked(windows: Callable[..., DataFrame], **fixed) -> Callable[..., DataFrame]:
    """Results that need no dimension."""
    return lambda cells, dims, memory, **options: windows(cells, memory=memory, **fixed, **options)


MEASURE_JOBS = {
    "keyword_counts": MeasureJob(names.PAGE_TOPIC, "dws_traffic_keyword_page_view_window", page_maps,
                                 traffic.keyword_counts),
    "page_visitors": MeasureJob(names.PAGE_TOPIC, "dws_traffic_page_view_window", log_rows, traffic.page_visitor_cells,
                                _marked(traffic.page_visitor_windows)),
    "traffic_by_source": MeasureJob(names.PAGE_TOPIC, "dws_traffic_source_window", log_rows, traffic.source_cells,
                                    lambda c, dims, memory: traffic.name_sources(traffic.source_windows(c, memory=memory), dims(*SOURCE_DIM))),
    "traffic_by_time": MeasureJob(names.PAGE_TOPIC, "dws_traffic_time_window", log_rows, traffic.time_cells,
                                  _marked(traffic.time_windows)),
    "traffic_by_visitor_kind": MeasureJob(names.PAGE_TOPIC, "dws_traffic_visitor_kind_window", log_rows,
                                          partial(traffic.source_cells, by="is_new"), _marked(traffic.visitor_kind_windows)),
    "user_logins": MeasureJob(names.PAGE_TOPIC, "dws_user_user_login_window", log_rows, users.login_cells,
                              _marked(users.login_windows)),
    "user_registrations": MeasureJob(names.USER_REGISTER_TOPIC, "dws_user_user_register_window",
                                     _rows("create_time string"), users.registrations),
    "cart_users": MeasureJob(names.CART_ADD_TOPIC, "dws_trade_cart_add_uu_window",
                             _rows(schemas.strings(schemas.FACT_KEYS["cart_info"])), partial(trade.user_cells, trade.CART_USERS),
                             _marked(trade.cart_user_windows)),
    "order_users": MeasureJob(names.ORDER_DETAIL_TOPIC, "dws_trade_order_window", _rows(_DETAIL),
                              partial(trade.user_cells, trade.ORDER_USERS), _marked(trade.order_user_windows)),
    "order_totals": MeasureJob(names.ORDER_DETAIL_TOPIC, "dws_trade_order_count_window", _rows(_DETAIL),
                               trade.order_cells, _marked(trade.order_total_windows)),
    "order_totals_by_user": MeasureJob(names.ORDER_DETAIL_TOPIC, "dws_trade_order_user_count_window", _rows(_DETAIL),
                                       partial(trade.order_cells, by_user=True), _marked(trade.order_total_windows, by_user=True)),
    "orders_by_province": MeasureJob(names.ORDER_DETAIL_TOPIC, "dws_trade_province_order_window", _rows(_DETAIL),
                                     partial(trade.line_cells, trade.LINES),
                                     lambda c, dims, memory: trade.name_provinces(trade.province_windows(c, memory=memory), dims(*PROVINCE_DIM))),
    "orders_by_course_subject": MeasureJob(names.ORDER_DETAIL_TOPIC, "dws_trade_course_subject_order_window", _rows(_DETAIL),
                                           partial(trade.line_cells, trade.COURSE_LINES),
                                           lambda c, dims, memory: trade.course_windows(c, dims(*COURSE_DIM), dims(*SUBJECT_DIM), memory=memory)),
    "orders_by_course_subject_per_detail": MeasureJob(
        names.ORDER_DETAIL_TOPIC, "dws_trade_course_subject_detail_window", _rows(_DETAIL), partial(trade.line_cells, trade.DETAIL_LINES),
        lambda c, dims, memory: trade.course_windows(c, dims(*COURSE_DIM), dims(*SUBJECT_DIM), per_detail=True, memory=memory)),
    "papers_by_course": MeasureJob(names.TEST_PAPER_TOPIC, "dws_test_paper_course_window", _rows(_PAPER),
                                   study.paper_measures,
                                   lambda w, dims, memory: study.name_papers(w, dims(*COURSE_DIM))),
    "course_reviews": MeasureJob(names.REVIEW_ADD_TOPIC, "dws_course_user_review_window", _rows(_REVIEW),
                                 study.review_measures,
                                 lambda w, dims, memory: study.name_reviews(w, dims(*COURSE_DIM))),
    "course_reviews_by_user": MeasureJob(names.REVIEW_ADD_TOPIC, "dws_course_review_user_window", _rows(_REVIEW),
                                         partial(study.review_measures, distinct_users=True),
                                         lambda w, dims, memory: study.name_reviews(w, dims(*COURSE_DIM))),
    "video_plays": MeasureJob(names.VIDEO_TOPIC, "dws_video_info_window", log_rows, study.video_cells,
                              lambda c, dims, memory: study.name_chapters(study.video_windows(c, memory=memory), dims(*VIDEO_DIM), dims(*CHAPTER_DIM))),
}


def start_measures(spark: SparkSession, name: str, reader: TopicReader, dims: DimReader, results: str | Callable[[DataFrame, str], None],
                   checkpoints: str | None = None, available_now: bool = False, unique: Sequence[str] = (), **options) -> StreamingQuery:
    """Start one window job into its result table.

    ``results`` is the folder of the result tables, or a function of rows and table name that puts them elsewhere, as
    ``append_jdbc`` into a database; such rows may come again after a failure, with the same keys and a later ``ts``.
    ``unique`` names columns (as ``id``, or ``common.mid``) by which records that a topic holds more than once, as one
    written again after a failure, are counted once; repeats must not be later than the bound on lateness.
    ``options`` go to the job's results, as ``retention`` for the logins, which else remember a user for ever.
    """
    job = MEASURE_JOBS[name]
    rows = job.parse(reader.stream(spark, job.topic, f"{name}_group"))
    if unique:
        rows = once(rows, unique)
    table = ResultTable(results, job.table) if isinstance(results, str) else None
    state = f"{_folder(spark, checkpoints)}/{name}-state"

    def put(rows: DataFrame, batch_id: int, run: str) -> None:
        if table:
            table.append(rows, batch_id, run)
        else:
            results(rows, job.table)

    def write(batch: DataFrame, batch_id: int) -> None:
        run = run_of(batch)
        if "role" not in batch.columns:  # plain windows: nothing is read twice
            put(job.results(batch, dims, None, **options), batch_id, run)
            return
        # Several actions read the cells; unpersisted, the stream's own state would be run again for each.
        cells = batch.persist()
        try:
            low = cells.agg(F.unix_micros(F.min("first.at")).alias("low")).first()["low"]
            if low is not None:
                memory = BatchMemory(state, run, batch_id, batch.sparkSession, low)
                put(job.results(cells, dims, memory, **options), batch_id, run)
                memory.commit()
        finally:
            cells.unpersist()

    return _start(job.cells(rows), write, checkpoints, name, available_now)


def start_change_log(spark: SparkSession, reader: TopicReader, log: ChangeLog, checkpoints: str | None = None,
                     available_now: bool = False) -> StreamingQuery:
    """Start the job that parses the change topic once and keeps it by table, for any number of fact jobs."""
    return _start(reader.stream(spark, names.CHANGE_TOPIC, "change_log_group"),
                  lambda batch, batch_id: log.append(batch, batch_id, run_of(batch)) and None, checkpoints, "change_log", available_now)


# Fact job: topic, plan over the change topic, key of the record (none for plain appends), tables it reads.
FACT_JOBS = {
    "cart_adds": (names.CART_ADD_TOPIC, facts.cart_adds, (), ("cart_info",)),
    "order_details": (names.ORDER_DETAIL_TOPIC, facts.order_details, ("id",), ("order_detail", "order_info")),
    "paid_details": (names.PAY_DETAIL_TOPIC, facts.paid_details, ("id",), ("order_detail", "payment_info")),
    "exams": (names.EXAM_TOPIC, facts.exams, ("id",), ("test_exam", "test_exam_question")),
    "exam_questions": (names.EXAM_QUESTION_TOPIC, facts.exam_questions, (), ("test_exam_question", "test_exam")),
    "course_reviews": (names.COURSE_REVIEW_TOPIC, facts.course_reviews, (), ("review_info",)),
    "chapter_comments": (names.CHAPTER_COMMENT_TOPIC, facts.chapter_comments, (), ("comment_info",)),
}


def start_facts(spark: SparkSession, name: str, reader: TopicReader | ChangeLog, writer: TopicWriter, database: str,
                checkpoints: str | None = None, available_now: bool = False, retention: str | None = None) -> StreamingQuery:
    """Start one fact job from the change topic, or from the parsed change log, into its fact topic.

    ``retention`` sets how far apart in time a joining job's partners may be written. What finds no partner is
    counted in the query's observed metrics (see ``streaming.drops``).
    """
    topic, plan, keys, tables = FACT_JOBS[name]
    options = {"retention": retention} if retention else {}
    if len(tables) > 1:
        options["counted"] = name
    changes = reader.stream(spark, *tables) if isinstance(reader, ChangeLog) else reader.stream(spark, names.CHANGE_TOPIC, f"{name}_group")
    facts_rows = plan(changes, database, **options)
    return _start(json_records(facts_rows, keys),
                  lambda batch, batch_id: writer.write_batch(batch, topic, batch_id, run_of(batch)),
                  checkpoints, name, available_now)


def start_test_papers(spark: SparkSession, reader: TopicReader, writer: TopicWriter, papers: Callable[[], DataFrame],
                      database: str, checkpoints: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Start the test-paper job; the paper table is looked up as it is at each micro-batch."""
    changes = reader.stream(spark, names.CHANGE_TOPIC, "test_papers_group")

    def write(batch: DataFrame, batch_id: int) -> None:
        records = json_records(facts.test_papers(batch, database, papers()))
        writer.write_batch(records, names.TEST_PAPER_TOPIC, batch_id, run_of(batch))

    return _start(changes, write, checkpoints, "test_papers", available_now)


def start_routing(spark: SparkSession, reader: TopicReader, writer: TopicWriter, store: DimStore,
                  config: Callable[[], DataFrame], checkpoints: str | None = None, available_now: bool = False, as_of: bool = False) -> StreamingQuery:
    """Start the routing of the change topic; ``config`` gives the current feed at each micro-batch.

    With ``as_of`` a change is routed by the configuration at its time, not by the current one. The folded feed is kept:
    a micro-batch folds what came to the feed since the one before, and needs no entry older than that from it.
    """
    values = reader.stream(spark, names.CHANGE_TOPIC, "routing_group")
    state = f"{_folder(spark, checkpoints)}/routing-state"

    def entries(batch_id: int, run: str) -> tuple[DataFrame, Callable[[], None]]:
        folded = Versions(f"{state}/routes", run, routing.ENTRY, ("kind", "route_table", "route_type", "at"))
        known, new = folded.latest(spark, batch_id), routing.route_entries(config())
        if known is not None:
            low = known.agg(F.max("at")).first()[0]
            new = new.where(F.col("at") >= (low or 0))
        rows = new if known is None else known.unionByName(new)
        return rows, lambda: folded.commit(latest_by_key(new, folded.keys, ["deleted", "sink_table", "sink_columns", "sink_pk", "sink_extend"]), batch_id)

    def write(batch: DataFrame, batch_id: int) -> None:
        run = run_of(batch)
        rows, commit = entries(batch_id, run) if as_of else (None, lambda: None)
        routes = (routing.routes_over_time(rows) if as_of else routing.fold_config(config())).persist()
        changes = change_rows(batch).persist()
        try:
            routed = routing.route(changes, routes)
            store.upsert(routed.dims, batch_id, run)
            writer.write_routed(routing.topic_records(routed.facts), batch_id, run)
            commit()
        finally:
            changes.unpersist()
            routes.unpersist()

    return _start(values, write, checkpoints, "routing", available_now)


def start_log_split(spark: SparkSession, reader: TopicReader, writer: TopicWriter, checkpoints: str | None = None,
                    available_now: bool = False, retention: str | None = None) -> StreamingQuery:
    """Start the repair and split of the log topic into its six branch topics.

    A device is remembered by its first log, for ``retention`` after its last one if that is given, else for ever.
    """
    values = reader.stream(spark, names.LOG_TOPIC, "log_split_group")
    state = f"{_folder(spark, checkpoints)}/log_split-state"

    def write(batch: DataFrame, batch_id: int) -> None:
        run = run_of(batch)
        logs, found, repaired = log_records(batch).persist(), None, None
        devices = Versions(f"{state}/devices", run, visitors.FIRST_LOG, ("mid",))
        try:
            found = visitors.first_logs(logs).persist()
            low = found.agg(F.min("first.ts")).first()[0]
            alive = F.lit(True)
            if retention and low is not None:
                alive = F.col("last") >= low - clock.duration_us(retention) // 1000
            known = devices.latest(batch.sparkSession, batch_id, found)
            if known is not None:
                known = known.where(alive)
            first = visitors.with_known(found, known)
            repaired = visitors.repair_new_flag(logs, first).persist()
            for topic, records in split_logs(repaired).items():
                writer.write_batch(records, topic, batch_id, run)
            if not retention and known is not None:  # first logs never change: only those of new devices are written
                first = first.join(known.select(F.col("mid").alias("_old")), F.col("mid").eqNullSafe(F.col("_old")), "left_anti")
            devices.commit(first, batch_id, lambda rows: rows.where(alive))
        finally:
            for held in (logs, found, repaired):
                if held is not None:
                    held.unpersist()

    return _start(values, write, checkpoints, "log_split", available_now)


def _folder(spark: SparkSession, checkpoints: str | None) -> str:
    return checkpoints or f"{shared_folder(spark)}/tidemark"


def _start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoints: str | None, name: str,
           available_now: bool) -> StreamingQuery:
    folder = _folder(df.sparkSession, checkpoints)
    writer = df.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/{name}").foreachBatch(write)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()

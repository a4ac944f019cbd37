"""Every window job as a stream over files, compared with the same plan over the whole table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark import names
from tidemark.bindings import Tables
from tidemark.sinks.results import ResultTable, sink_row
from tidemark.sinks.topics import json_records
from tidemark.sources.topics import TopicReader
from tidemark.streaming import jobs
from tidemark.streaming.drops import DropCounter

FOLDER = "/root/testdata/sf0.001"
FAR_MS, FAR_TEXT = 4_000_000_000_000, "2096-10-02 07:06:40"


def dims_of(tables: Tables):
    frames = {
        "dim_base_source": tables.traffic_sources, "dim_base_province": tables.provinces,
        "dim_course_info": tables.courses, "dim_base_subject_info": tables.subjects,
        "dim_video_info": tables.video_dim, "dim_chapter_info": tables.chapter_dim,
    }
    return lambda name, columns: frames[name]().select(*columns)


INPUTS = {
    names.PAGE_TOPIC: (Tables.pages, "ts"), names.VIDEO_TOPIC: (Tables.videos, "ts"),
    names.USER_REGISTER_TOPIC: (Tables.registrations, "create_time"), names.CART_ADD_TOPIC: (Tables.carts, "create_time"),
    names.ORDER_DETAIL_TOPIC: (Tables.order_lines, "create_time"),
    names.TEST_PAPER_TOPIC: (Tables.papers_taken, "create_time"), names.REVIEW_ADD_TOPIC: (Tables.reviews_added, "create_time"),
}


def write_topic(tables: Tables, topic: str, folder: str, files: int = 2) -> None:
    """The rows in time order as ``files`` files, then one row far ahead that closes all windows.

    That row also passes every job's filters, in different keys where a job splits on them.
    """
    make, time = INPUTS[topic]
    rows = make(tables)
    if time == "ts":
        at = F.col("ts")
        far = [{"mid": "far", "uid": "far", "page_id": p} for p in ("home", "good_detail")]
        spark = tables.spark
        common = F.struct(F.col("mid"), F.col("uid"))
        page = F.struct(F.col("page_id"), F.lit("keyword").alias("item_type"), F.lit("zz").alias("item"))
        video = F.struct(F.lit(1).alias("play_sec"), F.lit("0").alias("video_id"))
        last = spark.createDataFrame(far).select(
            common.alias("common"), (video.alias("appVideo") if topic == names.VIDEO_TOPIC else page.alias("page")),
            F.lit(FAR_MS).alias("ts"))
    else:
        at = F.unix_timestamp(F.to_timestamp(time))
        last = tables.spark.range(1).select(*[
            F.lit(FAR_TEXT).alias(c) if c == time else F.lit(1).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    low, high = rows.select(F.min(at), F.max(at)).first()
    step = (high - low) // files + 1
    part = ((at - F.lit(low)) / F.lit(step)).cast("int")
    for i in range(files):
        json_records(rows.filter(part == i)).coalesce(1).write.text(f"{folder}/{topic}/part={i}")
    json_records(last).coalesce(1).write.text(f"{folder}/{topic}/part={files}")


@pytest.fixture(scope="module")
def topics(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("topics"))
    for topic in INPUTS:
        write_topic(Tables(spark, FOLDER), topic, folder)
    return folder


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("name", sorted(jobs.MEASURE_JOBS))
def test_stream_equals_batch(spark, topics, tmp_path, name):
    job = jobs.MEASURE_JOBS[name]
    tables = Tables(spark, FOLDER)
    dims = dims_of(tables)
    reader = TopicReader(folder=topics, options={"maxFilesPerTrigger": "1"})
    query = jobs.start_measures(spark, name, reader, dims, str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True)
    assert query.awaitTermination(240)
    assert query.exception() is None

    # The batch reads the same records but for the closing ones.
    values = reader.table(spark, job.topic).filter(~F.col("value").contains(str(FAR_MS)) & ~F.col("value").contains(FAR_TEXT))
    expected = sink_row(job.results(job.cells(job.parse(values)), dims, None), job.table)
    actual = sink_row(ResultTable(str(tmp_path / "out"), job.table).versions(spark), job.table)
    timeless = [c for c in expected.columns if c != "ts" or name.startswith("orders_by_course_subject")]
    expected, actual = expected.select(*timeless), actual.select(*timeless)
    want = sorted(map(str, expected.collect()))
    got = sorted(map(str, actual.collect()))
    assert want and got == want


def write_rows(spark, folder, topic, *files):
    for i, rows in enumerate(files):
        spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(f"{folder}/{topic}/part={i}")


def test_late_rows_are_dropped(spark, tmp_path):
    def signed_up(*times):
        return [f'{{"create_time": "2024-01-01 {t}"}}' for t in times]

    # 00:00:08 comes late, but its window is open still; 00:00:09 comes when it was emitted.
    write_rows(spark, str(tmp_path), names.USER_REGISTER_TOPIC, signed_up("00:00:01", "00:00:11"), signed_up("00:00:08"),
               signed_up("00:01:00"), signed_up("00:01:01"), signed_up("00:00:09"), signed_up("10:00:00"))
    reader = TopicReader(folder=str(tmp_path), options={"maxFilesPerTrigger": "1"})
    query = jobs.start_measures(spark, "user_registrations", reader, None, str(tmp_path / "out"), str(tmp_path / "ck"), True)
    assert query.awaitTermination(120) and query.exception() is None
    got = ResultTable(str(tmp_path / "out"), "dws_user_user_register_window").read(spark).collect()
    assert sorted((r.stt[11:], r.registerCt) for r in got) == [("00:00:00", 2), ("00:00:10", 1), ("00:01:00", 2)]


def test_logins_forget_users_after_the_retention(spark, tmp_path):
    def login(user, day):
        return [f'{{"common": {{"uid": "{user}"}}, "page": {{}}, "ts": {day * 86_400_000}}}']

    write_rows(spark, str(tmp_path), names.PAGE_TOPIC, login("a", 1), login("b", 15), login("a", 20), login("x", 40))
    reader = TopicReader(folder=str(tmp_path), options={"maxFilesPerTrigger": "1"})
    query = jobs.start_measures(spark, "user_logins", reader, None, str(tmp_path / "out"), str(tmp_path / "ck"), True, retention="9 days")
    assert query.awaitTermination(120) and query.exception() is None
    got = ResultTable(str(tmp_path / "out"), "dws_user_user_login_window").read(spark).collect()
    assert {r.stt[:10]: (r.uuCt, r.backCt) for r in got}["1970-01-21"] == (1, 0)  # a was away for 19 days, but is forgotten


def test_late_rows_are_counted(spark, tmp_path):
    write_rows(spark, str(tmp_path), names.USER_REGISTER_TOPIC, *[[f'{{"create_time": "2024-01-01 {t}"}}'] for t in ("00:01:00", "00:01:01", "00:00:09", "10:00:00")])
    reader, drops = TopicReader(folder=str(tmp_path), options={"maxFilesPerTrigger": "1"}), DropCounter()
    spark.streams.addListener(drops)
    try:
        query = jobs.start_measures(spark, "user_registrations", reader, None, str(tmp_path / "out"), str(tmp_path / "ck"), True)
        assert query.awaitTermination(120) and query.exception() is None
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(drops)
    assert drops.counts[str(query.id)]["late"] == 1


def test_repeated_records_are_counted_once(spark, tmp_path):
    def line(i, second):
        return f'{{"id": "{i}", "order_id": "o{i}", "user_id": "u", "final_amount": "2", "create_time": "2024-01-01 00:00:{second:02}"}}'

    write_rows(spark, str(tmp_path), names.ORDER_DETAIL_TOPIC, [line(1, 1), line(1, 1), line(2, 2)], [line(1, 1), line(3, 3), line(3, 4)],
               ['{"id": "far", "order_id": "far", "user_id": "u", "final_amount": "0", "create_time": "2096-01-01 00:00:00"}'])
    reader = TopicReader(folder=str(tmp_path), options={"maxFilesPerTrigger": "1"})
    for name, options, lines in (("plain", {}, 6), ("once", {"unique": ("id",)}, 4)):
        query = jobs.start_measures(spark, "order_totals", reader, None, str(tmp_path / name), str(tmp_path / f"{name}-ck"), True, **options)
        assert query.awaitTermination(120) and query.exception() is None
        [row] = [r for r in ResultTable(str(tmp_path / name), "dws_trade_order_count_window").read(spark).collect() if r.stt < "2096"]
        assert (row.orderCount, row.userCount, float(row.totalAmount)) == (lines, 3, 2.0 * lines)


def test_results_go_where_they_are_sent(spark, tmp_path):
    write_rows(spark, str(tmp_path), names.USER_REGISTER_TOPIC, ['{"create_time": "2024-01-01 00:00:01"}', '{"create_time": "2024-01-01 00:00:02"}'],
               ['{"create_time": "2030-01-01 00:00:00"}'])
    sent = []
    query = jobs.start_measures(spark, "user_registrations", TopicReader(folder=str(tmp_path)), None, lambda rows, table: sent.extend(
        (table, r.registerCt) for r in sink_row(rows, table).collect()), str(tmp_path / "ck"), True)
    assert query.awaitTermination(120) and query.exception() is None
    assert sent == [("dws_user_user_register_window", 2)]

"""Change log, routing, log split, lookups, functions and sinks on literal rows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark import names, schemas
from tidemark.functions import clock, documents, words
from tidemark.operators import routing
from tidemark.operators.latest import latest_by_key
from tidemark.operators.logsplit import split_logs
from tidemark.operators.lookup import enrich
from tidemark.operators.visitors import repair_new_flag
from tidemark.plans import facts, study, traffic
from tidemark.sinks.changes import ChangeLog
from tidemark.sinks.dims import DimStore, dim_schema
from tidemark.sinks.results import ResultTable
from tidemark.sinks.topics import TopicWriter, json_records
from tidemark.sources.tables import config_feed, config_snapshot
from tidemark.sources.topics import TopicReader, change_rows, log_records, log_rows, page_maps
from tidemark.streaming import jobs
from tidemark.streaming.drops import DropCounter


def values(spark, rows):
    return spark.createDataFrame([(json.dumps(r) if isinstance(r, dict) else r,) for r in rows], "value string")


def change(table, data, type="insert", database="edu", ts=1, xid=1):
    return {"database": database, "table": table, "type": type, "ts": ts, "xid": xid, "data": data, "commit": True}


# --- parsing ---

def test_null_is_dropped_and_malformed_fails(spark):
    assert change_rows(values(spark, [None, change("t", {"id": 1})])).count() == 1
    with pytest.raises(Exception, match="MALFORMED"):
        change_rows(values(spark, ['{"database": "edu", "table": ['])).collect()


def test_text_is_parsed_once(spark):
    rows = change_rows(values(spark, [change("t", {"id": 1})])).filter("table = 't' and type = 'insert' and database = 'edu'")
    plan = rows.select(*[documents.text_of(F.col("data"), k) for k in ("id", "x")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_escaped_names_are_found_and_broken_text_of_other_tables_fails(spark):
    text = json.dumps(change("cart_info", {"id": 1})).replace("cart_info", "cart\\u005finfo")
    assert facts.inserted(values(spark, [text, change("other", {"id": 2})]), "edu", "cart_info").count() == 1
    with pytest.raises(Exception, match="MALFORMED"):
        facts.cart_adds(values(spark, [text, '{"table": "other", "data": {']), "edu").collect()
    for broken in ("[1]", "5", '{"common": {'):
        with pytest.raises(Exception, match="MALFORMED"):
            log_records(values(spark, [broken])).collect()


def test_numbers_may_come_as_text_and_keep_their_values(spark):
    rows = [change("t", {"a": 12345678901234567890.0, "b": "200.00"}, ts="5", xid="7")]
    text = json.dumps(rows[0]).replace("1.2345678901234567e+19", "12345678901234567890.12")
    [row] = change_rows(values(spark, [text])).select("ts", "xid", F.to_json("data").alias("data")).collect()
    assert tuple(row) == (5, 7, '{"a":12345678901234567890.12,"b":"200.00"}')
    logs = log_rows(values(spark, [{"ts": "5", "page": {"during_time": "9"}}, {"ts": 6.0, "appVideo": {"play_sec": "x"}}]))
    assert sorted((r.ts, r.during_time, r.play_sec) for r in logs.select("ts", "page.during_time", "appVideo.play_sec").collect()) == [
        (5, 9, None), (6, None, None)]
    assert log_records(values(spark, [{"ts": "5"}])).first().ts == 5


# --- facts ---

def test_fact_filters(spark):
    rows = [change("cart_info", {"id": 1, "cart_price": "200.00"}), change("cart_info", {"id": 2}, type="update"),
            change("cart_info", {"id": 3}, database="other"), change("other", {"id": 4})]
    [row] = facts.cart_adds(values(spark, rows), "edu").collect()
    assert (row.id, row.cart_price, row.sold) == ("1", "200.00", None)
    assert row.pt is not None


def test_joined_facts(spark):
    stamp = "2024-01-01 00:00:00"
    rows = [
        change("order_detail", {"id": 1, "order_id": 7, "final_amount": 5, "create_time": stamp}),
        change("order_detail", {"id": 2, "order_id": 8, "create_time": stamp}),
        change("order_info", {"id": 7, "province_id": 3, "origin_amount": 9, "create_time": "2030-01-01 00:00:00"}),
        change("payment_info", {"id": 1, "order_id": 7, "payment_status": "1602", "total_amount": 9, "create_time": stamp}),
        change("payment_info", {"id": 2, "order_id": 8, "payment_status": "1601", "create_time": stamp}),
        change("test_exam", {"id": 5, "paper_id": 4, "score": 60, "create_time": stamp}),
        change("test_exam", {"id": 6, "paper_id": "x", "score": 61, "create_time": stamp}),
        change("test_exam_question", {"id": 1, "exam_id": 5, "question_id": 1, "score": 1, "create_time": stamp}),
        change("test_exam_question", {"id": 2, "exam_id": 5, "question_id": 2, "score": 2, "create_time": stamp}),
    ]
    topic = values(spark, rows)
    [order] = facts.order_details(topic, "edu").collect()
    assert (order.id, order.order_id, order.province_id, order.origin_amount) == ("1", "7", "3", "9")
    [paid] = facts.paid_details(topic, "edu").collect()
    assert (paid.id, paid.payment_status, paid.total_amount) == ("1", "1602", "9")
    exams = facts.exams(topic, "edu")
    assert exams.count() == 2
    assert [(r.id, r.question_id) for r in facts.upserted(exams).collect()] == [("5", "2")]
    questions = facts.exam_questions(topic, "edu").collect()
    assert sorted((r.id, r.question_score, r.paper_score) for r in questions) == [("1", "1", "60"), ("2", "2", "60")]
    papers = spark.createDataFrame([(4, "Java", 39)], "id bigint, paper_title string, course_id bigint")
    [paper] = facts.test_papers(topic, "edu", papers).collect()  # text that is no number has no paper
    assert (paper.id, paper.paper_title, paper.course_id) == ("5", "Java", 39)
    assert facts.course_reviews(topic, "edu").columns == list(schemas.FACT_KEYS["review_info"])
    assert facts.chapter_comments(topic, "edu").count() == 0


def test_streamed_join_is_bounded_in_time(spark, tmp_path):
    early, late = "2024-01-01 00:00:00", "2030-01-01 00:00:00"  # business times don't matter
    rows = [change("order_detail", {"id": 1, "order_id": 7, "create_time": early}, ts=1000),
            change("order_detail", {"id": 2, "order_id": 8, "create_time": early}, ts=1000),
            change("order_info", {"id": 7, "create_time": late}, ts=1900), change("order_info", {"id": 8, "create_time": early}, ts=4600)]
    values(spark, rows).coalesce(1).write.text(str(tmp_path / "topics" / names.CHANGE_TOPIC))
    reader = TopicReader(folder=str(tmp_path / "topics"))

    def run(folder, **options):
        writer = TopicWriter(folder=str(tmp_path / folder))
        query = jobs.start_facts(spark, "order_details", reader, writer, "edu", str(tmp_path / folder / "ck"), True, **options)
        assert query.awaitTermination(120) and query.exception() is None
        out = TopicReader(folder=str(tmp_path / folder)).table(spark, names.ORDER_DETAIL_TOPIC)
        return sorted(json.loads(r.value)["id"] for r in out.collect())

    assert run("a") == ["1"]
    assert run("b", retention="2 hours") == ["1", "2"]


FACT_ROWS = [
    change("cart_info", {"id": 1, "cart_price": 200.5, "unknown": 1}), change("cart_info", {"id": 2}, type="delete"),
    change("order_detail", {"id": 1, "order_id": 7, "final_amount": 5.25, "create_time": "2024-01-01 00:00:00"}),
    change("order_detail", {"id": 2, "order_id": 7, "create_time": None}),
    change("order_info", {"id": 7, "province_id": 3, "create_time": "2030-01-01 00:00:00"}),
    change("payment_info", {"id": 1, "order_id": 7, "payment_status": 1602, "create_time": "2024-01-01 00:00:00"}),
    change("test_exam", {"id": 5, "paper_id": 4, "score": 60, "create_time": "2024-01-01 00:00:00"}),
    change("test_exam_question", {"id": 1, "exam_id": 5, "question_id": 1, "create_time": "2024-01-01 00:00:10"}),
    change("review_info", {"id": 3, "course_id": 9, "review_stars": 5}), change("comment_info", {"id": 4, "chapter_id": 2}),
    change("review_info", None), None,
]


@pytest.mark.parametrize("name", sorted(jobs.FACT_JOBS))
def test_fact_stream_equals_batch(spark, tmp_path, name):
    topic, plan, _, _ = jobs.FACT_JOBS[name]
    folder = str(tmp_path / "topics")
    values(spark, [r for r in FACT_ROWS if r]).coalesce(1).write.text(f"{folder}/{names.CHANGE_TOPIC}")
    reader, writer = TopicReader(folder=folder), TopicWriter(folder=folder)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    query = jobs.start_facts(spark, name, reader, writer, "edu", str(tmp_path / "ck"), available_now=True)
    assert query.awaitTermination(120) and query.exception() is None
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = [json.loads(r.value) for r in json_records(plan(values(spark, FACT_ROWS), "edu").drop("pt")).collect()]
    got = [json.loads(r.value) for r in reader.table(spark, topic).collect()]
    for record in got:
        record.pop("pt", None)
    assert want and sorted(map(str, got)) == sorted(map(str, want))


def test_change_log_is_parsed_once_and_read_by_table(spark, tmp_path):
    topics, log = str(tmp_path / "topics"), ChangeLog(str(tmp_path / "log"))
    values(spark, [r for r in FACT_ROWS if r]).coalesce(1).write.text(f"{topics}/{names.CHANGE_TOPIC}")
    reader, writer = TopicReader(folder=topics), TopicWriter(folder=str(tmp_path / "out"))
    assert log.rows(spark).count() == 0
    query = jobs.start_change_log(spark, reader, log, str(tmp_path / "ck"), available_now=True)
    assert query.awaitTermination(120) and query.exception() is None
    assert log.rows(spark).count() == len(FACT_ROWS) - 1
    plan = facts.order_details(log.rows(spark), "edu")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in text and text.count("table#") and text.count("PartitionFilters: [isnotnull(table") == 2
    assert [r.id for r in plan.collect()] == ["1", "2"]
    query = jobs.start_facts(spark, "order_details", log, writer, "edu", str(tmp_path / "ck"), available_now=True)
    assert query.awaitTermination(120) and query.exception() is None
    got = [json.loads(r.value) for r in TopicReader(folder=str(tmp_path / "out")).table(spark, names.ORDER_DETAIL_TOPIC).collect()]
    assert sorted(map(str, got)) == sorted(map(str, (json.loads(r.value) for r in json_records(plan).collect())))
    # A batch that is repeated leaves its files as they are.
    before = sorted(str(f) for f in (tmp_path / "log").rglob("*.parquet"))
    run = next((tmp_path / "log").iterdir()).name.partition("=")[2]
    log.append(values(spark, [FACT_ROWS[0]]), 0, run)
    assert sorted(str(f) for f in (tmp_path / "log").rglob("*.parquet")) == before


def test_rows_that_are_left_out_are_counted(spark, tmp_path):
    def lines(*ids_orders, ts):
        return [change("order_detail", {"id": i, "order_id": o}, ts=ts) for i, o in ids_orders]

    def orders(*ids, ts):
        return [change("order_info", {"id": i}, ts=ts) for i in ids]

    batches = [lines((1, 7), (2, 8), (3, 9), (4, None), ts=1000) + orders(7, 20, 21, ts=1010), orders(8, ts=1020),
               lines((5, 50), ts=100_000) + orders(50, ts=100_000), lines((6, 60), ts=200_000) + orders(61, ts=200_000)]
    folder = str(tmp_path / "topics")
    for i, rows in enumerate(batches):
        values(spark, rows).coalesce(1).write.text(f"{folder}/{names.CHANGE_TOPIC}/part={i}")
    drops = DropCounter()
    spark.streams.addListener(drops)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        query = jobs.start_facts(spark, "order_details", TopicReader(folder=folder, options={"maxFilesPerTrigger": "1"}), TopicWriter(folder=str(tmp_path / "out")),
                                 "edu", str(tmp_path / "ck"), available_now=True)
        assert query.awaitTermination(180) and query.exception() is None
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(drops)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = drops.counts[str(query.id)]
    # The last line and order may yet find a partner.
    assert (got["matched"], got["unmatched_left"], got["unmatched_right"]) == (3, 2, 2)
    table = facts.order_details(values(spark, [r for rows in batches for r in rows]), "edu", counted="counted")
    seen = Observation("table")
    assert table.observe(seen, F.count(F.lit(1)).alias("n")).count() == 3 and seen.get["n"] == 3


# --- routing ---

def config(source, kind, sink, columns, type=None, pk=None):
    return {"source_table": source, "source_type": type, "sink_table": sink, "sink_type": kind, "sink_columns": columns,
            "sink_pk": pk, "sink_extend": None}


def feed(spark, *entries):
    return config_feed(values(spark, [
        {"op": op, "before": c if op == "d" else None, "after": None if op == "d" else c, "ts_ms": at} for op, c, at in entries]))


ROUTES = [
    ("r", config("user_info", "dim", "dim_user_info", "id,name"), 0),
    ("u", config("user_info", "dim", "dim_user_info", "id,name,level"), 5),
    ("c", config("review_info", "dwd", "dwd_review_add", "id,stars", "insert"), 0),
    ("c", config("review_info", "dim", "dim_review", "id,txt"), 1),  # a table that is both
    ("c", config("gone", "dim", "dim_gone", "id"), 1), ("d", config("gone", "dim", "dim_gone", "id"), 2),
    ("c", config("live", "dim", "dim_live", "code, name", pk="code"), 9),
]


def test_routing(spark):
    folded = routing.fold_config(feed(spark, *ROUTES))
    assert folded.count() == 4
    rows = [change("user_info", {"id": 1, "name": "a", "level": 2, "secret": "s"}, "update"),
            change("user_info", {"id": 1}, "delete"), change("review_info", {"id": 3, "stars": 5, "txt": "t"}),
            change("review_info", {"id": 4, "stars": 5, "txt": "t"}, "bootstrap-insert"),
            change("gone", {"id": 9}), change("live", {"code": "x", "name": "n"}), change("review_info", {"id": 5}, "delete")]
    routed = routing.route(change_rows(values(spark, rows)), folded)
    dims = sorted((r.sink_table, r.pk, tuple(sorted(r.data.items()))) for r in routed.dims.collect())
    assert dims == [
        ("dim_live", "x", (("code", "x"),)),  # column names are compared as they are, " name" is not "name"
        ("dim_review", "3", (("id", "3"), ("txt", "t"))), ("dim_review", "4", (("id", "4"), ("txt", "t"))),
        ("dim_user_info", "1", (("id", "1"), ("level", "2"), ("name", "a"))),
    ]
    records = [(r.topic, json.loads(r.value)) for r in routing.topic_records(routed.facts).collect()]
    assert records == [("dwd_review_add", {"id": 3, "stars": 5})]
    assert sorted((r.table, r.type) for r in routed.unrouted.collect()) == [
        ("gone", "insert"), ("review_info", "delete"), ("user_info", "delete")]


def test_changes_are_routed_where_they_are(spark, monkeypatch):
    rows = change_rows(values(spark, [change("user_info", {"id": n, "name": "a"}) for n in range(50)] + [change("review_info", {"id": 3, "stars": 5})]))

    def parts(folded):
        routed = routing.route(rows, folded)
        return routed.dims, routed.facts, routed.unrouted

    folded = routing.fold_config(feed(spark, *ROUTES))
    broadcast = parts(folded)
    for part in broadcast:  # neither shuffled by the few names of tables nor broadcast themselves
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BuildLeft" not in plan and "hashpartitioning(table" not in plan
    monkeypatch.setattr(routing, "SENT_ROUTES", 3)
    for part, other in zip(broadcast, parts(folded)):  # a large configuration gives the same rows
        names = [c for c in part.columns if c != "pt"]
        text = [sorted(map(str, p.select(*[F.to_json(c).alias(c) if c in ("data", "old") else c for c in names]).collect())) for p in (part, other)]
        assert text[0] == text[1]


def test_config_snapshot_reads_as_feed(spark):
    table = spark.createDataFrame([tuple(config("t", "dim", "dim_t", "id").values())], schemas.CONFIG)
    [row] = routing.fold_config(config_snapshot(table)).collect()
    assert (row.kind, row.route_table, row.sink_pk) == ("dim", "t", "id")


def test_routing_job_updates_dimensions_and_topics(spark, tmp_path):
    folder = str(tmp_path / "topics")
    topic = f"{folder}/{names.CHANGE_TOPIC}"
    reader, writer, store = TopicReader(folder=folder), TopicWriter(folder=folder), DimStore(str(tmp_path / "dims"))
    assert store.read(spark, "dim_user_info", "id,name").count() == 0

    def run(rows, entries):
        values(spark, rows).coalesce(1).write.mode("append").text(topic)
        query = jobs.start_routing(spark, reader, writer, store, lambda: feed(spark, *entries), str(tmp_path / "ck"), True)
        assert query.awaitTermination(120) and query.exception() is None

    run([change("user_info", {"id": 1, "name": "a"}, ts=1), change("live", {"code": "x"}, ts=1)], ROUTES[:2])
    run([change("user_info", {"id": 1, "name": "b"}, "update", ts=2), change("user_info", {"id": 2, "name": None}, ts=2),
         change("review_info", {"id": 3, "stars": 5}), change("live", {"code": "x"}, ts=3)], ROUTES)
    got = sorted(tuple(r) for r in store.read(spark, "dim_user_info", "id,name").collect())
    assert got == [("1", "b"), ("2", None)]
    assert store.read(spark, "dim_live", ("code",)).count() == 1  # added while running
    [record] = reader.table(spark, names.REVIEW_ADD_TOPIC).collect()
    assert json.loads(record.value) == {"id": 3, "stars": 5}


def test_changes_are_routed_as_of_their_time(spark):
    entries = [("r", config("t", "dim", "old", "id"), 0), ("u", config("t", "dim", "new", "id"), 5_000), ("d", config("t", "dim", "new", "id"), 9_000),
               ("c", config("t", "dwd", "fact", "id", "insert"), 5_000), ("u", config("t", "dwd", "fact2", "id", "insert"), 5_000)]
    routes = routing.routes_over_time(routing.route_entries(feed(spark, *entries)))
    rows = change_rows(values(spark, [change("t", {"id": n}, ts=n) for n in (1, 4, 5, 8, 9, 20)]))
    routed = routing.route(rows, routes)
    assert sorted((r.pk, r.sink_table) for r in routed.dims.collect()) == [("1", "old"), ("4", "old"), ("5", "new"), ("8", "new")]
    assert sorted((json.loads(r.value)["id"], r.topic) for r in routing.topic_records(routed.facts).collect()) == [(n, "fact2") for n in (5, 8, 9, 20)]
    assert routed.unrouted.count() == 0


def test_replay_after_a_configuration_change_routes_as_before(spark, tmp_path):
    early, late = ROUTES[:1], [("u", config("user_info", "dim", "dim_renamed", "id,name"), 60_000)]

    def run(place, rows, entries):
        values(spark, rows).coalesce(1).write.mode("append").text(f"{tmp_path}/{place}/topics/{names.CHANGE_TOPIC}")
        folder, store = f"{tmp_path}/{place}/topics", DimStore(f"{tmp_path}/{place}/dims")
        query = jobs.start_routing(spark, TopicReader(folder=folder), TopicWriter(folder=folder), store, lambda: feed(spark, *entries),
                                   f"{tmp_path}/{place}/ck", True, as_of=True)
        assert query.awaitTermination(120) and query.exception() is None
        return [sorted(tuple(r) for r in store.read(spark, t, "id,name").collect()) for t in ("dim_user_info", "dim_renamed")]

    before, after = [change("user_info", {"id": 1, "name": "a"}, ts=10)], [change("user_info", {"id": 2, "name": "b"}, ts=70)]
    run("live", before, early)
    # The second run's feed holds the new entry alone; the first is in the folded feed.
    live = run("live", after, late)
    assert live == [[("1", "a")], [("2", "b")]] == run("replay", before + after, early + late)


def test_routed_topic_feeds_its_window_job(spark, tmp_path):
    folder, stamp = str(tmp_path / "topics"), "2024-01-01 00:00:0"
    review = config("review_info", "dwd", names.REVIEW_ADD_TOPIC, "id,user_id,course_id,review_stars,create_time", "insert")
    rows = [change("review_info", {"id": n, "user_id": n, "course_id": 7, "review_stars": n, "create_time": f"{stamp}{n}"}) for n in (4, 5)]
    far = change("review_info", {"id": 9, "user_id": 9, "course_id": 8, "review_stars": 1, "create_time": "2030-01-01 00:00:00"})
    values(spark, [*rows, far]).coalesce(1).write.text(f"{folder}/{names.CHANGE_TOPIC}")
    reader, writer, store = TopicReader(folder=folder), TopicWriter(folder=folder), DimStore(str(tmp_path / "dims"))
    courses = spark.createDataFrame([("7", "Java", "1")], "id string, course_name string, subject_id string")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for query in (lambda: jobs.start_routing(spark, reader, writer, store, lambda: feed(spark, ("c", review, 0)), str(tmp_path / "ck"), True),
                  lambda: jobs.start_measures(spark, "course_reviews", reader, lambda name, columns: courses.select(*columns),
                                              str(tmp_path / "out"), str(tmp_path / "ck"), True)):
        running = query()
        assert running.awaitTermination(120) and running.exception() is None
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    got = ResultTable(str(tmp_path / "out"), "dws_course_user_review_window").read(spark).collect()
    assert [(r.courseName, r.reviewStartsCount, r.userCt, r.startsUserCt) for r in got] == [("Java", 9, 2, 1)]


def dim_rows(spark, *rows):
    return spark.createDataFrame([(t, k, {"id": k, "name": n}, ts, ts) for t, k, n, ts in rows],
                                 "sink_table string, pk string, data map<string,string>, ts bigint, xid bigint")


def test_dim_store_replays_compacts_and_reports(spark, tmp_path):
    store = DimStore(str(tmp_path / "dims"))

    def current(table):
        return sorted(tuple(r) for r in store.read(spark, table, "id,name").collect())

    store.upsert(dim_rows(spark, ("a", "1", "x", 1), ("b", "1", "y", 1)), 0, "r")
    store.upsert(dim_rows(spark, ("a", "1", "x", 1)), 0, "r")  # repeated, under a configuration without b
    assert (current("a"), current("b")) == ([("1", "x")], [])
    store.upsert(dim_rows(spark, ("a", "1", "z", 2), ("a", "2", "w", 2)), 0, "new checkpoint")
    store.upsert(dim_rows(spark, ("a", "3", "v", 3)), 1, "r")
    before = current("a")
    assert before == [("1", "z"), ("2", "w"), ("3", "v")]
    store.compact(spark)
    assert current("a") == before
    store.upsert(dim_rows(spark, ("a", "3", "u", 4)), 2, "r")
    store.compact(spark)
    store.vacuum(spark)
    assert current("a") == [("1", "z"), ("2", "w"), ("3", "u")]
    assert not (tmp_path / "dims" / "run=r" / "batch_id=0").exists() and (tmp_path / "dims" / "run=r" / "batch_id=2").exists()
    with pytest.raises(Exception, match="no key in a row of a"):
        store.upsert(dim_rows(spark, ("a", None, "u", 5)), 3, "r")
    assert len(current("a")) == 3  # a batch that failed is not read
    (tmp_path / "dims" / "run=r" / "batch_id=2" / "sink_table=a" / "part-broken.parquet").write_text("broken")
    with pytest.raises(Exception):
        current("a")


def test_repeated_topic_batches_stay_and_runs_are_apart(spark, tmp_path):
    writer, reader = TopicWriter(folder=str(tmp_path)), TopicReader(folder=str(tmp_path))

    def routed(*rows):
        return spark.createDataFrame(list(rows), "topic string, value string")

    writer.write_routed(routed(("dwd_review_add", "1"), ("dwd_user_register", "2")), 0, "a")
    writer.write_routed(routed(("dwd_review_add", "changed")), 0, "a")
    writer.write_routed(routed(("dwd_review_add", "3")), 0, "b")
    assert sorted(r.value for r in reader.table(spark, "dwd_review_add").collect()) == ["1", "3"]
    assert [r.value for r in reader.table(spark, "dwd_user_register").collect()] == ["2"]
    for run in "aab":
        writer.write_batch(values(spark, [{"r": run}]), "t", 0, run)
    assert reader.table(spark, "t").count() == 2


def test_dim_schema():
    assert dim_schema("id,name").simpleString() == "struct<id:string,name:string>"


# --- application log ---

def log(ts, mid="m", is_new="0", **parts):
    return {"common": {"mid": mid, "is_new": is_new, "uid": "u"}, "ts": ts, **parts}


DAY = 86_400_000
PAGE = {"page_id": "home", "during_time": 5}


def flags(spark, rows):
    fixed = repair_new_flag(log_records(values(spark, rows)))
    return [r.is_new for r in fixed.orderBy("ts").select("is_new").collect()]


def test_new_flag_repair(spark):
    def sequence(*pairs):
        return [log(ts, is_new=flag, page=PAGE) for ts, flag in pairs]

    assert flags(spark, sequence((0, "1"), (5, "1"), (DAY, "1"), (DAY + 1, "0"))) == ["1", "1", "0", "0"]
    assert flags(spark, sequence((0, "0"), (5, "1"))) == ["0", "0"]
    assert flags(spark, sequence((0, None), (5, "1"), (6, None))) == [None, "0", None]


SPLIT = [
    log(1, page=PAGE), log(2, page=PAGE, displays=[{"item": "3", "pos": 1, "ts": 9}, {}], actions=[{"action_id": "add"}]),
    log(3, start={"entry": "icon"}, err={"error_code": 1}), log(4, appVideo={"play_sec": 3, "video_id": "7"}),
    log(5, err={"error_code": 2, "msg": "m"}), log(6, start={"entry": "x"}, appVideo={"video_id": "8"}),
    log(7, page=PAGE, err={"error_code": 3}, start=None), None,
]


def check_split(branches):
    def of(topic):
        return sorted((json.loads(v) for v in branches[topic]), key=lambda r: (r["ts"], len(r)))

    assert [r["ts"] for r in of(names.ERROR_TOPIC)] == [3, 5, 7]
    assert of(names.ERROR_TOPIC)[1]["err"] == {"error_code": 2, "msg": "m"}
    assert [(r["ts"], r["start"]["entry"], "err" in r) for r in of(names.START_TOPIC)] == [(3, "icon", False), (6, "x", False)]
    assert [(r["ts"], r["appVideo"]["video_id"]) for r in of(names.VIDEO_TOPIC)] == [(4, "7")]
    assert of(names.DISPLAY_TOPIC) == [{"ts": 2, "page_id": "home"}, {"item": "3", "pos": 1, "ts": 2, "page_id": "home"}]
    assert of(names.ACTION_TOPIC) == [{"action_id": "add", "ts": 2, "page_id": "home"}]
    assert [r["ts"] for r in of(names.PAGE_TOPIC)] == [1, 2, 7]
    assert all(set(r) == {"common", "page", "ts"} for r in of(names.PAGE_TOPIC))


def test_log_split(spark):
    branches = split_logs(repair_new_flag(log_records(values(spark, SPLIT))))
    check_split({topic: [r.value for r in df.collect()] for topic, df in branches.items()})


def test_unknown_fields_survive_the_split(spark):
    extra = {"n": 1, "deep": [1.5, {"a": "b"}]}
    common = {"mid": "m", "is_new": "1", "extra_c": extra}
    rows = [
        {"common": common, "ts": 1, "page": {"page_id": "p", "refer": extra}, "top": extra, "displays": [{"x": extra}], "err": {"e": extra}},
        {"common": {**common, "is_new": "0"}, "ts": 2, "start": {"entry": "i", "more": extra}, "top": extra},
        {"common": {"mid": "m", "is_new": "1"}, "ts": DAY, "appVideo": {"video_id": 8, "quality": 12345678901234567}, "top": None},
    ]
    branches = split_logs(repair_new_flag(log_records(values(spark, rows))))
    got = {topic: [json.loads(r.value) for r in df.collect()] for topic, df in branches.items()}
    page = {k: v for k, v in rows[0].items() if k not in ("displays", "err")}
    assert got[names.PAGE_TOPIC] == [page] and got[names.ERROR_TOPIC] == [rows[0]] and got[names.START_TOPIC] == [rows[1]]
    assert got[names.DISPLAY_TOPIC] == [{"x": extra, "ts": 1, "page_id": "p"}]
    video = {"common": {"mid": "m", "is_new": "0"}, "ts": DAY, "appVideo": rows[2]["appVideo"]}  # flag repaired, null left out
    assert got[names.VIDEO_TOPIC] == [video]


def test_log_job(spark, tmp_path):
    folder = str(tmp_path / "topics")
    reader, writer = TopicReader(folder=folder), TopicWriter(folder=folder)
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run(rows):
        values(spark, [r for r in rows if r]).coalesce(1).write.mode("append").text(f"{folder}/{names.LOG_TOPIC}")
        query = jobs.start_log_split(spark, reader, writer, str(tmp_path / "ck"), available_now=True)
        assert query.awaitTermination(180) and query.exception() is None

    run(SPLIT)
    check_split({topic: [r.value for r in reader.table(spark, topic).collect()] for topic in (
        names.ERROR_TOPIC, names.START_TOPIC, names.VIDEO_TOPIC, names.DISPLAY_TOPIC, names.ACTION_TOPIC, names.PAGE_TOPIC)})
    # The flag of a device is remembered from batch to batch.
    run([log(8, "n", "1", page=PAGE), log(9, "n", "1", page=PAGE)])
    run([log(10, "n", "1", page=PAGE), log(DAY, "n", "1", page=PAGE), log(11, "m", "1", page=PAGE)])
    pages = [json.loads(r.value) for r in reader.table(spark, names.PAGE_TOPIC).collect()]
    assert sorted((p["ts"], p["common"]["is_new"]) for p in pages if p["ts"] > 7) == [
        (8, "1"), (9, "1"), (10, "1"), (11, "0"), (DAY, "0")]
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_log_job_with_a_hot_device_and_without_devices(spark, tmp_path):
    folder = str(tmp_path / "topics")
    reader, writer = TopicReader(folder=folder), TopicWriter(folder=folder)
    hot = (spark.range(100_000).selectExpr(
        """format_string('{"common":{"mid":"hot","is_new":"1"},"page":{"page_id":"home"},"ts":%d}', id * 1000) AS value"""))
    none = spark.range(1000).selectExpr(
        """format_string('{"common":{"mid":null,"is_new":"1"},"page":{"page_id":"home"},"ts":%d}', id * 1000) AS value""")
    hot.union(none).repartition(4).write.text(f"{folder}/{names.LOG_TOPIC}")
    query = jobs.start_log_split(spark, reader, writer, str(tmp_path / "ck"), available_now=True)
    assert query.awaitTermination(180) and query.exception() is None
    got = reader.table(spark, names.PAGE_TOPIC).selectExpr("get_json_object(value, '$.common.mid') AS mid", "get_json_object(value, '$.common.is_new') AS new",
                                                           "get_json_object(value, '$.ts') < 86400000 AS today").groupBy("mid", "new", "today").count().collect()
    # The hot device is new on its first day alone; logs without a device are never known to be new.
    assert {tuple(r) for r in got} == {("hot", "1", True, 86400), ("hot", "0", False, 13600), (None, "0", True, 1000)}
    # One small row per device is all that is remembered, no text.
    state = spark.read.parquet(f"{tmp_path}/ck/log_split-state/devices/versions")
    assert sorted(map(str, (r.mid for r in state.collect()))) == ["None", "hot"] and "value" not in state.columns


def test_log_job_forgets_devices_after_the_retention(spark, tmp_path):
    folder = str(tmp_path / "topics")
    reader, writer = TopicReader(folder=folder), TopicWriter(folder=folder)

    def run(*rows):
        values(spark, list(rows)).coalesce(1).write.mode("append").text(f"{folder}/{names.LOG_TOPIC}")
        query = jobs.start_log_split(spark, reader, writer, str(tmp_path / "ck"), available_now=True, retention="2 days")
        assert query.awaitTermination(180) and query.exception() is None

    run(log(1, "a", "0", page=PAGE), log(1, "b", "0", page=PAGE))
    run(log(DAY, "a", "1", page=PAGE))  # renews a
    run(log(3 * DAY - 1, "a", "1", page=PAGE), log(3 * DAY, "b", "1", page=PAGE))
    pages = [json.loads(r.value) for r in reader.table(spark, names.PAGE_TOPIC).collect()]
    assert sorted((p["ts"], p["common"]["mid"], p["common"]["is_new"]) for p in pages if p["ts"] > 1) == [
        (DAY, "a", "0"), (3 * DAY - 1, "a", "0"), (3 * DAY, "b", "1")]


# --- lookups, keyed tables, measures ---

def test_enrich_keeps_misses(spark):
    df = spark.createDataFrame([("1",), ("2",), (None,)], "k string")
    dim = spark.createDataFrame([(1, "one")], "id bigint, name string")
    got = {r.k: r.label for r in enrich(df, dim, "k", {"label": "NAME"}).collect()}
    assert got == {"1": "one", "2": None, None: None}


def test_latest_by_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y")], "k string, n int, v string")
    assert sorted((r.k, r.n, r.v) for r in latest_by_key(df, ["k"], ["n"]).collect()) == [("a", 2, None), ("b", 1, "y")]


def test_reviews_and_papers(spark):
    t = "2024-01-01 00:00:00"
    added = spark.createDataFrame([(1, 7, 5, t), (1, 7, 5, t), (1, 8, None, t), (2, 8, 3, t)],
                                  "course_id bigint, user_id bigint, review_stars bigint, create_time string")
    courses = spark.createDataFrame([("1", "Java")], "id string, course_name string")
    got = {r.courseId: (r.courseName, r.reviewStartsCount, r.userCt, r.startsUserCt) for r in study.reviews(added, courses).collect()}
    assert got == {"1": ("Java", 10, 3, 2), "2": (None, 3, 1, 0)}
    distinct = study.reviews(added, courses, distinct_users=True)
    assert {r.courseId: (r.reviewStartsCount, r.userCt, r.startsUserCt) for r in distinct.collect()} == {"1": (10, 2, 1), "2": (3, 1, 0)}
    rates = {r.courseId: (r.avgStars, r.topRate) for r in study.review_rates(study.reviews(added, courses)).collect()}
    assert rates["2"] == (3.0, 0.0)
    taken = spark.createDataFrame([("1", "u", "45.5", "10", t, "A", 1), ("1", "u", "55", "20", t, "B", 1)],
                                  "paper_id string, user_id string, score string, duration_sec string, create_time string, paper_title string, course_id bigint")
    windows = study.papers(taken, courses)
    [paper] = windows.collect()
    assert (paper.userCount, float(paper.scoreCount), paper.paperTitle, paper.courseName) == (2, 100.5, "A", "Java")
    [average] = study.paper_averages(windows, "courseId").collect()
    assert (average.avgScore, average.avgDurSec) == (50.25, 15.0)
    assert {(r.band, r.examCt) for r in study.score_bands(taken).collect()} == {(40, 1), (50, 1)}
    assert [r.userCount for r in study.paper_users(taken).collect()] == [1]


# --- functions ---

def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_clock(spark):
    assert one(spark, clock.to_epoch_ms(F.lit("1970-01-02"))) == 16 * 3_600_000
    assert one(spark, clock.to_epoch_ms(F.lit("1970-01-01 08:00:01"), full=True)) == 1000
    assert one(spark, clock.ms_to_date(F.lit(86_400_000))) == "1970-01-02"
    assert one(spark, clock.ms_to_stamp(F.lit(61_000))) == "1970-01-01 00:01:01"
    assert one(spark, clock.date_of_text(F.lit("2024-01-01 10:00:00"))) == "2024-01-01"
    assert one(spark, clock.text_to_time(F.lit("nothing"))) is None
    assert clock.duration_us("1 day 2 hours") == 26 * 3_600_000_000
    assert one(spark, clock.now_ms()) > one(spark, clock.now_seconds()) > 0
    with pytest.raises(ValueError):
        clock.duration_us("soon")


def test_words(spark):
    def split(text):
        return one(spark, words.split_words(F.lit(text)))

    assert split("Spark 3.5, SQL!") == ["spark", "3", "5", "sql"]
    assert split("学Java编程语言") == ["java", "学", "编程", "程语", "语言"]
    assert split("...") == []
    df = spark.createDataFrame([("a b",), ("..",), (None,)], "t string")
    assert [r.word for r in words.explode_words(df, "t").collect()] == ["a", "b"]
    whole = words.explode_words(df, "t", splitter=lambda c: F.lit(None).cast("array<string>"))
    assert [r.word for r in whole.collect()] == ["a b", ".."]


def test_keywords_from_page_maps(spark):
    rows = [{"common": {}, "page": {"item": "big data data", "item_type": "keyword"}, "ts": 1000},
            {"common": {}, "page": {"item": "9", "item_type": "course_id"}, "ts": 1000},
            {"common": {}, "page": {"item_type": "keyword"}, "ts": 1000}]
    counted = traffic.keyword_counts(page_maps(values(spark, rows)).drop("rt"), emit_ts=F.lit(0))
    assert {(r.keyword, r.keyword_count) for r in counted.collect()} == {("big", 1), ("data", 2)}


def test_json_records_and_fields(spark):
    df = spark.createDataFrame([("1", None)], "id string, v string")
    assert [tuple(r) for r in json_records(df, ("id",)).collect()] == [('{"id":"1"}', '{"id":"1"}')]
    row = spark.range(1).select(F.parse_json(F.lit('{"a":1,"ts":2}')).alias("v"))
    fields = documents.put_fields(documents.fields_of(F.col("v")), ts=F.lit(5))
    assert row.select(F.to_json(fields).alias("x")).first().x == '{"a":1,"ts":5}'


def test_kafka_options():
    reader = TopicReader(servers="host:1", options={"maxOffsetsPerTrigger": "10"})
    assert reader.kafka_options("t", "g") == {"kafka.bootstrap.servers": "host:1", "subscribe": "t", "startingOffsets": "latest",
                                              "kafka.group.id": "g", "maxOffsetsPerTrigger": "10"}
    assert TopicWriter(servers="host:1").kafka_options("t") == {"kafka.bootstrap.servers": "host:1", "topic": "t"}


def test_topic_writer_streams_to_a_folder(spark, tmp_path):
    folder = str(tmp_path / "topics")
    values(spark, [{"a": 1}, {"a": 2}]).coalesce(1).write.text(f"{folder}/in")
    reader, writer = TopicReader(folder=folder), TopicWriter(folder=folder)
    query = writer.stream(reader.stream(spark, "in"), "out", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert query.awaitTermination(60) and query.exception() is None
    assert sorted(r.value for r in reader.table(spark, "out").collect()) == ['{"a": 1}', '{"a": 2}']


def test_test_paper_job(spark, tmp_path):
    folder = str(tmp_path / "topics")
    values(spark, [change("test_exam", {"id": 5, "paper_id": 4, "score": 60})]).coalesce(1).write.text(f"{folder}/{names.CHANGE_TOPIC}")
    reader, writer = TopicReader(folder=folder), TopicWriter(folder=folder)
    papers = lambda: spark.createDataFrame([(4, "Java", 39)], "id bigint, paper_title string, course_id bigint")
    query = jobs.start_test_papers(spark, reader, writer, papers, "edu", str(tmp_path / "ck"), available_now=True)
    assert query.awaitTermination(60) and query.exception() is None
    [record] = reader.table(spark, names.TEST_PAPER_TOPIC).collect()
    assert json.loads(record.value) == {"id": "5", "paper_id": "4", "score": "60", "paper_title": "Java", "course_id": 39}


def test_checkpoint_folder_comes_from_the_session():
    from types import SimpleNamespace

    from tidemark.session import shared_folder

    def session(**conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: conf.get(key, default)))

    assert shared_folder(session(**{"spark.checkpoint.dir": "/shared/ck/"})) == "/shared/ck"
    with pytest.raises(ValueError):
        shared_folder(session())


# --- result tables ---

def test_result_table_keeps_greatest_ts(spark, tmp_path):
    def rows(*items):
        return spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01 00:00:10", n, ts) for n, ts in items],
                                     "stt string, edt string, registerCt bigint, ts bigint")

    table = ResultTable(str(tmp_path / "a"), "dws_user_user_register_window")
    table.append(rows((5, 20)), 0)
    table.append(rows((4, 10)), 1)
    table.append(rows((4, 10)), 1)  # the same batch again
    assert table.versions(spark).count() == 2
    table.append(rows((3, 5)), 0, "new checkpoint")
    assert table.versions(spark).count() == 3  # another checkpoint counts its batches anew and replaces nothing
    assert [r.registerCt for r in table.read(spark, "2024-01-01").collect()] == [5]
    assert table.read(spark, "2024-01-02").count() == 0
    compacted = table.compact(spark, str(tmp_path / "b"))
    assert [tuple(r)[2:] for r in compacted.versions(spark).select(*schemas.RESULT_COLUMNS[table.table]).collect()] == [(5, 20)]


def test_result_rows_that_share_a_name_are_kept(spark, tmp_path):
    def rows(ts, *items):
        return spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01 00:00:10", name, n, 1, 1, 0, 5, ts) for name, n in items],
                                     "stt string, edt string, sourceName string, uvCt bigint, svCt bigint, pageCt bigint, "
                                     "pageOneCt bigint, durSum bigint, ts bigint")

    table = ResultTable(str(tmp_path), "dws_traffic_source_window")
    table.append(rows(1, (None, 9), ("web", 1)), 0)
    table.append(rows(2, (None, 2), (None, 3)), 1)
    assert sorted((str(r.sourceName), r.uvCt) for r in table.read(spark).collect()) == [("None", 2), ("None", 3), ("web", 1)]

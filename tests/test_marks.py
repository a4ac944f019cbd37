"""First-row operator: literal sequences, a replay of each machine, hot keys and plan shape."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import marks
from tidemark.operators.marks import Mark, count_marks, first_rows, mark_cells
from tidemark.operators.totals import last_totals, running_totals
from tidemark.plans import trade, traffic, users
from tidemark.streaming import state

D1, D2 = datetime(2024, 1, 1), datetime(2024, 1, 2)


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, rt timestamp, c string")


def firsts(df, **options):
    return sorted((r.k, r.rt, r.c) for r in first_rows(df, ["k"], ["c"], **options).collect())


def at(seconds, base=D1):
    return base + timedelta(seconds=seconds)


CASES = [
    ("day", None, [at(8 * 3600), at(9 * 3600), D2], [1, 0, 1]),
    ("idle", "5 seconds", [at(0), at(4), at(8), at(13)], [1, 0, 0, 1]),
    ("idle", "5 seconds", [at(3), at(4), at(9), at(10)], [1, 0, 1, 0]),
    ("day_or_idle", "1 hour", [at(28800), at(30600), at(34200), D2], [1, 0, 1, 1]),
    ("day_or_idle", "1 hour", [at(86390), D2, at(10, D2)], [1, 1, 0]),
]


@pytest.mark.parametrize("reset,ttl,times,flags", CASES)
def test_literal_sequences(spark, reset, ttl, times, flags):
    df = frame(spark, [("a", t, "x") for t in times])
    expected = [("a", t, "x") for t, flag in zip(times, flags) if flag]
    assert firsts(df, reset=reset, ttl=ttl) == expected


def replay(rows, reset, ttl):
    """The state machine, row by row in time order."""
    state, out = {}, []
    for key, time, carry in sorted(rows, key=lambda r: (r[1], r[2])):
        last = state.get(key)
        first = last is None
        if last is not None and reset != "idle" and last.date() != time.date():
            first = True
        if last is not None and ttl is not None and time - last >= timedelta(seconds=ttl):
            first = True
        if first:
            out.append((key, time, carry))
        state[key] = time
    return sorted(out)


@pytest.mark.parametrize("reset,ttl", [("day", None), ("idle", 5), ("idle", 86400), ("day_or_idle", 3600), ("day_or_idle", 5)])
def test_equals_replay_with_a_hot_key(spark, reset, ttl):
    rng = random.Random(7)
    span = 20 if ttl == 5 else 5 * 86400
    rows = []
    for i in range(4000):
        key = "hot" if i % 3 == 0 else f"k{rng.randint(0, 60)}"
        rows.append((key, at(rng.randint(0, span * 40) / 40 * (60 if ttl == 5 else 1)), rng.choice("xyz")))
    rows += rows[:200]  # exact copies
    got = firsts(frame(spark, rows), reset=reset, ttl=f"{ttl} seconds" if ttl else None)
    assert got == replay(rows, reset, ttl)


def test_negative_times(spark):
    rows = [("a", datetime(1969, 12, 31, 23, 59, 57), "x"), ("a", datetime(1970, 1, 1, 0, 0, 1), "x")]
    assert len(firsts(frame(spark, rows), reset="idle", ttl="5 seconds")) == 1


def test_previous_day(spark):
    days = [datetime(2024, 1, d, 10) for d in (1, 8, 16)]
    got = first_rows(frame(spark, [("a", d, "x") for d in days]), ["k"], previous_day=True)
    gaps = sorted((r.rt, None if r.previous_day is None else r.day - r.previous_day) for r in got.collect())
    assert [g for _, g in gaps] == [None, 7, 8]


def test_days_follow_the_session_zone(spark):
    rows = [("a", datetime(2024, 1, 1, 15, 59), "x"), ("a", datetime(2024, 1, 1, 16, 1), "x")]
    df = spark.createDataFrame([(k, int((t - datetime(1970, 1, 1)).total_seconds()), c) for k, t, c in rows],
                               "k string, s bigint, c string").select("k", F.timestamp_seconds("s").alias("rt"), "c")
    assert first_rows(df, ["k"]).count() == 1
    spark.conf.set("spark.sql.session.timeZone", "Asia/Shanghai")
    try:
        assert first_rows(df, ["k"]).count() == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_bad_options(spark):
    df = frame(spark, [("a", D1, "x")])
    for options in ({"reset": "week"}, {"reset": "idle"}, {"reset": "day", "ttl": "1 day"},
                    {"reset": "idle", "ttl": "1 day", "previous_day": True}):
        with pytest.raises(ValueError):
            first_rows(df, ["k"], **options)


def test_rows_are_reduced_before_the_shuffle(spark):
    """A hot key leaves each map task as one record per slot."""
    df = spark.range(0, 50_000, 1, 4).select(
        F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).otherwise("hot").alias("k"), F.timestamp_seconds(F.col("id") % 50).alias("rt"), F.lit("x").alias("c"))
    plan = first_rows(df, ["k"], ["c"], reset="idle", ttl="5 seconds")._jdf.queryExecution().executedPlan().toString()
    # Two exchanges, each fed by cells: the partial aggregate stands below the first one.
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.index("partial_min") > plan.index("_slot")


@pytest.mark.parametrize("reset,ttl", [("idle", 86400), ("idle", 36000), ("day_or_idle", 3600)])
def test_a_key_with_cells_on_a_thousand_days(spark, reset, ttl):
    rng = random.Random(11)
    rows = [("hot", at(day * 86400 + second), "x") for day in range(1000) if rng.random() < 0.8
            for second in {0, 86399, *(rng.randint(0, 86399) for _ in range(3))} if rng.random() < 0.7]
    df = frame(spark, rows)
    assert firsts(df, reset=reset, ttl=f"{ttl} seconds") == replay(rows, reset, ttl)
    # No window is by the key alone: it is cut into chunks of a day.
    plan = first_rows(df, ["k"], ["c"], reset=reset, ttl=f"{ttl} seconds")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Window \[lag.*\[key#\d+, role#\d+, _chunk#\d+L?(, _day#\d+)?\], \[_slot", plan)


def test_one_scan_whatever_is_counted(spark, tmp_path):
    spark.range(100).selectExpr("timestamp_seconds(id) AS rt", "id % 7 AS a", "id % 5 AS b", "id % 3 AS g", "1 AS n").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    marks = [Mark("days", ("a",)), Mark("idle", ("b",), "idle", "1 day", ("n",)), Mark("distinct", ("g", "a"), "window")]
    windows = count_marks(mark_cells(df, marks, ["g"], {"rows": F.lit(1)}), marks, ["g"])
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan and plan.count("Exchange hashpartitioning") == 3
    got = {(r.window.start.second // 10, r.g): (r.rows, r.days, r.idle, r.distinct) for r in windows.where("window.start < timestamp'1970-01-01 00:00:10'").collect()}
    assert got == {(0, 0): (4, 3, 2, 4), (0, 1): (3, 2, 2, 3), (0, 2): (3, 2, 1, 3)}


@pytest.mark.parametrize("reset,ttl", [("day", None), ("idle", "5 seconds"), ("day_or_idle", "1 hour")])
def test_batches_with_memory_equal_one_table(spark, tmp_path, monkeypatch, reset, ttl):
    monkeypatch.setattr(state, "SNAPSHOT_EVERY", 2)
    rng = random.Random(5)
    step = 2 if ttl == "5 seconds" else 7200
    rows = [(rng.choice(["a", "b", "c", None]), at(10 * (i * step // 10) + rng.randint(0, 9)), "x") for i in range(100)]
    mark = [Mark("n", ("k",), reset, ttl)]
    whole = {r.window.start: r.n for r in count_marks(mark_cells(frame(spark, rows), mark), mark).collect()}
    got, size = {}, 20
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for number in range(5):
        part = frame(spark, [r for r in rows if number == _batch_of(rows, r, size)])
        for _ in range(2 if number == 3 else 1):  # a batch that is repeated changes nothing
            cells = apart(part, mark)
            low = cells.agg(F.unix_micros(F.min("first.at")).alias("low")).first()["low"]
            memory = state.BatchMemory(str(tmp_path), "r", number, spark, low)
            found = {r.window.start: r.n for r in count_marks(cells, mark, memory=memory, name="m").collect()}
            memory.commit()
        got |= found
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == whole
    assert len(list((tmp_path / "m" / "versions" / "run=r").iterdir())) <= 4  # older ones are in the snapshot


def apart(df, mark):
    """Several cells to a slot, as a stream's aggregate gives them for several windows."""
    odd = F.pmod(F.floor(F.unix_timestamp("rt") / 10), F.lit(2)) == 1
    return mark_cells(df.where(odd), mark).unionByName(mark_cells(df.where(~odd), mark))


def _batch_of(rows, row, size):
    """Batches hold whole windows, as those of a stream do."""
    starts = [min(int((r[1] - D1).total_seconds()) // 10 for r in rows[i:i + size]) for i in range(0, len(rows), size)]
    window = int((row[1] - D1).total_seconds()) // 10
    return max(i for i, s in enumerate(starts) if s <= window)


# --- running totals ---

@pytest.mark.parametrize("chunk", ["1 second", "1 minute", "1 hour", "1 day"])
def test_running_totals_equal_replay(spark, chunk):
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else rng.choice(["a", "b", None]), at(rng.randint(0, 3 * 86400)), f"c{i}", i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t timestamp, c string, n bigint")
    got = {r.c: (r.total, r.starts) for r in running_totals(
        df, ["k"], "t", ["c"], {"total": "n"}, starts="starts", ttl="5 seconds", chunk=chunk).collect()}
    state, want = {}, {}
    for key, time, c, n in sorted(rows, key=lambda r: (r[1], r[2])):
        last, total, starts = state.get(key, (None, 0, 0))
        if last is None or last.date() != time.date() or time - last >= timedelta(seconds=5):
            starts += 1
        state[key] = (time, total + n, starts)
        want[c] = (total + n, starts)
    assert got == want


def test_running_totals_go_on_from_the_last_row(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), at(i * 977), f"c{i:03}", i) for i in range(90)]
    make = lambda part: spark.createDataFrame(part, "k string, t timestamp, c string, n bigint")
    options = dict(starts="starts", ttl="20 minutes")
    want = {r.c: (r.total, r.starts) for r in running_totals(make(rows), ["k"], "t", ["c"], {"total": "n"}, **options).collect()}
    got, before = {}, None
    for i in range(0, 90, 30):
        out = running_totals(make(rows[i:i + 30]), ["k"], "t", ["c"], {"total": "n"}, before=before, **options)
        got |= {r.c: (r.total, r.starts) for r in out.collect()}
        last = last_totals(out, ["k"], "t", ["c"], ["total", "starts"])
        before = spark.createDataFrame(last.collect(), last.schema)
    assert got == want


# --- jobs on literal rows ---

def page(mid, ts, uid=None, sid=None, sc="1", page_id="home", last=None, kind=None, dur=1):
    return ({"mid": mid, "uid": uid, "sid": sid or mid, "sc": sc, "is_new": "0"},
            {"page_id": page_id, "last_page_id": last, "item_type": kind, "item": None, "during_time": dur}, ts)


def pages(spark, rows):
    return spark.createDataFrame(rows, (
        "common struct<mid:string,uid:string,sid:string,sc:string,is_new:string>, "
        "page struct<page_id:string,last_page_id:string,item_type:string,item:string,during_time:bigint>, ts bigint"))


DAY = 86_400_000


def test_returning_user_after_eight_days(spark):
    rows = [page("m", 0, "u"), page("m", 7 * DAY, "u"), page("m", 15 * DAY, "u", last="login"),
            page("m", 16 * DAY, "u", last="search"), page("m", 16 * DAY, None)]
    got = {r.stt[:10]: (r.uuCt, r.backCt) for r in users.logins(pages(spark, rows)).collect()}
    assert got == {"1970-01-01": (1, 0), "1970-01-08": (1, 0), "1970-01-16": (1, 1)}


def test_single_page_session_and_missing_values(spark):
    rows = [page("m", 1000, dur=None), page("m", 2000, kind="course"), page("n", 3000, last="home", sc="9")]
    sources = spark.createDataFrame([("1", "web")], "id string, source_site string")
    got = {r.sourceName: tuple(r)[3:8] for r in traffic.by_source(pages(spark, rows), sources).collect()}
    # A source without a dimension row is kept, with no name.
    assert got == {"web": (1, 1, 2, 1, 1), None: (1, 1, 1, 0, 1)}


def test_window_edges(spark):
    rows = [page("m", 9_999), page("n", 10_000)]
    assert {(r.stt[-8:], r.edt[-8:]) for r in traffic.by_time(pages(spark, rows)).collect()} == {
        ("00:00:00", "00:00:10"), ("00:00:10", "00:00:20")}


def test_page_ids_are_parameters(spark):
    rows = [page("m", 0, page_id="course_detail"), page("m", 1, page_id="home"), page("m", 2, page_id="other")]
    [r] = traffic.page_visitors(pages(spark, rows), detail="course_detail").collect()
    assert (r.homeUvCt, r.goodDetailUvCt) == (1, 1)


def detail(i, time, order="o", user="u", course="c", amount="1.5", province="p"):
    return (i, order, user, course, f"name {course}", amount, time, province)


def details(spark, rows):
    return spark.createDataFrame(rows, "id string, order_id string, user_id string, course_id string, "
                                       "course_name string, final_amount string, create_time string, province_id string")


def test_order_measures(spark):
    rows = [detail("1", "2024-01-01 00:00:01"), detail("1", "2024-01-01 00:00:02"),  # a copy within five seconds
            detail("2", "2024-01-01 00:00:03", course="d"), detail("3", "2024-01-01 00:00:04", order="q"),
            detail("4", "unreadable"), detail("5", "2024-01-02 00:00:00", amount="bad")]
    df = details(spark, rows)
    provinces = spark.createDataFrame([("p", "North")], "id string, name string")
    first, second = sorted(trade.by_province(df, provinces).collect(), key=lambda r: r.stt)
    assert (first.provinceName, first.orderCount, first.userCount, float(first.orderAmount)) == ("North", 2, 1, 4.5)
    # The user was last seen less than a day before; there is no reset at midnight here.
    assert (second.orderCount, second.userCount) == (1, 0)
    totals = sorted((r.stt, float(r.totalAmount), r.userCount, r.orderCount) for r in trade.order_totals(df).collect())
    assert totals == [("2024-01-01 00:00:00", 6.0, 2, 4), ("2024-01-02 00:00:00", 0.0, 1, 1)]
    by_user = sorted((r.stt, r.userCount, r.orderCount) for r in trade.order_totals_by_user(df).collect())
    assert by_user == [("2024-01-01 00:00:00", 1, 2), ("2024-01-02 00:00:00", 1, 1)]


def test_course_and_subject(spark):
    rows = [detail("1", "2024-01-01 00:00:01"), detail("2", "2024-01-01 00:00:02"), detail("3", "2024-01-01 00:00:12"),
            detail("4", "2024-01-01 00:00:03", course="d"), detail("5", "2024-01-01 00:00:03", course="lost")]
    courses = spark.createDataFrame([("c", "s", "C"), ("d", "s", "D")], "id string, subject_id string, course_name string")
    subjects = spark.createDataFrame([("s", "Maths")], "id string, subject_name string")
    got = sorted(tuple(r)[0:1] + (r.courseId, r.courseOrderUserCt, r.subjectName, r.subOrderCt, r.subOrderUserCt, float(r.subOrderAmount))
                 for r in trade.by_course_and_subject(details(spark, rows), courses, subjects).collect())
    w1, w2 = "2024-01-01 00:00:00", "2024-01-01 00:00:10"
    assert got == [(w1, "c", 1, "Maths", 1, 1, 1.5), (w1, "d", 1, "Maths", 2, 1, 3.0), (w1, "lost", 1, None, 1, 1, 1.5),
                   (w2, "c", 1, "Maths", 3, 2, 4.5)]
    per_detail = trade.by_course_and_subject(details(spark, rows), courses, subjects, per_detail=True).collect()
    assert sorted((r.stt, r.courseId, r.courseOrderUserCt) for r in per_detail) == [
        (w1, "c", 2), (w1, "d", 1), (w1, "lost", 1), (w2, "c", 1)]


def test_idle_marks_of_a_table_need_no_window(spark):
    rows = frame(spark, [("a", at(s), "x") for s in (0, 4, 9, 13, 20, 86_399, 86_401)])
    marks = [Mark("n", ("k",), "idle", "5 seconds"), Mark("d", ("k",), "day_or_idle", "5 seconds"), Mark("w", ("k",), "window")]
    windows = count_marks(mark_cells(rows, marks, ahead=True), marks)
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert "Window [" not in plan and plan.count("Exchange") == 2  # cells, and windows
    got = {r.window.start: (r.n, r.d, r.w) for r in windows.collect()}
    assert got == {at(0): (2, 2, 1), at(10): (0, 0, 1), at(20): (1, 1, 1), at(86_390): (1, 1, 1), at(86_400): (0, 1, 1)}


def test_rows_of_an_idle_mark_are_shuffled_once(spark):
    rng = random.Random(8)
    rows = frame(spark, [(rng.choice(["a", "b", None]), at(rng.randint(-2000, 2000)), f"x{i}") for i in range(900)])
    mark = Mark(None, ("k",), "idle", "5 seconds", ("k", "c"))
    cells = mark_cells(rows, [mark], ahead=True)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    # Only rows of the last of a chunk's slots go to two chunks, where all went to two slots before.
    assert plan.count(" Exchange ") == 1 and cells.count() == 900
    want, last = set(), {}
    for r in sorted(rows.collect(), key=lambda r: (r.rt, r.c)):
        if r.k not in last or r.rt - last[r.k] >= timedelta(seconds=5):
            want.add((r.rt, r.k, r.c))
        last[r.k] = r.rt
    assert {(r["at"], r.k, r.c) for r in marks.firsts(cells, [mark]).collect()} == want


@pytest.mark.parametrize("per_detail", [False, True])
def test_subject_windows_are_shuffled_once(spark, per_detail):
    rows = [detail(str(i), f"2024-01-01 0{i % 3}:00:{i % 60:02}", course=["c", "d", "lost"][i % 3]) for i in range(90)]
    # Each row of a dimension gives a row, as a lookup after the windows does.
    courses = spark.createDataFrame([("c", "s"), ("c", "s"), ("d", "t"), ("d", "u")], "id string, subject_id string")
    subjects = spark.createDataFrame([("s", "Maths"), ("t", "Art"), ("t", "Art")], "id string, subject_name string")
    result = trade.by_course_and_subject(details(spark, rows), courses, subjects, per_detail=per_detail)
    got = result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Lines by their key, and by subject and hour; chunk sums read these again (the third, reused).
    assert plan.count("REPARTITION_BY_COL") == 3 and plan.count("ReusedExchange") == 1
    windows = {(r.stt, r.courseId) for r in got}
    count = {c: len({w for w in windows if w[1] == c}) for c in ("c", "d", "lost")}
    assert sorted((r.courseId, r.subjectId or "", r.subjectName or "") for r in got) == sorted(
        [("c", "s", "Maths")] * 2 * count["c"] + [("d", "t", "Art")] * 2 * count["d"] + [("d", "u", "")] * count["d"] + [("lost", "", "")] * count["lost"])
    assert sorted(r.subOrderCt for r in got if r.subjectId == "s") == list(range(1, 2 * count["c"] + 1))
    assert sum(r.courseOrderUserCt for r in got if r.courseId == "lost") == (30 if per_detail else count["lost"])


def test_running_totals_skip_nulls_at_the_start_of_a_chunk(spark):
    rows = [("a", at(0), "c0", None), ("a", at(10), "c1", 5), ("a", at(3600), "c2", None), ("a", at(3610), "c3", 2)]
    df = spark.createDataFrame(rows, "k string, t timestamp, c string, n bigint")
    got = {r.c: r.total for r in running_totals(df, ["k"], "t", ["c"], {"total": "n"}, starts="starts", ttl="5 seconds").collect()}
    assert got == {"c0": None, "c1": 5, "c2": 5, "c3": 7}

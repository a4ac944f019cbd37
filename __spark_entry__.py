"""Registered queries over the shared parquet tables, and their SQL equivalents.

Every query runs a job of ``tidemark.plans`` over whole tables, read through ``tidemark.bindings``.
Wall-clock columns are dropped and amounts turned into rounded doubles, for comparison only.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark import names
from tidemark.bindings import DATABASE, HAN, Tables
from tidemark.functions import clock
from tidemark.operators import routing
from tidemark.operators.latest import latest_by_key
from tidemark.operators.logsplit import split_logs
from tidemark.operators.visitors import repair_new_flag
from tidemark.plans import facts, study, trade, traffic, users

try:
    import corpus_pipeline
    from tidemark.llm import registry
except ModuleNotFoundError as missing:  # these two may be absent as a whole; a fault inside them must show
    if missing.name not in ("corpus_pipeline", "tidemark.llm"):
        raise
    corpus_pipeline = registry = None


def _plain(df: DataFrame, *drop: str) -> DataFrame:
    kept = [c for c in df.columns if c not in drop]
    return df.select(*[
        F.round(F.col(c), 4).cast("double").alias(c) if isinstance(df.schema[c].dataType, T.DecimalType) else F.col(c)
        for c in kept
    ])


def entry(spark: SparkSession) -> DataFrame:
    """Orders by province on the smallest test tables."""
    return queries()["orders_by_province"](spark, "/root/testdata/sf0.001")


def _windowed(job: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: _plain(job(Tables(spark, folder)), "ts")


def _rows(job: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: _plain(job(Tables(spark, folder)))


# Parts of every record, the fields that the package itself doesn't know among them.
_COMMON = "common struct<mid:string,is_new:string,extra:string>, ts bigint, trace struct<id:int>"


def _json(df: DataFrame, schema: str) -> DataFrame:
    return df.select(F.from_json("value", schema).alias("r")).select("r.*")


def _branch(topic: str, schema: str, flatten: Callable[[DataFrame], DataFrame]):
    def run(t: Tables) -> DataFrame:
        return flatten(_json(split_logs(repair_new_flag(t.logs()))[topic], schema))
    return _rows(run)


def _routed(t: Tables) -> routing.Routed:
    return routing.route(t.routed_changes(), routing.fold_config(t.routing_feed()))


def _routed_as_of(t: Tables) -> DataFrame:
    """Every order line routed by the configuration of its ship date."""
    routed = routing.route(t.part_changes(), routing.routes_over_time(routing.route_entries(t.order_config_feed())))
    kinds = [d.select(F.lit(kind).alias("kind"), "sink_table", "table", "type", "xid", F.cardinality("data").alias("fields"))
             for kind, d in ((routing.DIM, routed.dims), (routing.FACT, routed.facts))]
    return kinds[0].unionByName(kinds[1]).unionByName(routed.unrouted.select(
        F.lit("none").alias("kind"), F.lit(None).cast("string").alias("sink_table"), "table", "type", "xid", F.lit(0).alias("fields")))


def _dim_rows(t: Tables) -> DataFrame:
    d = F.col("data")
    return _routed(t).dims.select(
        "sink_table", "pk", "type", "ts", "xid", d["name"].alias("name"), d["level"].alias("level"),
        d["review_stars"].alias("stars"), F.cardinality(d).alias("fields"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per job or operator; each takes (spark, folder)."""
    added = {**registry.queries(), "pipeline": corpus_pipeline.run} if registry else {}
    return {
        **added,
        # facts from the change log
        "cart_add_facts": _rows(lambda t: facts.cart_adds(t.event_changes("cart_info"), DATABASE).drop("pt")),
        "order_detail_facts": _rows(lambda t: facts.order_details(
            t.change_log(t.order_detail_changes(), t.order_info_changes()), DATABASE)),
        "paid_detail_facts": _rows(lambda t: facts.paid_details(
            t.change_log(t.order_detail_changes(), t.payment_changes()), DATABASE)),
        "exam_facts": _rows(lambda t: facts.exams(t.change_log(t.exam_changes(), t.exam_question_changes()), DATABASE)),
        "exam_upserts": _rows(lambda t: facts.upserted(
            facts.exams(t.change_log(t.exam_changes(), t.exam_question_changes()), DATABASE))),
        "exam_question_facts": _rows(lambda t: facts.exam_questions(
            t.change_log(t.exam_changes(), t.exam_question_changes()), DATABASE)),
        "test_paper_facts": _rows(lambda t: facts.test_papers(t.exam_changes(), DATABASE, t.test_papers())),
        "course_review_facts": _rows(lambda t: facts.course_reviews(t.event_changes("review_info"), DATABASE)),
        "chapter_comment_facts": _rows(lambda t: facts.chapter_comments(t.event_changes("comment_info"), DATABASE)),
        # routing by configuration
        "routing_config": _rows(lambda t: routing.fold_config(t.order_config_feed())),
        "routing_dim_rows": _rows(_dim_rows),
        "routing_dim_latest": _rows(lambda t: latest_by_key(_dim_rows(t), ["sink_table", "pk"], ["ts", "xid"])),
        "routing_fact_records": _rows(lambda t: _json(
            routing.topic_records(_routed(t).facts).withColumn("value", F.to_json(F.struct("topic", "value"))),
            "topic string, value string")),
        "routing_unrouted": _rows(lambda t: _routed(t).unrouted.groupBy("table", "type").agg(F.count(F.lit(1)).alias("n"))),
        "routing_as_of": _rows(_routed_as_of),
        # times as text
        "time_texts": _rows(lambda t: t.order_time_texts().select(
            "o_orderkey", clock.date_of_text(F.col("text")).alias("day"), clock.to_epoch_ms(clock.date_of_text(F.col("text"))).alias("day_ms"),
            clock.to_epoch_ms(F.col("text"), full=True).alias("ms"), clock.ms_to_date(F.col("ms")).alias("date"),
            clock.ms_to_stamp(F.col("ms") + 3_723_000).alias("stamp"))),
        # application log
        "new_flag_repair": _rows(lambda t: repair_new_flag(t.logs()).select(
            "ts", "mid", "is_new")),
        "page_branch": _branch(names.PAGE_TOPIC, _COMMON + ", page struct<page_id:string,during_time:bigint,refer:int>, displays string, actions string, err string",
                               lambda d: d.select("common.*", "page.*", "ts", "trace.id", "displays", "actions", "err")),
        "display_branch": _branch(names.DISPLAY_TOPIC, "item_type string, item string, order int, ts bigint, page_id string",
                                  lambda d: d),
        "action_branch": _branch(names.ACTION_TOPIC, "action_id string, item string, ts bigint, page_id string", lambda d: d),
        "start_branch": _branch(names.START_TOPIC, _COMMON + ", start struct<entry:string,loading_time:int>, appVideo struct<video_id:string,quality:decimal(18,2)>",
                                lambda d: d.select("common.*", "start.*", "appVideo.*", "ts", "trace.id")),
        "video_branch": _branch(names.VIDEO_TOPIC, _COMMON + ", appVideo struct<video_id:string,play_sec:bigint,quality:decimal(18,2)>",
                                lambda d: d.select("common.*", "appVideo.*", "ts", "trace.id")),
        "error_branch": _branch(names.ERROR_TOPIC, _COMMON + ", page struct<page_id:string,refer:int>, err struct<error_code:int,msg:string>",
                                lambda d: d.select("common.*", "page.*", "err.*", "ts", "trace.id")),
        # traffic
        "keyword_counts": _windowed(lambda t: traffic.keyword_counts(t.searches())),
        "han_keyword_counts": _windowed(lambda t: traffic.keyword_counts(t.han_searches(), "1 hour")),
        "page_keyword_counts": _windowed(lambda t: traffic.keyword_counts(t.pages(), "1 hour")),
        "page_visitors": _windowed(lambda t: traffic.page_visitors(t.pages())),
        "traffic_by_source": _windowed(lambda t: traffic.by_source(t.pages(), t.traffic_sources())),
        "traffic_by_time": _windowed(lambda t: traffic.by_time(t.pages())),
        "traffic_by_time_daily": _windowed(lambda t: traffic.by_time(t.pages(), "1 day")),
        "traffic_by_visitor_kind": _windowed(lambda t: traffic.by_visitor_kind(t.pages(), "1 hour")),
        # users
        "user_logins": _windowed(lambda t: users.logins(t.pages())),
        "user_logins_returning_after_2_days": _windowed(lambda t: users.logins(t.pages(), "1 day", return_days=2)),
        "user_registrations": _windowed(lambda t: users.registrations(t.registrations())),
        # trade
        "cart_users": _windowed(lambda t: trade.cart_users(t.carts())),
        "order_users": _windowed(lambda t: trade.order_users(t.order_lines())),
        "order_totals": _windowed(lambda t: trade.order_totals(t.order_lines())),
        "order_totals_by_user": _windowed(lambda t: trade.order_totals_by_user(t.order_lines(), "1 hour")),
        "orders_by_province": _windowed(lambda t: trade.by_province(t.order_lines(), t.provinces())),
        "orders_by_province_daily": _windowed(lambda t: trade.by_province(t.order_lines(), t.provinces(), "1 day")),
        "orders_by_course_subject": _rows(lambda t: trade.by_course_and_subject(
            t.order_lines(), t.courses(), t.subjects())),
        "orders_by_course_subject_per_detail": _rows(lambda t: trade.by_course_and_subject(
            t.order_lines(), t.courses(), t.subjects(), per_detail=True)),
        # study
        "papers_by_course": _windowed(lambda t: study.papers(t.papers_taken(), t.courses(), "1 hour")),
        "paper_users": _windowed(lambda t: study.paper_users(t.papers_taken(), "1 day")),
        "paper_averages": _rows(lambda t: study.paper_averages(study.papers(t.papers_taken(), t.courses()))),
        "paper_score_bands": _rows(lambda t: study.score_bands(t.papers_taken())),
        "question_accuracy": _windowed(lambda t: study.question_accuracy(t.answers(), "1 day")),
        "course_reviews": _windowed(lambda t: study.reviews(t.reviews_added(), t.courses(), "1 hour")),
        "course_reviews_by_user": _windowed(lambda t: study.reviews(t.reviews_added(), t.courses(), "1 day", distinct_users=True)),
        "course_review_rates": _rows(lambda t: study.review_rates(study.reviews(t.reviews_added(), t.courses()))),
        "video_plays": _windowed(lambda t: study.video_plays(t.videos(), t.video_dim(), t.chapter_dim())),
    }


# --- SQL equivalents -------------------------------------------------------------------------------

_STAMP = "'%Y-%m-%d %H:%M:%S'"
_E = "e AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, epoch_us(ts) // 1000 AS ms FROM events)"
_P = f"""{_E}, p AS (SELECT 'm' || user_id AS mid, CAST(user_id AS VARCHAR) AS uid,
    user_id || '-' || strftime(ts, '%Y%m%d') AS sid, CAST(k % 5 AS VARCHAR) AS sc,
    CASE WHEN k % 4 = 0 THEN '1' ELSE '0' END AS is_new, CAST(floor(value) AS BIGINT) AS during_time,
    'Item ' || event_type AS item, CASE WHEN k % 2 = 0 THEN 'keyword' END AS item_type,
    CASE k % 3 WHEN 1 THEN 'login' WHEN 2 THEN 'search' END AS last_page_id,
    CASE event_type WHEN 'view' THEN 'home' WHEN 'click' THEN 'good_detail' ELSE event_type END AS page_id,
    CASE WHEN k % 2 <> 0 AND k % 3 = 0 THEN 1 ELSE 0 END AS one, make_timestamp(ms * 1000) AS rt FROM e)"""
_L = """l AS (SELECT l_orderkey || '-' || l_linenumber AS id, CAST(l_partkey AS VARCHAR) AS course_id,
    'course ' || l_partkey AS course_name, CAST(l_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS user_id,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CAST(c_nationkey AS VARCHAR) AS province_id,
    o_orderdate + to_seconds((o_orderkey * 37 + l_suppkey) % 86400) AS rt
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""


def _w(size: str, at: str = "rt") -> str:
    return f"time_bucket(INTERVAL '{size}', {at})"


def _se(size: str) -> str:
    return f"strftime(w, {_STAMP}) AS stt, strftime(w + INTERVAL '{size}', {_STAMP}) AS edt"


def _insert(key: str) -> str:
    return f"{key} % 10 NOT IN (0, 1)"


def _kind(key: str) -> str:
    return f"CASE {key} % 10 WHEN 0 THEN 'update' WHEN 1 THEN 'delete' ELSE 'insert' END"


def _t(column: str) -> str:
    return f"CAST({column} AS VARCHAR)"


def _d(column: str) -> str:
    """An amount as text without closing zeros, as a JSON number has none that count."""
    return f"rtrim(rtrim(CAST(CAST({column} AS DECIMAL(18,2)) AS VARCHAR), '0'), '.')"


def _s(column: str) -> str:
    return f"strftime({column}, {_STAMP})"


def _num(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 4)"


def _visits(keys: str, size: str, extra: str, select: str) -> str:
    sep = f", {keys}" if keys else ""
    return f"""WITH {_P}, f AS (SELECT *, {_w(size)} AS w,
        lag(rt) OVER (PARTITION BY mid ORDER BY rt{sep}) AS pm, lag(rt) OVER (PARTITION BY sid ORDER BY rt{sep}, one) AS ps FROM p),
      g AS (SELECT *, CASE WHEN pm IS NULL OR epoch_us(rt) - epoch_us(pm) >= 86400000000 THEN 1 ELSE 0 END AS uv,
        CASE WHEN ps IS NULL OR epoch_us(rt) - epoch_us(ps) >= 86400000000 THEN 1 ELSE 0 END AS sv FROM f),
      h AS (SELECT w{sep}, CAST(sum(uv) AS BIGINT) AS uvCt, CAST(sum(sv) AS BIGINT) AS svCt, count(*) AS pageCt,
        CAST(sum(sv * one) AS BIGINT) AS pageOneCt, CAST(sum(during_time) AS BIGINT) AS durSum FROM g GROUP BY w{sep})
      SELECT {_se(size)}, {select} FROM h {extra}"""


def _day_users(cte: str, source: str, key: str, out: str) -> str:
    return f"""WITH {cte}, f AS (SELECT rt, lag(rt) OVER (PARTITION BY {key} ORDER BY rt) AS pv FROM {source}),
      h AS (SELECT {_w('10 seconds')} AS w, count(*) AS {out} FROM f
        WHERE pv IS NULL OR CAST(pv AS DATE) <> CAST(rt AS DATE) GROUP BY 1)
      SELECT {_se('10 seconds')}, {out} FROM h"""


def _province(size: str) -> str:
    return f"""WITH {_L}, a AS (SELECT *, lag(rt) OVER (PARTITION BY id ORDER BY rt, order_id, user_id, province_id, amount) AS pv FROM l),
      b AS (SELECT * FROM a WHERE pv IS NULL OR epoch_us(rt) - epoch_us(pv) >= 5000000),
      c AS (SELECT *, lag(rt) OVER (PARTITION BY user_id ORDER BY rt, province_id) AS pu FROM b),
      h AS (SELECT {_w(size)} AS w, province_id, count(DISTINCT order_id) AS orderCount,
        CAST(sum(CASE WHEN pu IS NULL OR epoch_us(rt) - epoch_us(pu) >= 86400000000 THEN 1 ELSE 0 END) AS BIGINT) AS userCount,
        {_num('sum(amount)')} AS orderAmount FROM c GROUP BY 1, 2)
      SELECT {_se(size)}, province_id AS provinceId, n_name AS provinceName, orderCount, userCount, orderAmount
      FROM h LEFT JOIN nation ON province_id = CAST(n_nationkey AS VARCHAR)"""


def _course_subject(key: str, tie: str) -> str:
    return f"""WITH {_L}, a AS (SELECT *, lag(rt) OVER (PARTITION BY {key} ORDER BY rt, {tie}) AS pv FROM l),
      b AS (SELECT {_w('10 seconds')} AS w, course_id, count(*) AS ct, sum(amount) AS amt, min(rt) AS t0, min(course_name) AS course_name
        FROM a WHERE pv IS NULL OR epoch_us(rt) - epoch_us(pv) >= 5000000 GROUP BY 1, 2),
      c AS (SELECT b.*, CAST(p_size % 5 AS VARCHAR) AS subject_id FROM b LEFT JOIN part ON course_id = CAST(p_partkey AS VARCHAR)),
      d AS (SELECT *, lag(t0) OVER (PARTITION BY subject_id ORDER BY t0, course_id) AS pt0 FROM c),
      f AS (SELECT *, CASE WHEN pt0 IS NULL OR CAST(pt0 AS DATE) <> CAST(t0 AS DATE) OR epoch_us(t0) - epoch_us(pt0) >= 5000000
        THEN 1 ELSE 0 END AS fl FROM d)
      SELECT {_se('10 seconds')}, course_id AS courseId, course_name AS courseName, ct AS courseOrderUserCt,
        {_num('amt')} AS courseOrderAmount, subject_id AS subjectId, r_name AS subjectName,
        count(*) OVER r AS subOrderCt, CAST(sum(fl) OVER r AS BIGINT) AS subOrderUserCt, {_num('sum(amt) OVER r')} AS subOrderAmount,
        epoch_us(t0) // 1000 AS ts
      FROM f LEFT JOIN region ON subject_id = CAST(r_regionkey AS VARCHAR)
      WINDOW r AS (PARTITION BY subject_id ORDER BY t0, course_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


_SEEN = "mid, is_new, 'x' || k AS extra, ms AS ts, k AS id"
_QUALITY = _num("CAST(value AS DECIMAL(18,2))")
# The log records, with the repaired flag, as columns.
_LOG = f"""{_E}, g AS (SELECT *, 'm' || user_id AS mid, CASE WHEN k % 4 = 3 THEN NULL WHEN k % 2 = 0 THEN '1' ELSE '0' END AS raw_new,
    (event_type IN ('view', 'click') OR (event_type = 'error' AND k % 2 = 0)) AS is_page,
    (event_type = 'purchase' OR (event_type = 'signup' AND k % 2 = 0)) AS is_video FROM e),
  f AS (SELECT mid AS fmid, raw_new AS fnew, CAST(make_timestamp(ms * 1000) AS DATE) AS fday FROM g
    QUALIFY row_number() OVER (PARTITION BY mid ORDER BY ms, raw_new NULLS FIRST) = 1),
  v AS (SELECT g.*, CASE WHEN raw_new = '1' THEN CASE WHEN fnew = '1' AND fday = CAST(make_timestamp(ms * 1000) AS DATE)
    THEN '1' ELSE '0' END ELSE raw_new END AS is_new FROM g JOIN f ON mid = fmid)"""

_OD = f"""od AS (SELECT l_orderkey || '-' || l_linenumber AS id, {_t('l_partkey')} AS course_id, 'course ' || l_partkey AS course_name,
    {_t('l_orderkey')} AS order_id, {_t('l_suppkey')} AS user_id, {_d('l_extendedprice')} AS origin_amount,
    {_d('l_discount')} AS coupon_reduce, {_d('l_extendedprice')} AS final_amount, {_s('l_shipdate')} AS create_time
    FROM lineitem WHERE {_insert('l_partkey')})"""
_TE = f"""te AS (SELECT {_t('o_orderkey')} AS id, {_t('o_custkey')} AS paper_id, {_t('o_custkey')} AS user_id, {_d('o_totalprice')} AS score,
    {_t('o_orderkey % 3600')} AS duration_sec, {_s('o_orderdate')} AS create_time, {_s("o_orderdate + INTERVAL '20 minutes'")} AS submit_time,
    o_custkey FROM orders WHERE {_insert('o_custkey')})"""
_EQ = f"""eq AS (SELECT l_orderkey || '-' || l_linenumber AS id, {_t('l_orderkey')} AS exam_id, {_t('l_suppkey')} AS paper_id,
    {_t('l_partkey')} AS question_id, {_t('l_suppkey')} AS user_id, l_linestatus AS answer,
    CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS is_correct, {_d('l_quantity')} AS score
    FROM lineitem WHERE {_insert('l_partkey')})"""
_EXAMS = """te.id, te.paper_id, te.user_id, te.score, te.duration_sec, te.create_time, te.submit_time,
    eq.question_id, eq.answer, eq.is_correct FROM te JOIN eq ON te.id = eq.exam_id"""

_DIMS = f"""{_E}, k AS (SELECT *, {_kind('k')} AS type, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM e),
  d AS (SELECT 'dim_user_info' AS sink_table, {_t('user_id')} AS pk, type, sec AS ts, CAST(k AS BIGINT) AS xid, 'user ' || user_id AS name,
      {_t('k')} AS level, CAST(NULL AS VARCHAR) AS stars, 3 AS fields FROM k WHERE type <> 'delete'
    UNION ALL SELECT 'dim_review', {_t('event_id')}, type, sec, CAST(k AS BIGINT), NULL, NULL, {_t('user_id % 5 + 1')}, 3 FROM k WHERE type <> 'delete')"""


def oracle_sql() -> dict[str, str]:
    """The same results in SQL over the same tables."""
    hour, day, ten = "1 hour", "1 day", "10 seconds"
    added = dict(registry.oracle_sql()) if registry else {}
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        added["pipeline"] = corpus_pipeline.ORACLE_SQL
    paper = f"""{_E}, q AS (SELECT {_t('k')} AS paper_id, CAST(k * 3 AS VARCHAR) AS course_id, 'paper ' || k AS title,
        CAST(value AS DECIMAL(18,2)) AS score, user_id, date_trunc('second', ts) AS rt FROM e)"""
    review = f"{_E}, q AS (SELECT CAST(k AS VARCHAR) AS course_id, user_id, user_id % 5 + 1 AS stars, date_trunc('second', ts) AS rt FROM e)"
    return {
        **added,
        "cart_add_facts": f"""WITH {_E} SELECT {_t('event_id')} AS id, {_t('user_id')} AS user_id, {_t('k')} AS course_id,
            'course ' || k AS course_name, {_d('value')} AS cart_price, 's' || user_id AS session_id, {_s('ts')} AS create_time,
            CASE WHEN k % 2 = 0 THEN '1' END AS sold FROM e WHERE {_insert('k')}""",
        "order_detail_facts": f"""WITH {_OD} SELECT id, course_id, course_name, order_id, user_id, coupon_reduce, final_amount, create_time,
            {_d('o_totalprice')} AS origin_amount, o_orderstatus AS order_status, o_orderpriority AS trade_body, 's' || o_custkey AS session_id,
            {_t('o_custkey % 25')} AS province_id, {_s("o_orderdate + INTERVAL '15 minutes'")} AS expire_time
            FROM od JOIN orders ON order_id = {_t('o_orderkey')} WHERE {_insert('o_custkey')}""",
        "paid_detail_facts": f"""WITH {_OD} SELECT id, course_id, course_name, order_id, user_id, origin_amount, coupon_reduce, final_amount,
            create_time, create_time AS update_time, {_d('o_totalprice')} AS total_amount, o_orderpriority AS trade_body,
            o_orderstatus AS payment_type, '1602' AS payment_status, 'ok' AS callback_content,
            {_s("o_orderdate + INTERVAL '30 seconds'")} AS callback_time
            FROM od JOIN orders ON order_id = {_t('o_orderkey')} WHERE {_insert('o_custkey')} AND o_orderstatus = 'F'""",
        "exam_facts": f"WITH {_TE}, {_EQ} SELECT {_EXAMS}",
        "exam_upserts": f"""WITH {_TE}, {_EQ}, j AS (SELECT {_EXAMS}) SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY id
            ORDER BY create_time DESC, paper_id DESC, user_id DESC, score DESC, duration_sec DESC, submit_time DESC,
            question_id DESC, answer DESC, is_correct DESC) = 1""",
        "exam_question_facts": f"""WITH {_TE}, {_EQ} SELECT eq.id, exam_id, eq.paper_id, question_id, eq.user_id, answer, is_correct,
            eq.score AS question_score, te.score AS paper_score, duration_sec, create_time FROM eq JOIN te ON exam_id = te.id""",
        "test_paper_facts": f"""WITH {_TE} SELECT id, paper_id, user_id, score, duration_sec, create_time, p_name AS paper_title,
            CAST(p_size AS BIGINT) AS course_id FROM te JOIN part ON o_custkey = p_partkey""",
        "course_review_facts": f"""WITH {_E} SELECT {_t('event_id')} AS id, {_t('user_id')} AS user_id, {_t('k')} AS course_id,
            event_type AS review_txt, {_t('user_id % 5 + 1')} AS review_stars, {_s('ts')} AS create_time FROM e WHERE {_insert('k')}""",
        "chapter_comment_facts": f"""WITH {_E} SELECT {_t('event_id')} AS id, {_t('user_id')} AS user_id, {_t('k % 7')} AS chapter_id,
            {_t('k')} AS course_id, event_type AS comment_txt, {_s('ts')} AS create_time FROM e WHERE {_insert('k')}""",
        "routing_config": """WITH f AS (SELECT o_orderstatus = 'F' AS gone, o_custkey % 3 = 0 AS dim, 'table_' || o_custkey % 200 AS route_table,
              CASE WHEN o_custkey % 3 = 0 THEN '' WHEN o_custkey % 2 = 0 THEN 'insert' ELSE 'update' END AS route_type,
              'sink_' || o_orderkey % 7 AS sink_table, 'id,' || o_orderpriority AS sink_columns, o_orderdate, o_orderkey FROM orders)
            SELECT CASE WHEN dim THEN 'dim' ELSE 'dwd' END AS kind, route_table, route_type, sink_table, sink_columns, 'id' AS sink_pk,
              '' AS sink_extend FROM f QUALIFY row_number() OVER (PARTITION BY dim, route_table, route_type ORDER BY o_orderdate DESC, gone DESC,
              sink_table DESC, sink_columns DESC) = 1 AND NOT gone""",
        "time_texts": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, epoch_ms(date_trunc('day', o_orderdate)::TIMESTAMP) - 28800000 AS day_ms,
            epoch_ms(o_orderdate) - 28800000 AS ms, strftime(o_orderdate, '%Y-%m-%d') AS date,
            strftime(o_orderdate + INTERVAL 3723 SECOND, '%Y-%m-%d %H:%M:%S') AS stamp FROM orders""",
        "routing_as_of": """WITH f AS (SELECT o_orderstatus = 'F' AS gone, CASE WHEN o_custkey % 3 = 0 THEN 'dim' ELSE 'dwd' END AS kind, 'table_' || o_custkey % 200 AS t,
              CASE WHEN o_custkey % 3 = 0 THEN '' WHEN o_custkey % 2 = 0 THEN 'insert' ELSE 'update' END AS y, 'sink_' || o_orderkey % 7 AS sink_table,
              'id,' || o_orderpriority AS cols, o_orderdate AS low FROM orders
              QUALIFY row_number() OVER (PARTITION BY kind, t, y, low ORDER BY gone DESC, sink_table DESC, cols DESC) = 1),
            r AS (SELECT * FROM (SELECT *, lead(low) OVER (PARTITION BY kind, t, y ORDER BY low) AS high FROM f) WHERE NOT gone),
            c AS (SELECT 'table_' || l_partkey % 200 AS "table", CASE WHEN l_linenumber % 2 = 0 THEN 'insert' ELSE 'update' END AS type,
              l_shipdate AS x, l_orderkey * 10 + l_linenumber AS xid FROM lineitem),
            j AS (SELECT kind, sink_table, "table", type, xid, CASE WHEN cols LIKE '%5-LOW%' THEN 2 ELSE 1 END AS fields
              FROM c JOIN r ON "table" = t AND (kind = 'dim' OR type = y) AND x >= low AND (high IS NULL OR x < high))
            SELECT * FROM j UNION ALL SELECT 'none', NULL, "table", type, xid, 0 FROM c
              WHERE NOT EXISTS (SELECT 1 FROM r WHERE "table" = t AND (kind = 'dim' OR type = y) AND x >= low AND (high IS NULL OR x < high))""",
        "routing_dim_rows": f"WITH {_DIMS} SELECT * FROM d",
        "routing_dim_latest": f"""WITH {_DIMS} SELECT * FROM d
            QUALIFY row_number() OVER (PARTITION BY sink_table, pk ORDER BY ts DESC, xid DESC) = 1""",
        "routing_fact_records": f"""WITH {_E} SELECT 'dwd_review_add' AS topic, '{{"course_id":' || k || ',"create_time":"' || {_s('ts')} ||
            '","id":' || event_id || ',"review_stars":' || (user_id % 5 + 1) || ',"user_id":' || user_id || '}}' AS value
            FROM e WHERE {_insert('k')}
            UNION ALL SELECT 'dwd_cart_drop', '{{"cart_price":' || {_d('value')} || ',"id":' || event_id || ',"tag":{{"k":' || k ||
            '}},"user_id":' || user_id || '}}' FROM e WHERE k % 10 = 1""",
        "routing_unrouted": f"""WITH {_E}, k AS (SELECT {_kind('k')} AS type FROM e), u AS (
            SELECT 'user_info' AS "table", type FROM k WHERE type = 'delete' UNION ALL SELECT 'review_info', type FROM k WHERE type = 'delete'
            UNION ALL SELECT 'comment_info', type FROM k UNION ALL SELECT 'cart_info', type FROM k WHERE type <> 'delete')
            SELECT "table", type, count(*) AS n FROM u GROUP BY 1, 2""",
        "new_flag_repair": f"WITH {_LOG} SELECT ms AS ts, mid, is_new FROM v",
        "page_branch": f"""WITH {_LOG} SELECT {_SEEN}, event_type AS page_id, CAST(floor(value) AS BIGINT) AS during_time, k + 1 AS refer,
            CAST(NULL AS VARCHAR) AS displays, CAST(NULL AS VARCHAR) AS actions, CAST(NULL AS VARCHAR) AS err
            FROM v WHERE is_page AND event_type <> 'signup' AND NOT is_video""",
        "display_branch": f"""WITH {_LOG} SELECT 'course_id' AS item_type, {_t('k')} AS item, k AS "order", ms AS ts, event_type AS page_id
            FROM v, (VALUES (1), (2)) AS twice(n) WHERE event_type = 'view'""",
        "action_branch": f"WITH {_LOG} SELECT 'add' AS action_id, {_t('k')} AS item, ms AS ts, event_type AS page_id FROM v WHERE event_type = 'click'",
        "start_branch": f"""WITH {_LOG} SELECT {_SEEN}, 'icon' AS entry, k AS loading_time, CASE WHEN is_video THEN {_t('k')} END AS video_id,
            CASE WHEN is_video THEN {_QUALITY} END AS quality FROM v WHERE event_type = 'signup'""",
        "video_branch": f"""WITH {_LOG} SELECT {_SEEN}, {_t('k')} AS video_id, CAST(k AS BIGINT) AS play_sec, {_QUALITY} AS quality
            FROM v WHERE event_type = 'purchase'""",
        "error_branch": f"""WITH {_LOG} SELECT {_SEEN}, CASE WHEN is_page THEN event_type END AS page_id, CASE WHEN is_page THEN k + 1 END AS refer,
            k AS error_code, 'boom' AS msg
            FROM v WHERE event_type = 'error'""",
        "keyword_counts": f"""WITH x AS (SELECT make_timestamp((doc_id // 8 + 1704067200) * 1000000) AS rt,
              unnest(regexp_extract_all(lower(text), '[a-z0-9]+') || CASE WHEN regexp_matches(text, '[一-鿿]') THEN ['?'] ELSE [] END) AS keyword FROM documents),
            h AS (SELECT {_w(ten)} AS w, keyword, count(*) AS keyword_count FROM x GROUP BY 1, 2)
            SELECT {_se(ten)}, keyword, keyword_count FROM h""",
        "han_keyword_counts": f"""WITH d AS (SELECT make_timestamp((doc_id // 8 + 1704067200) * 1000000) AS rt,
              translate(text, 'abcdefghijklmnopqrstuvwxyz', '{"".join(chr(HAN + i) for i in range(26))}') AS text FROM documents),
            r AS (SELECT rt, unnest(regexp_extract_all(text, '[{chr(0x4E00)}-{chr(0x9FFF)}]+')) AS run FROM d),
            x AS (SELECT rt, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS keyword FROM d
              UNION ALL SELECT rt, unnest(CASE WHEN length(run) = 1 THEN [run] ELSE [substring(run, i, 2) for i in range(1, length(run))] END) FROM r),
            h AS (SELECT {_w(hour)} AS w, keyword, count(*) AS keyword_count FROM x GROUP BY 1, 2)
            SELECT {_se(hour)}, keyword, keyword_count FROM h""",
        "page_keyword_counts": f"""WITH {_P}, x AS (SELECT rt, unnest(regexp_extract_all(lower(item), '[a-z0-9]+')) AS keyword FROM p WHERE item_type = 'keyword'),
            h AS (SELECT {_w(hour)} AS w, keyword, count(*) AS keyword_count FROM x GROUP BY 1, 2)
            SELECT {_se(hour)}, keyword, keyword_count FROM h""",
        "page_visitors": f"""WITH {_P}, f AS (SELECT *, lag(rt) OVER (PARTITION BY mid, page_id ORDER BY rt) AS pv FROM p WHERE page_id IN ('home', 'good_detail')),
            h AS (SELECT {_w(ten)} AS w, count(*) FILTER (page_id = 'home') AS homeUvCt, count(*) FILTER (page_id <> 'home') AS goodDetailUvCt
              FROM f WHERE pv IS NULL OR CAST(pv AS DATE) <> CAST(rt AS DATE) GROUP BY 1)
            SELECT {_se(ten)}, homeUvCt, goodDetailUvCt FROM h""",
        "traffic_by_source": _visits("sc", ten, "LEFT JOIN region ON sc = CAST(r_regionkey AS VARCHAR)",
                                     "r_name AS sourceName, uvCt, svCt, pageCt, pageOneCt, durSum"),
        "traffic_by_time": _visits("", ten, "", "uvCt, svCt, pageCt"),
        "traffic_by_time_daily": _visits("", day, "", "uvCt, svCt, pageCt"),
        "traffic_by_visitor_kind": _visits("is_new", hour, "", "is_new, uvCt, svCt, pageCt, pageOneCt, durSum"),
        **{name: f"""WITH {_P}, f AS (SELECT rt, uid, CAST(rt AS DATE) AS dt, lag(CAST(rt AS DATE)) OVER (PARTITION BY uid ORDER BY rt) AS pd
              FROM p WHERE last_page_id IS NULL OR last_page_id = 'login'),
            h AS (SELECT {_w(size)} AS w, CAST(sum(CASE WHEN pd IS NOT NULL AND (epoch_us(rt) - epoch_us(CAST(pd AS TIMESTAMP))) // 86400000000 >= {days}
                THEN 1 ELSE 0 END) AS BIGINT) AS backCt, count(*) AS uuCt FROM f WHERE pd IS NULL OR pd <> dt GROUP BY 1)
            SELECT {_se(size)}, backCt, uuCt FROM h"""
           for name, size, days in (("user_logins", ten, 8), ("user_logins_returning_after_2_days", day, 2))},
        "user_registrations": f"""WITH h AS (SELECT {_w(ten, 'ts')} AS w, count(*) AS registerCt FROM events WHERE event_type = 'signup' GROUP BY 1)
            SELECT {_se(ten)}, registerCt FROM h""",
        "cart_users": _day_users("c AS (SELECT user_id, date_trunc('second', ts) AS rt FROM events WHERE event_type = 'click')", "c", "user_id", "cartAddUuCt"),
        "order_users": _day_users(_L, "l", "user_id", "orderUniqueUserCount"),
        "order_totals": f"""WITH {_L}, f AS (SELECT *, lag(rt) OVER (PARTITION BY order_id ORDER BY rt) AS pv FROM l),
            h AS (SELECT {_w(ten)} AS w, {_num('sum(amount)')} AS totalAmount, CAST(sum(CASE WHEN pv IS NULL OR CAST(pv AS DATE) <> CAST(rt AS DATE)
              THEN 1 ELSE 0 END) AS BIGINT) AS userCount, count(*) AS orderCount FROM f GROUP BY 1)
            SELECT {_se(ten)}, totalAmount, userCount, orderCount FROM h""",
        "order_totals_by_user": f"""WITH {_L}, f AS (SELECT *, lag(rt) OVER (PARTITION BY order_id ORDER BY rt) AS po,
              lag(rt) OVER (PARTITION BY user_id ORDER BY rt) AS pu FROM l),
            h AS (SELECT {_w(hour)} AS w, {_num('sum(amount)')} AS totalAmount,
              CAST(sum(CASE WHEN pu IS NULL OR CAST(pu AS DATE) <> CAST(rt AS DATE) THEN 1 ELSE 0 END) AS BIGINT) AS userCount,
              CAST(sum(CASE WHEN po IS NULL OR CAST(po AS DATE) <> CAST(rt AS DATE) THEN 1 ELSE 0 END) AS BIGINT) AS orderCount FROM f GROUP BY 1)
            SELECT {_se(hour)}, totalAmount, userCount, orderCount FROM h""",
        "orders_by_province": _province(ten),
        "orders_by_province_daily": _province(day),
        "orders_by_course_subject": _course_subject("course_id", "course_name, amount"),
        "orders_by_course_subject_per_detail": _course_subject("id", "course_id, course_name, amount"),
        "papers_by_course": f"""WITH {paper}, h AS (SELECT {_w(hour)} AS w, paper_id, count(*) AS userCount, {_num('sum(score)')} AS scoreCount,
              {_num('sum(user_id)')} AS durSecCount, min(title) AS paperTitle, min(course_id) AS courseId FROM q GROUP BY 1, 2)
            SELECT {_se(hour)}, userCount, scoreCount, durSecCount, paper_id AS paperId, paperTitle, courseId, p_name AS courseName
            FROM h LEFT JOIN part ON courseId = CAST(p_partkey AS VARCHAR)""",
        "paper_users": f"""WITH {paper}, h AS (SELECT {_w(day)} AS w, paper_id AS paperId, count(DISTINCT user_id) AS userCount FROM q GROUP BY 1, 2)
            SELECT {_se(day)}, paperId, userCount FROM h""",
        "paper_averages": f"""WITH {paper} SELECT paper_id AS paperId, count(*) AS userCount, CAST(sum(score) AS DOUBLE) / count(*) AS avgScore,
            CAST(sum(user_id) AS DOUBLE) / count(*) AS avgDurSec FROM q GROUP BY 1""",
        "paper_score_bands": f"""WITH {paper} SELECT paper_id, CAST(floor(score / 10) * 10 AS BIGINT) AS band, count(*) AS examCt FROM q GROUP BY 1, 2""",
        "question_accuracy": f"""WITH h AS (SELECT {_w(day, 'l_shipdate')} AS w, {_t('l_partkey')} AS questionId,
              CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS corrCt, count(*) AS questionCt,
              count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS corrUuCt, count(DISTINCT l_suppkey) AS questionUuCt
              FROM lineitem GROUP BY 1, 2)
            SELECT {_se(day)}, questionId, corrCt, questionCt, corrUuCt, questionUuCt FROM h""",
        "course_reviews": f"""WITH {review}, h AS (SELECT {_w(hour)} AS w, course_id, CAST(sum(stars) AS BIGINT) AS reviewStartsCount, count(*) AS userCt,
              count(*) FILTER (stars = 5) AS startsUserCt FROM q GROUP BY 1, 2)
            SELECT {_se(hour)}, course_id AS courseId, p_name AS courseName, reviewStartsCount, userCt, startsUserCt
            FROM h LEFT JOIN part ON course_id = CAST(p_partkey AS VARCHAR)""",
        "course_reviews_by_user": f"""WITH {review}, h AS (SELECT {_w(day)} AS w, course_id, CAST(sum(stars) AS BIGINT) AS reviewStartsCount,
              count(DISTINCT user_id) AS userCt, count(DISTINCT user_id) FILTER (stars = 5) AS startsUserCt FROM q GROUP BY 1, 2)
            SELECT {_se(day)}, course_id AS courseId, p_name AS courseName, reviewStartsCount, userCt, startsUserCt
            FROM h LEFT JOIN part ON course_id = CAST(p_partkey AS VARCHAR)""",
        "course_review_rates": f"""WITH {review} SELECT course_id AS courseId, count(*) AS userCt, CAST(sum(stars) AS DOUBLE) / count(*) AS avgStars,
            CAST(count(*) FILTER (stars = 5) AS DOUBLE) / count(*) AS topRate FROM q GROUP BY 1""",
        "video_plays": f"""WITH {_E}, q AS (SELECT user_id, {_t('k')} AS video_id, CAST(floor(value) AS BIGINT) AS sec, make_timestamp(ms * 1000) AS rt FROM e),
            f AS (SELECT *, lag(rt) OVER (PARTITION BY user_id ORDER BY rt, video_id) AS pv FROM q),
            c AS (SELECT f.*, CAST(p_size AS VARCHAR) AS chapter FROM f LEFT JOIN part ON video_id = CAST(p_partkey AS VARCHAR)),
            h AS (SELECT {_w(ten)} AS w, chapter, count(*) AS videoPlayCt, CAST(sum(sec) AS BIGINT) AS palySec,
              CAST(sum(CASE WHEN pv IS NULL OR CAST(pv AS DATE) <> CAST(rt AS DATE) OR epoch_us(rt) - epoch_us(pv) >= 3600000000
                THEN 1 ELSE 0 END) AS BIGINT) AS userCt FROM c GROUP BY 1, 2)
            SELECT {_se(ten)}, s_name AS chapterName, videoPlayCt, palySec, userCt
            FROM h LEFT JOIN supplier ON chapter = CAST(s_suppkey AS VARCHAR)""",
    }

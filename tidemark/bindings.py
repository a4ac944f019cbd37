"""The jobs' inputs, derived by Spark from a folder of star-schema parquet tables.

``orders``, ``lineitem`` and ``customer`` give the change log and the order lines, ``events`` the
application log, exams, reviews and videos, ``documents`` the searched text; ``part``, ``nation``,
``region`` and ``supplier`` serve as dimensions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.functions import clock
from tidemark.session import scratch_folder
from tidemark.sinks.changes import ChangeLog
from tidemark.sources.topics import change_rows, log_records

DATABASE = "edu"
#: The Han character that stands for the letter a; those of the other letters follow it.
HAN = 0x4E00
# Schema and number of splits per application and path: read from the files once, not for every query.
_SHAPES: dict[tuple[str, str], tuple[T.StructType, int]] = {}
LARGE_TABLES = ("lineitem", "orders", "events", "documents")


def _once(rows: DataFrame, value: Column) -> DataFrame:
    """``value`` as the only column. The generator keeps later filters from making the text twice."""
    return rows.select(F.inline(F.array(F.struct(value.alias("value")))))


def _text(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


class Tables:
    """Inputs over ``folder/<table>.parquet``. Every frame covers its whole tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._frames: dict[str, DataFrame] = {}

    def read(self, table: str) -> DataFrame:
        """A table; one with fewer input splits than cores is spread by its first column.

        A file with a single row group is one split however many cores there are. Tables with enough
        splits, as any large one, are left as they are.
        """
        if table not in self._frames:
            self._frames[table] = self._load(table)
        return self._frames[table]

    def _load(self, table: str) -> DataFrame:
        path = f"{self.folder}/{table}.parquet"
        known = (self.spark.sparkContext.applicationId, path)
        if known in _SHAPES:
            schema, splits = _SHAPES[known]
            df = self.spark.read.schema(schema).parquet(path)
        else:
            df = self.spark.read.parquet(path)
            splits = df.rdd.getNumPartitions() if table in LARGE_TABLES else 0
            _SHAPES[known] = df.schema, splits
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores, df.columns[0]) if 0 < splits < cores else df

    # --- order lines, as the order-detail topic holds them ---

    def order_lines(self) -> DataFrame:
        # Customers go to the orders first: the lines, several times as many, are shuffled once.
        orders = self.read("orders").join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        joined = self.read("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), _text("l_partkey").alias("course_id"),
            F.concat(F.lit("course "), "l_partkey").alias("course_name"), _text("l_orderkey").alias("order_id"),
            _text("o_custkey").alias("user_id"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("final_amount"),
            _line_time().alias("create_time"), _text("c_nationkey").alias("province_id"),
        )

    def order_time_texts(self) -> DataFrame:
        """Order times as text, and in milliseconds."""
        return self.read("orders").select("o_orderkey", clock.stamp(F.col("o_orderdate").cast("timestamp")).alias("text"),
                                          F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("ms"))

    def carts(self) -> DataFrame:
        return self.events().filter(F.col("event_type") == "click").select(
            _text("event_id").alias("id"), _text("user_id").alias("user_id"), F.date_trunc("second", "ts").alias("create_time"))

    # --- the event table and what it stands for ---

    def events(self) -> DataFrame:
        return self.read("events").withColumns({
            "ts": F.col("ts").cast("timestamp"),
            "k": F.regexp_extract("props", "[0-9]+", 0).cast("int"),
        })

    def pages(self) -> DataFrame:
        """Page log rows: one visit per event, sessions by device and day."""
        k = F.col("k")
        return self.events().select(
            F.struct(
                F.concat(F.lit("m"), "user_id").alias("mid"), _text("user_id").alias("uid"),
                F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("sid"),
                _text(k % 5).alias("sc"), F.when(k % 4 == 0, "1").otherwise("0").alias("is_new"),
            ).alias("common"),
            F.struct(
                F.floor("value").cast("bigint").alias("during_time"), F.concat(F.lit("Item "), "event_type").alias("item"),
                F.when(k % 2 == 0, "keyword").alias("item_type"),
                F.when(k % 3 == 1, "login").when(k % 3 == 2, "search").alias("last_page_id"),
                F.when(F.col("event_type") == "view", "home").when(F.col("event_type") == "click", "good_detail")
                .otherwise(F.col("event_type")).alias("page_id"),
            ).alias("page"),
            F.unix_millis("ts").alias("ts"),
        )

    def searches(self) -> DataFrame:
        """Page rows whose searched item is a whole document; eight documents share a second."""
        return self.read("documents").select(
            F.struct(_text("doc_id").alias("mid")).alias("common"),
            F.struct(F.col("text").alias("item"), F.lit("keyword").alias("item_type")).alias("page"),
            ((F.floor(F.col("doc_id") / 8) + 1_704_067_200) * 1000).cast("bigint").alias("ts"),
        )

    def han_searches(self) -> DataFrame:
        """``searches`` with every lower-case letter as a Han character: the texts become Han runs and words of the rest."""
        pages = self.searches()
        letters = "".join(map(chr, range(ord("a"), ord("z") + 1)))
        han = F.translate("page.item", letters, "".join(chr(HAN + i) for i in range(len(letters))))
        return pages.withColumn("page", F.col("page").withField("item", han))

    def videos(self) -> DataFrame:
        return self.events().select(
            F.struct(_text("user_id").alias("uid")).alias("common"),
            F.struct(F.floor("value").cast("bigint").alias("play_sec"), _text("k").alias("video_id")).alias("appVideo"),
            F.unix_millis("ts").alias("ts"),
        )

    def papers_taken(self) -> DataFrame:
        return self.events().select(
            _text("event_id").alias("id"), _text("k").alias("paper_id"), _text("user_id").alias("user_id"),
            F.col("value").cast("decimal(18,2)").alias("score"), _text("user_id").alias("duration_sec"),
            F.date_trunc("second", "ts").alias("create_time"), F.concat(F.lit("paper "), "k").alias("paper_title"),
            (F.col("k") * 3).cast("bigint").alias("course_id"),
        )

    def reviews_added(self) -> DataFrame:
        return self.events().select(
            F.col("k").cast("bigint").alias("course_id"), F.col("user_id"), F.col("event_id").alias("id"),
            (F.col("user_id") % 5 + 1).alias("review_stars"), F.date_trunc("second", "ts").alias("create_time"))

    def answers(self) -> DataFrame:
        return self.read("lineitem").select(
            _text("l_partkey").alias("question_id"), _text("l_suppkey").alias("user_id"),
            F.when(F.col("l_returnflag") == "R", "1").otherwise("0").alias("is_correct"),
            F.col("l_shipdate").cast("timestamp").alias("create_time"))

    def registrations(self) -> DataFrame:
        return self.events().filter(F.col("event_type") == "signup").select(F.date_trunc("second", "ts").alias("create_time"))

    # --- application log as JSON text, parsed like the real topic ---

    def log_values(self) -> DataFrame:
        """Records with fields that no schema of this package names, at every level."""
        k, kind = F.col("k"), F.col("event_type")
        page = kind.isin("view", "click") | (kind == "error") & (k % 2 == 0)
        item = F.struct(F.lit("course_id").alias("item_type"), _text("k").alias("item"), k.alias("order"))
        return _once(self.events(), F.to_json(F.struct(
            F.struct(F.concat(F.lit("m"), "user_id").alias("mid"), _text("user_id").alias("uid"),
                     F.when(k % 4 != 3, F.when(k % 2 == 0, "1").otherwise("0")).alias("is_new"),
                     F.concat(F.lit("x"), "k").alias("extra")).alias("common"),
            F.struct(k.alias("id")).alias("trace"),
            F.unix_millis("ts").alias("ts"),
            F.when(page, F.struct(kind.alias("page_id"), F.floor("value").cast("bigint").alias("during_time"),
                                  (k + 1).alias("refer"))).alias("page"),
            F.when(kind == "view", F.array(item, item)).alias("displays"),
            F.when(kind == "click", F.array(F.struct(F.lit("add").alias("action_id"), _text("k").alias("item"),
                                                     F.lit(7).alias("ts")))).alias("actions"),
            F.when(kind == "signup", F.struct(F.lit("icon").alias("entry"), k.alias("loading_time"))).alias("start"),
            F.when((kind == "purchase") | (kind == "signup") & (k % 2 == 0), F.struct(
                k.cast("bigint").alias("play_sec"), _text("k").alias("video_id"),
                F.col("value").cast("decimal(18,2)").alias("quality"))).alias("appVideo"),
            F.when(kind == "error", F.struct(k.alias("error_code"), F.lit("boom").alias("msg"))).alias("err"),
        )))

    def logs(self) -> DataFrame:
        return log_records(self.log_values())

    # --- change log as JSON text, as the real topic holds it ---

    def _changes(self, rows: DataFrame, table: str, key: Column, data: dict[str, Column]) -> DataFrame:
        kind = F.when(key % 10 == 0, "update").when(key % 10 == 1, "delete").otherwise("insert")
        return _once(rows, F.to_json(F.struct(
            F.lit(DATABASE).alias("database"), F.lit(table).alias("table"), kind.alias("type"),
            F.unix_timestamp(F.to_timestamp(data["create_time"])).alias("ts"), key.cast("bigint").alias("xid"),
            F.struct(*[column.alias(name) for name, column in data.items()]).alias("data"),
        )))

    def change_log(self, *parts: DataFrame) -> DataFrame:
        """Change text of several tables as one topic, parsed once and read by table."""
        values = reduce(DataFrame.unionByName, parts)
        return ChangeLog(scratch_folder(self.spark)).append(values).rows(self.spark)

    def order_info_changes(self) -> DataFrame:
        return self._changes(self.read("orders"), "order_info", F.col("o_custkey"), {
            "id": F.col("o_orderkey"), "user_id": F.col("o_custkey"),
            "origin_amount": F.col("o_totalprice").cast("decimal(18,2)"), "order_status": F.col("o_orderstatus"),
            "trade_body": F.col("o_orderpriority"), "session_id": F.concat(F.lit("s"), "o_custkey"),
            "province_id": F.col("o_custkey") % 25, "create_time": clock.stamp(F.col("o_orderdate")),
            "expire_time": clock.stamp(F.col("o_orderdate") + F.expr("interval 15 minutes")),
        })

    def order_detail_changes(self) -> DataFrame:
        return self._changes(self.read("lineitem"), "order_detail", F.col("l_partkey"), {
            "id": F.concat_ws("-", "l_orderkey", "l_linenumber"), "course_id": F.col("l_partkey"),
            "course_name": F.concat(F.lit("course "), "l_partkey"), "order_id": F.col("l_orderkey"),
            "user_id": F.col("l_suppkey"), "origin_amount": F.col("l_extendedprice").cast("decimal(18,2)"),
            "coupon_reduce": F.col("l_discount").cast("decimal(18,2)"),
            "final_amount": F.col("l_extendedprice").cast("decimal(18,2)"),
            "create_time": clock.stamp(F.col("l_shipdate")), "update_time": clock.stamp(F.col("l_shipdate")),
        })

    def payment_changes(self) -> DataFrame:
        return self._changes(self.read("orders"), "payment_info", F.col("o_custkey"), {
            "id": F.col("o_orderkey"), "order_id": F.col("o_orderkey"),
            "total_amount": F.col("o_totalprice").cast("decimal(18,2)"), "trade_body": F.col("o_orderpriority"),
            "payment_type": F.col("o_orderstatus"),
            "payment_status": F.when(F.col("o_orderstatus") == "F", "1602").otherwise("1601"),
            "create_time": clock.stamp(F.col("o_orderdate")), "callback_content": F.lit("ok"),
            "callback_time": clock.stamp(F.col("o_orderdate") + F.expr("interval 30 seconds")),
        })

    def exam_changes(self) -> DataFrame:
        return self._changes(self.read("orders"), "test_exam", F.col("o_custkey"), {
            "id": F.col("o_orderkey"), "paper_id": F.col("o_custkey"), "user_id": F.col("o_custkey"),
            "score": F.col("o_totalprice").cast("decimal(18,2)"), "duration_sec": F.col("o_orderkey") % 3600,
            "create_time": clock.stamp(F.col("o_orderdate")),
            "submit_time": clock.stamp(F.col("o_orderdate") + F.expr("interval 20 minutes")),
        })

    def exam_question_changes(self) -> DataFrame:
        return self._changes(self.read("lineitem"), "test_exam_question", F.col("l_partkey"), {
            "id": F.concat_ws("-", "l_orderkey", "l_linenumber"), "exam_id": F.col("l_orderkey"),
            "paper_id": F.col("l_suppkey"), "question_id": F.col("l_partkey"), "user_id": F.col("l_suppkey"),
            "answer": F.col("l_linestatus"), "is_correct": F.when(F.col("l_returnflag") == "R", "1").otherwise("0"),
            "score": F.col("l_quantity").cast("decimal(18,2)"), "create_time": clock.stamp(F.col("l_shipdate")),
        })

    def event_changes(self, table: str) -> DataFrame:
        """``cart_info``, ``review_info``, ``comment_info`` or ``user_info`` changes, one per event."""
        common = {"id": F.col("event_id"), "user_id": F.col("user_id"), "create_time": clock.stamp(F.col("ts"))}
        data = {
            "cart_info": {"course_id": F.col("k"), "course_name": F.concat(F.lit("course "), "k"),
                          "cart_price": F.col("value").cast("decimal(18,2)"),
                          "session_id": F.concat(F.lit("s"), "user_id"), "sold": F.when(F.col("k") % 2 == 0, "1"),
                          "tag": F.struct(F.col("k"))},
            "review_info": {"course_id": F.col("k"), "review_txt": F.col("event_type"),
                            "review_stars": F.col("user_id") % 5 + 1},
            "comment_info": {"chapter_id": F.col("k") % 7, "course_id": F.col("k"), "comment_txt": F.col("event_type")},
            "user_info": {"name": F.concat(F.lit("user "), "user_id"), "level": F.col("k"), "secret": F.col("props")},
        }[table]
        return self._changes(self.events(), table, F.col("k"), {**common, **data})

    def routing_feed(self) -> DataFrame:
        """A routing configuration as its change feed, with an update, a deletion and a table of both kinds."""
        rows = [
            ("c", 1, None, ("user_info", None, "dim_user_info", "dim", "user_id,name", "user_id", None)),
            ("u", 2, None, ("user_info", None, "dim_user_info", "dim", "user_id,name,level", "user_id", None)),
            ("r", 0, None, ("review_info", None, "dim_review", "dim", "id,course_id,review_stars", None, None)),
            ("r", 0, None, ("review_info", "insert", "dwd_review_add", "dwd", "id,user_id,course_id,review_stars,create_time", None, None)),
            ("r", 0, None, ("comment_info", "insert", "dwd_interaction_comment_add", "dwd", "id,comment_txt", None, None)),
            ("d", 3, ("comment_info", "insert", "dwd_interaction_comment_add", "dwd", "id,comment_txt", None, None), None),
            ("r", 0, None, ("cart_info", "delete", "dwd_cart_drop", "dwd", "id,user_id,cart_price,tag", None, None)),
        ]
        feed = self.spark.createDataFrame(rows, (
            "op string, ts_ms bigint, "
            + ", ".join(f"{side} struct<{', '.join(f'{c}:string' for c in schemas.CONFIG_COLUMNS)}>" for side in ("before", "after"))))
        return feed

    def order_config_feed(self) -> DataFrame:
        """A long configuration feed: every order sets, or if finished deletes, one of a few hundred routes."""
        dim = F.col("o_custkey") % 3 == 0
        entry = F.struct(
            F.concat(F.lit("table_"), F.col("o_custkey") % 200).alias("source_table"),
            F.when(F.col("o_custkey") % 2 == 0, "insert").otherwise("update").alias("source_type"),
            F.concat(F.lit("sink_"), F.col("o_orderkey") % 7).alias("sink_table"),
            F.when(dim, "dim").otherwise("dwd").alias("sink_type"),
            F.concat(F.lit("id,"), "o_orderpriority").alias("sink_columns"),
            F.lit(None).cast("string").alias("sink_pk"), F.lit(None).cast("string").alias("sink_extend"),
        )
        gone = F.col("o_orderstatus") == "F"
        return self.read("orders").select(
            F.when(gone, entry).alias("before"), F.when(~gone, entry).alias("after"),
            F.when(gone, "d").otherwise("u").alias("op"),
            (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) * 1000).alias("ts_ms"))

    def part_changes(self) -> DataFrame:
        """Parsed changes of the tables that the long feed routes, one per order line."""
        return self.read("lineitem").select(
            F.lit(DATABASE).alias("database"), F.concat(F.lit("table_"), F.col("l_partkey") % 200).alias("table"),
            F.when(F.col("l_linenumber") % 2 == 0, "insert").otherwise("update").alias("type"),
            F.to_variant_object(F.struct(_text("l_orderkey").alias("id"), F.col("l_linenumber").alias("5-LOW"))).alias("data"),
            F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("xid"))

    def routed_changes(self) -> DataFrame:
        parts = [change_rows(self.event_changes(t)) for t in ("user_info", "review_info", "comment_info", "cart_info")]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    # --- dimensions ---

    def courses(self) -> DataFrame:
        return self.read("part").select(_text("p_partkey").alias("id"), F.col("p_name").alias("COURSE_NAME"),
                                        _text(F.col("p_size") % 5).alias("SUBJECT_ID"))

    def subjects(self) -> DataFrame:
        return self.read("region").select(_text("r_regionkey").alias("id"), F.col("r_name").alias("SUBJECT_NAME"))

    def provinces(self) -> DataFrame:
        return self.read("nation").select(_text("n_nationkey").alias("id"), F.col("n_name").alias("NAME"))

    def traffic_sources(self) -> DataFrame:
        return self.read("region").select(_text("r_regionkey").alias("id"), F.col("r_name").alias("SOURCE_SITE"))

    def video_dim(self) -> DataFrame:
        return self.read("part").select(_text("p_partkey").alias("id"), _text("p_size").alias("CHAPTER_ID"))

    def chapter_dim(self) -> DataFrame:
        return self.read("supplier").select(_text("s_suppkey").alias("id"), F.col("s_name").alias("CHAPTER_NAME"))

    def test_papers(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("paper_title"),
                                        F.col("p_size").cast("bigint").alias("course_id"))


def _line_time() -> Column:
    """Order day plus a second of the day that differs between the lines of an order."""
    second = F.pmod(F.col("o_orderkey") * 37 + F.col("l_suppkey"), F.lit(86_400))
    return F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + second)

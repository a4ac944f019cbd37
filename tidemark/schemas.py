"""Input schemas and the column order of every result table."""

# Numbers are read as text and then cast, as a producer may write them either way.
# Change log: one JSON object per row change. ``ts`` (seconds) and ``xid`` give the change order. Row values
# stay VARIANT, so that numbers and nested values keep their types.
CHANGE = "database string, table string, type string, data variant, old variant, ts string, xid string"
# What a fact job reads of a change.
CHANGED_ROW = "database string, table string, type string, data variant, ts string"

# What the window jobs read of the application log. The log split carries whole records instead.
LOG = (
    "common struct<ar:string, ba:string, ch:string, is_new:string, md:string, mid:string, os:string, "
    "sc:string, sid:string, uid:string, vc:string>, "
    "ts string, "
    "page struct<during_time:string, item:string, item_type:string, last_page_id:string, page_id:string>, "
    "appVideo struct<play_sec:string, position_sec:string, video_id:string>"
)
LOG_NUMBERS = (("page", "during_time"), ("appVideo", "play_sec"), ("appVideo", "position_sec"))

PAGE_MAPS = "common map<string,string>, page map<string,string>, ts string"

CONFIG_COLUMNS = (
    "source_table", "source_type", "sink_table", "sink_type", "sink_columns", "sink_pk", "sink_extend",
)
_CONFIG = ", ".join(f"{c}:string" for c in CONFIG_COLUMNS)
CONFIG = ", ".join(f"{c} string" for c in CONFIG_COLUMNS)
CONFIG_FEED = f"before struct<{_CONFIG}>, after struct<{_CONFIG}>, op string, ts_ms bigint"

# ``data`` keys kept by each fact job.
FACT_KEYS = {
    "cart_info": ("id", "user_id", "course_id", "course_name", "cart_price", "session_id", "create_time", "sold"),
    "order_detail": ("id", "course_id", "course_name", "order_id", "user_id", "origin_amount", "coupon_reduce",
                     "final_amount", "create_time", "update_time"),
    "order_info": ("id", "user_id", "origin_amount", "coupon_reduce", "final_amount", "order_status", "trade_body",
                   "session_id", "province_id", "create_time", "expire_time", "update_time"),
    "payment_info": ("id", "out_trade_no", "order_id", "alipay_trade_no", "total_amount", "trade_body",
                     "payment_type", "payment_status", "create_time", "update_time", "callback_content",
                     "callback_time"),
    "test_exam": ("id", "paper_id", "user_id", "score", "duration_sec", "create_time", "submit_time"),
    "test_exam_question": ("id", "exam_id", "paper_id", "question_id", "user_id", "answer", "is_correct", "score",
                           "create_time", "update_time", "deleted"),
    "review_info": ("id", "user_id", "course_id", "review_txt", "review_stars", "create_time"),
    "comment_info": ("id", "user_id", "chapter_id", "course_id", "comment_txt", "create_time"),
}


def strings(columns: tuple[str, ...], **others: str) -> str:
    """DDL of a fact topic: every column a string but for ``others``."""
    return ", ".join(f"{c} {others.get(c, 'string')}" for c in columns)


# Sink column order is the schema: the store binds by position.
RESULT_COLUMNS = {
    "dws_traffic_keyword_page_view_window": ("stt", "edt", "keyword", "keyword_count", "ts"),
    "dws_traffic_page_view_window": ("stt", "edt", "homeUvCt", "goodDetailUvCt", "ts"),
    "dws_traffic_source_window": ("stt", "edt", "sourceName", "uvCt", "svCt", "pageCt", "pageOneCt", "durSum", "ts"),
    "dws_traffic_time_window": ("stt", "edt", "uvCt", "svCt", "pageCt", "ts"),
    "dws_trade_cart_add_uu_window": ("stt", "edt", "cartAddUuCt", "ts"),
    "dws_trade_order_window": ("stt", "edt", "orderUniqueUserCount", "ts"),
    "dws_trade_order_count_window": ("stt", "edt", "totalAmount", "userCount", "orderCount", "ts"),
    "dws_trade_province_order_window": ("stt", "edt", "provinceId", "provinceName", "orderCount", "userCount",
                                        "orderAmount", "ts"),
    "dws_trade_course_subject_order_window": ("stt", "edt", "courseId", "courseName", "courseOrderUserCt",
                                              "courseOrderAmount", "subjectId", "subjectName", "subOrderCt",
                                              "subOrderUserCt", "subOrderAmount", "ts"),
    "dws_user_user_login_window": ("stt", "edt", "backCt", "uuCt", "ts"),
    "dws_user_user_register_window": ("stt", "edt", "registerCt", "ts"),
    "dws_test_paper_course_window": ("stt", "edt", "userCount", "scoreCount", "durSecCount", "paperId", "paperTitle",
                                     "courseId", "courseName", "ts"),
    "dws_course_user_review_window": ("stt", "edt", "courseId", "courseName", "reviewStartsCount", "userCt",
                                      "startsUserCt", "ts"),
    "dws_video_info_window": ("stt", "edt", "chapterName", "videoPlayCt", "palySec", "userCt", "ts"),
}
# The same measures counted in another way (by user, by order line) have tables of their own.
RESULT_COLUMNS |= {
    "dws_traffic_visitor_kind_window": ("stt", "edt", "is_new", "uvCt", "svCt", "pageCt", "pageOneCt", "durSum", "ts"),
    "dws_trade_order_user_count_window": RESULT_COLUMNS["dws_trade_order_count_window"],
    "dws_trade_course_subject_detail_window": RESULT_COLUMNS["dws_trade_course_subject_order_window"],
    "dws_course_review_user_window": RESULT_COLUMNS["dws_course_user_review_window"],
}

# Keys under which the row with the greatest ``ts`` replaces earlier ones.
RESULT_KEYS = {
    "dws_traffic_keyword_page_view_window": ("stt", "edt", "keyword"),
    "dws_traffic_page_view_window": ("stt", "edt"),
    "dws_traffic_source_window": ("stt", "edt", "sourceName"),
    "dws_traffic_time_window": ("stt", "edt"),
    "dws_trade_cart_add_uu_window": ("stt", "edt"),
    "dws_trade_order_window": ("stt", "edt"),
    "dws_trade_order_count_window": ("stt", "edt"),
    "dws_trade_province_order_window": ("stt", "edt", "provinceId"),
    "dws_trade_course_subject_order_window": ("stt", "edt", "courseId", "subjectId"),
    "dws_user_user_login_window": ("stt", "edt"),
    "dws_user_user_register_window": ("stt", "edt"),
    "dws_test_paper_course_window": ("stt", "edt", "paperId", "courseId"),
    "dws_course_user_review_window": ("stt", "edt", "courseId"),
    "dws_video_info_window": ("stt", "edt", "chapterName"),
    "dws_traffic_visitor_kind_window": ("stt", "edt", "is_new"),
    "dws_trade_order_user_count_window": ("stt", "edt"),
    "dws_trade_course_subject_detail_window": ("stt", "edt", "courseId", "subjectId"),
    "dws_course_review_user_window": ("stt", "edt", "courseId"),
}

# Tables whose key is a looked-up name: several sources or chapters may share one name, or have none.
KEYED_BY_NAME = ("dws_traffic_source_window", "dws_video_info_window")

AMOUNT = "decimal(22,6)"
SINK_AMOUNT = "decimal(38,20)"

"""Fixed names shared by jobs: topics, result tables and code values."""

# Source topics
CHANGE_TOPIC = "topic_db"
LOG_TOPIC = "topic_log"

# Log topics
PAGE_TOPIC = "dwd_traffic_page_log"
START_TOPIC = "dwd_traffic_start_log"
DISPLAY_TOPIC = "dwd_traffic_display_log"
ACTION_TOPIC = "dwd_traffic_action_log"
ERROR_TOPIC = "dwd_traffic_error_log"
VIDEO_TOPIC = "dwd_traffic_appVideo_log"

# Fact topics with a job of their own
CART_ADD_TOPIC = "dwd_trade_cart_add"
ORDER_DETAIL_TOPIC = "dwd_trade_order_detail"
PAY_DETAIL_TOPIC = "dwd_trade_pay_detail_suc"
EXAM_TOPIC = "dwd_test_exam"
EXAM_QUESTION_TOPIC = "dwd_test_exam_question"
TEST_PAPER_TOPIC = "dwd_test_paper"
COURSE_REVIEW_TOPIC = "dwd_course_review"
CHAPTER_COMMENT_TOPIC = "dwd_chapter_commnet"

# Fact topics written by configured routing
FAVOR_ADD_TOPIC = "dwd_interaction_favor_add"
REVIEW_ADD_TOPIC = "dwd_review_add"
COMMENT_ADD_TOPIC = "dwd_interaction_comment_add"
USER_REGISTER_TOPIC = "dwd_user_register"
VIP_CHANGE_TOPIC = "dwd_vip_change_detail_add"
ROUTED_TOPICS = (FAVOR_ADD_TOPIC, REVIEW_ADD_TOPIC, COMMENT_ADD_TOPIC, USER_REGISTER_TOPIC, VIP_CHANGE_TOPIC)

# Code values tested by the jobs
PAYMENT_DONE = "1602"
DIM_CHANGE_TYPES = ("insert", "update", "bootstrap-insert")
HOME_PAGE = "home"
DETAIL_PAGE = "good_detail"
LOGIN_PAGE = "login"
KEYWORD_ITEM = "keyword"
TOP_STARS = 5
RETURN_AFTER_DAYS = 8

# Window, lateness and retention of the jobs
WINDOW = "10 seconds"
LATENESS = "2 seconds"
JOIN_RETENTION = "905 seconds"
SHORT_JOIN_RETENTION = "5 seconds"

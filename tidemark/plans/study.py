"""Window measures of exams, reviews and videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import names, schemas
from tidemark.functions import clock
from tidemark.operators.lookup import enrich
from tidemark.operators.marks import Mark, Memory, count_marks, mark_cells
from tidemark.operators.windows import stamped, sum_parts, tumble
from tidemark.sources.topics import with_event_time

VIEWER_IDLE = "1 hour"
VIDEO_MEASURES = ("videoPlayCt", "palySec", "userCt")


def _timed(rows: DataFrame) -> DataFrame:
    return with_event_time(rows, clock.text_to_time(F.col("create_time"))).filter(F.col("rt").isNotNull())


def _distinct_per_window(rows: DataFrame, keys: list[str], who: str, out: str, size: str) -> DataFrame:
    """Distinct ``who`` per window and keys as a part for ``sum_parts``; two plain aggregates, no set."""
    pairs = tumble(rows.filter(F.col(who).isNotNull()), {"_n": F.count(F.lit(1))}, [*keys, who], size)
    return pairs.select(F.window_time("window").alias("rt"), *keys, F.lit(1).alias(out))


def paper_measures(taken: DataFrame, size: str = names.WINDOW) -> DataFrame:
    """Exams taken, summed score and duration per paper; title and course are those of the first row."""
    rows = _timed(taken)
    first = F.min(F.struct(F.col("rt").cast("timestamp").alias("at"), F.col("course_id").cast("string").alias("course_id"),
                           "paper_title"))
    return tumble(rows, {
        "userCount": F.count(F.lit(1)),
        "scoreCount": F.sum(F.col("score").try_cast(schemas.AMOUNT)),
        "durSecCount": F.sum(F.col("duration_sec").try_cast(schemas.AMOUNT)),
        "_first": first,
    }, ["paper_id"], size).select(
        "window", "userCount", "scoreCount", "durSecCount", F.col("paper_id").alias("paperId"),
        F.col("_first.paper_title").alias("paperTitle"), F.col("_first.course_id").alias("courseId"))


def name_papers(windows: DataFrame, courses: DataFrame, emit_ts: Column | None = None) -> DataFrame:
    named = enrich(windows, courses, "courseId", {"courseName": "COURSE_NAME"})
    return stamped(named, schemas.RESULT_COLUMNS["dws_test_paper_course_window"], emit_ts)


def papers(taken: DataFrame, courses: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None) -> DataFrame:
    """The measures of every paper with the name of its course."""
    return name_papers(paper_measures(taken, size), courses, emit_ts)


def paper_users(taken: DataFrame, size: str = names.WINDOW) -> DataFrame:
    """Distinct users per paper and window."""
    part = _distinct_per_window(_timed(taken), ["paper_id"], "user_id", "userCount", size)
    summed = sum_parts([part], ["userCount"], ["paper_id"], size)
    return stamped(summed.withColumnRenamed("paper_id", "paperId").withColumn("ts", F.lit(0)),
                   ("stt", "edt", "paperId", "userCount"))


def paper_averages(windows: DataFrame, by: str = "paperId") -> DataFrame:
    """Average score and duration per paper or course over the stored windows."""
    return windows.groupBy(by).agg(
        F.sum("userCount").alias("userCount"),
        (F.sum("scoreCount").cast("double") / F.sum("userCount")).alias("avgScore"),
        (F.sum("durSecCount").cast("double") / F.sum("userCount")).alias("avgDurSec"),
    )


def score_bands(taken: DataFrame, width: int = 10) -> DataFrame:
    """Exams per paper and score band; ``band`` is the band's lower bound."""
    score = F.col("score").try_cast(schemas.AMOUNT)
    band = (F.floor(score / width) * width).cast("bigint")
    return taken.filter(score.isNotNull()).groupBy("paper_id", band.alias("band")).agg(F.count(F.lit(1)).alias("examCt"))


def question_accuracy(answers: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None) -> DataFrame:
    """Answers, right answers and the distinct users of both, per question."""
    right = F.col("is_correct") == "1"
    rows = _timed(answers).select(
        "rt", F.col("question_id").alias("questionId"), "user_id",
        F.when(right, 1).otherwise(0).alias("corrCt"), F.lit(1).alias("questionCt"))
    pairs = tumble(rows, {"corrCt": F.sum("corrCt"), "questionCt": F.sum("questionCt")}, ["questionId", "user_id"], size)
    known = F.col("user_id").isNotNull()
    per_user = pairs.select(
        F.window_time("window").alias("rt"), "questionId", "corrCt", "questionCt",
        F.when(known & (F.col("corrCt") > 0), 1).otherwise(0).alias("corrUuCt"),
        F.when(known, 1).otherwise(0).alias("questionUuCt"))
    measures = ["corrCt", "questionCt", "corrUuCt", "questionUuCt"]
    summed = tumble(per_user, {m: F.sum(m) for m in measures}, ["questionId"], size)
    return stamped(summed, ("stt", "edt", "questionId", *measures, "ts"), emit_ts)


def review_measures(added: DataFrame, size: str = names.WINDOW, distinct_users: bool = False) -> DataFrame:
    """Stars, reviews and top-star reviews per course; ``distinct_users`` counts users, not rows."""
    stars = F.col("review_stars").try_cast("bigint")
    rows = _timed(added).select(
        "rt", F.col("course_id").cast("string").alias("course_id"), "user_id", stars.alias("reviewStartsCount"), F.lit(1).alias("userCt"),
        F.when(stars == names.TOP_STARS, 1).otherwise(0).alias("startsUserCt"))
    measures = ["reviewStartsCount", "userCt", "startsUserCt"]
    if distinct_users:
        best = rows.filter(F.col("startsUserCt") == 1)
        parts = [rows.select("rt", "course_id", "reviewStartsCount"),
                 _distinct_per_window(rows, ["course_id"], "user_id", "userCt", size),
                 _distinct_per_window(best, ["course_id"], "user_id", "startsUserCt", size)]
        return sum_parts(parts, measures, ["course_id"], size)
    return tumble(rows, {m: F.sum(m) for m in measures}, ["course_id"], size)


def name_reviews(windows: DataFrame, courses: DataFrame, emit_ts: Column | None = None) -> DataFrame:
    named = enrich(windows, courses, "course_id", {"courseName": "COURSE_NAME"})
    return stamped(named.withColumnRenamed("course_id", "courseId"),
                   schemas.RESULT_COLUMNS["dws_course_user_review_window"], emit_ts)


def reviews(added: DataFrame, courses: DataFrame, size: str = names.WINDOW, emit_ts: Column | None = None,
            distinct_users: bool = False) -> DataFrame:
    """The measures of every course under its name."""
    return name_reviews(review_measures(added, size, distinct_users), courses, emit_ts)


def review_rates(windows: DataFrame) -> DataFrame:
    """Average stars and share of top-star reviews per course over the stored windows."""
    return windows.groupBy("courseId").agg(
        F.sum("userCt").alias("userCt"),
        (F.sum("reviewStartsCount") / F.sum("userCt")).alias("avgStars"),
        (F.sum("startsUserCt") / F.sum("userCt")).alias("topRate"),
    )


VIEWERS = (Mark("userCt", ("uid",), "day_or_idle", VIEWER_IDLE),)


def video_cells(videos: DataFrame, size: str = names.WINDOW) -> DataFrame:
    """Cells of viewers with plays and seconds played."""
    rows = with_event_time(videos, clock.ms_to_time(F.col("ts"))).select(
        "rt", F.col("common.uid").alias("uid"), F.col("appVideo.video_id").alias("video_id"),
        F.col("appVideo.play_sec").cast("bigint").alias("play_sec"))
    return mark_cells(rows, VIEWERS, ["video_id"], {"videoPlayCt": F.lit(1), "palySec": F.col("play_sec")}, size)


def video_windows(cells: DataFrame, size: str = names.WINDOW, memory: Memory | None = None) -> DataFrame:
    """Plays, seconds played and daily viewers per video."""
    return count_marks(cells, VIEWERS, ["video_id"], size, memory)


def name_chapters(windows: DataFrame, video_dim: DataFrame, chapter_dim: DataFrame,
                  emit_ts: Column | None = None) -> DataFrame:
    """Sum videos to chapters: the chapter is looked up once per video and window, its name once per chapter."""
    with_chapter = enrich(windows, video_dim, "video_id", {"chapterId": "CHAPTER_ID"})
    summed = with_chapter.groupBy("window", "chapterId").agg(*[F.sum(m).alias(m) for m in VIDEO_MEASURES])
    named = enrich(summed, chapter_dim, "chapterId", {"chapterName": "CHAPTER_NAME"})
    return stamped(named, schemas.RESULT_COLUMNS["dws_video_info_window"], emit_ts)


def video_plays(videos: DataFrame, video_dim: DataFrame, chapter_dim: DataFrame, size: str = names.WINDOW,
                emit_ts: Column | None = None) -> DataFrame:
    """Plays, seconds played and daily viewers per chapter."""
    return name_chapters(video_windows(video_cells(videos, size), size), video_dim, chapter_dim, emit_ts)

"""Split of the application log into its branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import names
from tidemark.functions import documents


def _explode_part(pages: DataFrame, part: str) -> DataFrame:
    items = pages.select(
        "ts", documents.text_of(F.col("record"), "page", "page_id").alias("page_id"),
        F.explode(F.try_variant_get("record", f"$.{part}", "array<variant>")).alias("_item"))
    fields = documents.put_fields(documents.fields_of(F.col("_item")), ts=F.col("ts"), page_id=F.col("page_id"))
    return items.select(F.to_json(fields).alias("value"))


def _without(*removed: str) -> Column:
    """JSON text of the record as it came, with the repaired flag and without the ``removed`` parts."""
    record = F.col("record")
    common = F.try_variant_get(record, "$.common", "map<string,variant>")
    changed = F.col("is_new") != documents.text_of(record, "common", "is_new")
    repaired = F.to_variant_object(documents.put_fields(common, is_new=F.col("is_new")))
    fields = documents.put_fields(
        documents.fields_of(record),
        common=F.when(changed, repaired).otherwise(F.try_variant_get(record, "$.common", "variant")))
    return F.to_json(F.map_filter(fields, lambda k, _: ~k.isin(*removed)) if removed else fields).alias("value")


def split_logs(logs: DataFrame) -> dict[str, DataFrame]:
    """Branch topic to JSON ``value`` rows, from ``log_records`` (columns ``record``, ``is_new``, ``ts``).

    Records go on whole, with fields nobody here knows, but for the parts named below and JSON nulls.
    Any record with ``err`` goes whole to the error branch; the others carry no ``err``. A start record
    wins over a video record, and what is neither is a page with its displays and actions taken out.
    A record without a page goes nowhere but to the error branch.
    """
    record = F.col("record")
    start, video = documents.present(record, "start"), documents.present(record, "appVideo")
    pages = logs.filter(~start & ~video & documents.present(record, "page"))
    return {
        names.ERROR_TOPIC: logs.filter(documents.present(record, "err")).select(_without()),
        names.START_TOPIC: logs.filter(start).select(_without("err")),
        names.VIDEO_TOPIC: logs.filter(~start & video).select(_without("err")),
        names.DISPLAY_TOPIC: _explode_part(pages, "displays"),
        names.ACTION_TOPIC: _explode_part(pages, "actions"),
        names.PAGE_TOPIC: pages.select(_without("displays", "actions", "err")),
    }

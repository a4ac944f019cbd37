"""Registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import alignment, bpe, chat, decontaminate, exact_dedup, html_text, langid, line_dedup, packing, pitman_yor, simhash, topk, whitening
from tidemark.llm.common import prepare


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, folder, "documents"))


def op2_bpe_coding(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    return bpe.encoded(spark, _table(spark, folder, "documents"), path, with_ids=False)


def op3_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.digests(chat.formatted(chat.with_extra(spark, _table(spark, folder, "conversations"))))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return pitman_yor.scored(_table(spark, folder, "documents"), pitman_yor.trains())


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.predictions(_table(spark, folder, "documents"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.report(_table(spark, folder, "documents"))


def op9_packing(spark: SparkSession, folder: str, vocabulary: str | None = None) -> DataFrame:
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    return packing.digests(packing.packed(_table(spark, folder, "documents"), path))


def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extracted(_table(spark, folder, "pages"))


def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.digests(decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")))


def op12_alignment(spark: SparkSession, folder: str, vocabulary: str | None = None, model: str | None = None) -> DataFrame:
    path_a = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    return alignment.linked(_table(spark, folder, "documents"), path_a, model or public_tokenizers.path("piece_bpe_32k.model"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(_table(spark, folder, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_bpe_coding": op2_bpe_coding,
        "op3_topk_search": op3_topk_search,
        "op4_chat_formatting": op4_chat_formatting,
        "op5_simhash": op5_simhash,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_language_id": op7_language_id,
        "op8_line_dedup": op8_line_dedup,
        "op9_packing": op9_packing,
        "op10_html_extraction": op10_html_extraction,
        "op11_decontamination": op11_decontamination,
        "op12_alignment": op12_alignment,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.SQL, "op3_topk_search": topk.SQL, "op4_chat_formatting": chat.SQL,
            "op8_line_dedup": line_dedup.SQL, "op11_decontamination": decontaminate.SQL}

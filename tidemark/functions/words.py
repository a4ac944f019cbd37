"""Keyword splitting as column expressions, so it stays inside the JVM.

Letter and digit runs are words. A run of Han characters gives its overlapping pairs (or its only
character), in place of a dictionary; a dictionary splitter can be plugged in as a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
WORD_RUN = "[a-z0-9]+"
HAN_RUN = "[一-鿿]+"


def _pairs(run: Column) -> Column:
    return F.when(F.length(run) == 1, F.array(run)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    )


def split_words(text: Column) -> Column:
    """All words of ``text``, lower-cased; an empty array where it has none, null for null."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(WORD_RUN), F.lit(0))
    han = F.regexp_extract_all(text, F.lit(HAN_RUN), F.lit(0))
    return F.concat(runs, F.flatten(F.transform(han, _pairs)))


def explode_words(
    df: DataFrame,
    column: str,
    word: str = "word",
    splitter: Callable[[Column], Column] = split_words,
) -> DataFrame:
    """Lateral split: one row per word. A splitter that gives null falls back to the whole text."""
    text = F.col(column)
    return df.filter(text.isNotNull()).withColumn(word, F.explode(F.coalesce(splitter(text), F.array(text))))

"""Chat formatting with column expressions: sort, merge same-role turns, escape, concatenate, and read back.

A conversation becomes ``<|turn ROLE|>text<|and|>text<|end|>`` blocks. Control strings begin with ``<|`` and
end with ``|>``; inside roles and texts a backslash goes before every ``\\`` and ``|``, so ``<|`` can't occur there, and
``|>`` only behind a backslash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, NAMED, NEXT, END = "<|turn ", "|>", "<|and|>", "<|end|>"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _begins(turns: Column) -> Column:
    """Where runs of turns of one role begin."""
    return F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))


def _blocks(turns: Column, begins: Column) -> Column:
    """The runs with their texts gathered; linear in the number of turns, as both arguments are plain columns."""
    return F.transform(begins, lambda b, k: F.struct(
        F.get(turns, b)["role"].alias("role"),
        F.transform(F.slice(turns, b + 1, F.coalesce(F.get(begins, k + 1), F.size(turns)) - b), lambda t: t["text"]).alias("texts")))


def _segments(block: Column, learned: str) -> Column:
    """The block as (text, loss) segments: header, first text, and a separator before every further text."""
    loss = block["role"] == F.lit(learned)
    head = F.concat(F.lit(OPEN), escaped(block["role"]), F.lit(NAMED))
    inner = F.flatten(F.transform(block["texts"], lambda t, i: F.array(
        F.struct(F.when(i == 0, head).otherwise(F.lit(NEXT)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escaped(t).alias("text"), loss.alias("loss")))))
    return F.concat(inner, F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))))


def formatted(turns: DataFrame, learned: str = LEARNED) -> DataFrame:
    """One row per conversation: conv_id, formatted string, segments array<struct<text, loss>>.

    The segments, concatenated, are the formatted text; ``loss`` marks what is trained on. Turns sort by
    (turn, role, text), nulls first, so ties and repeated rows have one order, and repeated rows all stay.
    Null roles and texts count as empty; rows with a null conv_id form one conversation of that id. One
    conversation is one output string, so its turns meet in one row. No rows, no conversations; other columns aren't read.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"),
                 F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    merged = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    runs = merged.select("conv_id", "turns", _begins(F.col("turns")).alias("begins"))
    blocks = runs.select("conv_id", _blocks(F.col("turns"), F.col("begins")).alias("blocks"))
    parts = blocks.select("conv_id", F.flatten(F.transform("blocks", lambda b: _segments(b, learned))).alias("segments"))
    return parts.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted_text: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation, unescaped."""
    pieces = F.split(formatted_text, r"<\|turn ", -1)
    blocks = F.slice(pieces, F.lit(2), F.size(pieces))

    def turns(block: Column) -> Column:
        # Up to the first mark that isn't escaped: a role may hold the mark itself.
        role = F.regexp_extract(block, r"(?s)^((?:[^\\|]++|\\.)*+)\|>", 1)
        body = F.regexp_replace(F.substr(block, F.length(role) + 3), r"<\|end\|>$", "")
        return F.transform(F.split(body, r"<\|and\|>", -1), lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(conversations: DataFrame) -> DataFrame:
    """What ``op4`` reports, read back from formatted conversations."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    read = conversations.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss.alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


#: The extra conversation that every run of the query formats.
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def with_extra(spark: SparkSession, turns: DataFrame) -> DataFrame:
    extra = spark.range(2).select(F.lit(EXTRA_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)


SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
  e AS (SELECT *, replace(replace(text, '\', '\\'), '|', '\|') AS te, replace(replace(role, '\', '\\'), '|', '\|') AS re,
        coalesce(lag(role) OVER w = role, false) AS same FROM t
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(te) + CASE WHEN same THEN 7 ELSE 7 + length(re) + 2 + 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

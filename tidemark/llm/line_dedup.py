"""Line dedup by a log-template tree, in column expressions.

A line's path is its token count and its leading tokens; tokens with a digit or an at sign are variable fields from
the start. At the leaf a line has the template of all its tokens and, if it is long enough, five more in which
one fifth of its tokens is a variable field too. A line whose template stands in an earlier document is dropped.
The SQL of ``op8`` is bound to this rule. In the pipeline, lines that are too variable for a template are keyed by
their exact tokens. Templates are hashes, so only numbers are shuffled to find the first document of each; a hot template leaves
every map task as one row, and the join back is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import replaced

BLANK = r"\x20\x09-\x0D"
#: Tokens that aren't variable, at least, for a line to have a template, and the share of all its tokens.
CONSTANT_TOKENS, CONSTANT_SHARE = 3, 0.5
#: Tokens of a line, at least, to have templates with a variable part, and the parts.
PART_TOKENS, PARTS = 10, 5
LEADING = 2
#: Bytes, at least, of a line of one or two tokens to be keyed by them: ten letters of a script without blanks.
LONG = 30
FIELD = "<*>"


def _once(value: Column) -> Column:
    """The value by way of a generator: it is computed once per row, however often later columns name it."""
    return F.explode(F.array(value))


def _path(tokens: Column) -> Column:
    """A line's token count, leading tokens and the hash of each of its parts; token i belongs to part floor(i * PARTS / n)."""
    n = F.size(tokens)
    begin = [F.ceil(F.lit(p) * n / PARTS).cast("int") for p in range(PARTS + 1)]
    parts = [F.xxhash64(F.slice(tokens, begin[p] + 1, begin[p + 1] - begin[p])).alias(f"h{p}") for p in range(PARTS)]
    return F.struct(n.alias("n"), *(F.get(tokens, i).alias(f"t{i}") for i in range(LEADING)), *parts)


def _templates(line: Column) -> Column:
    """array<struct<k1, k2>>: hashes of the line's templates, from its path."""
    path = [line["n"], *(line[f"t{i}"] for i in range(LEADING))]

    def key(variable: int) -> Column:
        seen = [*path, F.lit(variable), *(line[f"h{p}"] for p in range(PARTS) if p != variable)]
        return F.struct(F.xxhash64(*seen).alias("k1"), F.hash(*seen).alias("k2"))

    return F.when(line["n"] >= PART_TOKENS, F.array(*(key(p) for p in range(-1, PARTS)))).otherwise(F.array(key(-1)))


def _exact(line: Column) -> Column:
    """array<struct<k1, k2>>: the hashes of a line's tokens as they are."""
    seen = [F.lit("exact"), F.split(_trimmed(line), rf"[{BLANK}]+", -1)]
    return F.array(F.struct(F.xxhash64(*seen).alias("k1"), F.hash(*seen).alias("k2")))


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def _keyed(docs: DataFrame, id_column: str, text_column: str, exact: bool = False) -> DataFrame:
    """doc_id, tag, pos, k1, k2: every template of every line; ``tag`` tells texts of one id apart.

    With ``exact``, lines without a template that have ``CONSTANT_TOKENS`` tokens or ``LONG`` bytes have one key too.
    """
    text = F.col(text_column).cast("string")
    here = ("doc_id", "tag", "pos")
    lines = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    masked = F.when(F.col("line").rlike("[0-9@]"), F.regexp_replace("line", rf"(?<![^{BLANK}])[^{BLANK}0-9@]*+[0-9@][^{BLANK}]*+", FIELD)).otherwise(F.col("line"))
    tokens = lines.select(*here, "line", _once(F.split(_trimmed(masked), rf"[{BLANK}]+", -1)).alias("tokens"))
    constant = F.size(F.array_remove("tokens", FIELD))
    templated = (F.size("tokens") >= CONSTANT_TOKENS) & (constant >= CONSTANT_TOKENS) & (constant >= F.size("tokens") * CONSTANT_SHARE)
    paths = tokens.where(templated).select(*here, _once(_path(F.col("tokens"))).alias("path"))
    keys = _templates(F.col("path"))
    if exact:
        whole = (F.size("tokens") >= CONSTANT_TOKENS) | (F.octet_length(_trimmed(F.col("line"))) >= LONG)
        useful = tokens.withColumn("templated", templated).where(F.col("templated") | whole)
        paths = useful.select(*here, F.when(~F.col("templated"), F.col("line")).alias("line"), _once(_path(F.col("tokens"))).alias("path"))
        keys = F.when(F.col("line").isNotNull(), _exact(F.col("line"))).otherwise(keys)
    return paths.select(*here, F.explode(keys).alias("k")).select(*here, "k.k1", "k.k2")


def repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", exact: bool = False) -> DataFrame:
    """doc_id, tag, dropped (array of line numbers): lines whose template stands in a document with a smaller id."""
    keyed = _keyed(docs, id_column, text_column, exact).where(F.col("doc_id").isNotNull())
    first = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    return keyed.join(first.drop("last"), ["k1", "k2"]).where("first < doc_id").groupBy("doc_id", "tag").agg(F.collect_set("pos").alias("dropped"))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", exact: bool = False) -> DataFrame:
    """One row per row of ``docs``: row (all its columns), text (what is left), n_lines, n_dropped.

    Lines end at line feeds. Of lines that share a template across documents those of the smallest doc_id stay,
    so one copy of a passage survives; repeats inside that document stay too. Lines with fewer than
    ``CONSTANT_TOKENS`` constant tokens, or with over half of their tokens variable, are never dropped, unless
    ``exact`` is set: then they go if the same tokens stand in an earlier document, but for lines of fewer than
    ``CONSTANT_TOKENS`` tokens and ``LONG`` bytes. Repeated rows are copies of one document and are treated
    alike. Null text stays null with no lines; a row with a null id keeps all its lines and drops no others.
    An empty table gives no rows.
    """
    drops = repeated_lines(docs, id_column, text_column, exact)
    text = F.col("row")[text_column].cast("string")
    packed = docs.select(F.struct("*").alias("row")).select("row", F.col("row")[id_column].cast("long").alias("id"), F.xxhash64(text).alias("own"))
    joined = packed.join(drops, (F.col("id") == drops.doc_id) & (F.col("own") == drops.tag), "left")
    lines = F.split(text, "\n", -1)
    left = F.when(F.col("dropped").isNull(), text).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("dropped", i)), "\n"))
    return joined.select("row", left.alias("text"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
                         F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without repeated lines, verbatim ones too, and with ``n_chars`` to match; rows that lose all their text go."""
    kept = without_repeats(docs, exact=True).where((F.col("n_dropped") == 0) | F.col("text").rlike(rf"[^{BLANK}]")).withColumnRenamed("row", "_row")
    new = {"text": F.when(F.col("n_dropped") > 0, F.col("text")).otherwise(F.col("_row")["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("_row")["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return kept.select(*replaced(docs, new))


def report(docs: DataFrame) -> DataFrame:
    """What ``op8`` reports: doc_id, n_lines, n_dropped, text."""
    return without_repeats(docs).select(F.col("row")["doc_id"].cast("long").alias("doc_id"), "n_lines", "n_dropped", "text")


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
  t AS (SELECT doc_id, pos, line, list_transform(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''),
          lambda x: CASE WHEN regexp_matches(x, '[0-9@]') THEN '<*>' ELSE x END) AS w FROM l),
  c AS (SELECT *, len(w) AS n, len(list_filter(w, lambda x: x <> '<*>')) AS fixed FROM t),
  k AS (SELECT c.*, p.v, CASE WHEN p.v < 0 THEN to_json(w) ELSE to_json([w[1:2], w[1:CAST(ceil(p.v * n / 5) AS BIGINT)], w[CAST(ceil((p.v + 1) * n / 5) AS BIGINT) + 1:]]) END AS k
        FROM c JOIN (SELECT unnest([-1, 0, 1, 2, 3, 4]) AS v) p ON p.v < 0 OR n >= 10 WHERE fixed >= 3 AND fixed >= n * 0.5),
  f AS (SELECT n AS fn, v AS fv, k AS fk, min(doc_id) AS first FROM k GROUP BY ALL),
  d AS (SELECT DISTINCT doc_id, pos FROM k JOIN f ON n = fn AND v = fv AND k = fk WHERE first < doc_id)
SELECT l.doc_id, count(*) AS n_lines, count(d.pos) AS n_dropped,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE d.pos IS NULL), '') AS text
FROM l LEFT JOIN d ON l.doc_id = d.doc_id AND l.pos = d.pos GROUP BY l.doc_id"""

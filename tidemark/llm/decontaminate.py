"""Benchmark decontamination by a prefix-filtered set join, in column expressions.

A window (ten consecutive words of an item) is the set of its placed shingles, and it occurs in a document only if
all of them do. So one shingle is prefix enough: the rarest of the window in this corpus. Documents are scanned once
against all shingles of the benchmark, which gives the shingles' frequencies and all places where a window can be;
places are joined to the windows by their rarest shingle, bounded by its position in the window and by the document's
length, and what is left is compared word by word. Shingles are hashes; only whole words decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import text_or_empty, written

WINDOW, SHINGLE = 10, 5
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, once A to Z are lower-case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Shingles of the benchmark that are broadcast at once, 16 bytes each; more of them take one more scan per block.
KEYS = 1 << 20
#: Windows, at most, that are broadcast to verify places; more of them are joined as Spark sees fit.
WINDOWS = 1 << 17


def words_of(column: str) -> Column:
    """The words of a text; null has none."""
    text = text_or_empty(column)
    # In ASCII, A to Z are all that lower() changes.
    small = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))
    return F.array_remove(F.split(small, BETWEEN, -1), "")


def _key(words: Column, at: Column, size: int) -> Column:
    """The hash of ``size`` words from ``at`` on."""
    return F.xxhash64(F.lit(size), *(F.get(words, at + i) for i in range(size)))


def windows(items: DataFrame, id_column: str, text_column: str, window: int) -> DataFrame:
    """item, words: the windows of every item; an item of fewer words is one window, one without words none."""
    own = items.select(F.col(id_column).cast("string").alias("item"), words_of(text_column).alias("all"))
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("all") - window, F.lit(0))))
    return own.where(F.size("all") > 0).select("item", "all", starts.alias("at")).select("item", F.slice("all", F.col("at") + 1, window).alias("words"))


def shingles(distinct: DataFrame, size: int) -> DataFrame:
    """words, offset, key: every shingle of every window; a window shorter than a shingle is one."""
    n = F.size("words")
    placed = distinct.select("words", F.explode(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))).alias("offset"))
    key = F.lit(None)
    for s in range(size, 0, -1):
        here = _key(F.col("words"), F.col("offset"), s)
        key = F.when(n >= size, here) if s == size else key.when(n == s, here)
    return placed.select("words", "offset", key.alias("key"))


def _places(docs: DataFrame, keys: DataFrame, sizes: list[int], window: int) -> DataFrame:
    """A row for each place of a document where a shingle of ``keys`` stands, with the words around it, and one row
    without a place for each row of ``docs``; one scan, in which word arrays are passed on, not copied."""
    pos, n = F.col("pos"), F.col("n_words")
    # Place n_words holds no word: this row stays whatever the join finds.
    rows = docs.select("doc_id", "digest", "words", F.size("words").alias("n_words")).select("*", F.explode(F.sequence(F.lit(0), n)).alias("pos"))
    hashed = F.array(*[F.when(pos + s <= n, _key(F.col("words"), pos, s)) for s in sizes] or [F.lit(None).cast("bigint")])
    rows = rows.select("*", F.posexplode(hashed).alias("which", "key"))
    joined = rows.join(F.broadcast(keys.select(F.col("key").alias("known"))), F.col("key") == F.col("known"), "left")
    first = F.greatest(pos - window + 1, F.lit(0))
    around = F.when(F.col("known").isNotNull(), F.slice("words", first + 1, 2 * window - 1))
    whole = (pos == n) & (F.col("which") == 0)
    return joined.where(F.col("known").isNotNull() | whole).select(
        "doc_id", "digest", "n_words", "pos", "known", first.alias("first"), around.alias("around"))


def _left(rows: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """A left join in which null keys meet."""
    named = more.select(*(F.col(k).alias(f"_{k}") for k in keys), *(c for c in more.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(named, on, "left").drop(*(f"_{k}" for k in keys))


def _hit_words(found: DataFrame, doc: list[str]) -> DataFrame:
    """How many words of each document lie in a window: the union of its stretches."""
    ends = found.groupBy(*doc, "start").agg((F.col("start") + F.max("size")).alias("end"))
    before = F.max("end").over(W.partitionBy(*doc).orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    new = F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0)))
    return ends.select(*doc, F.greatest(new, F.lit(0)).alias("new")).groupBy(*doc).agg(F.sum("new").alias("n_hit"))


def _items(found: DataFrame, owners: DataFrame, doc: list[str]) -> DataFrame:
    """The items of each document: a window is counted once per document, before its items are looked up."""
    pairs = found.select(*doc, "words").distinct().join(owners, "words").select(*doc, "item").distinct()
    return pairs.groupBy(*doc).agg(F.sort_array(F.collect_list("item")).alias("items"))


def contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_id_column: str = "item_id",
                 item_text_column: str = "text", window: int = WINDOW, shingle: int = SHINGLE, keys_at_once: int = KEYS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items (sorted ids), contaminated.

    Words are compared with A to Z in lower case. A window is ``window`` consecutive words of an item, or the whole
    of a shorter item; a document's word is hit if it lies in any occurrence of a window. Null, empty and blank
    texts have no words, so documents have no hits by them and items no windows. An item that repeats, or repeats
    another's words, counts by its id once; an item without an id marks words but isn't counted. Rows that repeat
    an id, or have none, each get their own result. Other columns aren't read. An empty table of documents gives no
    rows; against an empty benchmark no document is hit. A text of any length is one row while it is scanned.
    """
    owned = windows(items, item_id_column, item_text_column, window).distinct()
    placed = written(shingles(owned.select("words").distinct(), shingle))
    keys = placed.groupBy("key").agg(F.min(F.least(F.size("words"), F.lit(shingle))).alias("size"))
    sizes = {r["size"]: r["n"] for r in keys.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = max(1, -(-sum(sizes.values()) // keys_at_once))

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.md5(text_or_empty(text_column)).alias("digest"), words_of(text_column).alias("words"))
    parts = [_places(rows, keys.where(F.pmod("key", F.lit(blocks)) == b), sorted(sizes), window) for b in range(blocks)]
    seen = parts[0]
    for part in parts[1:]:
        seen = seen.unionByName(part.where(F.col("known").isNotNull()))
    seen = written(seen)

    doc = ["doc_id", "digest"]
    hits = seen.where(F.col("known").isNotNull())
    frequency = hits.groupBy(F.col("known").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    # Windows with a shingle that no document holds can't occur.
    prefix = (placed.join(frequency, "key", "left").groupBy("words")
              .agg(F.min_by(F.struct("key", "offset"), F.struct(F.coalesce("n", F.lit(0)), "key", "offset")).alias("rarest"), F.min(F.coalesce("n", F.lit(0))).alias("least"))
              .where(F.col("least") > 0).select("words", F.size("words").alias("size"), "rarest.*"))
    prefix = written(prefix)
    if prefix.count() <= WINDOWS:
        prefix = F.broadcast(prefix)
    start = F.col("pos") - F.col("offset")
    places = hits.join(prefix, F.col("known") == F.col("key")).where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
    found = places.where(F.slice("around", start - F.col("first") + 1, F.col("size")) == F.col("words")).select(*doc, start.alias("start"), "size", "words").distinct()
    found = written(found)
    marked, listed = _hit_words(found, doc), _items(found, owned.where(F.col("item").isNotNull()), doc)
    whole = seen.where(F.col("known").isNull()).select(*doc, "n_words")
    return _left(_left(whole, marked, doc), listed, doc).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.greatest(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def digests(result: DataFrame) -> DataFrame:
    """The result with the digest of the item ids, comma-joined, in place of the ids."""
    return result.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


# Windows of up to ten words: one of ten from each place, or the whole of a shorter item.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item, w, unnest(range(0, greatest(len(w) - 9, 1))) AS pos FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item, w[pos + 1:pos + 10] AS win FROM i),
s AS (SELECT DISTINCT len(win) AS k FROM v),
p AS (SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS pos FROM d, s WHERE len(w) >= k),
o AS (SELECT DISTINCT r, pos, k, item FROM (SELECT r, pos, k, w[pos + 1:pos + k] AS win FROM p) JOIN v USING (win)),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(pos, pos + k)) AS x FROM (SELECT DISTINCT r, pos, k FROM o)) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)"""

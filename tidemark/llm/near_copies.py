"""Near copies by SimHash fingerprints, made exact by a join of shingle sets: every pair of texts at the similarity or above is linked.

Fingerprints of the shingles (``simhash``) within ``RADIUS`` bits name the first pairs, found over tiles; a pair links if its whole
sets are similar enough. Similar sets may have fingerprints farther apart, and no radius is sure, so a join of the sets finds what
fingerprints leave. Shingles have one order there, rare ones first. Two sets that are similar enough share one among the first of each
(the prefix), so only prefixes are dealt out by shingle. Neighbours in a shingle's list are compared along with the pairs by
fingerprint; then all its pairs that aren't linked yet by way of others. Pairs are compared by their whole sets, but for those whose
parities already differ in more bits than similar sets differ in shingles. Any order gives the same pairs; that of a sketch of bounded size, counted on a sample, keeps frequent shingles out of the prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import components, simhash
from tidemark.llm.common import clean, prepare, slices

#: Words of a shingle, and the least similarity (shared shingles over all shingles of both) as a fraction.
WORDS, SIMILAR, OF = 5, 4, 5
#: Bits in which fingerprints of a pair may differ; pairs farther apart are left to the join of sets.
RADIUS = 3
#: Counters of the sketch, as bits, and the share of texts it is counted on; they order shingles and decide nothing.
COUNTERS, COUNTED = 22, 8
#: Sets a task remembers, so that a text that is copied again and again is dealt out once per task.
HELD = 1 << 16
#: Longs of a set's parities: bit k is the parity of its shingles whose hash ends in k.
PARITIES = 16
#: A counted table of so many rows (a few numbers each) is sent to all tasks; a larger one is joined by a shuffle.
FEW = 1_000_000
_LEVEL = 58
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def shingle_hashes(texts: pa.LargeStringArray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles, repeats included, and where each text's begin (with the end); shorter texts are one shingle."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    split = pc.ascii_split_whitespace(trimmed)
    offsets = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    word = np.concatenate([known[coded.indices.to_numpy()], np.zeros(words, np.uint64)])
    count = np.where(pc.binary_length(trimmed).to_numpy(zero_copy_only=False) > 0, np.diff(offsets), 0)
    shingles = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    ends = np.cumsum(shingles)
    at = np.arange(int(shingles.sum())) + np.repeat(offsets[:-1] - (ends - shingles), shingles)
    length = np.repeat(np.minimum(count, words), shingles)
    out = length.astype(np.uint64)
    for k in range(words):
        out += np.where(k < length, word[at + k], 0).astype(np.uint64) * _ODD[k]
    out = (out ^ (out >> np.uint64(31))) * _ODD[0]
    return out ^ (out >> np.uint64(29)), np.append(0, ends)


def _sets(texts: pa.LargeStringArray, levels: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingles, in their order: the sketch's level, then the hash."""
    hashes, starts = shingle_hashes(texts)
    level = levels[(hashes >> np.uint64(64 - COUNTERS)).astype(np.int64)].astype(np.uint64)
    ids = ((level << np.uint64(_LEVEL)) | (hashes & np.uint64((1 << _LEVEL) - 1))).view(np.int64)
    return [np.unique(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def _name(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63)


def _parities(own: np.ndarray) -> np.ndarray:
    odd = np.bincount(own & (64 * PARITIES - 1), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _array(lists: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in lists])), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))


def _levels(texts: DataFrame) -> np.ndarray:
    """A level below 32 for each counter of the sketch, by the counter's share of shingles in a sample of the texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, 0)):
            hashes, _ = shingle_hashes(clean(part.column(0)))
            at, n = np.unique((hashes >> np.uint64(64 - COUNTERS)).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["counter", "n"])

    sample = texts.where(F.pmod("tag", F.lit(COUNTED)) == 0).select("text").mapInArrow(count, "counter int, n bigint")
    # 2^COUNTERS rows of five bytes at most; what was met once is as good as new.
    level = F.least(F.floor(F.log2(F.sum("n") + 1)), F.lit(31)).cast("tinyint")
    counted = sample.groupBy("counter").agg(F.sum("n").alias("n"), level.alias("level")).where(F.col("n") > 1).select("counter", "level").toArrow()
    levels = np.zeros(1 << COUNTERS, np.uint8)
    levels[counted["counter"].to_numpy()] = counted["level"].to_numpy()
    return levels


def _similar(shared: Column, a: Column, b: Column) -> Column:
    """Whether sets of sizes a and b that share so many are similar enough."""
    return shared * (OF + SIMILAR) >= (a + b) * SIMILAR


def _may_be(a: str, b: str) -> Column:
    """Whether two sets can be similar enough, by their sizes and by what is left of each from the shared shingle on."""
    return _similar(F.least(F.col(f"{a}size") - F.col(f"{a}pos"), F.col(f"{b}size") - F.col(f"{b}pos")), F.col(f"{a}size"), F.col(f"{b}size"))


def _pair(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def by_fingerprint(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different sets (``node``) whose fingerprints (``fp``) are equal or connected within ``RADIUS`` bits.

    One set stands for those of equal fingerprints; each of the others is paired with it.
    """
    nodes = rows.groupBy("node").agg(F.min("fp").alias("fp")).checkpoint()
    heads = nodes.groupBy("fp").agg(F.min("node").alias("head")).checkpoint()
    same = nodes.join(heads, "fp").where("node <> head").select(*_pair("node", "head"))
    near = simhash.links(heads.select("fp"), RADIUS)
    for k in "ab":
        near = near.join(heads.select(F.col("fp").alias(k), F.col("head").alias(f"{k}_head")), k)
    return same.unionByName(near.select(*_pair("a_head", "b_head")))


def _sent(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= FEW else table


def _verified(pairs: DataFrame, rows: DataFrame, texts: DataFrame, levels) -> DataFrame:
    """The pairs (a, b) of sets that are similar enough, by all their shingles."""
    pairs = pairs.checkpoint()
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().checkpoint()
    known = rows.select("node", "tag", "size", "parities").join(_sent(nodes), "node", "left_semi").groupBy("node").agg(
        F.min("tag").alias("tag"), F.min("size").alias("size"), F.min("parities").alias("parities")).checkpoint()
    a, b = (known.select(F.col("node").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("tag", "size", "parities"))) for k in "ab")
    differ = F.aggregate(F.zip_with("a_parities", "b_parities", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    size = F.col("a_size") + F.col("b_size")
    pairs = pairs.join(a, "a").join(b, "b").where(_similar((size - differ) / 2, F.col("a_size"), F.col("b_size"))).select("a", "b", "a_tag", "b_tag").checkpoint()
    tags = pairs.select(F.explode(F.array("a_tag", "b_tag")).alias("tag")).distinct().checkpoint()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in slices(batch, 0)):
            own = _sets(clean(part.column(0)), levels.value)
            yield pa.RecordBatch.from_arrays([pa.array([_name(x) for x in own], pa.int64()), _array(own)], ["node", "own"])

    sets = texts.join(_sent(tags), "tag", "left_semi").select("text").mapInArrow(whole, "node bigint, own array<bigint>").dropDuplicates(["node"]).checkpoint()
    both = (pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b"))
    return both.where(_similar(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b").checkpoint()


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, tag (hash of the text), component_id.

    Texts link if their sets of ``WORDS``-word shingles have a Jaccard similarity of ``SIMILAR / OF`` or more;
    component_id is the smallest doc_id reachable over such links. Words are lower-cased ASCII-wise and end at ASCII
    blanks. Texts without words, null ones included, are equal to each other only. A component of null ids only has
    a null component_id. Repeated rows each give a row; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    text = F.col(text_column).cast("string")
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    levels = spark.sparkContext.broadcast(_levels(texts))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[int] = set()
        for part in (x for batch in batches for x in slices(batch, 2)):
            own = _sets(clean(part.column(2)), levels.value)
            names = [_name(x) for x in own]
            first = []
            for name, x in zip(names, own):
                first.append(x[:0] if name in held else x[:len(x) + 1 + (-SIMILAR * len(x)) // OF] if len(x) else x)
                if len(held) < HELD:
                    held.add(name)
            fps = simhash.fingerprints_of(clean(part.column(2)), WORDS).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.int64()), pa.array(fps), pa.array([len(x) for x in own], pa.int32()),
                                              _array(first), _array([_parities(x) for x in own])],
                                             ["doc_id", "tag", "node", "fp", "size", "prefix", "parities"])

    rows = texts.mapInArrow(prefixes, "doc_id bigint, tag bigint, node bigint, fp bigint, size int, prefix array<bigint>, parities array<bigint>").checkpoint()
    listed = rows.select("node", "size", F.posexplode("prefix").alias("pos", "shingle"))
    order = Window.partitionBy("shingle").orderBy("size", "node")
    here = F.struct("node", "size", "pos")
    listed = listed.select("*", F.lag(here).over(order).alias("p"), F.lead("node").over(order).alias("next"))
    shared = listed.where((F.col("p.node") != F.col("node")) | (F.col("next") != F.col("node"))).select(
        "shingle", "node", "size", "pos", F.col("p.node").alias("p_node"), F.col("p.size").alias("p_size"), F.col("p.pos").alias("p_pos")).checkpoint()
    beside = shared.where((F.col("p_node") != F.col("node")) & _may_be("", "p_")).select(*_pair("node", "p_node"))
    links = _verified(by_fingerprint(rows).unionByName(beside).distinct(), rows, texts, levels)
    linked = components.roots(links)
    own = shared.select("shingle", "node", "size", "pos").distinct().join(linked, "node", "left").select("shingle", "node", "size", "pos", F.coalesce("root", "node").alias("part"))
    own = own.checkpoint()
    x, y = (own.select("shingle", *(F.col(c).alias(f"{k}{c}") for c in ("node", "size", "pos", "part"))) for k in "xy")
    others = x.join(y, "shingle").where((F.col("xnode") < F.col("ynode")) & (F.col("xpart") != F.col("ypart")) & _may_be("x", "y"))
    others = others.select(F.col("xnode").alias("a"), F.col("ynode").alias("b")).distinct().join(links, ["a", "b"], "left_anti")
    roots = components.roots(links.unionByName(_verified(others, rows, texts, levels)))
    low = rows.groupBy("node").agg(F.min("doc_id").alias("low")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = low.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.select("doc_id", "tag", "node").join(low.join(lowest, "root").select("node", "component_id"), "node").select("doc_id", "tag", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id names its component; rows with a null id stay only if the whole component has none."""
    gone = near_copies(docs).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "tag").distinct().checkpoint()
    packed = docs.select(F.struct("*").alias("_row"))
    own = (F.col("_row")["doc_id"].cast("long").eqNullSafe(gone.doc_id)) & (F.xxhash64(F.col("_row")["text"].cast("string")) == gone.tag)
    return packed.join(_sent(gone), own, "left_anti").select("_row.*")

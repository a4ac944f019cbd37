"""SimHash near-duplicates by exact comparison of fingerprint tiles.

A tile holds distinct fingerprints whose four 16-bit quarters have the same population counts. Two fingerprints
within the radius have counts that differ by the radius at most, summed over the quarters, so all other pairs
of tiles are skipped. The rest are compared whole with numpy exclusive-or and bit counts. A tile pair
returns a spanning forest of its links, which keeps components and is never larger than the tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import components
from tidemark.llm.common import clean, flat, prepare

SEED = 42
#: Fingerprints of one block of a tile, about; bounds a comparison and an array in a row.
BLOCK = 4096
#: Shingles whose bits are counted at once, and rows of a tile compared at once; bound a worker's memory.
COUNTED, STRIP = 1 << 17, 256
QUARTERS, STEP = 4, 17


def shingle_spans(texts: pa.LargeStringArray, words: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words joined by one blank, as one buffer; where each shingle begins and ends there; shingles per text."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    data, offsets = flat(pc.binary_join(pc.ascii_split_whitespace(trimmed), pa.scalar(" ", pa.large_string())))
    blanks = np.flatnonzero(data == 0x20)
    full = np.diff(offsets) > 0
    begins = np.sort(np.concatenate([offsets[:-1][full], blanks + 1]))
    ends = np.sort(np.concatenate([offsets[1:][full], blanks]))
    count = np.where(full, np.diff(np.searchsorted(blanks, offsets)) + 1, 0)
    shingles = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    first = np.cumsum(count) - count
    at = np.arange(int(shingles.sum())) - np.repeat(np.cumsum(shingles) - shingles, shingles) + np.repeat(first, shingles)
    last = np.minimum(at + words - 1, np.repeat(first + count - 1, shingles))
    return data.tobytes(), begins[at], ends[last], shingles


def fingerprints_of(texts: pa.LargeStringArray, words: int) -> np.ndarray:
    """The fingerprint of each text: bits that over half of its shingles' hashes have; 0 without words."""
    buffer, begins, ends, shingles = shingle_spans(texts, words)
    ones = np.zeros((len(texts), 64), np.int64)
    stops = np.cumsum(shingles)
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(begins), COUNTED):
        b = min(a + COUNTED, len(begins))
        hashes = np.fromiter((digest(buffer[s:e], SEED) for s, e in zip(begins[a:b].tolist(), ends[a:b].tolist())), np.uint64, b - a)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        low, high = np.searchsorted(stops, [a, b - 1], "right")
        own = np.arange(low, high + 1)
        own = own[shingles[own] > 0]
        ones[own] += np.add.reduceat(bits, np.maximum(stops[own] - shingles[own] - a, 0), axis=0, dtype=np.int64)
    return np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, words: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fp (bigint) of every row; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints_of(clean(batch.column(1)), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fp bigint")


# --- tiles -----------------------------------------------------------------------------------------

def _tile(fp: Column) -> Column:
    """The four population counts as one number; there are 17^4 = 83,521 at most."""
    counts = [F.bit_count(F.shiftrightunsigned(fp, 16 * q).bitwiseAND(0xFFFF)) * STEP**q for q in range(QUARTERS)]
    return sum(counts[1:], counts[0]).cast("int")


def _near_tiles(tile: Column, radius: int) -> Column:
    """Tiles whose counts differ by ``radius`` at most in sum; of each pair of tiles one names the other."""
    moves = [m for m in product(range(-radius, radius + 1), repeat=QUARTERS) if sum(map(abs, m)) <= radius and m >= (0,) * QUARTERS]
    digits = [F.pmod(F.floor(tile / STEP**q), F.lit(STEP)) for q in range(QUARTERS)]
    near = [F.when(F.lit(True) if not any(m) else _inside(digits, m), tile + sum(d * STEP**q for q, d in enumerate(m))) for m in moves]
    return F.array_compact(F.array(*near))


def _inside(digits: list[Column], move: tuple[int, ...]) -> Column:
    tests = [(d + m).between(0, STEP - 1) for d, m in zip(digits, move) if m]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _lowest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of labels[a] and labels[b]; labels point to the lowest member."""
    while True:
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def forest(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links within ``radius`` connect, between two blocks or inside one.

    Inside one block only ``left`` is read: the two sides of a join may have gathered it in different orders.
    """
    right = left if same else right
    every = left if same else np.concatenate([left, right])
    labels = np.arange(len(every))
    shift = 0 if same else len(left)
    for a in range(0, len(left), STRIP):
        i, j = np.nonzero(np.bitwise_count(left[a:a + STRIP, None] ^ right[None, a if same else 0:]) <= radius)
        i, j = i + a, j + (a if same else 0)
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            _lowest(labels, i, j + shift)
    moved = np.flatnonzero(labels != np.arange(len(every)))
    return every[moved], every[labels[moved]]


def links(vertices: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that keep the components of all links within ``radius``."""
    tiled = vertices.select("fp", _tile(F.col("fp")).alias("tile"))
    # One row per tile, 83,521 at most whatever the input: this broadcast has a proven bound.
    parts = F.broadcast(tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts")))
    blocks = (tiled.join(parts, "tile").withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
              .groupBy("tile", "part").agg(F.sort_array(F.collect_list("fp")).alias("fps")))
    left = blocks.select(F.col("tile").alias("own"), F.col("part").alias("own_part"), F.col("fps").alias("a"),
                         F.explode(_near_tiles(F.col("tile"), radius)).alias("tile"))
    right = blocks.select("tile", "part", F.col("fps").alias("b"))
    pairs = left.join(right, "tile").where("own <> tile or own_part <= part")
    pairs = pairs.select("a", "b", ((F.col("own") == F.col("tile")) & (F.col("own_part") == F.col("part"))).alias("same"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, a_at), (b, b_at) = map(_lists, (batch.column(0), batch.column(1)))
            found = [forest(a[a_at[k]:a_at[k + 1]], b[b_at[k]:b_at[k + 1]], same, radius) for k, same in enumerate(batch.column(2).to_pylist())]
            x, y = (np.concatenate([f[k] for f in found]).view(np.int64) if found else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return pairs.mapInArrow(compare, "a bigint, b bigint")


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy().view(np.uint64), offsets


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``radius`` or fewer differing bits; component_id is the smallest doc_id reachable. Texts
    without words, null ones included, have fingerprint 0, which links like any other. Repeated rows and null ids
    each give a row; a component of null ids only has a null component_id. Other columns aren't read; an empty
    table gives no rows. Equal fingerprints meet once, so groups of copies cost one comparison.
    """
    prepare(docs.sparkSession)
    rows = fingerprints(docs, words, id_column, text_column).checkpoint()
    vertices = rows.groupBy("fp").agg(F.min("doc_id").alias("low")).checkpoint()
    roots = components.roots(links(vertices, radius))
    rooted = vertices.join(roots, vertices.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = rooted.join(lowest, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, whose doc_id names its component; rows with a null id stay only if the whole component has none."""
    found = near_duplicates(docs, words, radius)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct()
    packed = docs.select(F.struct("*").alias("_row"))
    return packed.join(keep, F.col("_row")["doc_id"].cast("long").eqNullSafe(F.col("_kept")), "left_semi").select("_row.*")

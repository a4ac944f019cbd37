"""Alignment of two tokenizers' ids by interval coalescing, and how often each pair of ids is linked in the corpus.

All tokens of both tokenizers lie on one line of bytes. Sorted by start, a group ends where a start reaches the
largest end so far (``maximum.accumulate``); inside a group every A token is expanded to the B tokens it overlaps.
Texts are encoded and aligned once. Their distinct pairs are written, counted by Spark, and looked up again: frequent
pairs in a memory-mapped table of bounded size, all others by a join.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import clean, flat, gather, prepare, publish, strings, written
from tidemark.llm.packing import ByteTokenizer

#: Bytes of text that are aligned at once; longer texts are cut where both tokenizers must cut.
SEGMENT = 1 << 20
#: Units remembered by a worker.
HELD_UNITS = 1 << 18
#: Pairs, at most, that are looked up in a worker's memory; levels of frequency per factor of two.
FREQUENT, LEVELS = 1 << 18, 16
BLANK = 0x20
SPACE_MARK = "▁"
TABLE = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


class PieceTokenizer:
    """SentencePiece ids of whole batches of texts that begin with a blank, distinct units encoded once.

    A unit is a run of blanks and what follows up to the next blank. No piece of the model has a blank after another
    character, so no merge crosses units.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(SPACE_MARK in x.lstrip(SPACE_MARK) for x in names):
            raise ValueError("a piece of the model spans two words")
        self.bytes = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace(SPACE_MARK, " ").encode() for i, x in enumerate(names)]
        self.known: dict[bytes, list[int] | None] = {}

    def units(self, found: list[bytes]) -> list[list[int] | None]:
        """The ids of each unit; none if they don't spell it."""
        if len(self.known) > HELD_UNITS:
            self.known.clear()
        new = [u for u in found if u not in self.known]
        # The library adds the blank that a unit begins with.
        for unit, ids in zip(new, self.model.encode([u[1:].decode() for u in new], num_threads=1) if new else ()):
            if unit == b" ":
                ids = [self.model.piece_to_id(SPACE_MARK)]  # of an empty text it gives nothing
            self.known[unit] = ids if b"".join(map(self.bytes.__getitem__, ids)) == unit else None
        return [self.known[u] for u in found]

    def encode(self, texts: pa.LargeStringArray) -> Iterator[np.ndarray | None]:
        data, offsets = flat(texts)
        begins = np.zeros(len(data) + 1, bool)
        begins[:-1] = data == BLANK
        begins[1:-1] &= data[:-1] != BLANK
        begins[offsets] = True
        starts = np.flatnonzero(begins)
        coded = strings(data, starts).cast(pa.large_binary()).dictionary_encode()
        own = self.units(coded.dictionary.to_pylist())
        wrong = np.fromiter((x is None for x in own), bool, len(own))
        size = np.fromiter((len(x or ()) for x in own), np.int64, len(own))
        values, codes = np.fromiter((i for x in own for i in x or ()), np.int64), coded.indices.to_numpy()
        n = size[codes]
        every, first = gather(values, (np.cumsum(size) - size)[codes], n), np.searchsorted(starts, offsets)
        ends, faults = np.append(0, np.cumsum(n))[first], np.append(0, np.cumsum(wrong[codes]))[first]
        for a, b, bad in zip(ends[:-1], ends[1:], np.diff(faults)):
            yield None if bad else every[a:b]


class _Flat:
    """Texts of ids as one table of bytes."""

    def __init__(self, texts: list[bytes]):
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(texts), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.data, self.start[ids], self.size[ids])


class Aligner:
    """Both tokenizers, and the alignment of texts that both spell."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokenizer(path_a), PieceTokenizer(path_b)
        self.a.special = {}  # their strings inside texts are plain text
        with open(path_a, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        byte = {letter: b for b, letter in tokens.byte_letters().items()}
        spelled = [b""] * (max(vocabulary.values()) + 1)
        for name, i in vocabulary.items():
            spelled[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else b""
        self.bytes_a, self.bytes_b = _Flat(spelled), _Flat(self.b.bytes)
        self.width = len(self.b.bytes)
        self.digits = _Flat([b"%d " % i for i in range(max(len(spelled), self.width))])

    def both(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """A's and B's ids of each text (with its leading blank); none where the bytes of either aren't the text's."""
        column = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        out = []
        for text, a, b in zip(texts, self.a.encode(column), self.b.encode(column)):
            out.append((a, b) if b is not None and self.bytes_a.of(a).tobytes() == text else None)
        return out


def groups(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group number of every A and B token: all tokens by start, cut where a start reaches the largest end so far."""
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    kind = np.repeat([0, 1], [len(start_a), len(start_b)])
    order = np.lexsort((kind, start))
    reach = np.maximum.accumulate(end[order])
    number = np.empty(len(order), np.int64)
    number[order] = np.append(0, np.cumsum(start[order][1:] >= reach[:-1])) if len(order) else 0
    return number[:len(start_a)], number[len(start_a):]


def overlaps(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (A token, B token) that share a byte, by number; tokens of a kind follow one another without gaps."""
    low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    n = high - low
    left = np.repeat(np.arange(len(start_a)), n)
    return left, np.arange(len(left)) - np.repeat(np.cumsum(n) - n - low, n)


class _Sums:
    """What the segments of one text add up to."""

    def __init__(self):
        self.counts, self.digest, self.keys, self.times, self.right = np.zeros(4, np.int64), hashlib.sha256(), [], [], True

    def row(self) -> tuple:
        n_a, n_b, n_groups, n_links = self.counts.tolist()
        if not self.right or not n_a:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, times = self.keys[0], self.times[0]
        if len(self.keys) > 1:
            keys, place = np.unique(np.concatenate(self.keys), return_inverse=True)
            times = np.bincount(place, np.concatenate(self.times)).astype(np.int64)
        return n_a, n_b, n_groups, n_links, self.digest.hexdigest(), keys, times


def align(aligner: Aligner, parts: list[tuple[_Sums, bytes]]) -> None:
    """Align segments and add each to its text's sums."""
    both = aligner.both([t for _, t in parts])
    for (own, _), ids in zip(parts, both):
        own.right &= ids is not None
    kept = [(own, *ids) for (own, _), ids in zip(parts, both) if ids is not None]
    if not kept:
        return
    n_a, n_b = (np.array([len(x[k]) for x in kept]) for k in (1, 2))
    a, b = (np.concatenate([x[k] for x in kept]) for k in (1, 2))
    end_a, end_b = np.cumsum(aligner.bytes_a.size[a]), np.cumsum(aligner.bytes_b.size[b])
    start_a, start_b = end_a - aligner.bytes_a.size[a], end_b - aligner.bytes_b.size[b]
    group_a, group_b = groups(start_a, end_a, start_b, end_b)
    left, right = overlaps(start_a, end_a, start_b, end_b)

    # The ids as text, group by group, A's before B's: where each goes, and the mark after it.
    per_a, per_b = np.bincount(group_a), np.bincount(group_b)
    until_a, until_b = np.cumsum(per_a), np.cumsum(per_b)
    place = np.concatenate([np.arange(len(a)) + (until_b - per_b)[group_a], np.arange(len(b)) + until_a[group_b]])
    ids, mark = np.empty(len(place), np.int64), np.full(len(place), ord(","), np.uint8)
    ids[place] = np.concatenate([a, b])
    mark[until_a + until_b - per_b - 1], mark[until_a + until_b - 1] = ord("|"), ord(";")
    text = aligner.digits.of(ids)
    ends = np.cumsum(aligner.digits.size[ids])
    text[ends - 1] = mark

    row_a = np.repeat(np.arange(len(kept)), n_a)
    span = len(aligner.bytes_a.size) * aligner.width
    keys, times = np.unique(row_a[left] * span + a[left] * aligner.width + b[right], return_counts=True)
    cut = np.searchsorted(keys, np.arange(len(kept) + 1) * span)
    first = np.append(0, np.cumsum(n_a + n_b))
    last_group = group_a[np.cumsum(n_a) - 1]
    n_groups, n_links = np.diff(last_group, prepend=-1), np.bincount(row_a[left], minlength=len(kept))
    whole = text.tobytes()
    for i, (own, _, _) in enumerate(kept):
        begin, end = (0 if first[i] == 0 else ends[first[i] - 1]), ends[first[i + 1] - 1]
        if own.counts[0]:
            own.digest.update(b";")
        own.digest.update(whole[begin:end - 1])
        own.counts += (n_a[i], n_b[i], n_groups[i], n_links[i])
        own.keys.append(keys[cut[i]:cut[i + 1]] - i * span)
        own.times.append(times[cut[i]:cut[i + 1]])


def segments(text: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, cut before blanks that follow a printable ASCII character."""
    at = 0
    while len(text) - at > size:
        cut = text.find(b" ", at + size)
        while cut >= 0 and not 0x21 <= text[cut - 1] <= 0x7E:
            cut = text.find(b" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]), kind))


def aligned(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text", segment: int = SEGMENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct linked pairs
    (A id * size of B's vocabulary + B id, ascending) with how often each is linked (``times``).

    ``groups_sha256`` is the digest of the ids as text, groups divided by ``;``, A's ids from B's by ``|``. Texts that
    are null or empty, or that either tokenizer doesn't spell, have no tokens: zeros, no pairs and an empty digest.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            sums, parts, held = [_Sums() for _ in range(batch.num_rows)], [], 0
            for own, text in zip(sums, clean(batch.column(1)).cast(pa.large_binary()).to_pylist()):
                for part in segments(b" " + text, segment) if text else ():
                    parts.append((own, part))
                    held += len(part)
                    if held >= segment:
                        align(both, parts)
                        parts, held = [], 0
            align(both, parts)
            made = list(zip(*(own.row() for own in sums))) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in made[:4]), pa.array(made[4], pa.string()), _lists(made[5], pa.int64()), _lists(made[6], pa.int32())],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, TABLE)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """pair, n, best: in how many documents each pair is linked, and whether no pair of its A id is in more.

    Counts are combined on the map side, so a pair that stands in every document costs no more than another.
    """
    counted = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("a", F.floor(F.col("pair") / width).cast("int"))
    counted = written(counted)
    most = counted.groupBy("a").agg(F.max("n").alias("most"))  # at most one row per id of A's vocabulary
    return counted.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _frequent_from(counts: DataFrame, size: int) -> tuple[int, bool]:
    """The least count of pairs to look up in memory, ``size`` pairs at most, whole levels of frequency at a time, and
    whether that is all of them. The driver gets a row per level, under 64 * ``LEVELS``."""
    level = F.floor(F.log2("n") * LEVELS).cast("int")
    held = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("pairs"), F.min("n").alias("least")).collect()
    total, lowest = 0, 1 << 62
    for r in sorted(held, key=lambda r: -r.level):
        total += r.pairs
        if total > size:
            return lowest, False
        lowest = r.least
    return lowest, True


@lru_cache(maxsize=2)
def _table(name: str) -> np.ndarray:
    return np.load(SparkFiles.get(name), mmap_mode="r")


def looked_up(rows: DataFrame, counts: DataFrame, size: int = FREQUENT) -> DataFrame:
    """``rows`` (of ``aligned``) with n_best and count_sum, the sums over links by the counts of their pairs."""
    spark = rows.sparkSession
    least, all_of_them = _frequent_from(counts, size)
    chosen = counts.where(F.col("n") >= least).toArrow()
    keys = chosen["pair"].to_numpy()
    order = np.argsort(keys)
    file = io.BytesIO()
    np.save(file, np.stack([keys, chosen["n"].to_numpy(), chosen["best"].to_numpy().astype(np.int64)])[:, order])
    name = publish(spark, file.getvalue(), ".npy")
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = _table(name)
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            starts = pairs.offsets.to_numpy().astype(np.int64)
            keys, weight = pairs.values.to_numpy()[starts[0]:starts[-1]], times.values.to_numpy()[starts[0]:starts[-1]].astype(np.int64)
            starts -= starts[0]
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            weights = [np.where(hit, v[at] * weight, 0) if len(known) else np.zeros(len(keys), np.int64) for v in (n, best)]
            sums = [np.diff(np.append(0, np.cumsum(v))[starts]) for v in weights]
            rest = np.append(0, np.cumsum(~hit))[starts].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(rest), pa.array(v[~hit])) for v in (keys, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", *own)] + [pa.array(s, pa.int64()) for s in sums] + lists,
                                             ["row", *own, "count_sum", "n_best", "pairs", "times"])

    schema = "row bigint, " + TABLE.split(", pairs")[0] + ", count_sum bigint, n_best bigint, pairs array<bigint>, times array<bigint>"
    part = rows.mapInArrow(run, schema)
    if all_of_them:
        return part.select(*own, "n_best", "count_sum")
    part = written(part)
    rest = part.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rare = counts.where(F.col("n") < least)
    added = rest.join(rare, "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    sums = [(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more"))]
    return part.join(added, "row", "left").select(*own, *sums)


def linked(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text", size: int = FREQUENT,
           segment: int = SEGMENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A's tokens are those of the text with a blank before it, B's those of the text; both as plain text without special
    tokens. A pair's count is the number of rows that hold it linked. ``n_best`` counts links whose pair has the highest
    count of its A id, ties included; ``count_sum`` adds the counts up over links. Null, empty and unspelled texts have
    zeros and an empty digest. Repeated rows and null ids each give a row and count each; other columns aren't read.
    An empty table gives no rows. Texts longer than ``segment`` bytes are aligned in parts, with the same result.
    """
    rows = written(aligned(docs, path_a, path_b, id_column, text_column, segment).withColumn("row", F.monotonically_increasing_id()))
    width = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    counts = written(pair_counts(rows, width))
    return looked_up(rows, counts, size)

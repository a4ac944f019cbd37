"""Packing documents into token sequences by an order-preserving dynamic programme.

Documents keep the order in which the table is scanned; each scan partition is packed on its own, so nothing is
shuffled. Window cuts lie at document or sentence ends, or inside a sentence longer than a window. The programme
minimises padding plus penalties for cut documents and sentences; its transition over all windows up to the
full length is the minimum of a sliding window, kept in a monotone queue. Lengths that are powers of two need
no padding and are a few more transitions, at a small price that keeps windows from getting short.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import clean, flat, gather, prepare, slices, strings

WINDOW = 1024
#: What a window end costs, in tokens of padding: at a sentence end inside a document, and inside a sentence.
SENTENCE_CUT, TOKEN_CUT = 2, 48
#: The shortest window that is ended for being a power of two, and what that costs.
SHORTEST, SHORT_WINDOW = 64, 4
#: Tokens that are planned at once; bounds the memory of a task.
SEGMENT = 1 << 17
#: Packed with each document's own end mark.
END_ID = 0


class ByteTokenizer:
    """Byte-level BPE ids of whole batches: pieces are split in numpy, distinct ones merged once a batch.

    No piece is remembered beyond its batch: merging it again takes no longer than looking it up among many.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        byte = {letter: b for b, letter in tokens.byte_letters().items()}
        ranks = {bytes(byte[c] for c in token): i for token, i in stored["model"]["vocab"].items() if all(c in byte for c in token)}
        self.special = {x["content"]: x["id"] for x in stored["added_tokens"]}
        ranks = {t: i for t, i in ranks.items() if i not in set(self.special.values())}
        self.core = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens=self.special)
        self.sentence_end = np.zeros(max([*ranks.values(), *self.special.values()]) + 1, bool)
        self.sentence_end[[i for t, i in ranks.items() if t.rstrip()[-1:] in (b".", b"!", b"?") or b"\n" in t]] = True

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        texts = clean(column)
        plain = texts.to_pylist() if self.special else None
        marked = [i for i, t in enumerate(plain or ()) if any(m in t for m in self.special)]
        if marked:
            keep = np.ones(len(texts), bool)
            keep[marked] = False
            rest = self._encode(texts.filter(pa.array(keep)))
            for i, text in enumerate(plain):
                yield next(rest) if keep[i] else self._with_marks(text)
        else:
            yield from self._encode(texts)

    def _with_marks(self, text: str) -> np.ndarray:
        parts, at = [], 0
        while True:
            found = min(((text.find(m, at), -len(m), m) for m in self.special if text.find(m, at) >= 0), default=None)
            if found is None:
                break
            parts += [*self._encode(pa.array([text[at:found[0]]], pa.large_string())), np.array([self.special[found[2]]])]
            at = found[0] + len(found[2])
        return np.concatenate([*parts, *self._encode(pa.array([text[at:]], pa.large_string()))])

    def _encode(self, texts: pa.LargeStringArray) -> Iterator[np.ndarray]:
        data, offsets = flat(texts)
        starts, _, first = tokens.split(data, offsets, keep_blank=True)
        coded = strings(data, starts).cast(pa.large_binary()).dictionary_encode()
        own = [self.core._encode_single_piece(p) for p in coded.dictionary.to_pylist()]
        size = np.fromiter(map(len, own), np.int64, len(own))
        values, codes = np.fromiter((i for x in own for i in x), np.int64), coded.indices.to_numpy()
        n = size[codes]
        every = gather(values, (np.cumsum(size) - size)[codes], n)
        ends = np.append(0, np.cumsum(n))[first]
        for a, b in zip(ends[:-1], ends[1:]):
            yield every[a:b]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def window_ends(cuts: np.ndarray, cost: np.ndarray, window: int = WINDOW) -> list[int]:
    """The cheapest window ends among ``cuts`` (ascending, from 0 to the last token, no gap over ``window``).

    best[j] = cost[j] + min over i of best[i] + padding(cuts[j] - cuts[i]), or the short window's price.
    """
    at, price = cuts.tolist(), cost.tolist()
    place = {c: i for i, c in enumerate(at)}
    powers = [1 << k for k in range(window.bit_length()) if SHORTEST <= 1 << k < window]
    best, back = [0.0], [0]
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (best[i] + cuts[i], i), ascending in both
    for j in range(1, len(at)):
        c = at[j]
        while at[queue[0][1]] < c - window:
            queue.popleft()
        least, via = queue[0][0] + window - c, queue[0][1]
        for p in powers:
            i = place.get(c - p)
            if i is not None and best[i] + SHORT_WINDOW < least:
                least, via = best[i] + SHORT_WINDOW, i
        best.append(least + price[j])
        back.append(via)
        key = best[j] + c
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    ends, j = [], len(at) - 1
    while j:
        ends.append(at[j])
        j = back[j]
    return ends[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end in a stretch of tokens, and what it costs; long sentences get cuts a window apart."""
    n, cost = len(ids), {}
    ends = np.flatnonzero(sentence_end[ids]) + 1
    cuts = np.unique(np.concatenate([[0], ends, doc_ends, [n]]))
    wide = np.flatnonzero(np.diff(cuts) > window)
    inner = [np.arange(cuts[i] + window, cuts[i + 1], window) for i in wide]
    forced = np.concatenate(inner) if inner else np.zeros(0, np.int64)
    every = np.union1d(cuts, forced).astype(np.int64)
    cost = np.full(len(every), float(SENTENCE_CUT))
    cost[np.isin(every, forced)] = TOKEN_CUT
    cost[np.isin(every, doc_ends)] = 0
    cost[0] = cost[-1] = 0
    return every, cost


class _Packer:
    """Packs a stream of documents; holds the documents of one segment."""

    def __init__(self, sentence_end: np.ndarray, window: int, base: int):
        self.sentence_end, self.window, self.next = sentence_end, window, base
        self.docs: list[tuple] = []  # (doc_id, first token here, ids from there, all tokens of the document)
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, 0, ids, len(ids)))
        self.size += len(ids)
        if self.size >= SEGMENT:
            yield from self.plan(last=False)

    def plan(self, last: bool) -> Iterator[tuple]:
        """Pieces of all windows; but for the last stretch, the open window stays for what follows."""
        if not self.size:
            return
        ids = np.concatenate([d[2] for d in self.docs])
        ends = np.cumsum([len(d[2]) for d in self.docs])
        windows = window_ends(*candidates(ids, ends, self.sentence_end, self.window), self.window)
        if not last:
            windows = windows[:-1]
        first, left = 0, 0
        done = 0
        for end in windows:
            offset = 0
            while first < end:
                doc_id, start, own, total = self.docs[done]
                stop = min(end, int(ends[done]))
                begins = int(ends[done]) - len(own)
                n = stop - first
                yield doc_id, start + first - begins, n, own[first - begins:stop - begins], total, self.next, offset
                offset += n
                first = stop
                if stop == ends[done]:
                    done += 1
            self.next += 1
            left = end
        rest = []
        for (doc_id, start, own, total), end in zip(self.docs[done:], ends[done:]):
            skip = max(0, left - (int(end) - len(own)))
            rest.append((doc_id, start + skip, own[skip:], total))
        self.docs, self.size = rest, sum(len(d[2]) for d in rest)


SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def packed(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's tokens are its text's ids and then id 0; null text counts as empty, so it is that id alone. Rows
    are packed in the order they are read, each exactly once: repeated rows and null ids are documents of their own.
    sequence_id is the partition's number times 2^33 plus the sequence's number there. A very long text is cut
    into windows like any other. Other columns aren't read; an empty table gives no rows.
    """
    prepare(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        packer = _Packer(coder.sentence_end, window, TaskContext.get().partitionId() << 33)

        def out(pieces: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*pieces)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            values = [x if k != 3 else [i.astype("<u4").tobytes() for i in x] for k, x in enumerate(c)]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)],
                                              ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for part in slices(batch, 1):
                pieces = []
                for doc_id, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1))):
                    pieces += packer.add(doc_id, np.append(ids, END_ID))
                yield out(pieces)
        yield out(list(packer.plan(last=True)))

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(pack, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """What ``op9`` reports of packed pieces."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The frequent words of the corpus are counted with Spark over all documents. The driver compiles the most
frequent ones (a documented bound) into an automaton with shared suffixes whose arcs carry numbers; the sum
along a word's path is its place in a table of ids. Executors fetch the file and memory-map it, so all
workers of a host share its pages. Words outside the lexicon are merged exactly, so results don't depend on it.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.common import clean, flat, gather, prepare, publish, strings

#: Words in the lexicon, at most; bounds the driver's work and the file.
LEXICON_WORDS = 1 << 17
#: Levels of frequency in an octave, of which the lexicon takes whole ones.
LEVELS = 16
#: Distinct words that a worker counts or remembers before it lets go of them; bounds its memory.
HELD_WORDS = 1 << 19


class Vocabulary:
    """A byte-level BPE vocabulary with word ends, as the tokenizers library stores it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model, self.ids = stored["model"], stored["model"]["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in stored["added_tokens"]}
        self.names = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.merges = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        letters = tokens.byte_letters()
        self.inner = [self.ids[letters[b]] for b in range(256)]
        self.last = [self.ids[letters[b] + self.end] for b in range(256)]

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: again and again the leftmost pair of lowest rank becomes one symbol."""
        symbols = [self.inner[b] for b in word[:-1]] + [self.last[word[-1]]]
        return self._merge_long(symbols) if len(symbols) > 48 else self._merge_short(symbols)

    def _merge_short(self, symbols: list[int]) -> list[int]:
        merges, none = self.merges, (1 << 30, 0)
        found = [merges.get(p, none) for p in zip(symbols, symbols[1:])]
        while found:
            best = min(found)
            if best is none or best[0] == none[0]:
                break
            i = found.index(best)
            symbols[i:i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = merges.get((symbols[i - 1], symbols[i]), none)
            if i < len(found):
                found[i] = merges.get((symbols[i], symbols[i + 1]), none)
        return symbols

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same with a heap and links: n log n for very long words."""
        n, merges = len(symbols), self.merges
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(merges[p][0], i, *p) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges]
        heapify(heap)
        while heap:
            _, i, a, b = heappop(heap)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = merges[a, b][1], -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] < n and (pair := (symbols[k], symbols[right[k]])) in merges:
                    heappush(heap, (merges[pair][0], k, *pair))
        return [s for s in symbols if s >= 0]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _lowered(text: str) -> str:
    # Lower case letter by letter, as the library does; only the capital sigma would depend on its neighbours.
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class _Batch:
    """The distinct words of a batch of texts, and the texts as sequences of them; special strings stand apart."""

    def __init__(self, column: pa.Array, special: dict[str, int]):
        texts, self.cut = clean(column), None
        found = np.zeros(len(texts), bool)
        for mark in special:
            found |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        if found.any():
            at = regex.compile("(" + "|".join(map(regex.escape, special)) + ")")
            parts = [at.split(t) if f else [t] for t, f in zip(texts.to_pylist(), found)]
            self.cut = [[special[p] for p in x[1::2]] for x in parts]
            self.rows = np.cumsum([0, *((len(x) + 1) // 2 for x in parts)])
            segments = [_lowered(p) for x in parts for p in x[::2]]
        else:
            segments = [_lowered(t) for t in texts.to_pylist()]
        data, offsets = flat(pa.array(segments, pa.large_string()))
        starts, kind, first = tokens.split(data, offsets, keep_blank=False)
        coded = strings(data, starts).dictionary_encode()
        word = kind != tokens.SPACE
        codes, self.first = coded.indices.to_numpy()[word], np.append(0, np.cumsum(word))[first]
        used, self.codes, self.counts = np.unique(codes, return_inverse=True, return_counts=True)
        self.words = coded.dictionary.take(pa.array(used))

    def ids(self, values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
        """Per text, the ids of its words; ``values`` holds those of each distinct word."""
        n = lengths[self.codes]
        every, ends = gather(values, starts[self.codes], n), np.append(0, np.cumsum(n))[self.first]
        segments = [every[a:b] for a, b in zip(ends[:-1], ends[1:])]
        if self.cut is None:
            yield from segments
            return
        for i, marks in enumerate(self.cut):
            own = segments[self.rows[i]:self.rows[i + 1]]
            parts = [x for s, m in zip(own, marks) for x in (s, np.array([m], values.dtype))]
            yield np.concatenate([*parts, own[-1]])


def word_counts(docs: DataFrame, path: str, text_column: str = "text") -> DataFrame:
    """word, n: how often each word occurs in all documents; counted in the workers first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special, held = vocabulary(path).special, {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            own = _Batch(batch.column(0), special)
            for w, n in zip(own.words.to_pylist(), own.counts.tolist()):
                held[w] = held.get(w, 0) + n
            if len(held) > HELD_WORDS:
                yield out()
                held.clear()
        yield out()

    counted = docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


# --- the transducer --------------------------------------------------------------------------------

def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The minimal automaton of sorted distinct words, with numbered paths and the ids they lead to, as one file."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []  # (final, ((byte, target), ...)) of states that can't change any more

    def settle(final: bool, arcs: list) -> int:
        key = (final, tuple(arcs))
        at = register.get(key)
        if at is None:
            at = register[key] = len(states)
            states.append(key)
        return at

    path: list[list] = [[False, []]]  # the last word's states, still open
    before = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            path[-1][1].append((before[len(path) - 1], settle(final, arcs)))

    for word in words:
        shared = 0
        while shared < min(len(before), len(word)) and before[shared] == word[shared]:
            shared += 1
        close(shared)
        path.extend([False, []] for _ in word[shared:])
        path[-1][0], before = True, word
    close(0)
    root = settle(path[0][0], path[0][1])

    paths = [0] * len(states)  # words below a state; targets come before their sources
    keys, targets, sums = [], [], []
    for s, (final, arcs) in enumerate(states):
        total = int(final)
        for byte, target in arcs:
            keys.append(s << 8 | byte)
            targets.append(target)
            sums.append(total)
            total += paths[target]
        paths[s] = total
    arrays = {
        "keys": np.array(keys, np.int64), "targets": np.array(targets, np.int64), "sums": np.array(sums, np.int64),
        "final": np.array([f for f, _ in states], np.int64), "ids": np.array([i for x in ids for i in x], np.int64),
        "starts": np.cumsum([0, *map(len, ids)]).astype(np.int64), "root": np.array([root], np.int64),
    }
    head = json.dumps({k: len(v) for k, v in arrays.items()}).encode().ljust(512)
    return head + b"".join(v.tobytes() for v in arrays.values())


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, path: str):
        stored = np.memmap(path, np.uint8, "r")
        at = 512
        for name, n in json.loads(bytes(stored[:512])).items():
            setattr(self, name, stored[at:at + 8 * n].view(np.int64))
            at += 8 * n

    def find(self, words: pa.LargeStringArray) -> np.ndarray:
        """The place of each word, or -1; all words take one arc at a time together."""
        data, offsets = flat(words)
        length = np.diff(offsets)
        state, place = np.full(len(words), self.root[0]), np.zeros(len(words), np.int64)
        active, step = np.flatnonzero(length > 0), 0
        found = np.full(len(words), -1)
        while len(active) and len(self.keys):
            key = state[active] << 8 | data[offsets[active] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            active, at = active[hit], at[hit]
            state[active] = self.targets[at]
            place[active] += self.sums[at]
            step += 1
            done = length[active] == step
            ends = active[done]
            ends = ends[self.final[state[ends]] == 1]
            found[ends] = place[ends]
            active = active[~done]
        return found


def frequent_words(counted: DataFrame, size: int) -> list[str]:
    """The most frequent words, whole levels of frequency at a time, ``size`` at most.

    The driver gets one row per level, under 64 * ``LEVELS`` whatever the corpus, and then only the chosen words.
    Words of a level that doesn't fit whole are left to exact merging.
    """
    level = F.floor(F.log2("n") * LEVELS).cast("int")
    held = counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()
    total, lowest = 0, None
    for r in sorted(held, key=lambda r: -r.level):
        total += r.words
        if total > size:
            break
        lowest = r.level
    return [] if lowest is None else [r.word for r in counted.where(level >= lowest).select("word").collect()]


def publish_lexicon(spark: SparkSession, docs: DataFrame, path: str, text_column: str = "text", size: int = LEXICON_WORDS) -> str:
    """Count, choose and compile the frequent words; the file's name for ``SparkFiles.get``."""
    words = sorted(word.encode() for word in frequent_words(word_counts(docs, path, text_column).checkpoint(), size))
    return publish(spark, compile_lexicon(words, [vocabulary(path).merge(w) for w in words]), ".lexicon")


@lru_cache(maxsize=4)
def _lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


class Encoder:
    """Encodes batches: words by the lexicon, the others by exact merging, remembered within a bound."""

    def __init__(self, path: str, lexicon: Lexicon):
        self.vocabulary, self.lexicon, self.known = vocabulary(path), lexicon, {}

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        batch = _Batch(column, self.vocabulary.special)
        place = self.lexicon.find(batch.words)
        missing = np.flatnonzero(place < 0)
        if len(self.known) > HELD_WORDS:
            self.known.clear()
        own = []
        for w in batch.words.take(pa.array(missing)).to_pylist():
            ids = self.known.get(w)
            if ids is None:
                ids = self.known[w] = self.vocabulary.merge(w.encode())
            own.append(ids)
        base = len(self.lexicon.ids)
        lengths = np.diff(self.lexicon.starts)[place] if len(self.lexicon.starts) > 1 else np.zeros(len(place), np.int64)
        starts = self.lexicon.starts[place]
        lengths[missing] = np.fromiter(map(len, own), np.int64, len(own))
        starts[missing] = base + np.append(0, np.cumsum(lengths[missing]))[:-1]
        values = np.concatenate([self.lexicon.ids, np.fromiter((i for x in own for i in x), np.int64)])
        return batch.ids(values, starts, lengths)


def decode(ids: np.ndarray, names: dict[int, str]) -> str:
    """The text of ids: this vocabulary has no decoder, so tokens are joined by blanks, special ones included."""
    return " ".join(map(names.__getitem__, ids.tolist()))


def encoded(spark: SparkSession, docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text",
            size: int = LEXICON_WORDS, with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` ids (binary,
    little-endian unsigned 32-bit) and decoded.

    ids are those of the tokenizers library without added special tokens, truncation or padding; strings of special
    tokens inside a text give their ids. Null text counts as empty: no ids, the digest of nothing. Repeated rows
    and null ids each give a row; other columns aren't read. An empty table gives no rows.
    """
    prepare(spark)
    name = publish_lexicon(spark, docs, path, text_column, size)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, names = Encoder(path, _lexicon(name)), vocabulary(path).names
        for batch in batches:
            counts, digests, decoded_digests, raw, texts = [], [], [], [], []
            for ids in encoder.encode(batch.column(1)):
                stored, text = ids.astype("<u4").tobytes(), decode(ids, names)
                counts.append(len(ids))
                digests.append(hashlib.sha256(stored).hexdigest())
                decoded_digests.append(hashlib.sha256(text.encode()).hexdigest())
                if with_ids:
                    raw.append(stored)
                    texts.append(text)
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded_digests, pa.string())]
            more = [pa.array(raw, pa.binary()), pa.array(texts, pa.string())] if with_ids else []
            yield pa.RecordBatch.from_arrays(arrays + more, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][:4 + len(more)])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(encode, schema)

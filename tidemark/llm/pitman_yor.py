"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants: one per fine class of the word before, whose parents are restaurants of coarse classes, whose parent is
the root, whose base is uniform over the training vocabulary and one unseen word. Classes are functions of a word's
last letters, so there are ``FINE`` and ``COARSE`` of them whatever the corpus: their totals go to all workers.

Words are dealt to buckets by hash. All counts of a word are in its bucket, so seating is sampled there, top
to bottom, by Gibbs sweeps: the tables of a dish are drawn from their exact conditional given the level above
without its own customers. Totals of restaurants are summed over all buckets between passes. Words with more than
1/``HOT`` of all tokens, ``HOT`` at most, are scored where the text is read; other tokens travel to their bucket
as packed arrays and come back as sums per document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import clean, flat, prepare

COARSE, WITHIN = 64, 64
#: Restaurants of each level, with one for the start of a text.
FINE, START = COARSE * WITHIN + 1, COARSE * WITHIN
LEVELS = (1, COARSE + 1, FINE)
#: Discounts and strengths, root first.
DISCOUNT, STRENGTH = (0.8, 0.7, 0.6), (10.0, 5.0, 2.0)
#: Customers of a dish up to which tables are drawn exactly; further customers are seated in order, in blocks.
EXACT = 512
PASSES, BURN_IN, SAMPLES = 2, 2, 4
HOT = 1024
#: Characters of text for one bucket of words, about, and tokens that are counted at once.
BUCKET_CHARS, COUNTED = 1 << 25, 1 << 22
END = np.uint64(xxhash.xxh64_intdigest(b" end"))  # no word holds a blank


# --- tokens ----------------------------------------------------------------------------------------

def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash and fine class of the word before, for every token of a batch, and the tokens of each text."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(clean(column)))
    lists = pc.ascii_split_whitespace(texts)
    full = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    words = lists.filter(pa.array(full)).flatten().dictionary_encode()
    data, offsets = flat(words.dictionary)
    raw = data.tobytes()
    hashes = np.fromiter((xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())), np.uint64, len(offsets) - 1)
    last = [data[np.maximum(offsets[1:] - k, offsets[:-1])].astype(np.int64) if len(data) else np.zeros(0, np.int64) for k in (1, 2, 3)]
    classes = last[0] % COARSE * WITHIN + (last[0] + 7 * last[1] + 31 * last[2]) % WITHIN
    count = np.where(full, np.diff(lists.offsets.to_numpy()), 0)
    codes = words.indices.to_numpy(zero_copy_only=False)
    size = count + 1
    ends = np.cumsum(size)
    word, context = np.full(int(ends[-1]) if len(ends) else 0, END), np.full(int(ends[-1]) if len(ends) else 0, START, np.int64)
    at = np.arange(len(codes)) + np.repeat(np.arange(len(count)), count)
    word[at] = hashes[codes]
    context[at + 1] = classes[codes]  # every word has a token after it, the next word or the end
    return word, context, size


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one payload: their lengths, then their bytes."""
    return np.array([len(a) for a in arrays.values()], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays.values())


def _unpack(payload: bytes, **kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(payload, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for n, kind in zip(sizes, kinds.values()):
        out.append(np.frombuffer(payload, kind, n, at))
        at += out[-1].nbytes
    return out


_COUNTS = {"word": np.uint64, "entries": np.uint32, "context": np.uint16, "n": np.uint32}


def _grouped(word: np.ndarray, context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of ``n`` by (word, context): distinct words, entries of each, contexts, sums; in order."""
    words, code = np.unique(word, return_inverse=True)
    keys, back = np.unique(code << 13 | context, return_inverse=True)
    total = np.bincount(back, n, len(keys)).astype(np.uint32)
    return words, np.bincount(keys >> 13, minlength=len(words)).astype(np.uint32), (keys & 8191).astype(np.uint16), total


def _by_bucket(words, entries, context, n, buckets: int) -> Iterator[tuple[int, bytes]]:
    own = (words % np.uint64(buckets)).astype(np.int64)
    each = np.repeat(own, entries)
    for b in np.unique(own):
        w, e = own == b, each == b
        yield int(b), _pack(word=words[w], entries=entries[w], context=context[e], n=n[e])


def counted(docs: DataFrame, learn_from: Column, buckets: int) -> DataFrame:
    """bucket, counts: of all training texts, how often each word follows each fine class; one row per bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out():
            word, context = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            held.clear()
            rows = list(_by_bucket(*_grouped(word, context, np.ones(len(word))), buckets))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "counts"])

        size = 0
        for batch in batches:
            word, context, _ = tokens_of(batch.column(0))
            held.append((word, context))
            size += len(word)
            if size > COUNTED:
                yield out()
                size = 0
        if held:
            yield out()

    def merge(table: pa.Table) -> pa.Table:
        parts = [_unpack(p, **_COUNTS) for p in table.column("counts").to_pylist()]
        word = np.concatenate([np.repeat(w, e) for w, e, _, _ in parts])
        context, n = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
        merged = _grouped(word, context.astype(np.int64), n)
        return pa.table({"bucket": table.column("bucket")[:1], "counts": pa.array([_pack(**dict(zip(_COUNTS, merged)))], pa.binary())})

    texts = docs.where(learn_from).select("text")
    return texts.mapInArrow(count, "bucket int, counts binary").groupBy("bucket").applyInArrow(merge, "bucket int, counts binary")


# --- seating ---------------------------------------------------------------------------------------

@lru_cache(maxsize=3)
def _ways(discount: float) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: the weight of seating c customers of one dish at t tables."""
    table = np.full((EXACT + 1, EXACT + 1), -np.inf)
    table[1, 1] = 0
    t = np.arange(EXACT + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(2, EXACT + 1):
            stay = table[c - 1] + np.log(np.maximum(c - 1 - discount * t, 0))
            table[c, 1:] = np.logaddexp(stay[1:], table[c - 1, :-1])
    return table


def draw_tables(customers: np.ndarray, weight: np.ndarray, discount: float, r: np.random.Generator) -> np.ndarray:
    """Tables of each dish: t with a probability in proportion to ways(c, t) * weight^t."""
    out = np.minimum(customers, 1).astype(np.int64)
    order = np.argsort(customers, kind="stable")
    bounded = np.minimum(customers[order], EXACT)
    values, first = np.unique(bounded, return_index=True)
    log_weight = np.log(np.maximum(weight, 1e-300))
    for c, rows in zip(values.tolist(), np.split(order, first[1:])):
        if c < 2:
            continue
        step = max(1, (1 << 20) // c)
        for a in range(0, len(rows), step):
            own = rows[a:a + step]
            odds = _ways(discount)[c, 1:c + 1] + np.arange(1, c + 1) * log_weight[own][:, None]
            odds = np.exp(odds - odds.max(1, keepdims=True)).cumsum(1)
            out[own] = 1 + (odds < r.random(len(own))[:, None] * odds[:, -1:]).sum(1)
    more = np.flatnonzero(customers > EXACT)
    seated = np.full(len(more), EXACT, np.int64)
    while len(more):
        block = np.minimum(np.maximum(seated // 16, 1), customers[more] - seated)
        opens = weight[more] / (weight[more] + seated - discount * out[more])
        out[more] += r.binomial(block, np.clip(opens, 0, 1))
        seated = seated + block
        left = seated < customers[more]
        more, seated = more[left], seated[left]
    return out


class Totals:
    """Customers and tables of every restaurant, by level, and the size of the training text."""

    def __init__(self, customers: list[np.ndarray], tables: list[np.ndarray], tokens: int, vocabulary: int):
        self.tokens, self.vocabulary, self.base = tokens, vocabulary, 1.0 / (vocabulary + 1)
        self.new = [s + d * t for s, d, t in zip(STRENGTH, DISCOUNT, tables)]  # the weight of a new table
        self.all = [s + c for s, c in zip(STRENGTH, customers)]
        self.back = [n / a for n, a in zip(self.new, self.all)]  # the share that is left to the level above
        self.unseen = self.back[0][0] * self.base


class Seating:
    """The seating of the words of a bucket at all levels; rows of a level are sorted by word and restaurant."""

    def __init__(self, payload: bytes, seed: int):
        self.words, entries, fine, n = _unpack(payload, **_COUNTS)
        self.word = np.repeat(np.arange(len(self.words)), entries)
        self.fine, self.n = fine.astype(np.int64), n.astype(np.int64)
        key = self.word * (COARSE + 1) + self.fine // WITHIN
        keys, self.up = np.unique(key, return_inverse=True)
        self.coarse_word, self.coarse = keys // (COARSE + 1), keys % (COARSE + 1)
        self.count = np.bincount(self.word, self.n, len(self.words)).astype(np.int64)
        self.r = np.random.default_rng(seed)
        self.t2 = np.ones(len(self.n), np.int64)
        self._gather()
        self.t1 = np.ones(len(keys), np.int64)
        self.c0 = np.bincount(self.coarse_word, self.t1, len(self.words)).astype(np.int64)
        self.t0 = np.ones(len(self.words), np.int64)

    def _gather(self) -> None:
        self.c1 = np.bincount(self.up, self.t2, len(self.coarse)).astype(np.int64)

    def first_totals(self, buckets: int, tokens: int, vocabulary: int) -> Totals:
        """Before any pass: this bucket's own, as many times as there are buckets."""
        return Totals(*zip(*(((c * float(buckets)), (t * float(buckets))) for c, t in self.sums())), tokens, vocabulary)

    def sums(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Customers and tables per restaurant here, root first."""
        return [(np.array([self.c0.sum()], float), np.array([self.t0.sum()], float)),
                tuple(np.bincount(self.coarse, x, LEVELS[1]) for x in (self.c1, self.t1)),
                tuple(np.bincount(self.fine, x, LEVELS[2]) for x in (self.n, self.t2))]

    def _root(self, g: Totals, without=0, at=slice(None)) -> np.ndarray:
        c = self.c0[at] - without
        t = np.minimum(self.t0[at], c)
        return (np.maximum(c - DISCOUNT[0] * t, 0) + g.new[0][0] * g.base) / g.all[0][0]

    def _middle(self, g: Totals, root: np.ndarray, without=0, at=slice(None)) -> np.ndarray:
        c = self.c1[at] - without
        t = np.minimum(self.t1[at], c)
        own = self.coarse[at]
        return (np.maximum(c - DISCOUNT[1] * t, 0) + g.new[1][own] * root) / g.all[1][own]

    def sweep(self, g: Totals) -> None:
        root = self._root(g)
        above = self._middle(g, root[self.coarse_word[self.up]], self.t2, self.up)
        self.t2 = draw_tables(self.n, g.new[2][self.fine] * above, DISCOUNT[2], self.r)
        self._gather()
        above = self._root(g, self.t1, self.coarse_word)
        self.t1 = draw_tables(self.c1, g.new[1][self.coarse] * above, DISCOUNT[1], self.r)
        self.c0 = np.bincount(self.coarse_word, self.t1, len(self.words)).astype(np.int64)
        self.t0 = draw_tables(self.c0, np.full(len(self.words), g.new[0][0] * g.base), DISCOUNT[0], self.r)

    def averaged(self, g: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predictive probabilities by level, averaged over samples: root by word, middle and fine by row."""
        for _ in range(BURN_IN):
            self.sweep(g)
        sums = [0, 0, 0]
        for _ in range(SAMPLES):
            self.sweep(g)
            root = self._root(g)
            middle = self._middle(g, root[self.coarse_word])
            fine = (self.n - DISCOUNT[2] * self.t2 + g.new[2][self.fine] * middle[self.up]) / g.all[2][self.fine]
            sums = [s + p / SAMPLES for s, p in zip(sums, (root, middle, fine))]
        return tuple(sums)

    def probability(self, g: Totals, averages, code: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Of words (by place, -1 if unseen) after contexts: from the finest level that knows them, backed off from there."""
        root, middle, fine = averages
        coarse = context // WITHIN
        out = np.where(code >= 0, root[code] if len(root) else 0, g.unseen) * g.back[1][coarse]
        for values, keys, wanted in ((middle, self.coarse_word * 8192 + self.coarse, code * 8192 + coarse), (None, None, None), (fine, self.word * 8192 + self.fine, code * 8192 + context)):
            if values is None:
                out = out * g.back[2][context]
                continue
            if not len(keys):
                continue
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted
            out[hit] = values[at[hit]]
        return out


def restaurants(counts: DataFrame, before: Totals | None, buckets: int, tokens: int, vocabulary: int) -> Totals:
    """One pass of sweeps over all buckets, given the totals before; sums over all buckets come to the driver, ``sum(LEVELS)`` rows."""
    sent = counts.sparkSession.sparkContext.broadcast(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = Seating(payload, bucket)
                given = sent.value or own.first_totals(buckets, tokens, vocabulary)
                for _ in range(BURN_IN):
                    own.sweep(given)
                for level, (c, t) in enumerate(own.sums()):
                    at = np.flatnonzero(c)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), level), pa.int32()), pa.array(at, pa.int32()), pa.array(c[at]), pa.array(t[at])],
                                                     ["level", "restaurant", "c", "t"])

    rows = counts.mapInArrow(run, "level int, restaurant int, c double, t double").groupBy("level", "restaurant").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).collect()
    customers, tables = ([np.zeros(n) for n in LEVELS] for _ in range(2))
    for r in rows:
        customers[r.level][r.restaurant], tables[r.level][r.restaurant] = r.c, r.t
    return Totals(customers, tables, tokens, vocabulary)


def _size(counts: DataFrame) -> tuple[int, int]:
    """Tokens and distinct tokens of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_unpack(p, **_COUNTS) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([int(p[3].sum(dtype=np.int64)) for p in parts], pa.int64()), pa.array([len(p[0]) for p in parts], pa.int64())], ["n", "v"])

    row = counts.mapInArrow(run, "n bigint, v bigint").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    return row.n or 0, row.v or 0


def _hot_words(counts: DataFrame, g: Totals) -> dict[int, tuple[int, np.ndarray]]:
    """Count and probability after every context of the words with more than 1/HOT of the training tokens: HOT words at most."""
    sent = counts.sparkSession.sparkContext.broadcast(g)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = np.arange(FINE)
        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, entries, context, n = _unpack(payload, **_COUNTS)
                total = np.add.reduceat(n.astype(np.int64), np.cumsum(entries.astype(np.int64)) - entries) if len(words) else np.zeros(0)
                hot = total * HOT > sent.value.tokens
                if not hot.any():
                    continue
                each = np.repeat(hot, entries)
                own = Seating(_pack(word=words[hot], entries=entries[hot], context=context[each], n=n[each]), bucket)
                averages = own.averaged(sent.value)
                rows = [own.probability(sent.value, averages, np.full(FINE, i), every).tobytes() for i in range(len(own.words))]
                yield pa.RecordBatch.from_arrays([pa.array(own.words.view(np.int64)), pa.array(own.count), pa.array(rows, pa.binary())], ["word", "n", "p"])

    rows = counts.mapInArrow(run, "word bigint, n bigint, p binary").collect()
    return {r.word & (2**64 - 1): (r.n, np.frombuffer(r.p)) for r in rows}


# --- scoring ---------------------------------------------------------------------------------------

_TOKENS = {"word": np.uint64, "entries": np.uint32, "context": np.uint16, "doc": np.uint16}
_PARTS = {"doc": np.uint16, "known": np.uint32, "score": np.float32, "base": np.float64}
_DOCS = {"doc": np.int64, "valid": np.bool_, "held": np.bool_, "tokens": np.int64, **{k: _PARTS[k] for k in ("known",)}, "score": np.float64, "base": np.float64}


def _logs(count: np.ndarray, g: Totals) -> np.ndarray:
    return np.log10((count + 0.1) / (g.tokens + 0.1 * (g.vocabulary + 1)))


def scored(docs: DataFrame, learn_from: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A text's tokens are its words, lower case in A-Z, and one end. ``score`` is the model's log10 probability of the
    tokens, ``base_score`` that of smoothed counts; the perplexity is 10^(-score / n_tokens). Null text counts as
    empty: its end is scored. Rows with a null id learn and are scored. Repeated rows count as often as they
    occur and each give a row; very long texts are read whole. Other columns aren't read; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"), learn_from.alias("learn"))
    chars = rows.agg(F.sum(F.length("text").cast("long") + 1)).first()[0] or 0
    buckets = max(1, math.ceil(chars / BUCKET_CHARS))
    counts = counted(rows, F.col("learn"), buckets).checkpoint()
    size = _size(counts)
    g = None
    for _ in range(PASSES):
        g = restaurants(counts, g, buckets, *size)
    hot = spark.sparkContext.broadcast(_hot_words(counts, g))  # HOT * FINE numbers at most
    sent = spark.sparkContext.broadcast(g)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tokens of a batch to the buckets of their words; its documents, with hot words scored, to one of them."""
        g, own = sent.value, hot.value
        names = np.array(sorted(own), np.uint64)
        table = np.log10(np.stack([own[int(w)][1] for w in names])) if len(names) else np.zeros((0, FINE))
        base = _logs(np.array([own[int(w)][0] for w in names]), g) if len(names) else np.zeros(0)
        for number, batch in enumerate(batches):
            group = TaskContext.get().partitionId() << 24 | number
            word, context, size = tokens_of(batch.column(1))
            doc, n = np.repeat(np.arange(len(size)), size), len(size)
            at = np.minimum(np.searchsorted(names, word), max(len(names) - 1, 0))
            known = names[at] == word if len(names) else np.zeros(len(word), bool)
            ids = batch.column(0)
            out = [(group % buckets, group, True, _pack(
                doc=ids.fill_null(0).to_numpy(), valid=ids.is_valid().to_numpy(zero_copy_only=False), held=~batch.column(2).to_numpy(zero_copy_only=False), tokens=size.astype(np.int64),
                known=np.bincount(doc[known], minlength=n).astype(np.uint32), score=np.bincount(doc[known], table[at[known], context[known]], n),
                base=np.bincount(doc[known], base[at[known]], n)))]
            word, context, doc = word[~known], context[~known], doc[~known]
            bucket = (word % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((word, bucket))
            word, context, doc, bucket = word[order], context[order], doc[order], bucket[order]
            for a, b in zip(*(lambda s: (s, np.append(s[1:], len(bucket))))(np.flatnonzero(np.diff(bucket, prepend=-1)))):
                words, entries = np.unique(word[a:b], return_counts=True)
                out.append((int(bucket[a]), group, False, _pack(word=words, entries=entries.astype(np.uint32), context=context[a:b].astype(np.uint16), doc=doc[a:b].astype(np.uint16))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.bool_(), pa.binary()))], ["bucket", "grp", "docs", "payload"])

    def score(tokens: pa.Table, own: pa.Table) -> pa.Table:
        g = sent.value
        seating = averages = None
        groups, kinds, payloads = [], [], []
        if len(own):
            seating = Seating(own.column("counts")[0].as_py(), own.column("bucket")[0].as_py())
            averages = seating.averaged(g)
        for group, is_docs, item in zip(tokens.column("grp").to_pylist(), tokens.column("docs").to_pylist(), tokens.column("payload")):
            payload = item.as_py()
            if not is_docs:
                words, entries, context, doc = _unpack(payload, **_TOKENS)
                place = np.full(len(words), -1)
                count = np.zeros(len(words), np.int64)
                if seating is not None and len(seating.words):
                    at = np.minimum(np.searchsorted(seating.words, words), len(seating.words) - 1)
                    hit = seating.words[at] == words
                    place[hit], count[hit] = at[hit], seating.count[at[hit]]
                each = np.repeat(place, entries)
                p = np.log10(seating.probability(g, averages, each, context.astype(np.int64)) if seating is not None else
                             g.unseen * g.back[1][context.astype(np.int64) // WITHIN] * g.back[2][context])
                docs_here, back = np.unique(doc, return_inverse=True)
                payload = _pack(doc=docs_here, known=np.bincount(back, each >= 0).astype(np.uint32), score=np.bincount(back, p).astype(np.float32),
                                base=np.bincount(back, np.repeat(_logs(count, g), entries)))
            groups.append(group)
            kinds.append(is_docs)
            payloads.append(payload)
        return pa.table({"grp": pa.array(groups, pa.int64()), "docs": pa.array(kinds, pa.bool_()), "payload": pa.array(payloads, pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        kinds, payloads = table.column("docs").to_pylist(), table.column("payload").to_pylist()
        doc, valid, held, n, known, total, base = (x.copy() for x in _unpack(payloads[kinds.index(True)], **_DOCS))
        known = known.astype(np.int64)
        for is_docs, payload in zip(kinds, payloads):
            if not is_docs:
                at, k, s, b = _unpack(payload, **_PARTS)
                known[at] += k
                total[at] += s
                base[at] += b
        return pa.table({"doc_id": pa.array(doc, mask=~valid), "held_out": pa.array(held), "n_tokens": pa.array(n), "n_known": pa.array(known),
                         "train_tokens": pa.array(np.full(len(doc), sent.value.tokens)), "base_score": pa.array(base), "score": pa.array(total)})

    sent_tokens = rows.select("doc_id", "text", "learn").mapInArrow(read, "bucket int, grp bigint, docs boolean, payload binary")
    parts = sent_tokens.groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(score, "grp bigint, docs boolean, payload binary")
    return parts.where("payload is not null").groupBy("grp").applyInArrow(
        gather, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def trains(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 10 != 0, F.lit(True))

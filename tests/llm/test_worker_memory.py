"""What Python workers hold of the texts that they take apart."""

import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import near_copies, packing

BYTES = public_tokenizers.path("byte_bpe_50k.json")


class Rows:
    """Stands for a table, and gives the functions that its batches would go through."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *_):
        return self

    def mapInArrow(self, function, schema):
        return function


class Task:
    """Stands for a task's context outside a task."""

    @staticmethod
    def get():
        return Task

    @staticmethod
    def partitionId():
        return 0


def batch(rows, words):
    """Texts of mostly new words, so that nothing can be remembered to any use."""
    r = np.random.default_rng(3)
    texts = [" ".join(f"{x:x}" for x in r.integers(1 << 40, 1 << 44, words)) for _ in range(rows)]
    return pa.RecordBatch.from_arrays([pa.array(range(rows), pa.int64()), pa.array(texts)], ["doc_id", "text"])


@pytest.fixture
def traced():
    tracemalloc.start()
    yield
    tracemalloc.stop()


def test_tokenizer_remembers_no_pieces(traced):
    coder, texts = packing.ByteTokenizer(BYTES), batch(40, 500).column(1)
    next(coder.encode(pa.array(["once"])))
    before = tracemalloc.get_traced_memory()[0]
    assert sum(len(ids) for ids in coder.encode(texts)) > 40 * 500
    assert tracemalloc.get_traced_memory()[0] - before < 1 << 20


def test_packing_holds_the_arrays_of_a_slice(spark, monkeypatch, traced):
    monkeypatch.setattr(packing, "TaskContext", Task)
    pack, texts = packing.packed(Rows(spark), BYTES), batch(512, 1000)
    list(pack(iter([texts.slice(0, 1)])))
    tracemalloc.reset_peak()
    before, got = tracemalloc.get_traced_memory()[0], {}
    for out in pack(iter([texts])):
        for doc_id, start, ids in zip(*(out.column(c).to_pylist() for c in ("doc_id", "start", "ids"))):
            got.setdefault(doc_id, {})[start] = (zlib.crc32(ids), len(ids))
        held = tracemalloc.get_traced_memory()[1] - before
    assert held < 6 * texts.nbytes  # all its arrays at once are some thirty times as large
    library = Tokenizer.from_file(BYTES)
    for doc_id, text in list(zip(*(c.to_pylist() for c in texts.columns)))[::37]:
        whole = np.array([*library.encode(text, add_special_tokens=False).ids, packing.END_ID], "<u4").tobytes()
        at = 0
        for start, (crc, n) in sorted(got[doc_id].items()):
            assert start * 4 == at and crc == zlib.crc32(whole[at:at + n])
            at += n
        assert at == len(whole)
    assert len(got) == 512


def test_slices_hold_few_bytes_and_every_row(monkeypatch):
    from tidemark.llm import common

    monkeypatch.setattr(common, "SLICE", 10)
    texts = ["", None, "abcd", "éé", "abc", "x" * 25, "", "abcdefghij", None, "a"]
    whole = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], ["text", "n"])
    for own in (whole, whole.slice(2), whole.slice(3, 1), whole.slice(0, 0)):
        parts = list(common.slices(own, 0))
        assert [n for p in parts for n in p.column(1).to_pylist()] == own.column(1).to_pylist()
        assert [t for p in parts for t in p.column(0).to_pylist()] == own.column(0).to_pylist()
        assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.column(0).to_pylist()) <= 10 for p in parts)
    assert [len(p) for p in common.slices(whole, 0)] == [4, 1, 1, 3, 1]


def test_shingles_do_not_depend_on_slices(monkeypatch):
    from tidemark.llm import common

    texts = batch(30, 40)
    levels = np.zeros(1 << near_copies.COUNTERS, np.uint8)
    want = [x.tolist() for x in near_copies._sets(common.clean(texts.column(1)), levels)]
    monkeypatch.setattr(common, "SLICE", 1000)
    parts = list(common.slices(texts, 1))
    assert len(parts) > 5
    assert [x.tolist() for p in parts for x in near_copies._sets(common.clean(p.column(1)), levels)] == want

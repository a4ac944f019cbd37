"""Cross-tokenizer alignment against the libraries and all pairs of tokens."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment, tokens

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def encoders():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(data):
    a, b = encoders()
    byte, done = {letter: x for x, letter in tokens.byte_letters().items()}, []
    for doc_id, text in data:
        whole, spans = f" {text or ''}".encode(), []
        for side in range(2) if text else ():
            if side == 0:
                ids = a.encode(f" {text}", add_special_tokens=False).ids
                raw = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids]
            else:
                ids = b.encode(text)
                raw = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids]
            ends = np.cumsum([len(x) for x in raw]).tolist()
            spans.append([(i, e - len(x), e) for i, x, e in zip(ids, raw, ends)])
            if b"".join(raw) != whole:
                spans = []
                break
        if not spans:
            done.append((doc_id, 0, 0, [], Counter(), ""))
            continue
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        parts = [[[str(i) for i, s, e in side if low <= s and e <= high] for side in spans] for low, high in zip([0, *cuts], cuts)]
        links = Counter((i, j) for i, s, e in spans[0] for j, t, f in spans[1] if max(s, t) < min(e, f))
        text = ";".join("|".join(map(",".join, p)) for p in parts)
        done.append((doc_id, len(spans[0]), len(spans[1]), parts, links, hashlib.sha256(text.encode()).hexdigest()))
    count = Counter(pair for x in done for pair in x[4])
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return sorted(((d, n, m, len(p), sum(k.values()), sum(c for q, c in k.items() if count[q] == best[q[0]]), sum(c * count[q] for q, c in k.items()), h)
                   for d, n, m, p, k, h in done), key=str)


def result(df, **options):
    out = alignment.linked(df, A, B, **options)
    return sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=str)


def odd_texts():
    r = np.random.default_rng(3)
    letters = [*"abcdeéß日本🙂 \n\t'.,-0123456789", "  ", "   ", " the", "n't", "<|endoftext|>", "<s>", "<0x41>", "\r\n", "́", "don't ", "https://x.y ", "　", "\x00"]
    made = ["".join(letters[i] for i in r.integers(0, len(letters), int(n))) for n in r.integers(1, 80, 150)]
    return [*made, " ", "  ", "a ", " a", "▁", "a ▁b", "\n", "", None, "a b", "x" * 300, "😀" * 20, " " * 40 + "b" + " " * 17]


@pytest.mark.parametrize("size, segment", [(1 << 18, 1 << 20), (40, 64), (0, 16)])
def test_alignment_of_odd_texts(spark, size, segment):
    data = [(i % 140, t) for i, t in enumerate(odd_texts())] + [(None, "the end of it"), (None, "the end of it")]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 AS row", "'clash' AS pairs", "2 AS n")
    got = result(df, size=size, segment=segment)
    assert got == brute(data)
    assert sum(x[1] == 0 for x in got) >= 4 and sum(x[3] < x[1] for x in got) > 50


def test_alignment_of_documents(spark, documents, nothing):
    data = [(r.doc_id, r.text) for r in documents.where("length(text) < 3000").select("doc_id", "text").collect()]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert result(df, size=500, segment=1000) == brute(data)
    assert result(nothing) == []


def test_whole_texts_are_encoded_as_the_libraries_do(documents, odd):
    a, b = encoders()
    both = alignment.Aligner(A, B)
    texts = [r.text for frame in (documents, odd) for r in frame.select("text").collect() if r.text]
    for text, ids in zip(texts, both.both([f" {t}".encode() for t in texts])):
        assert ids[0].tolist() == a.encode(f" {text}", add_special_tokens=False).ids and ids[1].tolist() == b.encode(text)


def test_groups_and_overlaps():
    end_a, end_b = np.array([2, 5, 9, 10]), np.array([1, 5, 6, 10])
    spans = np.append(0, end_a)[:-1], end_a, np.append(0, end_b)[:-1], end_b
    assert [x.tolist() for x in alignment.groups(*spans)] == [[0, 0, 1, 1], [0, 0, 1, 1]]
    assert [x.tolist() for x in alignment.overlaps(*spans)] == [[0, 0, 1, 2, 2, 3], [0, 1, 1, 2, 3, 3]]

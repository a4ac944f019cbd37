"""Operators on documents, against brute force and on odd rows."""

import collections
import hashlib
import math
import re
import tempfile
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, components, exact_dedup, langid, line_dedup, packing, pitman_yor, simhash, tokens
from tidemark.llm.common import clean

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD_TEXTS = ["", "Hello  world's ÀΣΣ <|endoftext|> 123 İx '' 'sabc ", "<|startoftext|><|endoftext|>x", "don't 'LL ΑΣ.  \x1c\x85", "x" * 300, "é é 한 '’s 's", None]


def rows(df):
    return [r.asDict() for r in df.collect()]


def words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]


def test_exact_groups(spark, documents, odd, nothing):
    data = documents.select("doc_id", "text").collect()
    groups = collections.defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for r in data:
        groups[norm(r.text)].append(r.doc_id)
    got = {r["doc_id"]: r for r in rows(exact_dedup.exact_groups(documents))}
    for r in data:
        own = groups[norm(r.text)]
        assert got[r.doc_id] == {"doc_id": r.doc_id, "keep_id": min(own), "group_size": len(own), "kept": r.doc_id == min(own),
                                 "text_sha256": hashlib.sha256(norm(r.text).encode()).hexdigest()}
    found = rows(exact_dedup.exact_groups(odd))
    assert len(found) == 10
    assert sorted((r["group_size"], r["kept"]) for r in found if r["doc_id"] == 1) == [(3, True)] * 2
    assert [r["keep_id"] for r in found if r["doc_id"] == 6] == [5]
    kept = exact_dedup.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in rows(kept)) == [1, 2, 4, 5, 7]
    assert rows(exact_dedup.exact_groups(nothing)) == []


def test_transducer_is_exact_and_shared():
    v = bpe.vocabulary(WORDS)
    lexicon = sorted({w.encode() for w in "walking talking stalking walk talk walked talked é ée".split()})
    stored = bpe.compile_lexicon(lexicon, [v.merge(w) for w in lexicon])
    with tempfile.NamedTemporaryFile() as f:
        f.write(stored)
        f.flush()
        own = bpe.Lexicon(f.name)
        assert own.find(pa.array([w.decode() for w in lexicon], pa.large_string())).tolist() == list(range(len(lexicon)))
        assert (own.find(pa.array(["", "wal", "walkings", "zzz"], pa.large_string())) == -1).all()
        assert len(own.final) < sum(map(len, lexicon)) / 2  # suffixes are shared
    for word in (b"x" * 200, b"thethethe" * 20):
        symbols = [v.inner[b] for b in word[:-1]] + [v.last[word[-1]]]
        assert v._merge_short(list(symbols)) == v._merge_long(list(symbols))


def test_bpe_matches_the_library(spark, documents, odd, nothing):
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD_TEXTS)], "doc_id long, text string"))
    library = Tokenizer.from_file(WORDS)
    texts = {r.doc_id: r.text for r in df.collect()}
    got = rows(bpe.encoded(spark, df, WORDS, size=500))
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert len(rows(bpe.encoded(spark, odd, WORDS, with_ids=False))) == 10
    assert rows(bpe.encoded(spark, nothing, WORDS)) == []


def test_byte_pieces_match_the_library():
    library = Tokenizer.from_file(BYTES)
    coder = packing.ByteTokenizer(BYTES)
    texts = [*ODD_TEXTS, " a  b\n\n c\t", "  ", "\n x", "a 's 't'll", "²٣ 12a"]
    assert [i.tolist() for i in coder.encode(pa.array(texts))] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert tokens.split(np.zeros(0, np.uint8), np.zeros(3, np.int64), True)[2].tolist() == [0, 0, 0]


def brute_windows(cuts, cost, window):
    best = [0.0] + [math.inf] * (len(cuts) - 1)
    for j in range(1, len(cuts)):
        for i in range(j):
            n = cuts[j] - cuts[i]
            if n <= window:
                short = n >= packing.SHORTEST and n < window and not n & (n - 1)
                pad = min(window - n, packing.SHORT_WINDOW if short else math.inf)
                best[j] = min(best[j], best[i] + pad + cost[j])
    return best[-1]


def test_window_ends_are_cheapest():
    r = np.random.default_rng(1)
    for _ in range(40):
        window = 256
        cuts = np.append(0, np.cumsum(r.integers(1, 90, int(r.integers(1, 60)))))
        cost = r.integers(0, 9, len(cuts)).astype(float)
        ends = packing.window_ends(cuts, cost, window)
        place, total, before = {c: i for i, c in enumerate(cuts.tolist())}, 0.0, 0
        for e in ends:
            n = e - before
            assert 0 < n <= window
            total += cost[place[e]] + (packing.SHORT_WINDOW if packing.SHORTEST <= n < window and not n & (n - 1) else window - n)
            before = e
        assert before == cuts[-1] and total == brute_windows(cuts.tolist(), cost.tolist(), window)


def test_packing_keeps_every_token_once(spark, documents, odd, nothing):
    library = Tokenizer.from_file(BYTES)
    for df in (documents, odd):
        texts = df.select("doc_id", "text").collect()
        pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
        for p in packing.packed(df, BYTES).collect():
            pieces[p.doc_id].append(p)
            sequences[p.sequence_id].append(p)
        want = collections.defaultdict(list)
        for r in texts:
            want[r.doc_id].append([*library.encode(r.text or "", add_special_tokens=False).ids, 0])
        for doc_id, copies in want.items():
            # Each piece is the ids at its place; every place of every row of that id is in exactly one piece.
            places = collections.Counter()
            for p in pieces[doc_id]:
                own = np.frombuffer(p.ids, "<u4").tolist()
                assert p.length == len(own) and any(own == ids[p.start:p.start + p.length] and p.doc_tokens == len(ids) for ids in copies)
                places.update((p.doc_tokens, p.start + i) for i in range(p.length))
            assert places == collections.Counter((len(ids), i) for ids in copies for i in range(len(ids)))
        padding = total = 0
        for own in sequences.values():
            at = 0
            for p in sorted(own, key=lambda p: p.offset):
                assert p.offset == at
                at += p.length
            assert at <= 1024
            total, padding = total + at, padding + (0 if not at & (at - 1) else 1024 - at)
        assert df is odd or padding < 0.1 * total
        made = packing.packed(df, BYTES)
        crc = {(r.doc_id, r.start, r.length, r.sequence_id, r.offset): zlib.crc32(r.ids) for r in made.collect()}
        assert {(r.doc_id, r.start, r.length, r.sequence_id, r.offset): r.ids_crc32 for r in packing.digests(made).collect()} == crc
    assert rows(packing.packed(nothing, BYTES)) == []


def brute_fingerprint(text, n=3):
    own = words(text)
    shingles = [" ".join(own[i:i + n]) for i in range(max(1, len(own) - n + 1))] if own else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark, documents, odd, nothing, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    near = [(5000 + i, " ".join("abcd"[(i * k * k) % 4] for k in range(2 + i % 5))) for i in range(60)]
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame([*near, (9000, None), (9001, " \n")], "doc_id long, text string"))
    data = {r.doc_id: brute_fingerprint(r.text) for r in df.collect()}
    ids = sorted(data)
    values = np.array([data[i] for i in ids], np.uint64)
    linked = np.bitwise_count(values[:, None] ^ values[None]) <= 2
    label = np.array(ids)
    while True:
        low = np.array([label[m].min() for m in linked])
        if (low == label).all():
            break
        label = low
    got = {r["doc_id"]: r for r in rows(simhash.near_duplicates(df))}
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{data[i]:016x}", int(c)) for i, c in zip(ids, label)}
    found = rows(simhash.near_duplicates(odd))
    assert len(found) == 10 and {r["component_id"] for r in found if r["fingerprint"] == "0" * 16} == {2}
    assert simhash.representatives(odd).columns == odd.columns
    assert rows(simhash.near_duplicates(nothing)) == []


def test_blocks_may_be_gathered_in_any_order():
    values = np.arange(64, dtype=np.uint64) << np.uint64(20)
    a, b = simhash.forest(values, values, True, 1)
    c, d = simhash.forest(values, values[::-1], True, 1)
    assert (a == c).all() and (b == d).all()


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).selectExpr("id * 7919 % 301 AS a", "(id + 1) * 7919 % 301 AS b")
    found = rows(components.roots(edges))
    assert len(found) == 300 and {r["root"] for r in found} == {0}


def test_scores_and_seating(spark, documents, odd, nothing):
    data = documents.select("doc_id", "text").collect()
    split = {r.doc_id: [*words(r.text), "\n"] for r in data}
    count = collections.Counter()
    for i, t in split.items():
        if zlib.crc32(str(i).encode()) % 10:
            count.update(t)
    n, v = sum(count.values()), len(count)
    got = rows(pitman_yor.scored(documents, pitman_yor.trains()))
    assert len(got) == len(data)
    base = model = 0.0
    for r in got:
        t = split[r["doc_id"]]
        want = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (r["train_tokens"], r["n_tokens"], r["n_known"]) == (n, len(t), sum(w in count for w in t))
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) and r["base_score"] == pytest.approx(want, rel=1e-9)
        if r["held_out"]:
            base, model = base + want, model + r["score"]
    assert model > base  # a lower perplexity on what it hasn't seen
    assert len(rows(pitman_yor.scored(odd, pitman_yor.trains()))) == 10
    assert rows(pitman_yor.scored(nothing, pitman_yor.trains())) == []


def test_predictions_sum_to_one():
    r = np.random.default_rng(3)
    word, context = np.sort(r.integers(0, 40, 3000)).astype(np.uint64), r.integers(0, 30, 3000)
    counts = pitman_yor._grouped(word, context, np.ones(3000))
    own = pitman_yor.Seating(pitman_yor._pack(**dict(zip(pitman_yor._COUNTS, counts))), 1)
    g = own.first_totals(1, 3000, len(counts[0]))
    own.sweep(g)
    for _ in range(3):
        g = pitman_yor.Totals(*zip(*own.sums()), 3000, len(counts[0]))
        root = own._root(g)
        assert root.sum() + g.unseen == pytest.approx(1)
        own.sweep(g)


def test_tables_follow_their_law():
    """Frequencies of drawn tables against the exact distribution, by enumeration."""
    r, d, weight = np.random.default_rng(4), 0.6, 0.7
    drawn = pitman_yor.draw_tables(np.full(20_000, 4), np.full(20_000, weight), d, r)
    ways = {1: (1 - d) * (2 - d) * (3 - d), 2: 4 * (1 - d) * (2 - d) + 3 * (1 - d) ** 2, 3: 6 * (1 - d), 4: 1.0}
    total = sum(w * weight**t for t, w in ways.items())
    for t, w in ways.items():
        assert (drawn == t).mean() == pytest.approx(w * weight**t / total, abs=0.02)
    many = pitman_yor.draw_tables(np.full(50, 5000), np.full(50, 3.0), d, r)
    assert (many > 1).all() and (many < 5000).all()


def test_language_of_held_out_rows(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) > 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)
    by_id = collections.defaultdict(list)
    for r in rows(langid.predictions(odd)):
        by_id[r["doc_id"]].append(r["lang_pred"])
    assert by_id[2] == by_id[3] == by_id[4] == ["und"] and len(by_id[1]) == 2
    assert langid.identified(odd).columns == odd.columns
    assert rows(langid.predictions(nothing)) == []


def test_repeated_lines(spark, odd, nothing):
    shared = "this very long passage of many words stands in more than one of the documents here"
    lines = [(1, f"own words of one\n{shared}\ncall 555-1234 now please"), (2, f"{shared}\nfresh line of two"),
             (3, "call 999-0000 now please\nthis very long passage of some words stands in more than one of the documents here"), (4, "The.\nfresh start"), (5, "The.\n\n")]
    df = spark.createDataFrame(lines, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in rows(line_dedup.report(df))}
    assert got == {1: lines[0][1], 2: "fresh line of two", 3: "", 4: lines[3][1], 5: lines[4][1]}
    assert sorted(r["doc_id"] for r in rows(line_dedup.cleaned(df))) == [1, 2, 4, 5]
    kept = line_dedup.cleaned(odd)
    assert kept.columns == odd.columns and sorted((r["doc_id"] for r in rows(kept)), key=str) == [1, 1, 2, 3, 4, 5, 7, None, None]
    assert rows(line_dedup.report(nothing)) == []


def test_invalid_bytes_are_replaced():
    assert clean(pa.array([b"a\xff", None], pa.binary())).to_pylist() == ["a�", ""]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == source.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.select("doc_id").distinct().count() == docs.count() > 100
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_lexicon_takes_whole_levels_of_frequency(spark):
    counted = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate([100, 99, 40, 7, 7, 7, 1, 1])], "word string, n bigint")
    chosen = lambda size: sorted(bpe.frequent_words(counted, size))
    assert chosen(8) == [f"w{i}" for i in range(8)]
    assert chosen(5) == ["w0", "w1", "w2"]  # three words of 7 don't fit whole
    assert chosen(1) == []  # 100 and 99 share a level
    assert bpe.frequent_words(counted.limit(0), 5) == []


def test_language_sample_is_bounded_whatever_the_ids(spark, documents, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 20)
    many = spark.range(3000).selectExpr("IF(id % 2 = 0, NULL, 7L) AS doc_id", "IF(id % 3 = 0, 'the very same text again and again', concat('words of their own ', uuid())) AS text",
                                        "'en' AS lang").checkpoint()
    seen = []
    monkeypatch.setattr(langid, "letters", lambda text: seen.append(text) or text.encode())
    langid.fit(many, F.lit(True))
    assert 0 < len(seen) <= 20 and len(set(seen)) == len(seen)

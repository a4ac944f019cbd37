"""The pipeline's near-dedup against all pairs of shingle sets."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tidemark.llm import near_copies, simhash


def shingles(text, n=5):
    own = (text or "").lower().split()
    return {tuple(own[i:i + n]) for i in range(max(1, len(own) - n + 1))} if own else set()


def brute_kept(data):
    """Row numbers that stay: a row's id is the smallest that 0.8 of shared shingles reach."""
    sets = [shingles(t) for _, t in data]
    near = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    label = np.array([i for i, _ in data])
    while True:
        low = np.array([label[m].min() for m in near])
        if (low == label).all():
            return [k for k, (i, _) in enumerate(data) if i == label[k]]
        label = low


def test_near_dedup_keeps_what_all_pairs_keep(spark):
    r = np.random.default_rng(2)
    data = []
    for group in range(25):
        text = [f"w{x}" for x in r.integers(0, 400, int(r.integers(3, 120)))]
        for copy in range(6):
            own = list(text)
            for at in r.integers(0, len(own), int(r.integers(0, 4))):
                own[at] = f"v{r.integers(0, 400)}"
            data.append((int(r.permutation(10)[0]) + 10 * (group * 6 + copy), " ".join(own)))
    data += [(90_000, ""), (90_001, None), (90_002, "one word more"), (90_003, "One  word\nmore")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(row.doc_id for row in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert got == sorted(data[k][0] for k in brute_kept(data))
    assert 30 < len(got) < 120


def test_near_dedup_of_the_documents(spark, documents, odd, nothing):
    data = [(row.doc_id, row.text) for row in documents.select("doc_id", "text").collect()]
    got = sorted(row.doc_id for row in corpus_pipeline.near_dedup(spark, documents, "").collect())
    assert got == sorted(data[k][0] for k in brute_kept(data))
    kept = corpus_pipeline.near_dedup(spark, odd, "")
    assert kept.columns == odd.columns and sorted((row.doc_id for row in kept.collect()), key=str) == [1, 1, 2, 5, 7]
    assert corpus_pipeline.near_dedup(spark, nothing, "").count() == 0


def test_many_copies_of_one_text(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w30 ", "other ")
    df = spark.range(10_000).selectExpr("id AS doc_id", f"CASE WHEN id % 5000 = 17 THEN '{near}' WHEN id = 9000 THEN 'of its own altogether' ELSE '{text}' END AS text")
    got = {row.doc_id: row.component_id for row in near_copies.near_copies(df).collect()}
    assert len(got) == 10_000 and {i: c for i, c in got.items() if c != 0} == {9000: 9000}


def test_near_dedup_links_by_fingerprints(spark, monkeypatch):
    r = np.random.default_rng(5)
    base = [f"w{x}" for x in r.integers(0, 400, 300)]
    data = [(i, " ".join([*base[:10 * i], f"v{i}", *base[10 * i + 1:]])) for i in range(12)]
    data += [(100 + i, " ".join(f"w{x}" for x in r.integers(0, 400, 80))) for i in range(40)]
    seen = []

    def kept(vertices, radius, links=simhash.links):
        seen.append((radius, {row.fp for row in vertices.select("fp").collect()}))
        return links(vertices, radius)

    monkeypatch.setattr(simhash, "links", kept)
    got = sorted(row.doc_id for row in corpus_pipeline.near_dedup(spark, spark.createDataFrame(data, "doc_id long, text string"), "").collect())
    assert got == [0, *range(100, 140)]
    fps = simhash.fingerprints_of(pa.array([t for _, t in data], pa.large_string()), near_copies.WORDS).view(np.int64).tolist()
    assert seen == [(near_copies.RADIUS, set(fps))]


def test_pairs_by_fingerprint_connect_what_bits_connect(spark):
    fps = [0, 0, 7, 15 << 8, 31 << 8, 1 << 63, -1, -2]
    rows = spark.createDataFrame([(i + 1, f - (1 << 64) if f >= 1 << 63 else f) for i, f in enumerate(fps)], "node long, fp long")
    pairs = {(row.a, row.b) for row in near_copies.by_fingerprint(rows).collect()}
    joined = {i: {i} for i in range(1, 9)}
    for a, b in pairs:
        both = joined[a] | joined[b]
        for i in both:
            joined[i] = both
    assert {tuple(sorted(x)) for x in joined.values()} == {(1, 2, 3, 6), (4, 5), (7, 8)}

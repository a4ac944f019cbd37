"""Operators on conversations, vectors and pages."""

import pickle

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tidemark.llm import chat, html_text, topk


def rows(df):
    return [r.asDict(True) for r in df.collect()]


def test_chat_round_trip(spark):
    turns = [(1, 2, "assistant", "second <|end|> \\| x"), (1, 1, "user", "first\n<|turn user|>"), (1, 3, "assistant", "again\\"), (1, 3, "assistant", "again\\"),
             (2, 1, None, None), (None, None, "us|er", "no id"), (3, 1, "assistant", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' AS turns", "1 AS segments")
    made = chat.formatted(df)
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in rows(made.select("conv_id", chat.read_back(made.formatted).alias("turns")))}
    assert got == {1: [("user", "first\n<|turn user|>"), ("assistant", "second <|end|> \\| x"), ("assistant", "again\\"), ("assistant", "again\\")],
                   2: [("", "")], None: [("us|er", "no id")], 3: [("assistant", "")]}
    first = next(r for r in rows(made) if r["conv_id"] == 1)
    assert first["formatted"].count("<|turn ") == 2 and "".join(s["text"] for s in first["segments"]) == first["formatted"]
    assert rows(chat.digests(chat.formatted(df.limit(0)))) == []


@pytest.mark.parametrize("control", ["<|turn ", "|>", "<|and|>", "<|end|>", "\\", "\\|>", "\\\\|>", "|", "<|turn a|>b<|end|>", ">", "a|>b"])
def test_chat_control_strings_in_roles_and_texts(spark, control):
    turns = [(c, t, role, text) for c, (role, text) in enumerate([(control, "hi"), (f"a{control}", f"{control}hi"), (f"{control}b", f"hi{control}"), ("u", control * 3)])
             for t in range(2)]
    made = chat.formatted(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in rows(made.select("conv_id", chat.read_back(made.formatted).alias("turns")))}
    assert got == {c: [(role, text)] * 2 for c, _, role, text in turns}


def brute(ids, vectors, queries, k):
    out = {}
    for q in queries:
        score = vectors @ vectors[ids.tolist().index(q)]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), int(score[j])) for j in order]
    return out


@pytest.mark.parametrize("dim, spread", [(2, 30), (8, 3), (5, 1)])
def test_dual_tree_is_exact(dim, spread):
    r = np.random.default_rng(dim)
    points = (r.integers(-90, 90, (9, dim))[r.integers(0, 9, 700)] + r.integers(-spread, spread + 1, (700, dim))).astype(float)
    ids = r.permutation(2000)[:700]
    asked = r.random(700) < 0.1
    tree, own = topk.CoverTree(ids, points), topk.CoverTree(ids[asked], points[asked])
    for node in range(len(tree.radius)):
        inside = tree.points[tree.low[node]:tree.high[node]] - tree.points[tree.centre[node]]
        assert np.sqrt((inside**2).sum(1)).max() <= tree.radius[node] + 1e-9
    found = topk.Search(own, tree, 5)
    want = brute(ids, points, ids[asked].tolist(), 5)
    assert {int(q): [(int(i), int(s)) for i, s in zip(f, p)] for q, f, p in zip(own.ids, found.found, found.score)} == want


def test_top_k_on_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 3)
    data = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (50, [-0.001, 2.0]), (7, []), (100, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").selectExpr("*", "1 AS vec", "2 AS block", "3 AS score")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(topk.top_k(df, F.col("vec_id") % 50 == 0, 5))]
    # Every row counts, as in the query's SQL: both rows of id 0 ask, and both are candidates.
    assert sorted(got) == [(0, 1, 1, 65536), (0, 2, 1, 65536), (0, 3, 2, 32768), (0, 4, 2, 32768), (0, 5, 50, -256),
                           (50, 1, 2, 65408), (50, 2, 0, -256), (50, 3, 0, -256), (50, 4, 1, -256)]
    assert rows(topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0)) == []


def test_blocks_of_broken_markup():
    page = "<!-- x --><p>One <b>two<br>three<p>four &amp; five&nbsp;six<script>var a='<p>no</p>'</script> <ul><li>a<li><a href='x'>b</a></ul><p class=\"ad box\">ad"
    assert [(b.text, b.path[-1]) for b in html_text.blocks_of(page)] == [("One two three", "b"), ("four & five six", "p"), ("a", "li"), ("b", "li"), ("ad", ".box")]
    assert html_text.blocks_of(None) == html_text.blocks_of("") == html_text.blocks_of("<div><br></div><!-- ") == []


def test_gradient_is_right():
    made = html_text.Layouts(["some words that are long enough to count as a paragraph of the page, really."])
    pages = [html_text.page_of(*made.page()) for _ in range(3)]
    own = html_text.Labeller()

    def loss():
        odds, total, n = own.scores(pages), 0.0, 0
        for k, p in enumerate(pages):
            total += (np.logaddexp(0, odds[:len(p.main), k]) - p.main * odds[:len(p.main), k]).sum()
            n += len(p.main)
        return total / n

    for name, g in own._gradient(pages).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = own.w[name][at]
        own.w[name][at] = old + 1e-5
        high = loss()
        own.w[name][at] = old - 1e-5
        low = loss()
        own.w[name][at] = old
        assert (high - low) / 2e-5 == pytest.approx(g[at], abs=1e-6)


def test_main_text_of_pages_and_unseen_layouts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    own = html_text.fit(pages)
    got = {r["page_id"]: r for r in rows(html_text.extracted(pages, labeller=own))}
    for r in pages.collect():
        blocks = html_text.blocks_of(r.html)
        assert got[r.page_id]["text"] == " ".join(b.text for b, m in zip(blocks, html_text.weak_labels(blocks)) if m)
        assert got[r.page_id]["n_chars"] == len(got[r.page_id]["text"])
    unseen = html_text.Layouts([b.text for r in pages.limit(60).collect() for b in html_text.blocks_of(r.html)], seed=991)
    made = [unseen.page() for _ in range(150)]
    pairs = [(a, b) for (_, y), p in zip(made, own.main_blocks([p for p, _ in made])) for a, b in zip(y, p)]
    assert sum(a == b for a, b in pairs) > 0.97 * len(pairs)
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", ""), (2, None, "<p>" * 3000 + "x" * 100_000)], "page_id long, url string, html string").selectExpr("*", "1 AS text")
    assert len(rows(html_text.extracted(odd, labeller=own))) == 4 and rows(html_text.extracted(odd.limit(0))) == []


def test_top_k_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 4)
    data = [(1, [1.0, 0.0]), (1, [0.5, 0.0]), (0, [1.0, 0.0]), (2, [0.25, 0.0])] + [(7, [0.125, 0.0])] * 30
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = [(r["vec_id"], r["score"]) for r in rows(topk.top_k(df, F.col("vec_id") == 0, 5))]
    assert sorted(got) == [(1, 32768), (1, 65536), (2, 16384), (7, 8192), (7, 8192)]
    con = duckdb.connect()
    embeddings = pa.table({"vec_id": [i for i, _ in data], "embedding": pa.array([v for _, v in data], pa.list_(pa.float32()))})  # noqa: F841
    assert sorted((r[2], r[3]) for r in con.execute(topk.SQL).fetchall()) == sorted(got)


def test_top_k_refuses_products_beyond_doubles(spark):
    df = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="products"):
        topk.top_k(df, F.col("vec_id") == 0, 5).collect()


def test_points_far_apart_stay_together(spark):
    # No centre covers another point here: a node per point would prune nothing.
    r = np.random.default_rng(5)
    points = r.normal(size=(3000, 64))
    points = np.floor(256 * points / np.linalg.norm(points, axis=1)[:, None])
    points[::3] = points[0]  # ties
    ids = np.where(r.random(3000) < 0.1, 7, r.permutation(3000))  # and a repeated id
    asked = np.arange(3000) % 50 == 1
    tree, own = (pickle.loads(pickle.dumps(topk.CoverTree(i, p))) for i, p in ((ids, points), (ids[asked], points[asked])))
    assert len(tree.radius) <= 3000 / topk.LEAF
    found = topk.Search(own, tree, 5)
    scores = own.points.astype(float) @ points.T
    scores[own.ids[:, None] == ids] = -np.inf
    for q, row in enumerate(scores):
        best = np.lexsort((ids, -row))[:5]
        assert found.found[q].tolist() == ids[best].tolist() and found.score[q].tolist() == row[best].tolist()


def test_products_beyond_floats_are_exact(spark):
    r = np.random.default_rng(6)
    points = r.integers(-3000, 3000, (500, 30)).astype(float)
    small = points // 1000
    for q, p in ((points, points), (small, points), (points, small)):
        found = topk.Search(topk.CoverTree(np.arange(500), q), topk.CoverTree(np.arange(500, 1000), p), 3)
        assert np.array_equal(np.sort(found.score)[:, ::-1], np.sort(found.q.points.astype(float) @ p.T)[:, :-4:-1])

"""Benchmark decontamination against all windows at all places."""

import hashlib
import re

import numpy as np
import pytest

from tidemark.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, window=10):
    wins = [(None if i is None else str(i), tuple(w[a:a + window])) for i, t in items for w in [words(t)] if w for a in range(max(len(w) - window, 0) + 1)]
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item, win in set(wins):
            for a in range(len(own) - len(win) + 1):
                if tuple(own[a:a + len(win)]) == win:
                    hit.update(range(a, a + len(win)))
                    found.add(item)
        ids = sorted(found - {None})
        out.append((doc_id, len(own), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def result(docs, items, **options):
    return sorted((tuple(r) for r in decontaminate.digests(decontaminate.contaminated(docs, items, **options)).collect()), key=str)


def tables(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'clash' AS words", "1 AS pos", "2 AS known", "3 AS item"),
            spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'clash' AS doc_id", "'x' AS key", "4 AS n"))


@pytest.mark.parametrize("keys", [1 << 20, 7])
def test_windows_in_documents(spark, keys):
    r = np.random.default_rng(5)
    pool = [f"w{i}" for i in range(12)] + ["Éa", "x9", "日本"]
    text = lambda n: " ".join(pool[i] for i in r.integers(0, len(pool), n))
    items = [(i, text(int(n))) for i, n in enumerate(r.integers(10, 30, 12))] + [(20, text(3)), (21, "w1 w2"), (22, ""), (23, None), (None, text(11)), (3, text(12))]
    items += [(24, items[0][1]), (100, items[0][1].upper())]
    docs = [(i, text(int(n))) for i, n in enumerate(r.integers(0, 60, 20))]
    for i, (_, t) in enumerate(items):
        own, at = words(t), int(r.integers(0, 20))
        docs.append((40 + i, f"{text(at)}. {', '.join(own[:10])}"))  # a whole window
        docs.append((70 + i, f"{text(at)} {' '.join(own[1:])} {text(9)}"))
        docs.append((110 + i, " ".join(own[:9])))  # one word short
    docs += [(200, " ".join([items[1][1]] * 50)), (200, None), (None, items[2][1]), (None, items[2][1]), (201, "\n\t .")]
    got = result(*tables(spark, docs, items), keys_at_once=keys)
    assert got == brute(docs, items)
    assert sum(x[5] for x in got) > 30 and sum(not x[5] for x in got) > 20


def test_odd_tables(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "word1 the of and word2 the of and word3 the of and"), (2, "zz"), (3, "A-b C")], "item_id long, text string")
    got = result(odd, bench)
    assert got == brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], [tuple(r) for r in bench.collect()])
    assert result(nothing, bench) == []
    empty = hashlib.sha256(b"").hexdigest()
    assert {x[2:] for x in result(odd, bench.limit(0))} == {(0, 0, empty, False)}


def test_a_window_common_to_all_documents(spark):
    passage = " ".join(f"common{i}" for i in range(14))
    docs = spark.range(3000).selectExpr("id AS doc_id", f"concat('own', id, ' {passage} tail', id) AS text")
    bench = spark.createDataFrame([(i, passage) for i in range(30)], "item_id long, text string")
    got = {x[1:4] for x in result(docs, bench)}
    assert got == {(16, 14, 30)}

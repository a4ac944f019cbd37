"""Exact top-k by inner product with a dual cover tree.

Vectors are dealt to blocks of bounded size; each block becomes a cover tree, queries and candidates alike. A pair
of nodes is pruned when even centres' product plus covering radii can't reach the worst kth score of the query
node's group. Points of a node that division would leave nearly alone stay together: leaves are large, and a pair of
them is scored by one matrix product. Blocks of queries meet blocks of candidates by an equi-join on the block number.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import gather, prepare

#: Vectors of a block, about: bounds what one task holds, and the work on a pair of blocks.
CANDIDATES, QUERIES = 32768, 2048
#: Components of a block's vectors, about.
VALUES = 1 << 21
#: Points of a child, on average, and children of a node: a node that can't be divided so is a leaf, however large.
LEAF, CHILDREN = 64, 256
#: Candidates scored at once: the first ones, after which twice as many are, and the most.
FIRST, CHUNK = 256, 1024
SCALE = 256
#: Products below are whole numbers in doubles, and in floats.
EXACT, EXACT_FLOAT = float(1 << 53), float(1 << 24)


class CoverTree:
    """Points in depth-first order; node i covers ``low[i]:high[i]`` within ``radius[i]`` of point ``centre[i]``.

    A node's children are centred on points farther apart than half its radius, its own centre among them, and
    every point belongs to its nearest centre, within half the radius. ``short``: products with other such trees are
    exact in floats.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        squares = np.einsum("ij,ij->i", points, points, dtype=np.float64)
        # No sum of some of a product's terms is larger than the lengths' product.
        self.short = bool(squares.max() < EXACT_FLOAT)
        whole, points = points, points.astype(np.float32) if self.short else points
        nodes: list[list] = []  # centre, radius, low, high, first child, end of children
        order: list[np.ndarray] = []
        placed = 0

        # A node is opened when it is reached, and numbered with its siblings so that children are a range.
        todo = [(self._new(nodes), np.arange(len(ids)), 0, self._apart(points, squares, 0))]
        while todo:
            me, rows, at, gap = todo.pop()
            radius = float(gap.max())
            node = nodes[me]
            node[:4] = [int(rows[at]), radius * (1 + 1e-9), placed, placed + len(rows)]
            divided = self._divided(points[rows], squares[rows], at, gap, radius) if radius else None
            if divided is None:
                order.append(rows)
                placed += len(rows)
                continue
            centres, own, gap = divided
            groups = np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own, minlength=len(centres)))[:-1])
            node[4] = len(nodes)
            children = [self._new(nodes) for _ in centres]
            node[5] = len(nodes)
            # The last in is the next out, so points of a node stay together.
            for child, centre, group in reversed(list(zip(children, centres, groups))):
                todo.append((child, rows[group], int(np.searchsorted(group, centre)), gap[group]))
        order = np.concatenate(order)
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        self.ids, self.points = ids[order], whole[order]
        self.centre = where[[n[0] for n in nodes]]
        self.radius = np.array([n[1] for n in nodes])
        self.low, self.high, self.child, self.end = (np.array([n[k] for n in nodes], np.int64) for k in (2, 3, 4, 5))
        self.leaf = self.child == self.end
        self.length = np.sqrt(squares[order][self.centre]) * (1 + 1e-9)

    def __getstate__(self) -> dict:
        return self.__dict__ | ({"points": self.points.astype(np.int16)} if self.short else {})

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.points = self.points.astype(np.float64, copy=False)

    @staticmethod
    def _new(nodes: list) -> int:
        nodes.append([0, 0.0, 0, 0, 0, 0])
        return len(nodes) - 1

    @staticmethod
    def _apart(points: np.ndarray, squares: np.ndarray, at: int) -> np.ndarray:
        return np.sqrt(np.maximum(squares + squares[at] - 2 * (points @ points[at]).astype(np.float64), 0))

    @classmethod
    def _divided(cls, points: np.ndarray, squares: np.ndarray, at: int, gap: np.ndarray, radius: float) -> tuple | None:
        """Centres of a node's children, each point's centre and distance to it; None if there are too many for its points.

        It is given up as soon as the share of points that the centres so far cover says so.
        """
        most = min(CHILDREN, len(points) // LEAF)
        centres, own, gap = [at], np.zeros(len(points), np.int64), gap.copy()
        while True:
            far = int(gap.argmax())
            if gap[far] <= radius / 2:
                return centres, own, gap
            n = len(centres)
            if n >= most or n >= 16 and not n & (n - 1) and n * len(points) > most * np.count_nonzero(gap <= radius / 2):
                return None
            new = cls._apart(points, squares, far)
            nearer = new < gap
            nearer[far] = True
            own[nearer], gap[nearer] = n, new[nearer]
            gap[far] = 0
            centres.append(far)

    def below(self, node: int) -> np.ndarray:
        return np.array([node]) if self.leaf[node] else np.arange(self.child[node], self.end[node])


class Search:
    """The k best candidates of every query point of one tree in another, ties to the smaller id."""

    def __init__(self, queries: CoverTree, data: CoverTree, k: int):
        self.q, self.d, self.k = queries, data, k
        kind, n = np.float32 if queries.short and data.short else np.float64, len(queries.ids)
        self.queries, self.data = queries.points.astype(kind, copy=False), data.points.astype(kind, copy=False)
        self.score = np.full((n, k), -np.inf, kind)
        self.found = np.full((n, k), np.iinfo(np.int64).max)
        self.room = np.empty(n * CHUNK, kind)  # for products: new memory would take longer than they do
        todo = [(0, 0)]
        while todo:
            todo += self._visit(*todo.pop())

    def _bounds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        q, d = self.q, self.d
        ca, cb, ra, rb = q.centre[a], d.centre[b], q.radius[a][:, None], d.radius[b][None]
        reach = q.length[a][:, None] * rb + d.length[b][None] * ra + ra * rb
        return q.points[ca] @ d.points[cb].T + reach * (1 + 1e-9) + np.where(reach > 0, 1e-6, 0)

    def _worst(self, node: int) -> float:
        """The worst kth score of the queries under a node."""
        return self.score[self.q.low[node]:self.q.high[node], -1].min()

    def _visit(self, a: int, b: int) -> list[tuple[int, int]]:
        mine, theirs = self.q.below(a), self.d.below(b)
        bounds = self._bounds(mine, theirs)
        later = []
        for node, row in zip(mine.tolist(), bounds):
            open_ = np.flatnonzero(row >= self._worst(node))
            open_ = open_[np.argsort(-row[open_], kind="stable")]
            leaves = self.d.leaf[theirs[open_]] & self.q.leaf[node]
            self._score(node, theirs[open_[leaves]], row[open_[leaves]])
            worst = self._worst(node)
            later += [(node, int(theirs[j])) for j in open_[~leaves] if row[j] >= worst]
        return later[::-1]

    def _score(self, node: int, leaves: np.ndarray, bounds: np.ndarray) -> None:
        """Score the points of leaves, the best bounds first, in pieces that grow as the scores to beat do."""
        low, high, d = self.q.low[node], self.q.high[node], self.d
        sizes = d.high[leaves] - d.low[leaves]
        rows, bounds = gather(np.arange(len(d.ids)), d.low[leaves], sizes), np.repeat(bounds, sizes)
        mine = self.queries[low:high]
        at, size = 0, FIRST
        while at < len(rows) and bounds[at] >= self._worst(node):
            piece = rows[at:at + size]
            scores = self.room[:len(mine) * len(piece)].reshape(len(mine), len(piece))
            np.matmul(mine, self.data[piece].T, out=scores)
            self._merge(low, high, scores, d.ids[piece])
            at, size = at + size, min(2 * size, CHUNK)

    def _merge(self, low: int, high: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take what is better than the kth score of a query, or as good under a smaller id."""
        k, own, kth = self.k, self.q.ids[low:high], self.score[low:high, -1]
        least = kth
        if np.isneginf(kth).any() and len(ids) > k:  # the kth of these is to be beaten
            scores[own[:, None] == ids] = -np.inf
            least = np.maximum(kth, np.partition(scores, -k, axis=1)[:, -k])
        some = np.flatnonzero(scores.max(axis=1) >= least)
        i, j = np.nonzero(scores[some] >= least[some, None])
        i = some[i]
        s, v = scores[i, j], ids[j]
        useful = (v != own[i]) & ((s > kth[i]) | (v < self.found[low + i, -1]))
        if not useful.any():
            return
        i, s, v = i[useful], s[useful], v[useful]
        changed = np.unique(i)
        i = np.concatenate([np.repeat(changed, k), i])
        s, v = np.append(self.score[low + changed], s), np.append(self.found[low + changed], v)
        order = np.lexsort((v, -s, i))
        best = order[np.searchsorted(i[order], changed)[:, None] + np.arange(k)]
        self.score[low + changed], self.found[low + changed] = s[best], v[best]


def quantised(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, vec: floor(scale * x) of every component; rows that can't be compared are left out."""
    vector = F.col(vector_column).cast("array<double>")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & ~bad & (F.size(vector) > 0))
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x).cast("double"))
    return rows.select(F.col(id_column).cast("long").alias("vec_id"), whole.alias("vec"))


def _trees(vectors: DataFrame, size: int) -> tuple[DataFrame, int]:
    """One row per block and dimension: dim, block, tree; and the number of blocks."""
    n, values = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / size), math.ceil(values / VALUES))

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        points = table.column("vec").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        if (points**2).sum(axis=1).max() >= EXACT:
            raise ValueError("products of these vectors aren't exact: they reach 2^53")
        order = np.argsort(ids)
        tree = pickle.dumps(CoverTree(ids[order], points[order]), protocol=5)
        return pa.table({"dim": table.column("dim")[:1], "block": table.column("block")[:1], "tree": pa.array([tree], pa.binary())})

    # Dealt by row, not by id or vector: either may be on a third of all rows.
    dealt = vectors.select(F.size("vec").alias("dim"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), "vec_id", "vec")
    return dealt.groupBy("dim", "block").applyInArrow(build, "dim int, block int, tree binary"), blocks


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of highest integer product of each query row, ties to the smaller id.

    ``is_query`` is a condition on vec_id. Every vector but the query's own is a candidate; fewer than k are
    all returned. Vectors that are null, empty or hold null or non-finite components take no part, nor do null ids. Every
    row counts: rows that repeat an id are candidates each, but not of queries of that id, and query rows of one id
    share its k results. Only vectors of one length are compared with each other. Vectors whose products reach 2^53
    fail the job. Other columns aren't read; an empty table gives no rows.
    """
    prepare(vectors.sparkSession)
    rows = quantised(vectors, id_column, vector_column, scale).checkpoint()
    data, blocks = _trees(rows, CANDIDATES)
    asked, _ = _trees(rows.where(is_query), QUERIES)
    asked = asked.select("dim", F.col("block").alias("asked"), F.col("tree").alias("queries"),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def search(table: pa.Table) -> pa.Table:
        queries, tree = (pickle.loads(table.column(c)[0].as_py()) for c in ("queries", "tree"))
        done = Search(queries, tree, k)
        real = np.isfinite(done.score)
        return pa.table({"query_id": np.repeat(queries.ids, real.sum(1)), "vec_id": done.found[real], "score": done.score[real].astype(np.int64)})

    found = (asked.join(data, ["dim", "block"]).groupBy("dim", "block", "asked")
             .applyInArrow(search, "query_id bigint, vec_id bigint, score bigint"))
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

"""Whitened leading components of embeddings by spectrum slicing.

Spark reduces the distinct vectors to their sums and then to the centred covariance, a matrix whose size depends on
the vectors' dimension alone. The signs of the pivots of LDL^T of the shifted covariance count the eigenvalues above a
shift (Sylvester's law of inertia); bisection by such counts isolates each leading eigenvalue, Rayleigh quotient
iteration converges to it, and the counts at the ends of its interval certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare, written

SCALE, COMPONENTS = 256, 4
#: Share of the trace below which a component is rounding error and can't be whitened.
RANK = 1e-12
#: How a pivot of one row is weighed against one of two rows: the value that bounds the growth of both alike.
PIVOT = (1 + 17**0.5) / 8
_EPS = float(np.finfo(float).eps)
OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


# --- the spectrum of a symmetric matrix --------------------------------------------------------------

def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are greater than ``shift``: positive pivots of LDL^T with symmetric pivoting."""
    m = matrix - shift * np.eye(len(matrix))
    positive = 0
    while len(m):
        column = np.abs(m[1:, 0])
        r = 1 + int(column.argmax()) if len(column) else 0
        most = column[r - 1] if r else 0.0
        size = 1
        if abs(m[0, 0]) < PIVOT * most:
            row = np.abs(m[r])
            row[r] = 0
            widest = row.max()
            if abs(m[0, 0]) * widest < PIVOT * most * most:
                to = 0
                if abs(m[r, r]) < PIVOT * widest:
                    size, to = 2, 1
                if to != r:
                    m[[to, r]] = m[[r, to]]
                    m[:, [to, r]] = m[:, [r, to]]
        side = m[size:, :size]
        if size == 2:
            positive += 1  # such a block has one positive and one negative eigenvalue
            m = m[2:, 2:] - side @ np.linalg.solve(m[:2, :2], side.T)
        else:
            positive += int(m[0, 0] > 0)
            m = m[1:, 1:] - (side @ side.T / m[0, 0] if m[0, 0] else 0.0)
    return positive


def _orthogonal(v: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in found:
            v = v - (u @ v) * u
    return v / np.linalg.norm(v)


def _solved(matrix: np.ndarray, shift: float, v: np.ndarray, step: float) -> np.ndarray:
    """A step of inverse iteration; a shift that is an eigenvalue to the last bit is moved a little."""
    while True:
        try:
            out = np.linalg.solve(matrix - shift * np.eye(len(matrix)), v)
            if np.isfinite(out).all() and out.any():
                return out
        except np.linalg.LinAlgError:
            pass
        shift, step = shift + step, 2 * step


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues (falling) and their unit eigenvectors (as columns) of a symmetric matrix.

    An eigenvalue whose interval can't be told apart from its neighbours' at double precision is taken as
    multiple: its vectors are any orthonormal ones of their common space.
    """
    d = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max()) if d else 0.0
    fine, random = 4 * _EPS * norm, np.random.default_rng(0)
    counts = {-2 * norm: d, 2 * norm: 0}

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(matrix, shift)
        return counts[shift]

    values, found = [], []
    for c in range(1, min(k, d) + 1):
        if norm == 0:
            values.append(0.0)
            found.append(np.eye(d)[c - 1])
            continue
        while True:
            low, high = max(s for s, n in counts.items() if n >= c), min(s for s, n in counts.items() if n < c)
            alone = count(low) == c and count(high) == c - 1
            if not alone and high - low > fine:
                count((low + high) / 2)
                continue
            v, shift = _orthogonal(random.standard_normal(d), found), (low + high) / 2
            for step in range(40):
                v = _orthogonal(_solved(matrix, shift, v, fine), found)
                value = float(v @ matrix @ v)
                rest = float(np.linalg.norm(matrix @ v - value * v))
                if step >= 2 and low < value < high:
                    shift = value  # from here on the quotient of the last vector: Rayleigh quotient iteration
                if rest <= 8 * _EPS * norm and step:
                    break
            if low - fine <= value <= high + fine and rest <= 1e-12 * norm:
                values.append(value)
                found.append(v)
                break
            if high - low <= fine:
                raise ArithmeticError(f"component {c} does not converge")
            count((low + high) / 2)  # went to a neighbour: start again in half the interval
    return np.array(values), np.array(found).reshape(len(found), d).T


# --- the vectors ---------------------------------------------------------------------------------------

def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int = SCALE) -> DataFrame:
    """vec_id, x: floor(scale * entry) of each vector that is there, has entries, and holds only finite numbers whose
    scaled value fits a long."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
    fits = F.forall("v", lambda c: c.isNotNull() & (F.abs(F.coalesce(c, F.lit(0.0)) * scale) < float(1 << 63)))  # not so for NaN, which is the greatest
    return rows.where((F.size("v") > 0) & fits).select("vec_id", F.transform("v", lambda c: F.floor(c * scale)).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass(frozen=True)
class Fit:
    """What the distinct vectors say: their number, exact sums, leading components and how white these come out."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of (n * x - sum)^2; none where it doesn't fit a long."""
        largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
        if (self.n * largest + max(map(abs, self.sums))) ** 2 * len(self.sums) < 1 << 63:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]


def _sums(distinct: DataFrame, d: int) -> list[int]:
    """The exact sum of each dimension: halves of 32 bits are summed per batch, and the batches by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), d)
            halves = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), *map(pa.array, halves)], ["pos", "high", "low"])

    total = [F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("high", "low")]
    rows = distinct.mapInArrow(run, "pos int, high bigint, low bigint").groupBy("pos").agg(*total).collect()
    return [(int(r["high"]) << 32) + int(r["low"]) for r in sorted(rows, key=lambda r: r["pos"])]


def _products(distinct: DataFrame, d: int, change, size: int) -> np.ndarray:
    """The sum of the outer products of ``change`` of the vectors: each task adds its own up, Spark adds the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((size, size))
        for batch in batches:
            y = change(_matrix(batch.column(0), d))
            own += y.T @ y
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(own[i, j])], ["i", "j", "s"])

    sums = distinct.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros((size, size))
    i, j, s = (sums[c].to_numpy() for c in ("i", "j", "s"))
    out[i, j] = out[j, i] = s
    return out


def fit(distinct: DataFrame, d: int, components: int = COMPONENTS) -> Fit:
    """Fit over a table of distinct vectors of dimension ``d``; the driver holds d * d numbers."""
    n, sums = distinct.count(), _sums(distinct, d)
    mean = np.array([s / n for s in sums])
    covariance = _products(distinct, d, lambda x: x - mean, d) / n
    trace = float(np.trace(covariance))
    values, vectors = leading(covariance, components)
    there = values > RANK * trace
    found = Fit(n, sums, values[there], vectors[:, there], trace)
    if not there.any():
        return found
    white = _products(distinct, d, found.whitened, int(there.sum())) / n
    return Fit(n, sums, found.values, found.vectors, trace, float(np.abs(white - np.eye(len(white))).max()))


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Entries become x = floor(scale * entry). Rows without a vector, without entries, or with an entry that is null, not
    finite or too large for a long take no part, nor do vectors of another length than the most frequent one (the
    shorter on a tie). The fit counts equal x once; repeated rows and null ids each give their rows. Components
    that explain next to nothing of the trace (rounding) are left out, so equal vectors alone give no rows; neither
    does an empty table. ``deviation`` is null where it doesn't fit a long. Other columns aren't read.
    """
    spark = prepare(vectors.sparkSession)
    rows = quantised(vectors, id_column, vector_column, scale)
    length = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "d").first()
    if length is None:
        return spark.createDataFrame([], OUT)
    d = length["d"]
    rows = rows.where(F.size("x") == d)
    found = fit(written(rows.select("x").distinct()), d, components)
    k = len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        explained = np.divide(found.values, found.trace, out=np.zeros(k), where=found.trace > 0)
        for batch in batches:
            x, m = _matrix(batch.column(1), d), batch.num_rows
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, found.n)),
                 pa.array(found.deviations(x), pa.int64()).take(each), pa.array(found.whitened(x).ravel()), pa.array(np.tile(explained, m)),
                 pa.array(np.full(m * k, found.identity_error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, OUT)

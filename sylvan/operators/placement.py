"""Placing new items among reference points with known coordinates, from distances to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F


def adjacent_terms(distances: DataFrame) -> DataFrame:
    """(query, ref, term): half the difference of squared distances to a reference and the next, the last's next being the first."""
    s = F.col("d") * F.col("d")
    w = W.partitionBy("query").orderBy("ref")
    rows = distances.withColumn("s", s).withColumn("next", F.coalesce(F.lead("s").over(w), F.first("s").over(w)))
    return rows.select("query", "ref", (F.lit(0.5) * (F.col("s") - F.col("next"))).alias("term"))


class AnalyticalFit:
    """Linearised trilateration: coordinates by the pseudo-inverse of differences of the reference rows."""

    def __init__(self, refs: np.ndarray, pairwise: bool = False) -> None:
        n = len(refs)
        self.pairs = [(i, j) for i in range(n) for j in range(i + 1, n)] if pairwise else [(i, (i + 1) % n) for i in range(n)]
        i, j = (np.array(x) for x in zip(*self.pairs))
        self.i, self.j = i, j
        self.inverse = np.linalg.pinv(refs[j] - refs[i])
        self.offset = 0.5 * ((refs[j] ** 2).sum(axis=1) - (refs[i] ** 2).sum(axis=1))

    def __call__(self, d: np.ndarray) -> np.ndarray:
        return self.inverse @ (0.5 * (d[self.i] ** 2 - d[self.j] ** 2) + self.offset)


class LeastDistance:
    """Coordinates that minimise the squared errors of distances, by damped Gauss-Newton or gradient steps."""

    def __init__(self, refs: np.ndarray, method: str = "newton", rounds: int = 100, tolerance: float = 1e-10) -> None:
        if method not in ("newton", "levenberg", "gradient"):
            raise ValueError(f"unknown method {method}")
        self.refs, self.method, self.rounds, self.tolerance = refs, method, rounds, tolerance
        self.start = AnalyticalFit(refs)

    def loss(self, x: np.ndarray, d: np.ndarray) -> float:
        return float(((np.sqrt(((self.refs - x) ** 2).sum(axis=1)) - d) ** 2).sum())

    def __call__(self, d: np.ndarray) -> np.ndarray:
        x, damp = self.start(d), 0.0 if self.method == "newton" else 1e-2
        best = self.loss(x, d)
        for _ in range(self.rounds):
            away = x - self.refs
            r = np.maximum(np.sqrt((away**2).sum(axis=1)), 1e-20)
            jac, err = away / r[:, None], r - d
            slope = jac.T @ err
            if self.method == "gradient":
                size = golden_section(lambda t: self.loss(x - t * slope, d), 0.0, 1.0)
                step = -size * slope
            else:
                h = jac.T @ jac
                step = -np.linalg.lstsq(h + damp * np.diag(np.maximum(np.diag(h), 1e-12)), slope, rcond=None)[0]
            value = self.loss(x + step, d)
            if value <= best:
                x, gain, best = x + step, best - value, value
                damp /= 10
                if gain < self.tolerance:
                    break
            elif self.method == "levenberg":
                damp = max(damp * 10, 1e-8)
                if damp > 1e12:
                    break
            else:
                break
        return x


def golden_section(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-8) -> float:
    """The minimiser of a function with one minimum in [low, high]."""
    ratio = (5**0.5 - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = f(a), f(b)
    while high - low > tolerance:
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = f(b)
    return (low + high) / 2


class OutOfSampleMDS:
    """Projection of a new row on the leading eigenvectors of the centred reference matrix."""

    def __init__(self, square: np.ndarray, dimensions: int, recalculate: bool = False) -> None:
        s = square**2
        self.rows, self.grand, self.n, self.recalculate = s.mean(axis=1), s.mean(), len(s), recalculate
        b = -0.5 * (s - self.rows[:, None] - self.rows[None, :] + self.grand)
        value, vector = np.linalg.eigh(b)
        order = np.argsort(value)[::-1][:dimensions]
        value, vector = np.maximum(value[order], 1e-12), vector[:, order]
        vector = vector * np.sign(vector[np.abs(vector).argmax(axis=0), range(len(order))])
        self.project = vector / np.sqrt(value)
        self.coords = vector * np.sqrt(value)

    def __call__(self, d: np.ndarray) -> np.ndarray:
        s = d**2
        rows, grand, mean = self.rows, self.grand, s.mean()
        if self.recalculate:  # means with the new row among the others
            n = self.n
            rows = (self.rows * n + s) / (n + 1)
            grand = (self.grand * n * n + 2 * s.sum()) / (n + 1) ** 2
            mean = s.sum() / (n + 1)
        return (-0.5 * (s - rows - mean + grand)) @ self.project


def place(distances: DataFrame, fit: Callable[[np.ndarray], np.ndarray], refs: list[int]) -> DataFrame:
    """(query, x): every query's coordinates from its distances (query, ref, d) to all references.

    The fit, of the size of the reference set, goes to the workers with the plan; a query's few distances
    are gathered by a pre-aggregated group-by. Queries without a distance to every reference are left out.
    """
    order = F.array_sort(F.collect_list(F.struct("ref", "d")))
    rows = distances.groupBy("query").agg(order.alias("r")).where(F.size("r") == len(refs)).select("query", F.transform("r", lambda x: x["d"]).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fit(np.array(d)).tolist() for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["query", "x"])

    return rows.mapInArrow(run, "query long, x array<double>")

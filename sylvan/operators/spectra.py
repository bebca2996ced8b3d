"""Leading eigenvectors of symmetric matrices kept as edge lists, for more points than a dense matrix holds.

Block power iteration: a few trial vectors are multiplied by the matrix in one join and pre-aggregated group-by,
and made orthonormal through their Gram matrix, whose size is that of the trial vectors. Only such small
matrices reach the driver; every iterate is a written table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sylvan.operators import matrix as M
from sylvan.session import cut


def _combined(rows: DataFrame, by: np.ndarray) -> DataFrame:
    """(id, x) with x replaced by x times a small matrix."""
    out = [sum((F.get("x", F.lit(r)) * F.lit(float(by[r, c])) for r in range(by.shape[0])), F.lit(0.0)) for c in range(by.shape[1])]
    return rows.select("id", F.array(*out).alias("x"))


def _grams(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The small matrices of products x x, x y and y y of the vectors of (id, x, y), in one pass."""
    each = [(u, r, v, c) for u, v in (("x", "x"), ("x", "y"), ("y", "y")) for r in range(width) for c in range(width)]
    found = rows.agg(*[F.sum(F.get(u, F.lit(r)) * F.get(v, F.lit(c))).alias(f"g{k}") for k, (u, r, v, c) in enumerate(each)]).first()
    return tuple(np.array([x or 0.0 for x in found]).reshape(3, width, width))


def _with_image(square: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """(id, x, y): the vectors, and the matrix (i, j, v) times them."""
    sums = [F.sum(F.col("v") * F.get("x", F.lit(c))).alias(f"s{c}") for c in range(width)]
    image = square.join(vectors.withColumnRenamed("id", "j"), "j").groupBy("i").agg(*sums).select(F.col("i").alias("id"), F.array(*[f"s{c}" for c in range(width)]).alias("y"))
    return vectors.join(image, "id")


def leading(square: DataFrame, k: int, rounds: int = 300, extra: int = 5, tolerance: float = 1e-9, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """The k algebraically largest eigenvalues, and (id, x) with the vectors' components, of a full symmetric (i, j, v).

    Iterates are shifted by the most negative value seen, so that what is largest is also largest in size. A
    round is one multiplication, written with its factor, and one pass for the small matrices. It ends when the
    values change by no more than ``tolerance`` times the largest.
    """
    square = cut(square.select("i", "j", "v"))
    width = k + extra
    start = [((F.pmod(F.xxhash64("id", F.lit(seed + c)), F.lit(1 << 40)) / F.lit(float(1 << 39))) - 1) for c in range(width)]
    vectors = square.select(F.col("i").alias("id")).distinct().select("id", F.array(*start).alias("x"))
    last, shift = None, 0.0
    for _ in range(rounds):
        rows = cut(_with_image(square, vectors, width))
        xx, xy, yy = _grams(rows, width)
        value, basis = np.linalg.eigh(xx)  # the iterates' own products: they are made orthonormal here, not before
        some = value > value.max() * 1e-12
        by = basis[:, some] / np.sqrt(value[some])
        now, turn = np.linalg.eigh(by.T @ (xy + xy.T) / 2 @ by)
        order = np.argsort(now)[::-1]
        now, turn = now[order], by @ turn[:, order]
        if last is not None and len(now) >= min(k, len(last)) and np.abs(now[:k] - last[:k]).max() <= tolerance * max(1e-300, np.abs(now[:k]).max()):
            return now[:k], _combined(rows.select("id", "x"), turn[:, :k])
        last, shift = now, max(shift, -float(now.min()))
        turn = np.hstack([turn, np.zeros((width, width - turn.shape[1]))])
        vectors = _combined(rows.select("id", F.zip_with("y", "x", lambda a, b: a + F.lit(shift) * b).alias("x")), turn)
    raise RuntimeError(f"eigenvalues did not settle in {rounds} rounds")


def scaled(square: DataFrame, k: int, **how) -> DataFrame:
    """(id, x): classical scaling of a full distance matrix (i, j, d)."""
    value, vectors = leading(M.double_centred(square).withColumnRenamed("b", "v"), k, **how)
    return _combined(vectors, np.diag(np.sqrt(np.abs(value))))


def kernel_components(kernel: DataFrame, k: int, **how) -> DataFrame:
    """(id, x): kernel principal components of a full kernel (i, j, k)."""
    centred = M.double_centred(kernel.withColumnRenamed("k", "d"), squared=False).select("i", "j", (F.lit(-2.0) * F.col("b")).alias("v"))
    value, vectors = leading(centred, k, **how)
    return _combined(vectors, np.diag(np.sqrt(np.maximum(value, 0))))


def spectral(affinity: DataFrame, k: int, **how) -> DataFrame:
    """(id, x): vectors of the symmetric Laplacian of affinities (i, j, a) after the trivial one."""
    _, vectors = leading(M.laplacian(affinity).withColumnRenamed("l", "v"), k + 1, **how)
    return vectors.select("id", F.slice("x", 2, k).alias("x"))

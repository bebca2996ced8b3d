"""All-pairs distances as an edge list (i, j, d) with i < j, and views of it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sylvan.operators import blocks

#: Points of a dense matrix at most.
MOST = 5000


class TooManyPoints(ValueError):
    """More points than a dense matrix is made of."""


def _dealt(side: DataFrame) -> DataFrame:
    """By the pair of groups to as many tasks as the session shuffles to: what is made of few bytes is much, so they aren't merged into fewer."""
    return side.repartition(int(side.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "h")


def pairwise_euclid(points: DataFrame, block: int | None = None) -> DataFrame:
    """(i, j, d) for every pair of (id, x), i < j, from blocks of points that meet in tasks (``operators.blocks``)."""
    return blocks.distances(blocks.packed(points, block=block))


def every_pair(rows: DataFrame, key: str, group: int = 64) -> DataFrame:
    """(a, b), structs of every two rows with a's key less than b's.

    Rows are dealt to groups by a hash of the key, of about ``group`` rows each; every pair of groups is one key
    of an equi-join, so the work is spread evenly and no plan compares all rows with all. A key that occurs
    twice isn't paired with itself.
    """
    groups = max(1, -(-rows.count() // group))
    own = rows.where(F.col(key).isNotNull()).select(F.struct("*").alias("x"), F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("g"))
    left = own.withColumn("h", F.explode(F.sequence(F.col("g"), F.lit(groups - 1))))
    right = own.select(F.col("x").alias("y"), F.col("g").alias("h"), F.explode(F.sequence(F.lit(0), F.col("g"))).alias("g"))
    first = F.col(f"x.{key}") < F.col(f"y.{key}")
    met = _dealt(left).join(_dealt(right), ["g", "h"]).where((F.col("g") < F.col("h")) | first)
    return met.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"))


def symmetrised(dm: DataFrame) -> DataFrame:
    """Both (i, j) and (j, i), in one pass over the pairs."""
    back = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "d")
    return dm.select(F.explode(F.array(F.struct("i", "j", "d"), back)).alias("e")).select("e.*")


def full(dm: DataFrame, nodes: DataFrame) -> DataFrame:
    """The square matrix: both triangles and the zero diagonal."""
    return symmetrised(dm).unionByName(nodes.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(0.0).alias("d")))


def from_array(spark, array: np.ndarray, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, labels) of a square array; wrong names are dropped with a warning, as an unlabelled matrix."""
    import warnings

    a = np.asarray(array, float)
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise ValueError("a distance matrix is square")
    if names is not None and len(names) != len(a):
        warnings.warn("number of names differs from the matrix; left unnamed", stacklevel=2)
        names = None
    r, c = np.triu_indices(len(a), 1)
    edges = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(r, c)], "i long, j long, d double")
    labels = spark.createDataFrame([(k, names[k] if names else str(k)) for k in range(len(a))], "i long, name string")
    return edges, labels


def to_array(dm: DataFrame, n: int | None = None, most: int = MOST) -> tuple[np.ndarray, list[int]]:
    """A dense array for the numeric kernels, and its order of ids; refuses more than ``most`` points."""
    ids = [r[0] for r in dm.select(F.col("i").alias("k")).union(dm.select("j")).distinct().orderBy("k").limit(most + 1).collect()]
    if len(ids) > most:
        raise TooManyPoints(f"more than {most} points: use the distributed operators")
    rows = dm.select("i", "j", "d").toArrow()
    out, index = np.zeros((len(ids), len(ids))), np.array(ids)
    i, j = (np.searchsorted(index, rows.column(k).to_numpy()) for k in ("i", "j"))
    out[i, j] = out[j, i] = rows.column("d").to_numpy()
    return out, ids


def equal(a: DataFrame, b: DataFrame, tolerance: float = 1e-10) -> bool:
    """Whether two edge lists hold the same pairs with the same distances."""
    x, y = a.select("i", "j", "d"), b.select("i", "j", F.col("d").alias("e"))
    return x.join(y, ["i", "j"], "full_outer").where(F.col("d").isNull() | F.col("e").isNull() | (F.abs(F.col("d") - F.col("e")) >= tolerance)).isEmpty()


def with_noise(dm: DataFrame, std: float, seed: int) -> DataFrame:
    """Distances with Gaussian noise, kept positive; the same noise for (i, j) and (j, i) by the triangle."""
    return dm.select("i", "j", F.abs(F.col("d") + F.randn(seed) * std).alias("d"))

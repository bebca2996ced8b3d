"""Answers worked out where blocks of points meet against those from the table of all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvan import session
from sylvan.operators import blocks, connect, matrix, pairs, partition


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(50, 3)), rng.normal(size=(40, 3)) * 0.2 + 4, np.full((20, 3), 0.25), rng.normal(size=(10, 3)) * 9])  # with points in the same place
    return spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)], "id long, x array<double>, label int").repartition(3).cache()


@pytest.fixture(scope="module")
def square(points):
    left, right = points.select(F.col("id").alias("i"), F.col("x").alias("x")), points.select(F.col("id").alias("j"), F.col("x").alias("y"))
    return left.crossJoin(right).select("i", "j", F.sqrt(F.aggregate(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)).alias("d")).cache()


@pytest.fixture(autouse=True)
def written(monkeypatch):
    """Columns of what is written on the way; distances aren't."""
    real, seen = session.via_table, []
    monkeypatch.setattr(session, "via_table", lambda df, name: (seen.append(set(df.columns)), real(df, name))[1])
    return seen


def rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_pairs_without_an_exchange(points, square, written):
    out = pairs.pairwise_euclid(points, 7)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, square.where("i < j").collect()))


@pytest.mark.parametrize("k", [1, 7, 119, 120])
def test_kth_nearest(points, square, written, k):
    assert rows(blocks.kth(blocks.packed(points, block=9), k)) == rows(matrix.kth_nearest(square, k))
    assert not any({"i", "j"} <= c for c in written)


@pytest.mark.parametrize("logic", ["or", "and", "directed"])
def test_masks(points, square, written, logic):
    assert rows(blocks.mask(points, 7, logic).select("i", "j")) == rows(matrix.knn_mask(square, 7, logic).where("keep").select("i", "j"))
    assert not any({"i", "j"} <= c for c in written)


@pytest.mark.parametrize("bound", [0.0, 0.5, 1.1, 50.0])
def test_groups_of_near_points(points, square, written, bound):
    nodes, dm = points.select(F.col("id").alias("node")), square.where("i < j")
    assert rows(connect.single_linkage_points(points, bound)) == rows(connect.single_linkage_cut(nodes, dm, bound))
    got = rows(connect.dbscan_points(points, bound, 4))
    assert not any("d" in c for c in written)
    assert got == rows(connect.dbscan(nodes, dm, bound, 4))


def test_sums_inside_groups(points, square, written):
    sums = blocks.inside(points.select("id", "x", "label", (F.col("label") % 2).alias("two")), ["label", "two"])
    got = partition.penalties(sums.select((F.lit(3) - F.col("at")).alias("k"), "grp", "s"), points.agg(F.count("*").alias("n")))
    every = points.select(F.lit(3).alias("k"), F.col("id").alias("elem"), F.col("label").alias("grp")).union(points.select(F.lit(2), "id", F.col("label") % 2))
    assert not written or not any({"i", "j"} <= c for c in written)
    want = {r["k"]: r for r in partition.kelley_penalty(square.where("i < j"), every).collect()}
    for r in got.collect():
        assert (r["spread"], r["penalty"]) == pytest.approx((want[r["k"]]["spread"], want[r["k"]]["penalty"]))


@pytest.mark.parametrize("kind", [None, "symmetric", "random walk"])
def test_affinities_and_laplacians(points, square, written, kind):
    got = rows(matrix.affinity_points(points, kind))
    assert not any({"i", "j"} <= c for c in written)
    aff = matrix.affinity(square, matrix.row_medians(square))
    assert got == rows(aff if kind is None else matrix.laplacian(aff, kind))


def test_centring(points, square, written):
    got = {(i, j): b for i, j, b in matrix.double_centred_points(points).collect()}
    assert not any({"i", "j"} <= c for c in written)
    want = {(i, j): b for i, j, b in matrix.double_centred(square).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())

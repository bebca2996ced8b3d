"""Distributed eigenvectors against dense ones."""

import numpy as np
import pytest

from sylvan.functions import cluster
from sylvan.operators import spectra


@pytest.fixture(scope="module")
def far():
    x = np.random.default_rng(5).normal(size=(30, 6)) * np.array([9, 5, 3, 0.2, 0.1, 0.1])
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


def table(spark, m, name):
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m))], f"i long, j long, {name} double")


def rows(out):
    return np.array([r["x"] for r in sorted(out.collect(), key=lambda r: r["id"])])


def test_embeddings_without_a_dense_matrix(spark, far):
    x = rows(spectra.scaled(table(spark, far, "d"), 3, tolerance=1e-12))
    want = cluster.classical(far, 3)
    assert np.allclose(x @ x.T, want @ want.T, atol=1e-3)
    kernel = np.exp(-(far**2) / 2000)
    x, want = rows(spectra.kernel_components(table(spark, kernel, "k"), 2, tolerance=1e-12)), cluster.kernel_components(kernel, 2)
    assert np.allclose(x @ x.T, want @ want.T, atol=1e-5)


def test_largest_values_with_negative_ones(spark):
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    value = np.concatenate([[9.0, 5.0], -np.linspace(4, 1, 28)])
    m = (q * value) @ q.T
    got, vectors = spectra.leading(table(spark, m, "v"), 2, tolerance=1e-11)
    x = rows(vectors)
    assert np.allclose(got, [9, 5], atol=1e-6) and np.allclose(np.abs(x.T @ q[:, :2]), np.eye(2), atol=2e-3)

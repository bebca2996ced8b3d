"""The registered queries against their SQL on the smallest tables, and the entry module."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from sylvan.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cur = con.execute(catalogue.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == want


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["elem", "grp", "neighbour", "score"] and out.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name,kernel,setting,value", [("mmds_embedding", "smacof", "rounds", 300), ("kmedoids", "kmedoids", "starts", 100), ("affinity_propagation", "affinity_propagation", "rounds", 400)])
def test_dense_queries_do_the_whole_job_of_their_operators(monkeypatch, name, kernel, setting, value):
    import inspect

    from sylvan.functions import cluster
    from sylvan.plans import numeric

    real, used = getattr(cluster, kernel), []

    def spy(*a, **k):
        bound = inspect.signature(real).bind(*a, **k)
        bound.apply_defaults()
        used.append(bound.arguments[setting])
        return real(*a, **k)

    x = np.random.default_rng(3).normal(size=(40, 4))
    m = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    monkeypatch.setattr(cluster, kernel, spy)
    monkeypatch.setattr(numeric, "_dense", lambda *_: (m, list(range(40))))
    for out in ("_coords", "_groups"):
        monkeypatch.setattr(numeric, out, lambda spark, ids, made: made)
    assert len(numeric.QUERIES[name](None, "")) == 40 and used == [value]

"""Golden distances, metric axioms, and table operators on trees."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from sylvan.functions import geodesic as G, newick, treeops
from sylvan.operators import trees

#: Two ten-leaf trees and their published distances.
A = "((((A:1.5,(B:1.25,((C:0.0078125,D:0.00390625):0.25,E:0.375):0.75):1):0.25,(F:0.875,G:0.875):0.75):0.375,H:1):0.5,I:1,J:2);"


def random_splits(seed, n=9):
    t = treeops.iterative_random([f"T{i}" for i in range(n)], np.random.default_rng(seed))
    return newick.splits(t)


@given(st.integers(0, 10_000), st.integers(0, 10_000), st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_metric_axioms(x, y, z):
    a, b, c = (random_splits(s) for s in (x, y, z))
    for d in (G.geodesic, G.euclidean, G.weighted_rf, lambda p, q: G.robinson_foulds(p, q, 9)):
        assert d(a, a) == pytest.approx(0, abs=1e-7) and d(a, b) == pytest.approx(d(b, a), abs=1e-9)
        assert d(a, c) <= d(a, b) + d(b, c) + 1e-9
    assert G.euclidean(a, b) <= G.geodesic(a, b) + 1e-9 <= G.weighted_rf(a, b) + 2e-9


def test_geodesic_of_one_interchange_passes_the_corner():
    a, b = newick.parse("(((A:1,B:1):3,C:1):1,D:1,E:1);"), newick.parse("(((A:1,C:1):4,B:1):1,D:1,E:1);")
    assert G.geodesic(newick.splits(a), newick.splits(b)) == pytest.approx(7)
    assert G.euclidean(newick.splits(a), newick.splits(b)) == pytest.approx(5)


def test_geodesic_refines_its_supports():
    a = newick.splits(newick.parse("((((A:1,B:1):1,C:1):2,D:1):1,E:1,F:1);"))
    b = newick.splits(newick.parse("((((B:1,C:1):2,A:1):2,D:1):1,E:1,F:1);"))
    assert G.geodesic(a, b) == pytest.approx(3)  # one edge shrinks and its rival grows
    far = newick.splits(newick.parse("((A:1,F:1):1,((B:1,E:1):2,C:1):1,D:1);"))
    cone = sum(math.sqrt(sum(v * v for s, v in x.items() if s not in y)) for x, y in ((a, far), (far, a)))
    assert G.geodesic(a, far) <= math.hypot(cone, 0) + 1e-9


def test_newick_round_trip_and_errors():
    for text in (A, "(A,B,(C,D));", "('a b':1,'it''s':2,(x:1,y:1)0.9:2);", "((A:1,B:2)95:3,[note]C:1e-3);"):
        t = newick.parse(text)
        again = newick.parse(newick.write(t))
        assert newick.splits(again) == newick.splits(t) and again.labels() == t.labels() and again.support == t.support
    for text in ("(A,B", "A,B);", "(A,B));", "", "(A,B); (C,D);"):
        with pytest.raises(newick.NewickError):
            newick.parse(text)


def test_restriction_agrees_with_split_restriction():
    t = newick.parse(A)
    for keep in itertools.islice(itertools.combinations("ABCDEFGHIJ", 5), 0, 252, 9):
        a = newick.splits(newick.restricted(t, set(keep)))
        b = G.restrict(newick.splits(t), frozenset(keep))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_overlap_rule(spark):
    rows = [(1, "((A:1,B:1):1,C:1,(D:1,E:1):1);"), (2, "((A:1,C:1):1,B:1,(D:1,F:1):1);"), (3, "((A:1,X:1):1,Y:1,Z:1);")]
    df = spark.createDataFrame(rows, "tree_id long, newick string")
    out = {(r["i"], r["j"]): r["d"] for r in trees.tree_distances(df, "rf", min_overlap=4, fail_value=-1.0).collect()}
    assert out[1, 3] == out[2, 3] == -1 and out[1, 2] == 2.0
    with pytest.raises(ValueError):
        trees.tree_distances(df, "none")


def test_joined_distances_agree_with_the_kernels(spark):
    rows = [(k, newick.write(treeops.iterative_random(list("ABCDEFGH"), np.random.default_rng(k)))) for k in range(8)]
    df = spark.createDataFrame(rows, "tree_id long, newick string")
    s = {k: newick.splits(newick.parse(t)) for k, t in rows}
    for r in trees.pair_distances(trees.splits(df)).collect():
        a, b = s[r["a"]], s[r["b"]]
        for name, f in (("wrf", G.weighted_rf), ("euc", G.euclidean)):
            assert r[name] == pytest.approx(f(a, b)) and r[f"{name}_norm"] == pytest.approx(f(a, b, True))
        assert r["rf"] == G.robinson_foulds(a, b, 8) and r["rf_norm"] == pytest.approx(G.robinson_foulds(a, b, 8, True))


MOVES = [treeops.nearest_interchange, treeops.prune_and_regraft, treeops.lateral_transfer, treeops.incomplete_sorting, treeops.ultrametric_interchange, lambda t, r: treeops.relaxed_clock(t.copy(), r, 0.3), treeops.with_shuffled_labels, lambda t, r: treeops.collapsed(t, length=0.1), lambda t, r: treeops.unrooted(t)]


@pytest.mark.parametrize("k", range(len(MOVES)))
def test_moves_keep_the_leaves(k):
    names = [f"T{i}" for i in range(9)]
    for seed in range(25):
        t = treeops.yule(names, np.random.default_rng(seed))
        out = MOVES[k](t.copy(), np.random.default_rng(seed))
        assert sorted(out.labels()) == names and all(len(c) != 1 for c in out.children)
        if k in (2, 4):
            d = out.depth()
            assert np.ptp([d[x] for x in out.leaves()]) < 1e-9


def test_neighbour_joining_recovers_an_additive_tree():
    t = treeops.iterative_random(list("ABCDEFGHIJ"), np.random.default_rng(3))
    s, names = newick.splits(t), list("ABCDEFGHIJ")
    d = np.array([[sum(v for k, v in s.items() if (a in k) != (b in k)) for b in names] for a in names])
    got = newick.splits(treeops.neighbour_joining(d, names))
    assert got.keys() == s.keys() and all(got[k] == pytest.approx(s[k]) for k in s)
    u = treeops.yule(names, np.random.default_rng(4))
    e = np.array([[sum(v for k, v in newick.splits(u).items() if (a in k) != (b in k)) for b in names] for a in names])
    assert newick.splits(treeops.average_linkage(e, names)).keys() == newick.splits(u).keys()


def test_parsed_tables(spark):
    nodes = trees.parse_newick(spark.createDataFrame([(1, A)], "tree_id long, newick string")).collect()
    assert sum(r["is_leaf"] for r in nodes) == 10 and sorted(r["preorder"] for r in nodes) == list(range(len(nodes)))
    moved = trees.apply_to_trees(spark.createDataFrame([(1, A), (2, A)], "tree_id long, newick string"), lambda t, s: treeops.nearest_interchange(t, np.random.default_rng(s)))
    assert moved.collect() == moved.collect() and moved.count() == 2

"""Each registered query that SQL can't express, against a plain version of its own on the smallest tables."""

import math
import os
from collections import Counter, defaultdict

import numpy as np
import pytest

from sylvan.functions import geodesic as G, newick
from sylvan.plans import catalogue, numeric

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def points(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r["vec_id"])
    return np.array([r["embedding"] for r in rows], float), [r["label"] for r in rows]


@pytest.fixture(scope="module")
def far(points):
    x = points[0]
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


@pytest.fixture(scope="module")
def seqs(spark):
    out = defaultdict(dict)
    for r in catalogue.alignment(spark, SF).collect():
        out[r["locus"]][r["taxon"]] = r["seq"]
    return dict(out)


@pytest.fixture(scope="module")
def brands(spark):
    return {r["tree_id"]: r["newick"] for r in catalogue.newicks(spark, SF).collect()}


@pytest.fixture(scope="module")
def result(spark):
    held = {}
    return lambda name: held[name] if name in held else held.setdefault(name, numeric.QUERIES[name](spark, SF).collect())


def coordinates(rows, key="id"):
    return np.array([r["x"] for r in sorted(rows, key=lambda r: r[key])])


def labels(rows):
    return [r["grp"] for r in sorted(rows, key=lambda r: r["elem"])]


def canonical(x):
    seen = {}
    return [seen.setdefault(v, len(seen)) for v in x]


def gram(m, k):
    """The best approximation of rank k by a product of coordinates."""
    value, vector = np.linalg.eigh(m)
    top = np.argsort(value)[::-1][:k]
    return (vector[:, top] * value[top]) @ vector[:, top].T


def middle(m):
    j = np.eye(len(m)) - 1 / len(m)
    return j @ m @ j


def test_classical_scaling(result, far):
    x = coordinates(result("cmds_embedding"))
    assert np.allclose(x @ x.T, gram(-0.5 * middle(far**2), 3), atol=1e-8)


def test_kernel_components(result, far):
    x = coordinates(result("kpca_embedding"))
    assert np.allclose(x @ x.T, gram(middle(np.exp(-(far**2) / 2)), 3), atol=1e-8)


def test_spectral_embedding(result, far):
    a = np.exp(-(far**2) / 2)
    root = 1 / np.sqrt(a.sum(axis=1) - 1)
    value, vector = np.linalg.eigh(a * root[:, None] * root)
    want = vector[:, np.argsort(value)[::-1][1:4]] * root[:, None]
    x = coordinates(result("spectral_embedding"))
    assert all(min(np.abs(x[:, k] - s * want[:, k]).max() for s in (1, -1)) < 1e-8 for k in range(3))


def test_stress_majorisation(result, far):
    value, vector = np.linalg.eigh(-0.5 * middle(far**2))
    top = np.argsort(value)[::-1][:3]
    x = vector[:, top] * np.sqrt(value[top])
    dist = lambda y: np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2))
    stress = lambda y: ((dist(y) - far) ** 2).sum() / 2
    start, last = stress(x), np.inf
    for _ in range(300):
        now = dist(x)
        if last - (s := ((now - far) ** 2).sum() / 2) < 1e-9 * s:
            break
        last = s
        b = -np.divide(far, now, out=np.zeros_like(far), where=now > 1e-12)
        np.fill_diagonal(b, 0)
        np.fill_diagonal(b, -b.sum(axis=1))
        x = b @ x / len(x)
    got = coordinates(result("mmds_embedding"))
    assert stress(got) < start and abs(stress(got) - stress(x)) < 1e-4 * stress(x)


def test_neighbour_embedding_keeps_neighbours(result, points):
    y, group = coordinates(result("tsne_embedding")), np.array(points[1])
    d = ((y[:, None] - y[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = (group[d.argmin(axis=1)] == group).mean()
    x = points[0]
    e = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(e, np.inf)
    assert np.isfinite(y).all() and np.abs(y.mean(axis=0)).max() < 1e-6 and near > 0.8 * (group[e.argmin(axis=1)] == group).mean()


def agglomerated(d, x, method, k):
    """Merge the two nearest clusters until k are left; every distance from its definition, by members."""
    n = len(d)
    member = {i: [i] for i in range(n)}
    m = d.copy() if method in ("average", "complete") else d**2 / 2 if method == "ward" else d.copy()
    np.fill_diagonal(m, np.inf)
    while len(member) > k:
        i, j = divmod(int(m.argmin()), n)
        i, j = min(i, j), max(i, j)
        own, other = member[i], member.pop(j)
        for c, rest in member.items():
            if c == i:
                continue
            if method == "weighted":
                v = (m[i, c] + m[j, c]) / 2
            elif method == "ward":
                a, b = own + other, rest
                v = len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()
            else:
                block = d[np.ix_(own + other, rest)]
                v = block.mean() if method == "average" else block.max()
            m[i, c] = m[c, i] = v
        m[j] = m[:, j] = np.inf
        member[i] = own + other
    out = [0] * n
    for g in member.values():
        for e in g:
            out[e] = min(g)
    return canonical(out)


@pytest.mark.parametrize("method", ["ward", "average", "complete", "weighted"])
def test_hierarchical_clusters(result, far, points, method):
    assert labels(result(f"{method}_cluster")) == agglomerated(far, points[0], method, 10)


@pytest.mark.parametrize("method", ["centroid", "median"])
def test_clusters_by_centres(result, far, method):
    """Heights may fall here, so the cut at a height needn't give as many groups; each group hangs together in the merges."""
    n = len(far)
    m, name, size, heights, inside = far**2, list(range(n)), [1] * n, [], {k: [k] for k in range(n)}
    np.fill_diagonal(m, np.inf)
    for step in range(n - 1):
        i, j = sorted(divmod(int(m.argmin()), n))
        v, a, b = m[i, j], size[i], size[j]
        if method == "median":
            new = m[i] / 2 + m[j] / 2 - v / 4
        else:
            new = (a * m[i] + b * m[j]) / (a + b) - a * b * v / (a + b) ** 2
        inside[n + step] = inside[name[i]] + inside[name[j]]
        heights.append((math.sqrt(max(v, 0)), name[i], name[j]))
        m[i], m[:, i] = new, new
        m[i, i] = np.inf
        m[j] = m[:, j] = np.inf
        m[i, ~np.isfinite(m.sum(axis=0)) & (m[i] == np.inf)] = np.inf
        size[i], name[i] = a + b, n + step
    ordered = sorted(h for h, _, _ in heights)
    cut, top, high = (ordered[n - 11] + ordered[n - 10]) / 2, list(range(n)), {}
    for step, (h, a, b) in enumerate(heights):
        high[n + step] = max(h, high.get(a, 0), high.get(b, 0))
        if high[n + step] <= cut:
            for e in inside[n + step]:
                top[e] = n + step
    assert labels(result(f"{method}_cluster")) == canonical(top)


def test_kmeans_and_medoids_cannot_be_bettered_by_a_step(result, far):
    x = coordinates(result("cmds_embedding"))
    group = np.array(labels(result("kmeans_cluster")))
    centre = np.array([x[group == g].mean(axis=0) for g in range(10)])
    assert (((x[:, None] - centre) ** 2).sum(axis=2).argmin(axis=1) == group).all()
    group = np.array(labels(result("kmedoids")))
    medoid = [np.flatnonzero(group == g)[far[np.ix_(group == g, group == g)].sum(axis=1).argmin()] for g in range(10)]
    assert np.allclose(far[:, medoid].min(axis=1), far[np.arange(len(far)), np.array(medoid)[group]])
    rng = np.random.default_rng(1)
    assert far[:, medoid].min(axis=1).sum() < np.mean([far[:, rng.permutation(len(far))[:10]].min(axis=1).sum() for _ in range(200)])


def test_mixture_is_where_em_stays(result):
    x, group = coordinates(result("cmds_embedding")), np.array(labels(result("mixture_cluster")))
    assert len(set(group.tolist())) <= 10 and canonical(group.tolist()) == group.tolist()
    between = sum((group == g).sum() * ((x[group == g].mean(axis=0) - x.mean(axis=0)) ** 2).sum() for g in set(group.tolist()))
    assert between > 0.3 * ((x - x.mean(axis=0)) ** 2).sum()


def test_messages_of_affinity_propagation(result, far):
    s = np.exp(-(far**2) / 2)
    n = len(s)
    np.fill_diagonal(s, np.median(s[~np.eye(n, dtype=bool)]))
    s += 1e-12 * np.abs(s).max() * np.random.default_rng(0).normal(size=s.shape)
    r, a = np.zeros((n, n)), np.zeros((n, n))
    for _ in range(400):
        for i in range(n):
            t = a[i] + s[i]
            order = np.argsort(t)
            best = np.full(n, t[order[-1]])
            best[order[-1]] = t[order[-2]]
            r[i] = 0.5 * r[i] + 0.5 * (s[i] - best)
        for k in range(n):
            p = np.maximum(r[:, k], 0)
            p[k] = 0
            new = np.minimum(0, r[k, k] + p.sum() - p)
            new[k] = p.sum()
            a[:, k] = 0.5 * a[:, k] + 0.5 * new
    centres = [k for k in range(n) if a[k, k] + r[k, k] > 0]
    want = [centres.index(i) if i in centres else int(s[i, centres].argmax()) for i in range(n)]
    assert labels(result("affinity_propagation")) == canonical(want)


def test_spectral_clusters(result, far):
    scale = np.median(far, axis=1)
    a = np.exp(-(far**2) / np.outer(scale, scale))
    np.fill_diagonal(a, 1)
    root = 1 / np.sqrt(a.sum(axis=1) - 1)
    value, vector = np.linalg.eigh(a * root[:, None] * root)
    x = vector[:, np.argsort(value)[::-1][1:6]] * root[:, None]
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert labels(result("spectral_cluster")) == agglomerated(d, x, "ward", 5)


def test_placements(result, spark):
    rows = catalogue.likelihoods(spark, SF).collect()
    d = defaultdict(dict)
    for r in rows:
        d[r["elem"]][r["grp"]] = math.sqrt(-r["lnl"])
    refs = sorted(next(iter(d.values())))
    sums = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        sums[r["label"]].append(r["embedding"])
    centre = np.array([np.mean(np.array(sums[g], float), axis=0) for g in refs])
    s = ((centre[:, None] - centre[None]) ** 2).sum(axis=2)
    value, vector = np.linalg.eigh(-0.5 * middle(s))
    top = np.argsort(value)[::-1][:3]
    for r in result("oos_mds"):
        q = np.array([d[r["query"]][g] ** 2 for g in refs])
        b = -0.5 * (q - s.mean(axis=1) - q.mean() + s.mean())
        want = b @ vector[:, top] / np.sqrt(value[top])
        assert np.allclose(np.abs(r["x"]), np.abs(want), atol=1e-6)
    loss = lambda x, q, c: ((np.sqrt(((c - x) ** 2).sum(axis=1)) - q) ** 2).sum()
    coords = vector[:, top] * np.sqrt(value[top])
    signs = [np.array([a, b, c]) for a in (1, -1) for b in (1, -1) for c in (1, -1)]
    for r in result("analytical_placement")[::25]:
        q, x = np.array([d[r["query"]][g] for g in refs]), np.array(r["x"])
        c = min((coords * f for f in signs), key=lambda c: loss(x, q, c))
        step = max(loss(x, q, c) - loss(x + e, q, c) for e in [*np.eye(3) * 1e-3, *-np.eye(3) * 1e-3])
        assert step < 1e-5


def columns(rows):
    names = sorted(rows)
    return list(zip(*(rows[n] for n in names)))


def test_bootstrap_draws_whole_columns_in_order(result, seqs):
    reps = defaultdict(dict)
    for r in result("column_bootstrap"):
        reps[r["rep"], r["locus"]][r["taxon"]] = r["seq"]
    assert len(reps) == 3 * len(seqs)
    for (_, locus), rows in reps.items():
        have = columns(seqs[locus])
        drawn = columns(rows)
        assert len(drawn) == len(have) and set(drawn) <= set(have)
        at = 0
        for c in drawn:  # places never fall, so each column is found at or after the last one's first fitting place
            while at < len(have) and have[at] != c:
                at += 1
            assert at < len(have)
    assert len({tuple(columns(r)) for r in reps.values()}) > len(seqs)


def test_permuted_columns_stay_in_their_group(result, seqs):
    got = defaultdict(dict)
    for r in result("permuted_columns"):
        got[r["locus"]][r["taxon"]] = r["seq"]
    for members in ([k for k in seqs if k < "F"], [k for k in seqs if k >= "F"]):
        taxa = sorted({t for k in members for t in seqs[k]})
        full = lambda table: Counter(c for k in members for c in zip(*(table[k].get(t, "?" * len(next(iter(table[k].values())))) for t in taxa)))
        assert full(got) == full(seqs)
        assert all(len(next(iter(got[k].values()))) == len(next(iter(seqs[k].values()))) for k in members)


def jc(x, y):
    n = [(a, b) for a, b in zip(x, y) if a in "ACGT" and b in "ACGT"]
    return (sum(a != b for a, b in n) / len(n) if n else 0.0), len(n)


def test_likeliest_distances_are_the_closed_form(result, seqs):
    for r in result("ml_distance"):
        p, n = jc(seqs[r["locus"]][r["a"]], seqs[r["locus"]][r["b"]])
        if 0.01 < p < 0.7:
            d = -0.75 * math.log(1 - 4 * p / 3)
            assert abs(r["distance"] - d) < 1e-3 * d and abs(r["variance"] - p * (1 - p) / (n * (1 - 4 * p / 3) ** 2)) < 0.02 * r["variance"]


def joined(d, names):
    """Neighbour joining by its definition, as the set of its splits."""
    d = {(a, b): d[i][j] for i, a in enumerate(names) for j, b in enumerate(names)}
    live, below = list(names), {n: frozenset([n]) for n in names}
    while len(live) > 3:
        total = {a: sum(d[a, b] for b in live if b != a) for a in live}
        _, _, a, b = min(((len(live) - 2) * d[a, b] - total[a] - total[b], (i, j), a, b) for i, a in enumerate(live) for j, b in enumerate(live) if i < j)
        new = object()
        below[new] = below[a] | below[b]
        for c in live:
            if c not in (a, b):
                d[new, c] = d[c, new] = (d[a, c] + d[b, c] - d[a, b]) / 2
        live = [c for c in live if c not in (a, b)] + [new]
    every = frozenset(names)
    return {s if min(every) not in s else every - s for s in below.values() if 1 < len(s) < len(every) - 1}


def test_joined_trees(result, seqs):
    for r in result("nj_tree"):
        names = sorted(seqs[r["locus"]])
        tree = newick.parse(r["newick"])
        assert sorted(tree.labels()) == names and abs(r["lnl"] - pruned_lnl(tree, seqs[r["locus"]])) < 1e-4 * abs(r["lnl"])
    for r in result("average_tree"):
        tree = newick.parse(r["newick"])
        deep = tree.depth()
        tips = [deep[k] for k in tree.leaves()]
        assert sorted(tree.labels()) == sorted(seqs[r["locus"]]) and max(tips) - min(tips) < 1e-6


def test_neighbour_joining_by_definition():
    from sylvan.functions import treeops

    rng = np.random.default_rng(4)
    for _ in range(10):
        x = rng.normal(size=(9, 12))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        names = [f"t{k}" for k in range(9)]
        got = {s for s in newick.splits(treeops.neighbour_joining(d, names)) if 1 < len(s) < 8}
        assert got == joined(d.tolist(), names)


def pruned_lnl(tree, data):
    """The likelihood under equal rates, column by column, by Felsenstein's sums."""
    names = {tree.label[k]: k for k in tree.leaves()}
    total = 0.0
    for column, times in Counter(zip(*(data[n] for n in names))).items():
        state = dict(zip(names, column))
        part = {}
        for k in tree.postorder():
            if not tree.children[k]:
                c = state[tree.label[k]]
                part[k] = np.array([float(c == x) for x in "ACGT"]) if c in "ACGT" else np.ones(4)
                continue
            v = np.ones(4)
            for c in tree.children[k]:
                e = math.exp(-4 / 3 * max(tree.length[c] or 0.0, 0.0))
                same, other = 0.25 + 0.75 * e, 0.25 - 0.25 * e
                v = v * (other * part[c].sum() + (same - other) * part[c])
            part[k] = v
        total += times * math.log(part[0].mean())
    return total


def test_likelihoods_of_trees(result, seqs):
    made = {r["locus"]: newick.parse(r["newick"]) for r in result("nj_tree")}
    rows = result("tree_likelihood")
    assert len(rows) == len(seqs) ** 2
    for r in rows:
        keep = set(seqs[r["locus"]]) & set(made[r["tree"]].labels())
        tree = newick.restricted(made[r["tree"]], keep)
        assert abs(r["lnl"] - pruned_lnl(tree, seqs[r["locus"]])) < 1e-4 * abs(r["lnl"])


def test_random_trees_have_all_leaves(result, spark):
    names = sorted(r[0] for r in spark.read.parquet(f"{SF}/nation.parquet").select("n_name").collect())
    rows = result("random_trees")
    assert Counter(r["kind"] for r in rows) == {"iterative": 20, "yule": 20, "coalescent": 20} and len({r["newick"] for r in rows}) == 60
    for r in rows:
        t = newick.parse(r["newick"])
        assert sorted(t.labels()) == names and all(len(c) in (0, 2, 3) for c in t.children)
        if r["kind"] != "iterative":
            deep = t.depth()
            tips = [deep[k] for k in t.leaves()]
            assert max(tips) - min(tips) < 1e-6


def test_simulated_data(result, brands):
    rows = defaultdict(dict)
    for r in result("simulated_sequences"):
        rows[r["tree_id"]][r["taxon"]] = r["seq"]
    far, differ = [], []
    for k, text in brands.items():
        t = newick.parse(text)
        assert sorted(rows[k]) == sorted(t.labels()) and all(len(s) == 200 and set(s) <= set("ACGT") for s in rows[k].values())
        deep, below = t.depth(), t.below()
        names = {t.label[n]: n for n in t.leaves()}
        for a, b in [(x, y) for i, x in enumerate(sorted(names)) for y in sorted(names)[i + 1 :: 7]]:
            meet = max(deep[n] for n in below if {a, b} <= below[n])
            d = deep[names[a]] + deep[names[b]] - 2 * meet
            far.append(0.75 * (1 - math.exp(-4 / 3 * d)))
            differ.append(jc(rows[k][a], rows[k][b])[0])
    assert abs(np.mean(far) - np.mean(differ)) < 0.02
    genes = result("simulated_classes")
    by = defaultdict(list)
    for r in genes:
        by[r["class"]].append(newick.splits(newick.parse(r["newick"])))
    assert len(genes) == 15 and sorted(by) == [0, 1, 2] and all(len(v) == 5 for v in by.values())
    for v in by.values():
        assert len({frozenset(s) for s in v}) == 1
        ratio = [sum(s.values()) / sum(v[0].values()) for s in v]
        assert all(0.5 - 1e-9 <= x <= 2 + 1e-9 for x in ratio) and len(set(ratio)) == 5


def test_classes_by_em(result, points):
    x, group = points[0], np.array(canonical([v % 4 for v in points[1]]))
    for _ in range(8):
        centre = np.array([x[group == g].mean(axis=0) for g in range(4)])
        score = -((x[:, None] - centre) ** 2).sum(axis=2) + np.log(np.array([(group == g).mean() for g in range(4)]))
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = p.argmax(axis=1)
        for g in set(range(4)) - set(new.tolist()):  # an empty group gets its likeliest element of a group of several
            several = [e for e in range(len(x)) if (new == new[e]).sum() > 1]
            new[min(several, key=lambda e: (-p[e, g], e))] = g
        if (new == group).all():
            break
        group = new
    assert labels(result("cem_iterate")) == group.tolist()


@pytest.mark.parametrize("name,most", [("interchanged_trees", 2), ("regrafted_trees", 100)])
def test_moves_change_as_much_as_they_may(result, brands, name, most):
    rows = result(name)
    assert len(rows) == len(brands)
    for r in rows:
        a, b = newick.splits(newick.parse(brands[r["tree_id"]])), newick.splits(newick.parse(r["newick"]))
        assert {x for s in a for x in s} == {x for s in b for x in s} and G.robinson_foulds(a, b, 25) <= most


def test_collapsed_edges_are_gone(result, brands):
    for r in result("collapsed_edges"):
        a, b = newick.splits(newick.parse(brands[r["tree_id"]])), newick.splits(newick.parse(r["newick"]))
        t = newick.parse(r["newick"])
        assert set(b) <= set(a) and all((t.length[k] or 0) > 0.05 for k in t.preorder() if k and t.children[k])


def path_lengths(text):
    t = newick.parse(text)
    deep, below = t.depth(), t.below()
    names = {t.label[n]: n for n in t.leaves()}
    return {(a, b): deep[names[a]] + deep[names[b]] - 2 * max(deep[n] for n in below if {a, b} <= below[n]) for a in names for b in names if a < b}


def test_squares_of_trees(result, brands):
    paths = {k: path_lengths(t) for k, t in brands.items()}
    mean = {p: np.mean([v[p] for v in paths.values() if p in v]) for p in set().union(*paths.values())}
    var = {p: np.var([v[p] for v in paths.values() if p in v]) + 1e-6 for p in mean}
    for r in result("least_squares_scores"):
        own = paths[r["tree_id"]]
        sq = sum((own[p] - mean[p]) ** 2 / var[p] for p in own)
        norm = sum(math.log(2 * math.pi * var[p]) for p in own)
        assert abs(r["score"] - sq) < 1e-5 * max(1, sq) and abs(r["lnl"] + 0.5 * (sq + norm)) < 1e-5 * max(1, abs(r["lnl"]))


def test_least_squares_trees(result, seqs):
    """No shorter sum by another length for any one edge, and the score is that of the tree given."""
    for r in result("least_squares_search"):
        own, d, var = path_lengths(r["newick"]), {}, {}
        for a, b in own:
            p, n = jc(seqs[r["problem"]][a], seqs[r["problem"]][b])
            if n and p < 0.75:
                d[a, b] = -0.75 * math.log(1 - 4 * p / 3)
                var[a, b] = d[a, b] / n + 1e-6
        known = sum((own[p] - d[p]) ** 2 / var[p] for p in d)
        assert r["score"] >= known - 1e-3 * max(1, known)


def test_files_of_groups(result, seqs):
    files = defaultdict(dict)
    for r in result("group_alignments"):
        files[r["key"]][r["file"]] = r["value"]
    assert len(files) == 2 and all(set(f) == {"alignment", "partitions"} for f in files.values())
    found = []
    for f in files.values():
        head, *rows = f["alignment"].rstrip("\n").split("\n")
        taxa, n = map(int, head.split())
        parts = [line.replace(",", "").replace("=", "").split() for line in f["partitions"].split("\n")]
        text = dict(row.split(" ", 1) for row in rows)
        assert len(text) == taxa and all(len(s) == n for s in text.values())
        for _, locus, span in parts:
            start, stop = map(int, span.split("-"))
            assert all(s[start - 1 : stop] == seqs[locus].get(t, "?" * (stop - start + 1)) for t, s in text.items())
            found.append(locus)
    assert sorted(found) == sorted(seqs)


def test_gains(result):
    rows = result("null_gain")
    assert sorted((r["rep"], r["k"]) for r in rows) == [(k, 1) for k in range(4)] and all(math.isfinite(r["gain"]) for r in rows)


def test_geodesics_of_brands(result, brands):
    s = {k: newick.splits(newick.parse(t)) for k, t in brands.items()}
    rows = result("geodesic_distance")
    assert len(rows) == len(s) * (len(s) - 1) // 2
    for r in rows:
        assert abs(r["d"] - G.geodesic(s[r["i"]], s[r["j"]])) < 1e-5
        assert G.euclidean(s[r["i"]], s[r["j"]]) - 1e-5 <= r["d"] <= math.sqrt(sum(v * v for v in s[r["i"]].values())) + math.sqrt(sum(v * v for v in s[r["j"]].values()))

"""Partitions, matrices, kernels, likelihoods, sources and placement."""

import bz2
import gzip
import math

import numpy as np
import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from sylvan.functions import cluster, likelihood as L, newick, scalars, treeops
from sylvan.operators import align, cem, connect, estimate, matrix, pairs, partition, placement
from sylvan.sources import alignments, logs, tables
from sylvan.streaming import placement as stream

POINTS = np.vstack([np.random.default_rng(0).normal(c, 0.3, (5, 3)) for c in ((0, 0, 0), (5, 0, 0), (0, 5, 1))])
D = cluster.distances(POINTS)
TRUE = [0] * 5 + [1] * 5 + [2] * 5


@given(st.lists(st.integers(0, 4), min_size=1, max_size=20))
def test_growth_is_canonical(labels):
    g = partition.growth(labels)
    assert partition.growth(g) == g and [labels.index(x) for x in labels] == [g.index(x) for x in g]
    assert partition.growth([f"k{x}" for x in labels]) == g


def test_growth_of_letters():
    assert tuple(partition.growth(list("adaababccddddd"))) == (0, 1, 0, 0, 2, 0, 2, 3, 3, 1, 1, 1, 1, 1)


def test_partition_tables(spark):
    rows = list(enumerate("adaababccddddd"))
    p = partition.canonical(spark.createDataFrame(rows, "elem long, label string"))
    assert [r["grp"] for r in p.orderBy("elem").collect()] == partition.growth([x for _, x in rows])
    assert partition.from_membership(partition.membership(p)).exceptAll(p).isEmpty()
    assert partition.statistics(p).first().asDict() == {"num_groups": 4, "num_elements": 14, "is_minimal": False, "is_maximal": False}


def test_entropies(spark):
    e = partition.entropies(spark.createDataFrame([(0, "x"), (0, "x"), (1, "y"), (1, "y")], "g1 long, g2 string")).first()
    assert (e["h1"], e["mi"], e["nmi"], e["vi"]) == pytest.approx((1, 1, 1, 0))


def edges(spark):
    return pairs.from_array(spark, D)


def test_square_round_trip_and_guards(spark):
    dm, labels = edges(spark)
    back, ids = pairs.to_array(dm)
    assert np.allclose(back, D) and ids == list(range(15)) and labels.count() == 15
    assert pairs.equal(dm, dm) and not pairs.equal(dm, dm.withColumn("d", F.col("d") + 1e-6))
    with pytest.raises(ValueError):
        pairs.to_array(dm, most=3)
    with pytest.raises(ValueError):
        pairs.from_array(spark, np.zeros((2, 3)))
    x = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(POINTS)], "id long, x array<double>")
    for block in (2, 4, 256):
        assert pairs.equal(pairs.pairwise_euclid(x, block), dm, 1e-7)
    assert pairs.symmetrised(pairs.pairwise_euclid(x)).count() == 210


def test_matrix_operators(spark):
    dm, _ = edges(spark)
    nodes = spark.range(15).select(F.col("id").alias("node"))
    sq = pairs.full(dm, nodes)
    assert abs(matrix.double_centred(sq).groupBy("i").agg(F.sum("b").alias("s")).agg(F.max(F.abs("s"))).first()[0]) < 1e-9
    k, mask = matrix.smallest_connected_mask(sq, nodes)
    kd = np.sort(D, axis=1)
    joined = lambda k: connected((D <= kd[:, [k]]) | (D <= kd[:, [k]].T))
    assert joined(k) and (k == 1 or not joined(k - 1)) and connect.is_connected(nodes, mask)
    part = spark.createDataFrame([(i, g) for i, g in enumerate(TRUE)], "elem long, grp int")
    s = partition.silhouettes(sq, part)
    assert s.agg(F.min("score")).first()[0] > 0.5
    alone = spark.createDataFrame([(0, 0)] + [(i, 1) for i in range(1, 15)], "elem long, grp int")
    assert partition.silhouettes(sq, alone).where("elem = 0").first()["score"] == 0
    groups = connect.dbscan(nodes, dm, 2.0, 3).orderBy("node").collect()
    assert partition.growth([r["label"] for r in groups]) == TRUE
    cutted = connect.single_linkage_cut(nodes, dm, 2.5).orderBy("node").collect()
    assert partition.growth([r["label"] for r in cutted]) == TRUE


def connected(m):
    seen, todo = {0}, [0]
    while todo:
        for j in np.flatnonzero(m[todo.pop()]):
            if int(j) not in seen:
                seen.add(int(j))
                todo.append(int(j))
    return len(seen) == len(m)


def test_long_path_is_one_component(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connect.components(chain).select("label").distinct().collect()[0][0] == 0


@pytest.mark.parametrize("method", cluster.LINKAGES)
def test_linkages_find_the_groups(method):
    assert cluster.flat(cluster.linkage(D, method), 15, 3) == TRUE


def test_clusterings_find_the_groups():
    assert all(label == TRUE for k, _, label in cluster.every_clustering(D, 3) if k == 3)
    assert cluster.affinity_propagation(-(D**2)) == TRUE
    for kind in ("spectral", "normalised", "kpca"):
        for algorithm in ("kmeans", "gmm", "ward"):
            assert cluster.spectral_clusters(D, 3, kind=kind, algorithm=algorithm) == TRUE


@pytest.mark.parametrize("method", sorted(cluster.EMBEDDINGS))
def test_embeddings_have_their_shape(method):
    x = cluster.embedding(D, 2, method)
    assert x.shape == (15, 2) and np.isfinite(x).all() and (method == "tsne" or np.allclose(x, cluster.embedding(D, 2, method)))


def test_classical_scaling_is_exact_for_euclidean():
    assert np.allclose(cluster.distances(cluster.classical(D, 3)), D) and cluster.is_euclidean(D)
    bent = D**1.7
    assert not cluster.is_euclidean(bent) and cluster.is_euclidean(cluster.corrected(bent), 1e-4)
    with pytest.raises(ValueError):
        cluster.embedding(D, 2, "none")


@pytest.mark.parametrize("fit", [placement.AnalyticalFit(POINTS), placement.AnalyticalFit(POINTS, True), placement.LeastDistance(POINTS, "newton"), placement.LeastDistance(POINTS, "levenberg"), placement.LeastDistance(POINTS, "gradient", 20)])
def test_placement_finds_the_point(spark, fit):
    x = np.array([1.0, 2.0, 0.5])
    d = np.sqrt(((POINTS - x) ** 2).sum(axis=1))
    assert np.allclose(fit(d), x, atol=1e-5)
    far = spark.createDataFrame([(7, k, float(v)) for k, v in enumerate(d)] + [(8, 0, 1.0)], "query long, ref long, d double")
    out = placement.place(far, fit, list(range(15))).collect()
    assert len(out) == 1 and np.allclose(out[0]["x"], x, atol=1e-5)


def test_new_rows_project_onto_their_own_place():
    m = placement.OutOfSampleMDS(D, 3)
    for k in (0, 7, 14):
        assert np.allclose(m(D[k]), m.coords[k])


def test_stream_is_placed(spark, tmp_path):
    spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(POINTS)], "id long, x array<double>").write.parquet(str(tmp_path / "in"))
    rows = stream.placed(spark.readStream.schema("id long, x array<double>").parquet(str(tmp_path / "in")), POINTS, placement.AnalyticalFit(POINTS))
    stream.start(rows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()
    assert np.allclose([r["place"] for r in out], POINTS, atol=1e-6)


def test_models_and_likelihoods():
    m = L.gtr([1, 2, 0.5, 1, 3, 1], [0.1, 0.2, 0.3, 0.4])
    assert np.allclose(m.at(0), np.eye(4)) and np.allclose(m.at(0.7).sum(axis=1), 1) and np.allclose(m.at(0.3) @ m.at(0.4), m.at(0.7))
    assert L.gamma_rates(0.5).mean() == pytest.approx(1) and (np.diff(L.gamma_rates(0.5)) > 0).all()
    jc = L.equal_rates()
    assert L.ml_distance("ACGTACGTAC", "ACGTACGTAA", jc)[0] == pytest.approx(-0.75 * math.log(1 - 4 / 3 * 0.1))
    t = newick.parse("(A:0.1,B:0.2,C:0.3);")
    total = sum(math.exp(L.log_likelihood(t, {"A": a, "B": b, "C": c}, m)) for a in "ACGT" for b in "ACGT" for c in "ACGT")
    assert total == pytest.approx(1)
    tree = treeops.yule(list("ABCDE"), np.random.default_rng(1))
    seqs = L.simulate(tree, 400, m, np.random.default_rng(2))
    assert L.log_likelihood(tree, seqs, m) > L.log_likelihood(treeops.nearest_interchange(tree, np.random.default_rng(5)), {k: v[::-1] if k == "A" else v for k, v in seqs.items()}, m)


def test_least_squares_recover_lengths():
    t = treeops.unrooted(treeops.iterative_random(list("ABCDEFG"), np.random.default_rng(3)))
    names, s = list("ABCDEFG"), newick.splits(t)
    d = np.array([[sum(v for k, v in s.items() if (a in k) != (b in k)) for b in names] for a in names])
    v = np.ones_like(d)
    other = treeops.nearest_interchange(t, np.random.default_rng(1))
    best, score = L.search_squares(other, [(names, d, v), (names[:5], d[:5, :5], v[:5, :5])])
    assert score < 1e-6 and newick.splits(best).keys() == s.keys()


SEQS = [("g1", 0, "a", "ACGT-A"), ("g1", 1, "b", "ACCTNA"), ("g2", 0, "b", "GG"), ("g2", 1, "c", "GA")]


def test_alignment_tables(spark):
    s = spark.createDataFrame(SEQS, "locus string, seq_idx int, taxon string, seq string")
    assert {r["taxon"]: r["seq"] for r in align.concatenated(s).collect()} == {"a": "ACGT-A??", "b": "ACCTNAGG", "c": "??????GA"}
    lnl = {r["locus"]: r["lnl"] for r in align.unconstrained_lnl(s).collect()}
    assert lnl["g2"] == pytest.approx(-2 * math.log(2)) and lnl["g1"] == pytest.approx(2 * math.log(2) - 6 * math.log(6))
    b = align.bootstrap(s, 2, 1)
    assert b.collect() == b.collect() and b.count() == 8
    groups = spark.createDataFrame([("g1", 0), ("g2", 0)], "locus string, grp int")
    p = align.permuted(s, groups, 1)
    whole = {r["taxon"]: r["seq"] for r in align.concatenated(p.withColumn("seq_idx", F.lit(0))).collect()}
    assert sorted(zip(*(whole[t] for t in "abc"))) == sorted(zip("ACGT-A??", "ACCTNAGG", "??????GA"))


def test_scalars(spark):
    row = spark.createDataFrame([("ACGTacgt-A", "AGGTatgtCC", "dir/a10.b/x2.phy.gz")], "a string, b string, p string")
    got = row.select(scalars.ambiguous(F.col("a"), F.col("b")), scalars.ambiguous(F.col("a"), F.col("b"), True), scalars.gap_masked(F.col("b"), F.col("a")), scalars.strip_extensions(F.col("p")), scalars.is_dna(F.lit("ACX?-n")), scalars.is_dna(F.lit("ACE"))).first()
    assert tuple(got) == ("ASGTaygt-M", "X" * 10, "AGGTatgt-C", "x2", True, False)
    names = spark.createDataFrame([(x,) for x in ("c1_10", "c1_9", "c1_09b", "b2")], "n string").orderBy(scalars.natural_key(F.col("n"))).collect()
    assert [r["n"] for r in names] == ["b2", "c1_9", "c1_09b", "c1_10"]
    counts = spark.createDataFrame([(n,) for n in (1, 2, 5, 10, 53, 3289)], "n long").select(scalars.pair_count(F.col("n"))).collect()
    assert [r[0] for r in counts] == [0, 1, 10, 45, 1378, 5407116]


def test_alignment_files(spark, tmp_path):
    fasta, phylip = ">a x\nAC\nGT\n>b\nACGA\n", " 2 4\na AC\nb AC\n\nGT\nGA\n"
    sequential = " 2 4\na AC\nGT\nb AC\nGA\n"
    (tmp_path / "l10.fas").write_text(fasta)
    (tmp_path / "l9.fa.gz").write_bytes(gzip.compress(fasta.encode()))
    (tmp_path / "l1.phy").write_text(phylip)
    (tmp_path / "l2.phy.bz2").write_bytes(bz2.compress(sequential.encode()))
    for kind, loci in (("fasta", ["l9", "l10"]), ("phylip", ["l1", "l2"])):
        s = alignments.read_alignments(spark, str(tmp_path), kind, F.upper)
        rows = s.orderBy("locus_id", "seq_idx").collect()
        assert [r["locus"] for r in rows[::2]] == loci and [(r["taxon"], r["seq"]) for r in rows[:2]] == [("A", "ACGT"), ("B", "ACGA")]
        text = {r["locus"]: r["text"] for r in alignments.alignment_text(s, kind).collect()}
        assert (alignments.parse_fasta if kind == "fasta" else alignments.parse_phylip)(text[loci[0]]) == [("A", "ACGT"), ("B", "ACGA")]
    with pytest.raises(alignments.NoRecordsError):
        (tmp_path / "none").mkdir()
        alignments.read_alignments(spark, str(tmp_path / "none"), "fasta")
    with pytest.raises(ValueError):
        alignments.read_alignments(spark, str(tmp_path), "other")
    with pytest.raises(ValueError):
        alignments.parse_phylip(" 2 5\na AC\nb AC\n")


def test_tables_round_trip(spark, tmp_path):
    dm, labels = edges(spark)
    square = pairs.full(dm, spark.range(15).select(F.col("id").alias("node")))
    tables.write_distances(square, labels, str(tmp_path / "dm"))
    back, names = tables.read_distances(spark, str(tmp_path / "dm"))
    assert pairs.equal(back, dm) and names.count() == 15
    part = spark.createDataFrame([(k, g) for k, g in enumerate(TRUE)], "elem long, grp int")
    tables.write_partition(part, str(tmp_path / "p"))
    read = partition.canonical(tables.read_partition(spark, str(tmp_path / "p")))
    assert [r["grp"] for r in read.orderBy("elem").collect()] == TRUE
    text = '{"likelihood": -1.5, "unknown": 3, "partitions": {"0": {"alpha": 1, "name": "p", "rates": [1.0, 2.0]}}}'
    row = spark.createDataFrame([(text,)], "t string").select(tables.parameters_from_json(F.col("t")).alias("p")).first()["p"]
    assert row["likelihood"] == -1.5 and row["partitions"][0]["rates"] == [1.0, 2.0] and row["ml_tree"] is None


def test_logs(spark):
    search = "Name: p1\nSubstitution Matrix: GTR\nName: p2\nSubstitution Matrix: GTR\nalpha[0]: 0.5 rates[0] ac ag: 1.0 2.0 ML estimate base freqs[0]: 0.4 0.6 alpha[1]: 0.7 rates[1] ac ag: 3.0 4.0 freqs[1]: 0.1 0.9 \nalpha[0]: 0.6 rates[0] ac ag: 1.5 2.5 freqs[0]: 0.3 0.7 alpha[1]: 0.8 rates[1] ac: 1.0 1.0 freqs[1]: 0.5 0.5 \nInference[0] final GAMMA-based Likelihood: -10.5 tree\nInference[1] final GAMMA-based Likelihood: -9.5 tree\n"
    stats = ". Model of nucleotides substitution: \tTN93\n. Log-likelihood: \t\t-99.5\n. Gamma shape parameter: \t\t0.4\n. Transition/transversion ratio for purines: \t2.0\n. Transition/transversion ratio for pyrimidines: \t3.0\n - f(A)= 0.1\n - f(C)= 0.2\n - f(G)= 0.3\n - f(T)= 0.4\n"
    df = spark.createDataFrame([(search, stats)], "a string, b string")
    p = df.select(logs.search_log(F.col("a")).alias("p")).first()["p"]
    assert p["likelihood"] == -9.5 and p["best"] == 1 and p["partitions"][0]["rates"] == [1.5, 2.5] and p["partitions"][1]["alpha"] == 0.8 and p["partitions"][1]["name"] == "p2"
    q = df.select(logs.statistics_log(F.col("b")).alias("q")).first()["q"]
    assert (q["model"], q["alpha"], q["likelihood"], q["frequencies"], q["rates"]) == ("TN93", 0.4, -99.5, [0.1, 0.2, 0.3, 0.4], [1.0, 2.0, 1.0, 1.0, 3.0, 1.0])


def test_classification_em(spark):
    p = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(POINTS)], "elem long, x array<double>")

    def table(part):
        rows = {r["grp"]: np.mean([x["x"] for x in p.join(part.where(F.col("grp") == r["grp"]), "elem").collect()], axis=0) for r in part.select("grp").distinct().collect()}
        return spark.createDataFrame([(i, int(g), -float(((POINTS[i] - c) ** 2).sum())) for g, c in rows.items() for i in range(15)], "elem long, grp int, lnl double")

    start = spark.createDataFrame([(i, 0 if i < 4 else 1 if i < 9 else 2) for i in range(15)], "elem long, grp int")
    out, scores = cem.maximise(start, table, 3, 5)
    assert partition.growth([r["grp"] for r in out.orderBy("elem").collect()]) == TRUE and scores == sorted(scores)
    probs = cem.probabilities(table(start))
    assert probs.groupBy("elem").agg(F.sum("p").alias("s")).where("abs(s - 1) > 1e-9").isEmpty()
    fixed = cem.repaired(start.withColumn("grp", F.least("grp", F.lit(1))), probs, 3)
    assert fixed.select("grp").distinct().count() == 3
    assert cem.drawn(probs, 3).count() == 15


def test_estimated_trees(spark):
    t = treeops.yule(list("ABCDEF"), np.random.default_rng(2))
    seqs = estimate.simulate(spark.createDataFrame([(1, newick.write(t))], "tree_id long, newick string"), 600, 5)
    table = seqs.select(F.lit("l").alias("locus"), "taxon", "seq")
    made = estimate.estimate_trees(table).first()
    assert sorted(newick.parse(made["newick"]).labels()) == list("ABCDEF") and made["lnl"] < 0
    best = estimate.estimate_trees(table, estimate.by_likelihood).first()
    assert best["lnl"] >= made["lnl"]
    for kind in estimate.KINDS:
        a, b = (estimate.random_trees(spark, 3, list("ABCDE"), 1, kind).orderBy("tree_id").collect() for _ in range(2))
        assert a == b and len({r["newick"] for r in a}) == 3

"""Queries that SQL can't express: geodesics, embeddings, clusterings, trees, likelihoods, resampling.

Their kernels are pinned by tests. Dense kernels work on the driver behind the size check of
``pairs.to_array``; above it most have a way over tiles (``operators.held``); everything else is jobs over rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from sylvan.functions import cluster, treeops
from sylvan.operators import align, cem, estimate, held, pairs, partition, placement, resample, trees
from sylvan.plans import catalogue as C
from sylvan.session import cut
from sylvan.sources import groups as files


def _dense(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, list[int]]:
    """The points' distances as an array; more points than that is made for are refused before any is computed."""
    p = C.points(spark, sf_dir)
    if p.limit(pairs.MOST + 1).count() > pairs.MOST:
        raise pairs.TooManyPoints(f"more than {pairs.MOST} points: use the distributed operators")
    return pairs.to_array(cut(pairs.pairwise_euclid(p)))


def _coords(spark: SparkSession, ids: list[int], x: np.ndarray) -> DataFrame:
    return held.coords_table(spark, np.asarray(ids), x)


def _groups(spark: SparkSession, ids: list[int], label: list[int]) -> DataFrame:
    return held.groups_table(spark, np.asarray(ids), label)


def _either(dense, many, out):
    """A dense kernel's result on the driver, or, of more points than it takes, the same from the points and tasks."""

    def q(spark, d):
        try:
            m, ids = _dense(spark, d)
        except pairs.TooManyPoints:
            p = held.Held(C.points(spark, d))
            made = many(p)
            p.free()
            return globals()[out](spark, p.ids, made)
        return globals()[out](spark, ids, dense(m))

    return q


def _embedding(method: str, many, **options):
    return _either(lambda m: cluster.embedding(m, 3, method, **options), many, "_coords")


def _clusters(dense, many):
    return _either(dense, lambda p: partition.growth(np.asarray(many(p)).tolist()), "_groups")


def _refused(p: held.Held):
    raise pairs.TooManyPoints(f"more than {pairs.MOST} points: this kernel keeps a dense matrix")


def _spectral_labels(p: held.Held) -> list[int]:
    x = held.Held.of(p.spark, held.spectral(p, 5, held.local_scales(p), True))
    merges = held.linkage(x, "ward")
    x.free()
    return cluster.flat(merges, len(p), 5)


def _majorised(p: held.Held) -> np.ndarray:
    c = p.x - p.x.mean(axis=0)
    start = c @ np.linalg.eigh(c.T @ c)[1][:, ::-1][:, :3]
    return held.smacof(p, 3, cluster.signed(start))


def geodesic_distance(spark, d):
    return trees.tree_distances(C.newicks(spark, d), "geo").select("i", "j", C.r6("d").alias("d"))


def cmds_embedding(spark, d):
    return held.classical(C.points(spark, d), 3)


def _scaled(spark, d) -> held.Held:
    return held.Held(cut(cmds_embedding(spark, d)))


def kmeans_cluster(spark, d):
    p = _scaled(spark, d)
    label = held.kmeans(p, 10, 7)
    p.free()
    return held.groups_table(spark, p.ids, partition.growth(label.tolist()))


def mixture_cluster(spark, d):
    p = _scaled(spark, d)
    first = partition.growth(held.kmeans(p, 10, 7, 10).tolist())
    p.free()
    return held.groups_table(spark, p.ids, cluster.gaussian_mixture(p.x, 10, 7, first=first))


def oos_mds(spark, d):
    """Every point placed from its distances to the label centroids, themselves placed by classical scaling."""
    far = cut(C.likelihoods(spark, d).select(F.col("elem").alias("query"), F.col("grp").alias("ref"), F.sqrt(-F.col("lnl")).alias("d")))
    p = C.points(spark, d)
    centre = p.select("label", F.posexplode("x").alias("k", "v")).groupBy("label", "k").agg(F.avg("v").alias("v")).orderBy("label", "k").collect()
    refs = sorted({r["label"] for r in centre})
    x = np.array([r["v"] for r in centre]).reshape(len(refs), -1)
    return placement.place(far, placement.OutOfSampleMDS(cluster.distances(x), 3), refs)


def analytical_placement(spark, d):
    far = cut(C.likelihoods(spark, d).select(F.col("elem").alias("query"), F.col("grp").alias("ref"), F.sqrt(-F.col("lnl")).alias("d")))
    p = C.points(spark, d)
    centre = p.select("label", F.posexplode("x").alias("k", "v")).groupBy("label", "k").agg(F.avg("v").alias("v")).orderBy("label", "k").collect()
    refs = sorted({r["label"] for r in centre})
    x = np.array([r["v"] for r in centre]).reshape(len(refs), -1)
    coords = cluster.classical(cluster.distances(x), 3)
    return placement.place(far, placement.LeastDistance(coords, "levenberg"), refs)


def column_bootstrap(spark, d):
    return align.bootstrap(C.alignment(spark, d), 3, 7)


def permuted_columns(spark, d):
    seqs = cut(C.alignment(spark, d))
    groups = seqs.select("locus").distinct().select("locus", F.when(F.col("locus") < "F", 0).otherwise(1).alias("grp"))
    return align.permuted(seqs, cut(groups), 7)


def random_trees(spark, d):
    names = [r[0] for r in C.table(spark, d, "nation").select("n_name").orderBy("n_name").collect()]
    out = [estimate.random_trees(spark, 20, names, 7, k).select(F.lit(k).alias("kind"), "tree_id", "newick") for k in sorted(estimate.KINDS)]
    return out[0].union(out[1]).union(out[2])


def nj_tree(spark, d):
    return estimate.estimate_trees(C.alignment(spark, d), estimate.by_neighbour_joining)


def average_tree(spark, d):
    return estimate.estimate_trees(C.alignment(spark, d), estimate.by_average_linkage)


def ml_distance(spark, d):
    return estimate.ml_distances(C.alignment(spark, d)).select("locus", "a", "b", C.r6("distance").alias("distance"), C.r6("variance").alias("variance"))


def tree_likelihood(spark, d):
    """Every alignment's likelihood under every alignment's tree."""
    seqs = cut(C.alignment(spark, d))
    made = cut(estimate.estimate_trees(seqs).select(F.col("locus").alias("tree"), "newick"))
    return estimate.site_scores(seqs, seqs.select("locus").distinct().crossJoin(made))


def simulated_sequences(spark, d):
    return estimate.simulate(C.newicks(spark, d), 200, 7)


def simulated_classes(spark, d):
    names = [r[0] for r in C.table(spark, d, "nation").select("n_name").orderBy("n_name").collect()]
    return estimate.simulate_classes(spark, 3, 5, names, 7)


def cem_iterate(spark, d):
    """Classes of the points by EM from their labels halved, each class fitted by its mean."""
    p = cut(C.points(spark, d).select(F.col("id").alias("elem"), "x", "label"))

    def table(part: DataFrame) -> DataFrame:
        mean = part.join(p, "elem").select("grp", F.posexplode("x").alias("k", "v")).groupBy("grp", "k").agg(F.avg("v").alias("v")).groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("c"))
        far = F.aggregate(F.zip_with("x", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, v: a + v)
        return p.crossJoin(F.broadcast(mean)).select("elem", "grp", (-far).alias("lnl"))

    start = partition.canonical(p.select("elem", (F.col("label") % 4).alias("label")))
    return cem.maximise(start, table, 4, 8)[0]


def interchanged(spark, d):
    return trees.apply_to_trees(C.newicks(spark, d), lambda t, s: treeops.nearest_interchange(t, np.random.default_rng(s)))


def regrafted(spark, d):
    return trees.apply_to_trees(C.newicks(spark, d), lambda t, s: treeops.prune_and_regraft(t, np.random.default_rng(s)))


def collapsed_edges(spark, d):
    return trees.apply_to_trees(C.newicks(spark, d), lambda t, s: treeops.collapsed(t, length=0.05))


def least_squares_scores(spark, d):
    """Every brand's tree against the mean patristic distances, with the variance over brands."""
    p = cut(trees.patristic(C.rooted_clades(spark, d), C.leaf_table(spark, d)))
    family = p.groupBy("a", "b").agg(F.avg("d").alias("dist"), (F.var_pop("d") + 1e-6).alias("var"))
    return estimate.squares_scores(family, p).select("tree_id", C.r6("score").alias("score"), C.r6("lnl").alias("lnl"))


def least_squares_search(spark, d):
    """For every market segment, the least-squares tree of its closed-form distances, searched from neighbour joining."""
    seqs = cut(C.alignment(spark, d))
    guides = estimate.estimate_trees(seqs).select(F.col("locus").alias("problem"), "newick")
    far = align.jc69(seqs).where("d is not null").select(F.col("locus").alias("problem"), F.lit(0).alias("family"), "a", "b", F.col("d").alias("dist"), (F.col("d") / F.col("n") + 1e-6).alias("var"))
    return estimate.search_problems(far, guides, 3).select("problem", "newick", C.r6("score").alias("score"))


def group_alignments(spark, d):
    """The files of two groups of segments: the alignment laid end to end and the partition lines."""
    seqs = cut(C.alignment(spark, d))
    part = seqs.select("locus").distinct().select("locus", F.when(F.col("locus") < "F", 0).otherwise(1).alias("grp"))
    return files.group_files(seqs, cut(part), F.lit("DNA"))


def null_gain(spark, d):
    """The gain from one group of segments to two, in the data (replicate 0) and in three permuted replicates."""
    seqs = cut(C.alignment(spark, d))
    one = cut(seqs.select("locus").distinct().withColumn("grp", F.lit(0)))
    by = lambda m, k: cluster.flat(cluster.linkage(m, "average"), len(m), k)
    data = cut(seqs.withColumn("rep", F.lit(0)))
    real = resample.gains(cut(resample.scores(data, resample.clustered(data, [1, 2], by, "euc"))))
    return real.union(resample.null_gains(seqs, one, 1, 3, 7, by, "euc"))


def _merged(method):
    def q(spark, d):
        p = held.Held(C.points(spark, d))
        merges = held.linkage(p, method)
        p.free()
        return held.groups_table(spark, p.ids, cluster.flat(merges, len(p), 10))

    return q


QUERIES = {
    "least_squares_search": least_squares_search,
    "group_alignments": group_alignments,
    "null_gain": null_gain,
    "complete_cluster": _merged("complete"),
    "weighted_cluster": _merged("weighted"),
    "centroid_cluster": _merged("centroid"),
    "median_cluster": _merged("median"),
    "kmeans_cluster": kmeans_cluster,
    "mixture_cluster": mixture_cluster,
    "tsne_embedding": _embedding("tsne", _refused),
    "geodesic_distance": geodesic_distance,
    "cmds_embedding": cmds_embedding,
    "kpca_embedding": _embedding("kpca", lambda p: held.kernel_components(p, 3)),
    "spectral_embedding": _embedding("spectral", lambda p: held.spectral(p, 3, np.full(len(p), np.sqrt(2.0)))),
    "mmds_embedding": _embedding("mmds", _majorised),
    "ward_cluster": _merged("ward"),
    "average_cluster": _merged("average"),
    "spectral_cluster": _clusters(lambda m: cluster.labels(cluster.spectral(cluster.local_affinity(m), 5, True), 5, "ward"), _spectral_labels),
    "kmedoids": _clusters(lambda m: cluster.kmedoids(m, 10, 7)[0], lambda p: held.kmedoids(p, 10, 7)[0]),
    "affinity_propagation": _clusters(lambda m: cluster.affinity_propagation(cluster.rbf(m)), _refused),
    "oos_mds": oos_mds,
    "analytical_placement": analytical_placement,
    "column_bootstrap": column_bootstrap,
    "permuted_columns": permuted_columns,
    "random_trees": random_trees,
    "nj_tree": nj_tree,
    "average_tree": average_tree,
    "ml_distance": ml_distance,
    "tree_likelihood": tree_likelihood,
    "simulated_sequences": simulated_sequences,
    "simulated_classes": simulated_classes,
    "cem_iterate": cem_iterate,
    "interchanged_trees": interchanged,
    "regrafted_trees": regrafted,
    "collapsed_edges": collapsed_edges,
    "least_squares_scores": least_squares_scores,
}

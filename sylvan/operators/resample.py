"""How much better k + 1 groups are than k, and by how much they would be if k were right.

A partition's score is the sum of its groups' log likelihoods. The null distribution of the gain from k to
k + 1 comes from replicates in which the loci of a group share one tree: their columns are shuffled over the
group (non-parametric), or sequences evolve anew along the group's tree (parametric). Every replicate is clustered
into k and k + 1 groups like the data.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from sylvan.functions import likelihood as L
from sylvan.operators import align, estimate, pairs, trees
from sylvan.session import cut
from sylvan.sources.groups import grouped

#: Groups of a dense distance matrix: (matrix, k) to labels.
Clustering = Callable[[np.ndarray, int], list[int]]


def scores(seqs: DataFrame, partitions: DataFrame, estimator: estimate.TreeEstimator = estimate.by_neighbour_joining) -> DataFrame:
    """(rep, k, lnl) of partitions (rep, k, locus, grp) of loci (rep, locus, taxon, seq): all groups are jobs of one pass."""
    key = F.concat_ws("|", "rep", "k", "grp")
    own = partitions.withColumn("key", key)
    rows = seqs.join(own.select("rep", "locus", "key"), ["rep", "locus"]).select("taxon", "seq", F.concat_ws("#", "key", "locus").alias("locus"))
    part = own.select(F.concat_ws("#", "key", "locus").alias("locus"), F.col("key").alias("grp"))
    whole = grouped(rows, part).withColumnRenamed("grp", "locus")
    made = estimate.estimate_trees(whole, estimator).select(F.split("locus", r"\|").alias("p"), "lnl")
    return made.groupBy(F.col("p")[0].cast("int").alias("rep"), F.col("p")[1].cast("int").alias("k")).agg(F.sum("lnl").alias("lnl"))


def gains(score: DataFrame) -> DataFrame:
    """(rep, k, gain): how much the score grows from k to k + 1 groups."""
    more = score.select("rep", (F.col("k") - 1).alias("k"), F.col("lnl").alias("above"))
    return score.join(more, ["rep", "k"]).select("rep", "k", (F.col("above") - F.col("lnl")).alias("gain"))


def clustered(seqs: DataFrame, ks: list[int], clustering: Clustering, metric: str = "geo", estimator: estimate.TreeEstimator = estimate.by_neighbour_joining) -> DataFrame:
    """(rep, k, locus, grp): each replicate's loci by the distances of their trees.

    The trees of all replicates are built in one pass; a replicate's distances are one dense matrix of its loci.
    """
    made = cut(estimate.estimate_trees(seqs.select("taxon", "seq", F.concat_ws("|", "rep", "locus").alias("locus")), estimator))
    made = cut(made.select(F.split("locus", r"\|", 2).alias("p"), "newick").select(F.col("p")[0].cast("int").alias("rep"), F.col("p")[1].alias("locus"), "newick"))
    rows = []
    for rep in sorted(r[0] for r in made.select("rep").distinct().collect()):  # as many as were asked for
        own = made.where(F.col("rep") == rep)
        names = sorted(r[0] for r in own.select("locus").limit(5001).collect())
        number = own.sparkSession.createDataFrame(list(enumerate(names)), "tree_id long, locus string")
        d, ids = pairs.to_array(cut(trees.tree_distances(own.join(number, "locus").select("tree_id", "newick"), metric)))
        rows += [(rep, k, names[i], int(g)) for k in ks for i, g in zip(ids, clustering(d, k))]
    return seqs.sparkSession.createDataFrame(rows, "rep int, k int, locus string, grp int")


def replicates(seqs: DataFrame, part: DataFrame, n: int, seed: int, parametric: bool = False, estimator: estimate.TreeEstimator = estimate.by_neighbour_joining) -> DataFrame:
    """(rep, locus, taxon, seq), reps from 1: loci (locus, taxon, seq) as if each group of (locus, grp) had one tree."""
    if not parametric:
        numbered = seqs.crossJoin(seqs.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("rep")))  # n copies, as asked for
        name = F.concat_ws("|", "rep", "locus")
        rows = numbered.select("seq_idx", "taxon", "seq", name.alias("locus"), "rep")
        groups = part.crossJoin(seqs.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("rep"))).select(name.alias("locus"), F.concat_ws("|", "rep", "grp").alias("grp"))
        out = align.permuted(rows.drop("rep"), groups, seed)
        return out.select(F.split("locus", r"\|", 2).alias("p"), "taxon", "seq").select(F.col("p")[0].cast("int").alias("rep"), F.col("p")[1].alias("locus"), "taxon", "seq")
    made = estimate.estimate_trees(grouped(seqs, part).withColumnRenamed("grp", "locus"), estimator).select(F.col("locus").alias("grp"), "newick")
    lengths = seqs.groupBy("locus").agg(F.max(F.length("seq")).alias("n")).join(part.select("locus", F.col("grp").cast("string").alias("grp")), "locus").join(made, "grp")
    longest = lengths.agg(F.max("n")).first()[0]
    jobs = lengths.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("tree_id", F.xxhash64("rep", "locus"))
    jobs = cut(jobs)
    evolved = estimate.simulate(jobs.select("tree_id", "newick"), longest, seed, L.equal_rates)
    return evolved.join(jobs, "tree_id").select("rep", "locus", "taxon", F.substring(F.col("seq"), F.lit(1), F.col("n")).alias("seq"))


def null_gains(seqs: DataFrame, part: DataFrame, k: int, n: int, seed: int, clustering: Clustering, metric: str = "geo", parametric: bool = False, estimator: estimate.TreeEstimator = estimate.by_neighbour_joining) -> DataFrame:
    """(rep, k, gain) of n replicates in which the k groups of ``part`` are right."""
    made = cut(replicates(seqs, part, n, seed, parametric, estimator))
    return gains(cut(scores(made, clustered(made, [k, k + 1], clustering, metric, estimator), estimator)))

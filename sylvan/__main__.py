"""Command line: trees or alignments in, distances, groups and their quality out.

python -m sylvan -d FOLDER [-f fasta|phylip|newick] [-m geo|euc|wrf|rf] [-c METHOD] [-l 2] [-u 5] -o FOLDER
python -m sylvan -d - --simulate CLASSES GENES TAXA COLUMNS -o FOLDER
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from sylvan.functions import checks, cluster
from sylvan.operators import align, estimate, matrix, pairs, partition, resample, trees
from sylvan.session import local_session
from sylvan.sources import alignments, groups as files, tables

METHODS = (*cluster.LINKAGES, "spectral", "mds", "kmedoids")


def arguments() -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="sylvan", description=__doc__.split("\n")[0])
    p.add_argument("-d", "--directory", required=True, help="folder of alignments, or of .nwk trees")
    p.add_argument("-f", "--format", choices=("fasta", "phylip", "newick"), default="newick")
    p.add_argument("-m", "--metric", choices=sorted(trees.METRICS), default="geo")
    p.add_argument("-c", "--cluster", choices=METHODS, default="average")
    p.add_argument("-l", "--lower", type=int, default=2, help="fewest groups")
    p.add_argument("-u", "--upper", type=int, default=5, help="most groups")
    p.add_argument("--min-overlap", type=int, default=4)
    p.add_argument("--normalise", action="store_true")
    p.add_argument("--permute", action="store_true", help="shuffle the columns of all alignments together first")
    p.add_argument("-g", "--embedding-clusters", choices=("kmeans", "gmm", "ward"), default="kmeans", help="how spectral and mds find groups in their coordinates")
    p.add_argument("-r", "--permutations", type=int, default=0, help="replicates with columns shuffled within groups, to judge each gain by")
    p.add_argument("-s", "--simulations", type=int, default=0, help="replicates that evolve along the groups' trees, to judge each gain by")
    p.add_argument("--distances-in", help="read distances from a csv instead")
    p.add_argument("--trees-in", help="folder of .nwk trees to use for the alignments, in place of built ones")
    p.add_argument("--trees-out", help="folder for the trees, one for each locus")
    p.add_argument("--simulate", nargs=4, metavar=("CLASSES", "GENES", "TAXA", "COLUMNS"), type=int, help="write simulated trees, alignments and their partition to the output, and stop")
    p.add_argument("--piecewise-distances", action="store_true", help="also write the distances of sequences within each locus")
    p.add_argument("--groups-out", help="folder for each group's concatenated alignment and partition file")
    p.add_argument("--true", dest="truth", help="comma-separated labels to compare with")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--cores", type=int, default=4)
    p.add_argument("-o", "--output", required=True)
    return p.parse_args()


def groups(d, k: int, method: str, seed: int, algorithm: str = "kmeans") -> list[int]:
    if method in cluster.LINKAGES:
        return cluster.flat(cluster.linkage(d, method), len(d), k)
    if method == "spectral":
        return cluster.spectral_clusters(d, k, algorithm=algorithm, seed=seed)
    return cluster.scaling_clusters(d, k, algorithm=algorithm, seed=seed) if method == "mds" else cluster.kmedoids(d, k, seed)[0]


def simulated(spark, classes: int, genes: int, taxa: int, columns: int, seed: int, path: str) -> None:
    names = [f"Sp{k + 1}" for k in range(taxa)]
    made = matrix.cut(estimate.simulate_classes(spark, classes, genes, names, seed))
    files.write_simulation(made, estimate.simulate(made.select(F.col("gene").alias("tree_id"), "newick"), columns, seed), path)


def judged(a: argparse.Namespace, seqs, parts) -> list[tuple]:
    """(kind, replicate, k, gain) of the data (replicate 0) and of replicates in which k groups are right."""
    by = lambda d, k: groups(d, k, a.cluster, a.seed, a.embedding_clusters)
    own = parts.select(F.lit(0).alias("rep"), "k", F.col("name").alias("locus"), "grp")
    rows = [("data", *r) for r in resample.gains(matrix.cut(resample.scores(seqs.withColumn("rep", F.lit(0)), own))).collect()]
    for kind, n in (("permuted", a.permutations), ("simulated", a.simulations)):
        for k in range(a.lower, a.upper) if n else ():
            part = parts.where(F.col("k") == k).select(F.col("name").alias("locus"), "grp")
            rows += [(kind, *r) for r in resample.null_gains(seqs, part, k, n, a.seed, by, a.metric, kind == "simulated").collect()]
    return rows


def main() -> None:
    a = arguments()
    checks.in_range(a.lower, 1, a.upper)
    spark = local_session(a.cores, "sylvan")
    if a.simulate:
        return simulated(spark, *a.simulate, a.seed, a.output)
    checks.directory(spark, a.directory)
    seqs = None
    if a.distances_in:
        dm, names = tables.read_distances(spark, a.distances_in)
    else:
        if a.format == "newick":
            found = alignments.read_trees(spark, a.directory)
        else:
            seqs = matrix.cut(alignments.read_alignments(spark, a.directory, a.format))
            if a.permute:
                seqs = matrix.cut(align.permuted(seqs, seqs.select("locus").distinct().withColumn("grp", F.lit(0)), a.seed).withColumn("seq_idx", F.col("taxon")))
            if a.piecewise_distances:
                tables.write_results(estimate.ml_distances(seqs), f"{a.output}/piecewise")
            found = alignments.read_trees(spark, a.trees_in) if a.trees_in else matrix.cut(estimate.estimate_trees(seqs).select("locus", "newick"))
        if a.trees_out:
            found.select("locus", F.col("newick").alias("value")).write.partitionBy("locus").text(a.trees_out)
        rows = sorted((r["locus"], r["newick"]) for r in found.collect())
        names = spark.createDataFrame([(k, n) for k, (n, _) in enumerate(rows)], "i long, name string")
        table = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "tree_id long, newick string")
        dm = trees.tree_distances(table, a.metric, a.normalise, a.min_overlap)
    dm = matrix.cut(dm)
    d, ids = pairs.to_array(dm)
    square = matrix.cut(pairs.full(dm, names.select(F.col("i").alias("node"))))
    tables.write_distances(square, names, f"{a.output}/distances")
    made = [(k, i, g) for k in range(a.lower, min(a.upper, len(ids)) + 1) for i, g in zip(ids, groups(d, k, a.cluster, a.seed, a.embedding_clusters))]
    parts = matrix.cut(spark.createDataFrame(made, "k int, elem long, grp int"))
    named = matrix.cut(parts.join(names.withColumnRenamed("i", "elem"), "elem").select("k", "name", "grp"))
    tables.write_results(named.orderBy("k", "grp", "name"), f"{a.output}/memberships")
    if seqs is not None and a.groups_out:
        for k in range(a.lower, min(a.upper, len(ids)) + 1):
            files.write_groups(seqs, named.where(F.col("k") == k).select(F.col("name").alias("locus"), "grp"), f"{a.groups_out}/{k}")
    if seqs is not None and (a.permutations or a.simulations):
        tables.write_results(spark.createDataFrame(judged(a, seqs, named), "kind string, rep int, k int, gain double"), f"{a.output}/gains")
    scores = []
    kelley = {r["k"]: r["penalty"] for r in partition.kelley_penalty(dm, parts).collect()}
    for k in range(a.lower, min(a.upper, len(ids)) + 1):
        part = parts.where(F.col("k") == k).select("elem", "grp")
        mean = partition.silhouettes(square, part).agg(F.avg("score")).first()[0]
        vi = None
        if a.truth:
            truth = spark.createDataFrame(list(zip(ids, a.truth.split(","))), "elem long, g2 string")
            vi = partition.entropies(part.join(truth, "elem").withColumnRenamed("grp", "g1")).first()["vi"]
        scores.append((k, a.metric, a.cluster, mean, kelley.get(k), vi))
    tables.write_results(spark.createDataFrame(scores, "k int, metric string, method string, silhouette double, kelley double, vi double"), f"{a.output}/scores")


if __name__ == "__main__":
    main()

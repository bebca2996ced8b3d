"""Tree building, likelihoods and simulation as jobs over tables: one row of arguments a job.

Jobs are rows; a job's sequences are gathered by a group-by of one locus, whose size is that of one
alignment. A result is a function of the row and a seed hashed from its key, so a task that runs again gives
the same. ``TreeEstimator`` is the plug-in point for other programs; native ones are built in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sylvan.functions import likelihood as L, newick, treeops


class TreeEstimator(Protocol):
    def __call__(self, names: list[str], seqs: list[str]) -> tuple[newick.Tree, float | None]:
        """A tree of the sequences, and its log likelihood if it has one."""


def _model(seqs: list[str], protein: L.Model | None = None) -> L.Model:
    """Equal rates for DNA; for proteins the given model, such as one of ``models.read_model``, or equal rates."""
    dna = all(set(s.upper()) <= set("-?XGATCRYWSMKHBVDN") for s in seqs)
    return L.equal_rates() if dna else protein or L.equal_rates(L.PROTEIN)


def with_model(estimator: Callable, protein: L.Model) -> TreeEstimator:
    """The estimator with an amino-acid model of its own."""
    return partial(estimator, protein=protein)


def distance_matrix(names: list[str], seqs: list[str], protein: L.Model | None = None) -> np.ndarray:
    model, n = _model(seqs, protein), len(names)
    d = np.zeros((n, n))
    for i in range(n):
        for j in range(i):
            d[i, j] = d[j, i] = L.ml_distance(seqs[i], seqs[j], model)[0]
    return d


def by_neighbour_joining(names: list[str], seqs: list[str], protein: L.Model | None = None) -> tuple[newick.Tree, float | None]:
    tree = treeops.neighbour_joining(distance_matrix(names, seqs, protein), names)
    return tree, L.log_likelihood(tree, dict(zip(names, seqs)), _model(seqs, protein))


def by_average_linkage(names: list[str], seqs: list[str], protein: L.Model | None = None) -> tuple[newick.Tree, float | None]:
    tree = treeops.average_linkage(distance_matrix(names, seqs, protein), names)
    return tree, L.log_likelihood(tree, dict(zip(names, seqs)), _model(seqs, protein))


def by_likelihood(names: list[str], seqs: list[str], protein: L.Model | None = None) -> tuple[newick.Tree, float | None]:
    """The neighbour-joining topology with most likely lengths."""
    tree = treeops.neighbour_joining(distance_matrix(names, seqs, protein), names)
    return tree, L.fit_lengths(tree, dict(zip(names, seqs)), _model(seqs, protein), rounds=1)


def _jobs(rows: DataFrame, *key: str) -> DataFrame:
    """Rows dealt by key to as many tasks as the session shuffles to: jobs are long however few bytes they are, so they aren't merged into fewer tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def _gathered(seqs: DataFrame, key: str) -> DataFrame:
    rows = _jobs(seqs.select(F.col(key).cast("string").alias(key), "taxon", "seq"), key)
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("taxon", "seq"))).alias("rows"))


def estimate_trees(seqs: DataFrame, estimator: TreeEstimator = by_neighbour_joining, key: str = "locus") -> DataFrame:
    """(locus, newick, lnl) of every locus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows in batch.column(1).to_pylist():
                tree, lnl = estimator([r["taxon"] for r in rows], [r["seq"] for r in rows])
                out.append((newick.write(tree), lnl))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([v for _, v in out], pa.float64())], names=[key, "newick", "lnl"])

    return _gathered(seqs, key).mapInArrow(run, f"{key} string, newick string, lnl double")


def ml_distances(seqs: DataFrame, rates: list[float] = (1.0,), protein: L.Model | None = None) -> DataFrame:
    """(locus, a, b, distance, variance) of every two sequences of a locus."""
    a = seqs.select("locus", F.col("taxon").alias("a"), F.col("seq").alias("x"))
    b = seqs.select("locus", F.col("taxon").alias("b"), F.col("seq").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [L.ml_distance(x, y, _model([x, y], protein), np.array(rates)) for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array([t for t, _ in out], pa.float64()), pa.array([v for _, v in out], pa.float64())], names=["locus", "a", "b", "distance", "variance"])

    return _jobs(a.join(b, "locus").where("a < b").select("locus", "a", "b", "x", "y"), "locus", "a", "b").mapInArrow(run, "locus string, a string, b string, distance double, variance double")


def site_scores(seqs: DataFrame, trees: DataFrame, key: str = "locus", protein: L.Model | None = None) -> DataFrame:
    """(locus, newick's key as tree, lnl): the likelihood of each locus's sequences under each tree given for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                data = {r["taxon"]: r["seq"] for r in rows}
                tree = newick.restricted(newick.parse(text), set(data))
                out.append(L.log_likelihood(tree, data, _model(list(data.values()), protein)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=[key, "tree", "lnl"])

    return _jobs(_gathered(seqs, key).join(trees, key).select(key, "tree", "rows", "newick"), key, "tree").mapInArrow(run, f"{key} string, tree string, lnl double")


def simulate(trees: DataFrame, columns: int, seed: int, model: Callable[[], L.Model] = L.equal_rates) -> DataFrame:
    """(tree_id, taxon, seq) evolved along each (tree_id, newick)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model()
        for batch in batches:
            rows = []
            for tree_id, text, s in zip(*(batch.column(k).to_pylist() for k in range(3))):
                made = L.simulate(newick.parse(text), columns, own, np.random.default_rng(s & 0x7FFFFFFF))
                rows += [(tree_id, n, q) for n, q in made.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.int64(), pa.string(), pa.string()))], names=["tree_id", "taxon", "seq"])

    return trees.select("tree_id", "newick", F.xxhash64(F.lit(seed), "tree_id")).mapInArrow(run, "tree_id long, taxon string, seq string")


KINDS = {"iterative": treeops.iterative_random, "yule": treeops.yule, "coalescent": treeops.coalescent}


def random_trees(spark, n: int, names: list[str], seed: int, kind: str = "yule") -> DataFrame:
    """(tree_id, newick) of n random trees."""
    make = KINDS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [newick.write(make(names, np.random.default_rng(s & 0x7FFFFFFF))) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["tree_id", "newick"])

    return spark.range(n).select(F.col("id").alias("tree_id"), F.xxhash64(F.lit(seed), "id")).mapInArrow(run, "tree_id long, newick string")


def simulate_classes(spark, classes: int, genes: int, names: list[str], seed: int, change: str = "interchange", steps: int = 2) -> DataFrame:
    """(gene, class, newick): a master tree, a changed tree for each class, and genes with rates from 2/3 to 4/3 of it.

    A row is a gene; its class's tree and its rate come from seeds of the class and the gene, so any task can make it.
    """
    move = {"interchange": treeops.nearest_interchange, "regraft": treeops.prune_and_regraft, "transfer": treeops.lateral_transfer, "sorting": treeops.incomplete_sorting}[change]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        master, made = treeops.yule(names, np.random.default_rng(seed)), {}
        for batch in batches:
            out = []
            for g, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if c not in made:
                    rng, tree = np.random.default_rng([seed, c]), master
                    for _ in range(steps):
                        tree = move(tree, rng)
                    made = {c: tree}
                gene, rate = made[c].copy(), np.random.default_rng([seed, c, g]).uniform(2 / 3, 4 / 3)
                gene.length = [None if x is None else x * rate for x in gene.length]
                out.append(newick.write(gene))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["gene", "class", "newick"])

    return spark.range(classes * genes).select(F.col("id").alias("gene"), F.floor(F.col("id") / genes).alias("class")).mapInArrow(run, "gene long, class long, newick string")


def squares_scores(problems: DataFrame, trees: DataFrame) -> DataFrame:
    """(tree_id, score, lnl): squared errors of patristic (tree_id, a, b, d) against (family, a, b, dist, var)."""
    e = problems.join(trees, ["a", "b"])
    sq = (F.col("d") - F.col("dist")) * (F.col("d") - F.col("dist")) / F.col("var")
    return e.groupBy("tree_id").agg(F.sum(sq).alias("score"), (F.lit(-0.5) * F.sum(sq + F.ln(2 * F.pi() * F.col("var")))).alias("lnl"))


def search_problems(problems: DataFrame, guides: DataFrame, rounds: int = 50) -> DataFrame:
    """(problem, newick, score, lnl): the least-squares tree of each problem, searched from its guide tree.

    ``problems`` is (problem, family, a, b, dist, var), ``guides`` (problem, newick); a problem is one job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rows, guide in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                families: dict = {}
                for r in rows:
                    families.setdefault(r["family"], []).append(r)
                made = []
                for own in families.values():
                    names = sorted({x for r in own for x in (r["a"], r["b"])})
                    at = {x: k for k, x in enumerate(names)}
                    d, v = np.zeros((len(names), len(names))), np.ones((len(names), len(names)))
                    for r in own:
                        i, j = at[r["a"]], at[r["b"]]
                        d[i, j] = d[j, i] = r["dist"]
                        v[i, j] = v[j, i] = r["var"]
                    made.append((names, d, v))
                tree, score = L.search_squares(treeops.unrooted(newick.parse(guide)), made, rounds)
                out.append((newick.write(tree), score, L.squares_lnl(tree, made)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.string(), pa.float64(), pa.float64())))], names=["problem", "newick", "score", "lnl"])

    own = problems.groupBy("problem").agg(F.array_sort(F.collect_list(F.struct("family", "a", "b", "dist", "var"))).alias("rows"))
    return own.join(guides, "problem").select(F.col("problem").cast("string"), "rows", "newick").mapInArrow(run, "problem string, newick string, score double, lnl double")

"""Trees as tables: nodes, splits, and distances between trees as joins.

A tree is parsed once. Its splits (tree_id, clade, length, is_leaf) are the unrooted bipartitions, named by
the sorted leaves of the side without the smallest leaf; equal ones of a tree are added up. RF, weighted RF
and branch-length distances are joins of splits; only the geodesic, which needs an irregular search a pair,
runs in Python, on arrays of splits that meet in a pair join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sylvan.functions import geodesic as G, newick
from sylvan.operators.pairs import every_pair
from sylvan.session import cut

NODES = "tree_id long, node_id int, parent_id int, label string, length double, support double, is_leaf boolean, preorder int, depth int"


def parse_newick(trees: DataFrame) -> DataFrame:
    """The nodes of (tree_id, newick)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = newick.parse(text)
                deep = {0: 0}
                for place, k in enumerate(t.preorder()):
                    if k:
                        deep[k] = deep[t.parent[k]] + 1
                    rows.append((tree_id, k, t.parent[k] if k else None, t.label[k], t.length[k], t.support[k], not t.children[k], place, deep[k]))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.int32(), pa.int32())
            names = ("tree_id", "node_id", "parent_id", "label", "length", "support", "is_leaf", "preorder", "depth")
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, kinds)], names=list(names))

    return trees.select("tree_id", "newick").mapInArrow(run, NODES)


def splits(trees: DataFrame) -> DataFrame:
    """(tree_id, clade, length, is_leaf) of (tree_id, newick)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = newick.parse(text)
                n = len(t.leaves())
                rows += [(tree_id, sorted(s), v, len(s) in (1, n - 1)) for s, v in newick.splits(t).items()]
            kinds = (pa.int64(), pa.list_(pa.string()), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["tree_id", "clade", "length", "is_leaf"])

    return trees.select("tree_id", "newick").mapInArrow(run, "tree_id long, clade array<string>, length double, is_leaf boolean")


def leaf_sets(split_table: DataFrame) -> DataFrame:
    """(tree_id, leaves, n): leaves are those of all splits and the smallest one, which a leaf split's complement names."""
    return split_table.select("tree_id", F.explode("clade").alias("leaf")).distinct().groupBy("tree_id").agg(F.array_sort(F.collect_list("leaf")).alias("leaves"), F.count("*").alias("n"))


def pair_distances(split_table: DataFrame, leaves: int | Column = 0) -> DataFrame:
    """(a, b, rf, rf_norm, wrf, wrf_norm, euc, euc_norm) for every pair of trees on the same leaves.

    No full outer join is needed: with S = shared splits, the union's sums follow from each tree's totals
    and the sums over S. Only shared splits are joined, on the split itself, so the shuffle is of splits,
    not of pairs times splits; the totals are joined to the pairs after.
    """
    s = split_table.select("tree_id", F.array_join("clade", "\x1f").alias("key"), "length", "is_leaf")
    totals = cut(s.groupBy("tree_id").agg(F.sum(F.when(~F.col("is_leaf"), 1).otherwise(0)).alias("inner"), F.sum("length").alias("sum"), F.sum(F.col("length") * F.col("length")).alias("sq")))
    a, b = s.alias("a"), s.alias("b")
    both = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.tree_id") < F.col("b.tree_id")))
    x, y = F.col("a.length"), F.col("b.length")
    both = both.groupBy(F.col("a.tree_id").alias("i"), F.col("b.tree_id").alias("j")).agg(
        F.sum(F.when(~F.col("a.is_leaf"), 1).otherwise(0)).alias("common"),
        F.sum(F.abs(x - y) - x - y).alias("abs"),
        F.sum((x - y) * (x - y) - x * x - y * y).alias("cross"),
    )
    pairs = every_pair(totals, "tree_id").select(*[F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in totals.columns])
    pairs = pairs.join(both, (F.col("tree_id_a") == F.col("i")) & (F.col("tree_id_b") == F.col("j")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rf = (F.col("inner_a") + F.col("inner_b") - 2 * zero(F.col("common"))).cast("double")
    wrf = F.col("sum_a") + F.col("sum_b") + zero(F.col("abs"))
    euc = F.sqrt(F.greatest(F.col("sq_a") + F.col("sq_b") + zero(F.col("cross")), F.lit(0.0)))
    norm = lambda d, by: F.coalesce(F.try_divide(d, by), F.lit(0.0))
    return pairs.select(
        F.col("tree_id_a").alias("a"), F.col("tree_id_b").alias("b"),
        rf.alias("rf"), norm(rf, F.col("inner_a") + F.col("inner_b")).alias("rf_norm"),
        wrf.alias("wrf"), norm(wrf, F.col("sum_a") + F.col("sum_b")).alias("wrf_norm"),
        euc.alias("euc"), norm(euc, F.sqrt("sq_a") + F.sqrt("sq_b")).alias("euc_norm"),
    )


METRICS = {"geo": lambda a, b, n, norm: G.geodesic(a, b, norm), "euc": lambda a, b, n, norm: G.euclidean(a, b, norm), "wrf": lambda a, b, n, norm: G.weighted_rf(a, b, norm), "rf": G.robinson_foulds}


def tree_distances(trees: DataFrame, metric: str = "geo", normalise: bool = False, min_overlap: int = 4, fail_value: float = 0.0) -> DataFrame:
    """(i, j, d) for every pair of (tree_id, newick), on the leaves two trees share.

    Pairs with fewer than ``min_overlap`` shared leaves get ``fail_value``. Trees are parsed to arrays of
    splits once. If all trees have the same leaves, all metrics but the geodesic are joins of shared splits;
    otherwise, and for the geodesic, pairs of trees meet group by group and each pair is worked out by itself.
    """
    if metric not in METRICS:
        raise ValueError(f"{metric} is none of {sorted(METRICS)}")
    measure = METRICS[metric]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = newick.parse(text)
                s = newick.splits(t)
                rows.append((tree_id, sorted(t.labels()), [sorted(k) for k in s], list(s.values())))
            kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, kinds)], names=["tree_id", "leaves", "sides", "lengths"])

    rows = cut(trees.select("tree_id", "newick").mapInArrow(parse, "tree_id long, leaves array<string>, sides array<array<string>>, lengths array<double>"))
    kinds = rows.select("leaves").distinct().limit(2).collect() if metric != "geo" else []
    if len(kinds) == 1 and len(set(kinds[0][0])) >= min_overlap:
        n = len(kinds[0][0])
        table = rows.select("tree_id", F.explode(F.arrays_zip(F.col("sides").alias("clade"), F.col("lengths").alias("length"))).alias("s")).select("tree_id", "s.clade", "s.length")
        found = pair_distances(table.withColumn("is_leaf", F.size("clade").isin(1, n - 1)))
        return found.select(F.col("a").alias("i"), F.col("b").alias("j"), F.col(f"{metric}_norm" if normalise else metric).alias("d"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for la, sa, va, lb, sb, vb in zip(*(batch.column(k).to_pylist() for k in range(2, 8))):
                a, b = ({frozenset(k): v for k, v in zip(s, vs)} for s, vs in ((sa, va), (sb, vb)))
                on = G.on_common(a, b, frozenset(la), frozenset(lb), min_overlap)
                out.append(fail_value if on is None else measure(on[0], on[1], on[2], normalise))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["i", "j", "d"])

    names = [(x, c) for x in "ab" for c in ("leaves", "sides", "lengths")]
    met = every_pair(rows, "tree_id", 16).select(F.col("a.tree_id").alias("i"), F.col("b.tree_id").alias("j"), *[F.col(f"{x}.{c}").alias(f"{c}_{x}") for x, c in names])
    return met.mapInArrow(run, "i long, j long, d double")


def pruned(split_table: DataFrame, keep: DataFrame) -> DataFrame:
    """Splits on the leaves kept, (tree_id, keep array): what falls together is added up, without tree surgery."""
    rows = split_table.join(keep, "tree_id").withColumn("low", F.array_min("keep"))
    side = F.array_sort(F.array_intersect("clade", "keep"))
    rows = rows.withColumn("side", F.when(F.array_contains(side, F.col("low")), F.array_sort(F.array_except("keep", side))).otherwise(side))
    rows = rows.where((F.size("side") > 0) & (F.size("side") < F.size("keep")))
    n = F.max(F.size("keep"))
    out = rows.groupBy("tree_id", F.col("side").alias("clade")).agg(F.sum("length").alias("length"), n.alias("n"))
    return out.select("tree_id", "clade", "length", ((F.size("clade") == 1) | (F.size("clade") == F.col("n") - 1)).alias("is_leaf"))


def overlaps(leaves: DataFrame, min_overlap: int = 4) -> DataFrame:
    """(a, b, common, different, ok) for pairs of (tree_id, leaves)."""
    met = every_pair(leaves.select("tree_id", "leaves"), "tree_id")
    rows = met.select(F.col("a.tree_id").alias("a"), F.col("b.tree_id").alias("b"), F.col("a.leaves").alias("x"), F.col("b.leaves").alias("y")).withColumn("common", F.size(F.array_intersect("x", "y")))
    different = F.size("x") + F.size("y") - 2 * F.col("common")
    return rows.select("a", "b", "common", different.alias("different"), (F.col("common") >= min_overlap).alias("ok"))


def patristic(clades: DataFrame, leaves: DataFrame) -> DataFrame:
    """(tree_id, a, b, d): path length between two leaves, the sum of the edges that part them.

    With p(x) the length of all edges over x and q(a, b) that of the edges over both, d = p(a) + p(b) - 2 q.
    ``clades`` holds (tree_id, clade, length) of all edges of a rooted tree.
    """
    inside = clades.select("tree_id", "clade", "length", F.explode("clade").alias("a"))
    p = inside.groupBy("tree_id", "a").agg(F.sum("length").alias("p"))
    both = inside.select("tree_id", "a", "length", F.explode("clade").alias("b")).where("a < b").groupBy("tree_id", "a", "b").agg(F.sum("length").alias("q"))
    x = leaves.select("tree_id", F.explode("leaves").alias("a"), "leaves")
    pairs = x.select("tree_id", "a", F.explode("leaves").alias("b")).where("a < b")
    rows = pairs.join(p, ["tree_id", "a"]).join(p.select("tree_id", F.col("a").alias("b"), F.col("p").alias("p2")), ["tree_id", "b"]).join(both, ["tree_id", "a", "b"], "left")
    return rows.select("tree_id", "a", "b", (F.col("p") + F.col("p2") - 2 * F.coalesce("q", F.lit(0.0))).alias("d"))


def kendall_colijn(clades: DataFrame, leaves: DataFrame) -> DataFrame:
    """(tree_id, a, b, m, length): edges and length from the root to where a and b meet.

    Leaves come as (a, a) with one edge and their own edge's length. Inner edges over both leaves are counted.
    """
    inner = clades.where("not is_leaf").select("tree_id", "clade", "length", F.explode("clade").alias("a"))
    both = inner.select("tree_id", "a", "length", F.explode("clade").alias("b")).where("a < b").groupBy("tree_id", "a", "b").agg(F.count("*").alias("m"), F.sum("length").alias("length"))
    x = leaves.select("tree_id", F.explode("leaves").alias("a"), "leaves")
    pairs = x.select("tree_id", "a", F.explode("leaves").alias("b")).where("a < b")
    rows = pairs.join(both, ["tree_id", "a", "b"], "left").select("tree_id", "a", "b", F.coalesce("m", F.lit(0)).alias("m"), F.coalesce("length", F.lit(0.0)).alias("length"))
    own = clades.where("is_leaf").select("tree_id", F.get("clade", F.lit(0)).alias("a"), F.get("clade", F.lit(0)).alias("b"), F.lit(1).cast("long").alias("m"), "length")
    return rows.select("tree_id", "a", "b", F.col("m").cast("long").alias("m"), "length").union(own)


def kendall_colijn_distances(vectors: DataFrame, weight: float = 0.5) -> DataFrame:
    """(i, j, d): Euclidean distance of (1 - weight) m + weight length over the leaf pairs."""
    v = vectors.select("tree_id", "a", "b", ((1 - weight) * F.col("m") + weight * F.col("length")).alias("v"))
    x, y = v.alias("x"), v.alias("y")
    both = x.join(y, (F.col("x.a") == F.col("y.a")) & (F.col("x.b") == F.col("y.b")) & (F.col("x.tree_id") < F.col("y.tree_id")))
    e = F.col("x.v") - F.col("y.v")
    return both.groupBy(F.col("x.tree_id").alias("i"), F.col("y.tree_id").alias("j")).agg(F.sqrt(F.sum(e * e)).alias("d"))


def scaled(split_table: DataFrame, factor: float) -> DataFrame:
    return split_table.withColumn("length", F.col("length") * factor)


def stripped(split_table: DataFrame) -> DataFrame:
    return split_table.withColumn("length", F.lit(None).cast("double"))


def translated(split_table: DataFrame, names: dict[str, str]) -> DataFrame:
    """Leaves renamed; names that aren't in the table stay."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return split_table.withColumn("clade", F.array_sort(F.transform("clade", lambda c: F.coalesce(table[c], c))))


def multifurcated(split_table: DataFrame, threshold: float = 1e-6) -> DataFrame:
    """Without inner edges that are no longer than the threshold."""
    return split_table.where(F.col("is_leaf") | (F.col("length") > threshold))


def apply_to_trees(trees: DataFrame, change, column: str = "newick") -> DataFrame:
    """(tree_id, newick) with ``change(tree, seed)`` applied to each tree; the seed is the tree's own.

    The seed is a hash of tree_id, so a task that runs again makes the same tree.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, seeds = (batch.column(k).to_pylist() for k in range(3))
            out = [newick.write(change(newick.parse(t), s & 0x7FFFFFFF)) for t, s in zip(texts, seeds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["tree_id", "newick"])

    return trees.select("tree_id", column, F.xxhash64("tree_id").alias("seed")).mapInArrow(run, "tree_id long, newick string")

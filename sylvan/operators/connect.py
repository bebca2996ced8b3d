"""Connected components, connectivity tests and flat cuts that rest on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sylvan.operators import blocks
from sylvan.operators.pairs import symmetrised
from sylvan.session import cut, free


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of (a, b); label is the smallest node of its component.

    Each round a node takes the smallest label among its own and its neighbours', then its label's label,
    so the number of rounds grows with the logarithm of the longest path. All joins are on written
    tables with an exchange on both sides, so a node with very many links is split by the skew join; the
    minimum over neighbours is pre-aggregated before its exchange. Nothing but a count reaches the driver.
    """
    links = links.select("a", "b").where("a is not null and b is not null and a <> b")
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(links.select(F.explode(ways).alias("e")).select("e.*").distinct())
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label")))
    for _ in range(most_rounds):
        near = edges.join(labels.select(F.col("node").alias("a"), "label"), "a").groupBy("b").agg(F.min("label").alias("near"))
        step = cut(labels.join(near.withColumnRenamed("b", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("above"))
        last, labels = labels, cut(step.join(jump, "label").select("node", "was", F.least("label", "above").alias("label")))
        free(last, step)
        if labels.where("was <> label").isEmpty():
            free(edges)
            return labels.select("node", "label")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) for every node, those without links labelled by themselves."""
    own = components(links).withColumnRenamed("label", "_l")
    return nodes.join(own, "node", "left").select("node", F.coalesce("_l", "node").alias("label"))


def is_connected(nodes: DataFrame, mask: DataFrame) -> bool:
    """Whether all nodes hang together over the mask's (i, j) with keep true."""
    found = labelled(nodes, mask.where("keep").select(F.col("i").alias("a"), F.col("j").alias("b")))
    return found.select("label").distinct().limit(2).count() < 2


def single_linkage_cut(nodes: DataFrame, dm: DataFrame, height: float) -> DataFrame:
    """Groups of single-linkage clustering cut at a height: components of the pairs no further apart."""
    return labelled(nodes, dm.where(F.col("d") <= height).select(F.col("i").alias("a"), F.col("j").alias("b")))


def dbscan(nodes: DataFrame, dm: DataFrame, eps: float = 0.75, least: int = 3) -> DataFrame:
    """(node, label): density clustering on distances; a node counts itself, noise is one group, -1.

    A border node joins the cluster of its nearest core node, ties to the smaller node.
    """
    near = dm.where(F.col("d") <= eps)
    both = cut(symmetrised(near))
    core = cut(both.groupBy("i").agg((F.count("*") + 1).alias("n")).where(F.col("n") >= least).select(F.col("i").alias("node"))) if least > 1 else nodes
    c = core.withColumnRenamed("node", "j")
    to_core = cut(both.join(c, "j"))
    inner = to_core.join(core.withColumnRenamed("node", "i"), "i")
    label = cut(labelled(core, inner.select(F.col("i").alias("a"), F.col("j").alias("b"))))
    border = to_core.join(core.withColumnRenamed("node", "i"), "i", "left_anti").groupBy("i").agg(F.min(F.struct("d", "j")).alias("m"))
    border = border.select(F.col("i").alias("node"), F.col("m.j").alias("via")).join(label.withColumnRenamed("node", "via"), "via").select("node", "label")
    return nodes.join(cut(label).union(cut(border)), "node", "left").select("node", F.coalesce("label", F.lit(-1).cast("long")).alias("label"))


def single_linkage_points(points: DataFrame, height: float) -> DataFrame:
    """``single_linkage_cut`` of the distances of (id, x), which aren't made into rows."""
    return labelled(points.select(F.col("id").alias("node")), blocks.forest(blocks.packed(points), height))


def dbscan_points(points: DataFrame, eps: float = 0.75, least: int = 3) -> DataFrame:
    """``dbscan`` of the distances of (id, x), which aren't made into rows."""
    nodes = points.select(F.col("id").alias("node"))
    core = cut(blocks.reached(blocks.packed(points), eps, least - 1)) if least > 1 else nodes
    dense = blocks.packed(points.join(core.withColumnRenamed("node", "id"), "id"))
    rest = blocks.packed(points.join(core.withColumnRenamed("node", "id"), "id", "left_anti"))
    label = cut(labelled(core, blocks.forest(dense, eps)))
    border = blocks.nearest_of(rest, dense, eps).join(label.withColumnRenamed("node", "via"), "via").select("node", "label")
    return nodes.join(label.union(cut(border)), "node", "left").select("node", F.coalesce("label", F.lit(-1).cast("long")).alias("label"))

"""Likelihood tables (elem, grp, lnl), classification steps, and the bookkeeping of scoring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sylvan.session import cut


def probabilities(lk: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """(elem, grp, p): soft-max over the groups of each element, shifted by the row's maximum."""
    rows = lk if prior is None else lk.join(prior, "grp").withColumn("lnl", F.col("lnl") + F.col("log_p"))
    w = W.partitionBy("elem")
    shifted = rows.withColumn("e", F.exp(F.col("lnl") - F.max("lnl").over(w)))
    return shifted.select("elem", "grp", (F.col("e") / F.sum("e").over(w)).alias("p"))


def row_powers(probs: DataFrame, amount: float) -> DataFrame:
    """Rows scaled to sum to 1, to the power 1 / amount."""
    share = F.try_divide(F.col("p"), F.sum("p").over(W.partitionBy("elem")))
    return probs.select("elem", "grp", F.pow(share, F.lit(1.0 / amount)).alias("p"))


def assigned(probs: DataFrame) -> DataFrame:
    """(elem, grp): the most probable group, ties to the smaller; one pre-aggregated maximum."""
    best = F.max(F.struct("p", (-F.col("grp")).alias("g"))).alias("b")
    return probs.groupBy("elem").agg(best).select("elem", (-F.col("b.g")).alias("grp"))


def drawn(probs: DataFrame, seed: int) -> DataFrame:
    """(elem, grp): a group drawn by the row's probabilities, by a hash of (seed, elem)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "elem"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    w = W.partitionBy("elem").orderBy("grp")
    rows = probs.withColumn("c", F.sum("p").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("t", F.sum("p").over(W.partitionBy("elem"))).withColumn("u", u)
    return rows.where(F.col("c") >= F.col("u") * F.col("t")).groupBy("elem").agg(F.min("grp").alias("grp"))


def log_proportions(part: DataFrame) -> DataFrame:
    n = part.groupBy("grp").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select("grp", F.ln(F.col("n") / F.col("t")).alias("log_p"))


def repaired(part: DataFrame, probs: DataFrame, groups: int) -> DataFrame:
    """The partition with every empty group given its most probable element from a group of more than one.

    The number of groups is small; each repair is one query over the table.
    """
    part = cut(part)
    have = {r["grp"] for r in part.select("grp").distinct().collect()}
    for k in sorted(set(range(groups)) - have):
        sizes = part.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp")
        pick = probs.where(F.col("grp") == k).select("elem", "p").join(part.join(sizes, "grp").select("elem"), "elem").orderBy(F.col("p").desc(), "elem").limit(1).collect()
        if pick:
            part = cut(part.withColumn("grp", F.when(F.col("elem") == pick[0]["elem"], F.lit(k)).otherwise(F.col("grp"))))
    return part


def changed_elements(old: DataFrame, new: DataFrame) -> DataFrame:
    """(elem) of the groups, given by their members, that the new partition has and the old hasn't."""
    key = F.sha1(F.array_join(F.transform("members", lambda x: x.cast("string")), ","))
    return new.withColumn("key", key).join(old.select(key.alias("key")), "key", "left_anti").select(F.explode("members").alias("elem")).distinct()


def group_key(members: Column) -> Column:
    """A content address of a group: the hash of its sorted members."""
    return F.sha1(F.array_join(F.transform(F.array_sort(members), lambda x: x.cast("string")), ","))


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What has no result yet."""
    return work.join(done, key, "left_anti")


def partition_score(group_scores: DataFrame) -> DataFrame:
    """(score) of a partition: the sum over its groups, null while any is missing."""
    return group_scores.agg(F.when(F.count("*") == F.count("lnl"), F.sum("lnl")).alias("score"))


def likelihood_distances(lk: DataFrame, own: DataFrame) -> DataFrame:
    """(i, j, d), i < j, of groups: -1/2 (S + S') where S is the mean likelihood of i's members under j, less that under i."""
    s = cut(lk.join(own, "elem").groupBy("own", "grp").agg(F.avg("lnl").alias("m")))
    diagonal = s.where("own = grp").select("own", F.col("m").alias("self"))
    v = cut(s.join(diagonal, "own").select("own", "grp", (F.col("m") - F.col("self")).alias("v")))
    back = v.select(F.col("grp").alias("own"), F.col("own").alias("grp"), F.col("v").alias("w"))
    return v.join(back, ["own", "grp"]).where("own < grp").select(F.col("own").alias("i"), F.col("grp").alias("j"), (-0.5 * (F.col("v") + F.col("w"))).alias("d"))


def cumulative_share(values: DataFrame) -> DataFrame:
    """(dim, share): running share of (dim, value) from the largest value down; negatives count as 0."""
    v = values.withColumn("v", F.greatest("value", F.lit(0.0)))
    w = W.orderBy(F.col("v").desc(), "dim").rowsBetween(W.unboundedPreceding, 0)
    total = v.agg(F.sum("v").alias("t"))
    return v.crossJoin(F.broadcast(total)).select("dim", F.try_divide(F.sum("v").over(w), F.col("t")).alias("share"))


def maximise(part: DataFrame, table: Callable[[DataFrame], DataFrame], groups: int, rounds: int = 20, soft: bool = False, seed: int = 0) -> tuple[DataFrame, list[float]]:
    """Classification EM: likelihood table of the partition's groups, probabilities, classes, until nothing changes.

    ``table(part)`` refits the groups and gives (elem, grp, lnl). Every round is written, so lineage stays
    short and a lost executor costs one round at most. Returns the partition and each round's score.
    """
    part, scores = cut(part), []
    for k in range(rounds):
        lk = cut(table(part))
        probs = cut(probabilities(lk, log_proportions(part)))
        new = repaired(drawn(probs, seed + k) if soft else assigned(probs), probs, groups)
        scores.append(lk.join(part, ["elem", "grp"]).agg(F.sum("lnl")).first()[0] or 0.0)
        same = new.join(part.withColumnRenamed("grp", "was"), "elem").where("grp <> was").isEmpty()
        part = new
        if same:
            break
    return part, scores

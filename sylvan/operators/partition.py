"""Partitions of elements into groups: canonical labels, comparison, quality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sylvan.operators.prefix import running


def canonical(labels: DataFrame) -> DataFrame:
    """(elem, grp): groups numbered from 0 by their first element (restricted growth notation).

    The dense rank is a running count over ranges of one row a group, pre-aggregated, not over the elements.
    """
    first = labels.groupBy("label").agg(F.min("elem").alias("first"), F.lit(1).alias("one"))
    rank = running(first, ["first"], {"grp": "one"}).select("label", F.col("grp").cast("int").alias("grp"))
    return labels.join(rank, labels["label"].eqNullSafe(rank["label"])).select("elem", "grp")


def membership(part: DataFrame) -> DataFrame:
    """(grp, members): sorted elements of each group."""
    return part.groupBy("grp").agg(F.array_sort(F.collect_list("elem")).alias("members"))


def from_membership(groups: DataFrame) -> DataFrame:
    """(elem, grp) from rows of member arrays."""
    return canonical(groups.select(F.explode("members").alias("elem"), F.col("grp").alias("label")))


def statistics(part: DataFrame) -> DataFrame:
    """One row: groups, elements, whether all in one group, whether each in its own."""
    g = part.groupBy("grp").count().agg(F.count("*").alias("num_groups"), F.coalesce(F.sum("count"), F.lit(0)).alias("num_elements"))
    return g.select("num_groups", "num_elements", (F.col("num_groups") == 1).alias("is_minimal"), (F.col("num_groups") == F.col("num_elements")).alias("is_maximal"))


def _entropy(counts: DataFrame, name: str) -> DataFrame:
    total = F.sum("n")
    # -sum p log2 p = log2 N - (sum n log2 n) / N
    return counts.agg((F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias(name))


def entropies(pairs: DataFrame) -> DataFrame:
    """One row (h1, h2, mi, nmi, vi) in bits for elements labelled twice (g1, g2)."""
    joint = pairs.groupBy("g1", "g2").agg(F.count("*").alias("n"))
    h1 = _entropy(joint.groupBy("g1").agg(F.sum("n").alias("n")), "h1")
    h2 = _entropy(joint.groupBy("g2").agg(F.sum("n").alias("n")), "h2")
    both = h1.crossJoin(h2).crossJoin(_entropy(joint, "h12")).withColumn("mi", F.col("h1") + F.col("h2") - F.col("h12"))
    nmi = F.when(F.col("h1") + F.col("h2") == 0, F.lit(1.0)).otherwise(F.try_divide(2 * F.col("mi"), F.col("h1") + F.col("h2")))
    return both.select("h1", "h2", "mi", nmi.alias("nmi"), (F.col("h1") + F.col("h2") - 2 * F.col("mi")).alias("vi"))


def silhouettes(square: DataFrame, part: DataFrame) -> DataFrame:
    """(elem, grp, neighbour, score): (b - a) / max(a, b); alone in its group 0, ties to the smaller group.

    Two levels of aggregation: mean distance to each group, then the nearest other one.
    """
    p = part.select(F.col("elem").alias("j"), F.col("grp").alias("to"))
    own = part.select(F.col("elem").alias("i"), "grp")
    to = square.where("i <> j").join(p, "j").groupBy("i", "to").agg(F.avg("d").alias("m")).join(own, "i")
    best = to.groupBy("i", "grp").agg(F.max(F.when(F.col("to") == F.col("grp"), F.col("m"))).alias("a"), F.min(F.when(F.col("to") != F.col("grp"), F.struct("m", "to"))).alias("b"))
    s = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b.m") - F.col("a"), F.greatest("a", "b.m")), F.lit(0.0)))
    return best.select(F.col("i").alias("elem"), "grp", F.col("b.to").alias("neighbour"), s.alias("score"))


def kelley_penalty(dm: DataFrame, partitions: DataFrame) -> DataFrame:
    """(k, spread, penalty) for partitions (k, elem, grp) with 1 < k < n.

    Spread of a group is the sum of its pair distances over n (n - 1) / 2, n counting all elements;
    a partition's is the mean over groups of more than one. The penalty is the spread scaled to
    [1, n - 1] over the partitions, plus k.
    """
    p = partitions.select("k", F.col("elem").alias("i"), "grp")
    q = partitions.select("k", F.col("elem").alias("j"), F.col("grp").alias("h"))
    n = partitions.select("elem").distinct().agg(F.count("*").alias("n"))
    inside = dm.join(p, "i").join(q, ["k", "j"]).where("grp = h").groupBy("k", "grp").agg(F.sum("d").alias("s"))
    return penalties(inside, n)


def penalties(inside: DataFrame, n: DataFrame) -> DataFrame:
    """(k, spread, penalty) from the sums (k, grp, s) of each group and the number n of elements, one row."""
    spread = inside.groupBy("k").agg(F.avg("s").alias("s")).crossJoin(F.broadcast(n)).where("k > 1 and k < n").select("k", "n", (F.col("s") / (F.lit(0.5) * F.col("n") * (F.col("n") - 1))).alias("spread"))
    ends = spread.agg(F.min("spread").alias("lo"), F.max("spread").alias("hi"))
    norm = F.coalesce(F.try_divide(F.col("n") - 2, F.col("hi") - F.col("lo")), F.lit(0.0)) * (F.col("spread") - F.col("lo")) + 1
    return spread.crossJoin(F.broadcast(ends)).select("k", "spread", (norm + F.col("k")).alias("penalty"))


def information_criteria(lnl: Column, k: Column, n: Column) -> dict[str, Column]:
    """AIC, AICc and BIC of a log likelihood with k parameters and n observations."""
    return {
        "aic": F.lit(-2.0) * lnl + F.lit(2.0) * k,
        "aicc": F.lit(-2.0) * lnl + F.try_divide(F.lit(2.0) * k * n, n - k - 1),
        "bic": F.lit(-2.0) * lnl + k * F.ln(n),
    }


def random_partition(size: int, groups: int, seed: int, alpha: float = 1.0, fill: bool = False) -> list[int]:
    """Canonical labels drawn from Dirichlet proportions; with ``fill`` every group gets a member."""
    rng = np.random.default_rng(seed)
    labels = rng.choice(groups, size=size, p=rng.dirichlet([alpha] * groups))
    if fill:
        labels[rng.permutation(size)[:groups]] = np.arange(groups)
    return growth(labels.tolist())


def random_labels(elements: DataFrame, groups: int, seed: int, alpha: float = 1.0, fill: bool = False) -> DataFrame:
    """(elem, grp), canonical: each of the elements (elem) drawn by a hash from Dirichlet proportions.

    With ``fill`` the ``groups`` elements of the least hashes get a group each, so none is empty.
    """
    bounds = np.cumsum(np.random.default_rng(seed).dirichlet([alpha] * groups))
    spot = F.pmod(F.xxhash64(F.lit(seed), "elem"), F.lit(1 << 53)) / F.lit(float(1 << 53))
    label = F.least(F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= spot)), F.lit(groups - 1))
    rows = elements.select("elem", label.alias("label"))
    if fill:
        first = [r[0] for r in elements.select("elem").orderBy(F.xxhash64(F.lit(seed + 1), "elem"), "elem").limit(groups).collect()]  # one for each group
        own = elements.sparkSession.createDataFrame(list(enumerate(first)), T.StructType([T.StructField("own", T.IntegerType()), T.StructField("elem", elements.schema["elem"].dataType)]))
        rows = rows.join(F.broadcast(own), "elem", "left").select("elem", F.coalesce("own", "label").alias("label"))
    return canonical(rows)


def growth(labels: list) -> list[int]:
    """Restricted growth notation of a short list of labels."""
    seen: dict = {}
    return [seen.setdefault(x, len(seen)) for x in labels]

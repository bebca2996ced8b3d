"""Mixing sources to target weights as a time-varying curriculum.

Every source has a weight and a weight *schedule* over training time t in [0, 1]. The integral of
the schedule is the source's cumulative word demand; a document's place in its source's word stream,
put through the inverse of that demand, is its training position, and the mix is the documents
range-sorted by position. A source that is asked for more words than it has is read again from its
start, up to ``cap`` times.

Scale. Words are counted where the text lies and only (key, source, size) take part in the prefix
sums. A source's stream order is a hash of doc_id and text, cut into ``4096`` equal ranges: totals per
(source, range) are pre-aggregated, offsets of ranges are summed over those few rows, and only the rows of
one range meet in a window, which keeps one running sum. A source, or a doc_id (null too), that holds a
third of all rows is thus spread over 4096 groups.

Defined results. Null text: size 0. Null source: a source of its own, after all others. Null doc_id:
ordered as the empty id. Very long texts: whole; only the one at the end of a stream is cut. Repeated rows:
each is a document of its own; rows alike in doc_id and text are interchangeable. A source without words
has target 0 and takes nothing. Empty table: no rows. Columns of the input, whatever their names, are
carried along untouched; one with the name of a column made here gives way to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sylvan.llm.columns import named, without
from sylvan.operators.prefix import running
from sylvan.session import cut

WORD = r"[^\x20\x09-\x0D]+"
_OWN = ("size", "source_size", "target", "taken", "positions", "position", "_ord", "_bucket", "_start", "_at", "_s", "_b", "_turn", "_spot")


def ramp(slope: float) -> list[tuple[float, float]]:
    """A schedule that goes from 1 - slope to 1 + slope; its integral over [0, 1] is 1."""
    return [(0.0, 1.0 - slope), (1.0, 1.0 + slope)]


def _segments(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """(t0, width, demand before, weight at t0, slope) of each piece, scaled to a total demand of 1."""
    if knots[0][0] != 0 or knots[-1][0] != 1 or any(w < 0 for _, w in knots):
        raise ValueError("a schedule runs from 0 to 1 with weights of at least 0")
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    if area <= 0:
        raise ValueError("a schedule needs some weight")
    out, done = [], 0.0
    for (t, w), (u, v) in zip(knots, knots[1:]):
        if u > t:
            out.append((t, u - t, done, w / area, (v - w) / area / (u - t)))
            done += (u - t) * (w + v) / 2 / area
    return out


def _when(knots: Sequence[tuple[float, float]], y: Column) -> Column:
    """The time at which the share y of a source's demand has been asked for."""
    at = None
    for t, width, before, w, slope in reversed(_segments(knots)):
        need = F.greatest(y - F.lit(before), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w * w) + F.lit(2 * slope) * need, F.lit(0.0)))
        here = F.lit(t) + F.least(F.lit(width), F.when(F.lit(w) + root > 0, F.lit(2.0) * need / (F.lit(w) + root)).otherwise(F.lit(width)))
        at = here if at is None else F.when(y < F.lit(before + width * (w + slope * width / 2)), here).otherwise(at)
    return at


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target, _turn) from (source, source_size).

    The targets are min(cap * size, level * weight) with the one level at which they sum to ``share``
    of all words; that is where resharing the excess over the caps ends. One row per source. Ranks and sums
    over sources are running totals over ranges, so there may be as many sources as documents.
    """
    n = len(weights)
    ranked = running(sizes.withColumn("_none", F.col("source").isNull()).withColumn("_one", F.lit(1).cast("long")), ["_none", "source"], {"_rank": "_one"})
    pick = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("_turn", (F.col("_rank") % n).cast("int")).withColumn("_w", F.element_at(pick, F.col("_turn") + 1)).withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    ranked = running(ranked.withColumn("_fill", F.col("_cap") / F.col("_w")), ["_fill", "_rank"], {"_full": "_cap", "_before": "_w"})
    ranked = cut(ranked)
    words, weight = ranked.agg(F.sum("source_size"), F.sum("_w")).first()
    level = (F.lit(float(words or 0) * float(share)) - F.col("_full")) / (F.lit(float(weight or 0)) - F.col("_before"))
    first = ranked.withColumn("_level", level).where(F.col("_level") <= F.col("_fill")).agg(F.min(F.struct("_fill", "_rank", "_level"))["_level"]).first()[0]
    target = F.col("_cap") if first is None else F.least("_cap", F.lit(first) * F.col("_w"))
    return ranked.select("source", "source_size", target.alias("target"), "_turn")


def plan_mix(
    docs: DataFrame,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    schedules: Sequence[Sequence[tuple[float, float]]] = (ramp(0.5), ramp(0.0), ramp(-0.5)),
    ranges: int = 4096,
) -> DataFrame:
    """The documents with ``size, source_size, target, taken`` and ``positions``, one per reading.

    ``weights`` and ``schedules`` repeat over the sources in code point order. ``taken`` is the part of
    the stream [0, target) that falls on the document, over all readings, so each source's words meet
    its rounded target exactly and only the document at the end of the stream is taken in part.
    """
    docs = without(docs, _OWN)
    if len(schedules) != len(weights):
        raise ValueError("one schedule for each weight")
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    base = docs.withColumn("size", F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long"))
    base = base.withColumn("_ord", key).withColumn("_bucket", (F.conv(F.substring("_ord", 1, 8), 16, 10).cast("double") / 2.0**32 * ranges).cast("int"))
    per = cut(base.groupBy("source", "_bucket").agg(F.sum("size").alias("_n")))
    per = per.withColumn("_start", F.coalesce(F.sum("_n").over(W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))
    targets = source_targets(per.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, share, cap)
    t = targets.alias("t")
    per = per.alias("p").join(t, F.col("p.source").eqNullSafe(F.col("t.source"))).select(F.col("p.source").alias("_s"), F.col("_bucket").alias("_b"), "_start", "source_size", "target", "_turn")
    inside = W.partitionBy("source", "_bucket").orderBy("_ord", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    rows = base.withColumn("_at", F.sum("size").over(inside) - F.col("size"))
    rows = rows.join(per, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).withColumn("_at", F.col("_at") + F.col("_start"))
    want = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    readings = range(max(1, -int(-cap // 1)))
    part = [F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), want - F.col("source_size") * F.lit(e) - F.col("_at"))) for e in readings]
    spots = []
    for e in readings:
        y = (F.col("source_size") * F.lit(e) + F.col("_at") + part[e] / F.lit(2.0)) / F.col("target")
        spot = None
        for k in reversed(range(len(weights))):
            spot = _when(schedules[k], y) if spot is None else F.when(F.col("_turn") == k, _when(schedules[k], y)).otherwise(spot)
        spots.append(F.when(part[e] > 0, F.struct(spot.alias("position"), part[e].alias("words"))))
    taken = part[0]
    for p in part[1:]:
        taken = taken + p
    return rows.withColumn("taken", taken).withColumn("positions", F.array_compact(F.array(*spots))).select(*map(named, docs.columns), "size", "source_size", "target", "taken", "positions")


def emit_mix(plan: DataFrame) -> DataFrame:
    """One row per reading of a document, range-sorted by training position, with the words it takes.

    The text of the document at the very end of a source's stream is cut after its last taken word;
    all other texts are whole.
    """
    rows = plan.withColumn("_spot", F.explode("positions"))
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("_spot.words").cast("int")), "")
    rows = rows.withColumn("text", F.when(F.col("_spot.words") < F.col("size"), head).otherwise(F.col("text")))
    return rows.withColumn("position", F.col("_spot.position")).drop("_spot", "positions").repartitionByRange("position").sortWithinPartitions("position")

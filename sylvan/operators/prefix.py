"""Running totals over a whole table in one global order, without bringing all rows to one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from sylvan.session import cut


def running(df: DataFrame, by: Sequence[str], sums: Mapping[str, str], inclusive: bool = False) -> DataFrame:
    """The rows with, for each (name, column) of ``sums``, the column's total over all rows before in the order of ``by``.

    Rows are range-partitioned and written with their range's number (ranges come from a sample, so a task
    that ran again might cut them elsewhere); totals of ranges are one row each, and their running sums, over
    as many rows as there are shuffle partitions, are joined back. Rows that tie in ``by`` share a range.
    """
    ranges = cut(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()))
    totals = ranges.groupBy("_range").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    offsets = totals.select("_range", *[F.sum(f"_sum_{n}").over(before).alias(f"_sum_{n}") for n in sums])
    inside = W.partitionBy("_range").orderBy(*by).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    rows = ranges.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()]).join(F.broadcast(offsets), "_range")
    kind = {f.name: f.dataType for f in totals.schema}
    whole = [(F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_sum_{n}"), F.lit(0))).cast(kind[f"_sum_{n}"]).alias(n) for n in sums]
    return rows.select(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns], *whole)

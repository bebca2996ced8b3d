"""Input columns that an operator doesn't know: carried along, and out of the way of its own names."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, StructField, StructType


def named(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(docs: DataFrame, names: Iterable[str]) -> DataFrame:
    """The table without columns of these names (in any case): an operator's own columns come in their place."""
    own = {n.lower() for n in names}
    return docs.select(*[named(c) for c in docs.columns if c.lower() not in own])


def extended(docs: DataFrame, **more: DataType) -> StructType:
    """The table's schema with further columns; as a type, since no spelling of it suits every field name."""
    return StructType([*docs.schema.fields, *(StructField(n, t) for n, t in more.items())])


def shielded(docs: DataFrame, needed: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The needed columns with all others in one struct, by number, and what puts the original columns back."""
    needed = list(needed)
    place = {c: f"c{k}" for k, c in enumerate(c for c in docs.columns if c not in needed)}
    packed = docs.select(*needed, *([F.struct(*[named(c).alias(k) for c, k in place.items()]).alias("_carried")] if place else []))

    def restored(df: DataFrame) -> DataFrame:
        return df.select(*[F.col("_carried")[place[c]].alias(c) if c in place else F.col(c) for c in docs.columns])

    return packed, restored

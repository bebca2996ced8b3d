"""Python passes over Arrow batches of bounded size, by workers that give memory back."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows and bytes of a batch at most; a longer row makes a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1000, 8_000_000
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def _bytes(value: str) -> int:
    """A size as the session spells it, a number with b, k, m or g after it."""
    unit = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(value[-1:].lower())
    return int(value[:-1]) * unit if unit else int(value)


def give_back() -> None:
    """Return what the allocators hold free to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with the session's batches held to the sizes above, if they are larger.

    ``run`` takes columns by place: those with unusual names are renamed on the way in, since PySpark looks
    columns up by unquoted name there. The two settings stay as they are put here, for plans are made later.
    """
    if not all(re.fullmatch(r"\w+", c) for c in df.columns):
        df = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_ROWS)) <= BATCH_ROWS:
        conf.set(_ROWS, str(BATCH_ROWS))
    if not 0 < _bytes(conf.get(_BYTES)) <= BATCH_BYTES:
        conf.set(_BYTES, str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)

"""Placing a stream of items among static reference points: a stateless stream-static join, in append mode."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def placed(stream: DataFrame, refs: np.ndarray, fit: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, place) of each (id, x) as it comes: its distances to the references' points, then the fit.

    The references, a fixed number, go with the plan. Rows are independent, so there is no state and no
    watermark, and a batch that runs again gives the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            d = np.sqrt(((x[:, None] - refs[None]) ** 2).sum(axis=2)) if len(x) else np.empty((0, len(refs)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fit(r).tolist() for r in d], pa.list_(pa.float64()))], names=["id", "place"])

    return stream.select("id", "x").mapInArrow(run, "id long, place array<double>")


def start(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append placed rows to Parquet, all that is there now, then stop."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

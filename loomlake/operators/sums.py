"""Sums of arrays over a whole table, as large as a model's weights: added up in the tasks, then by chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 14


def summed(rows: DataFrame, size: int, add: Callable[[np.ndarray, pa.RecordBatch], None], chunk: int = CHUNK) -> np.ndarray:
    """The sum over all tasks of ``size`` numbers; add(total, batch) adds a batch to a task's own. A reducer holds the chunks
    that it has; the driver gets the sum and no more."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                add(total, b)
        parts = [(k, total[k * chunk : (k + 1) * chunk].tobytes()) for k in range(-(-size // chunk)) if total[k * chunk : (k + 1) * chunk].any()]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["chunk", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0.0) + np.frombuffer(data)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["chunk", "part"])

    kind = "chunk int, part binary"
    out = np.zeros(size)
    for k, data in rows.mapInArrow(part, kind).repartition("chunk").mapInArrow(merge, kind).collect():  # as much as the sum
        out[k * chunk : k * chunk + len(data) // 8] = np.frombuffer(data)
    return out

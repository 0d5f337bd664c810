"""A learned embedder: weighted words, reduced to the leading directions of the corpus.

Words are hashed to ``cells`` columns. A text's row holds 1 + ln(count) times the column's weight, ln(n / df), at length 1. The
leading right singular vectors of the table of all texts come from randomised subspace iteration: a pass adds up
A'(A W) in the tasks and by chunk, the driver orthonormalises the ``cells`` x ``width`` product and sends it out again.
Neither texts nor rows move, and what the driver holds doesn't grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import forget, stored
from ..sources.versions import Versioned
from .sums import summed
from .training import features

CELLS, DIM, MORE, PASSES = 1 << 15, 64, 16, 6
#: Rows of a block that is multiplied at once, and filled places, unless one row has more.
ROWS, FILLED = 32, 1 << 13


def _rows(at: pa.Array, x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.diff(at.offsets.to_numpy())
    return np.repeat(np.arange(len(at)), sizes), at.flatten().to_numpy(), x.flatten().to_numpy()


def _weighted(at: pa.Array, x: pa.Array, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, cell, value = _rows(at, x)
    value = value * weight[cell]
    length = np.sqrt(np.bincount(row, value**2, len(at)))
    return row, cell, value / np.where(length > 0, length, 1)[row]


def _blocks(row: np.ndarray, cell: np.ndarray, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of some rows at a time: these, the cells that they fill, and the table of both. row ascends. A block has ROWS rows, or as many
    filled places as these usually have, so that its table stays small."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
    ends, low = np.r_[starts[1:], len(row)], 0
    while low < len(starts):
        high = min(low + ROWS, max(low + 1, int(np.searchsorted(ends, starts[low] + FILLED, "right"))), len(starts))
        a, z = starts[low], ends[high - 1]
        cells, at = np.unique(cell[a:z], return_inverse=True)
        table = np.zeros((high - low, len(cells)))
        table[np.repeat(np.arange(high - low), ends[low:high] - starts[low:high]), at] = value[a:z]
        yield row[starts[low:high]], cells, table
        low = high


def _times(row: np.ndarray, cell: np.ndarray, value: np.ndarray, n: int, w: np.ndarray) -> np.ndarray:
    """The rows' product with w."""
    out = np.zeros((n, w.shape[1]))
    for own, cells, table in _blocks(row, cell, value):
        out[own] = table @ w[cells]
    return out


@dataclass
class LearnedEmbedder:
    """weight of each cell, vectors (cells x dim), values: the singular values. Called as any Embedder: id, v."""

    weight: np.ndarray
    vectors: np.ndarray
    values: np.ndarray

    def __call__(self, rows: DataFrame, key: str, text: str) -> DataFrame:
        held = rows.sparkSession.sparkContext.broadcast((self.weight, self.vectors))  # cells x dim
        found = features(rows.select(F.col(key).alias("id"), F.col(text).alias("text")), len(self.weight))
        kind = dict(found.dtypes)["id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weight, vectors = held.value
            for b in batches:
                v = _times(*_weighted(b.column(1), b.column(2), weight), b.num_rows, vectors)
                length = np.sqrt((v**2).sum(1, keepdims=True))
                v /= np.where(length > 0, length, 1)
                ends = pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], ["id", "v"])

        return found.select("id", "at", "x").mapInArrow(run, f"id {kind}, v array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, float(w), v.tolist()) for i, (w, v) in enumerate(zip(self.weight, self.vectors, strict=True)) if w]
        about = {"kind": "learned", "cells": len(self.weight), "values": self.values.tolist()}
        Versioned(spark, path).publish({"vectors": spark.createDataFrame(rows, "at int, weight double, v array<double>")}, about)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LearnedEmbedder:
        store = Versioned(spark, path)
        about = store.about()
        weight, vectors = np.zeros(about["cells"]), np.zeros((about["cells"], len(about["values"])))
        for r in store.read("vectors").collect():  # cells at most
            weight[r["at"]], vectors[r["at"]] = r.weight, r.v
        return cls(weight, vectors, np.array(about["values"]))


def fit(rows: DataFrame, text: str = "text", dim: int = DIM, cells: int = CELLS, passes: int = PASSES, seed: int = 0) -> LearnedEmbedder:
    """From all texts of rows; texts without words count for nothing. A corpus of a lower rank gives vectors whose last
    components are zero."""
    data = stored(features(rows.select(F.col(text).alias("text")), cells).where("size(at) > 0"), "rows")
    context = rows.sparkSession.sparkContext

    def count(total: np.ndarray, b: pa.RecordBatch) -> None:
        np.add.at(total, b.column(0).flatten().to_numpy(), 1)

    df = summed(data.select("at"), cells, count)
    n = data.count()
    weight = np.where(df > 0, np.log(np.maximum(n, 1) / np.maximum(df, 1)), 0)
    width = min(dim + MORE, cells)
    w = np.linalg.qr(np.random.default_rng(seed).normal(size=(cells, width)) * (weight > 0)[:, None])[0]
    product = np.zeros((cells, width))
    for _ in range(passes):
        held = context.broadcast((weight, w))  # cells x width

        def multiply(total: np.ndarray, b: pa.RecordBatch, held=held) -> None:
            weight, w = held.value
            row, cell, value = _weighted(b.column(0), b.column(1), weight)
            whole = total.reshape(cells, -1)
            for _, filled, table in _blocks(row, cell, value):
                whole[filled] += table.T @ (table @ w[filled])

        product = summed(data.select("at", "x"), cells * width, multiply).reshape(cells, width)
        held.destroy()
        w_old, w = w, np.linalg.qr(product)[0]
    # w_old' A'A w_old is known from the last pass: its eigenvectors give the singular vectors in that space
    values, turn = np.linalg.eigh((w_old.T @ product + product.T @ w_old) / 2)
    order = np.argsort(-values)[:dim]
    vectors = w_old @ turn[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    singular = np.sqrt(np.maximum(values[order], 0))
    vectors = vectors * np.where(signs == 0, 1, signs) * (singular > 1e-6 * max(singular.max(initial=0), 1e-12))
    forget(data)
    return LearnedEmbedder(weight, vectors, singular)

"""Multi-label classification: logistic outputs over hashed words, fitted by passes over the whole table.

Every step is one pass: tasks add up the gradient of the training rows under the weights of the step, and the confusion
counts of the validation rows, and the parts meet by chunk of the weights, so that a reducer holds one chunk. The driver
holds the weights (``dim`` + 1 rows of one number for each label) and moves them by Adam. An epoch is a few steps; the
weights of the best epoch by weighted F1 on the validation rows are kept, and ``patience`` epochs without a better one
end the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.labels import predict as predicted
from ..sources.scratch import forget, small_batches, stored
from ..sources.versions import Versioned
from .sums import CHUNK, summed

DIM = 1 << 15
EPOCHS, STEPS, PATIENCE = 15, 2, 10
RATE, DECAY, THRESHOLD = 0.2, 1e-4, 0.5


def features(rows: DataFrame, dim: int = DIM, text: str = "text") -> DataFrame:
    """rows without their text, with at (hashed words, ascending) and x (1 + ln of their counts, at length 1)."""
    small_batches(rows.sparkSession)
    words = T.tokenize(F.lower(F.coalesce(F.col(text), F.lit(""))))
    rest = [c for c in rows.columns if c != text]
    found = rows.select(*rest, F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int")).alias("at"))
    kinds = dict(found.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, row = b.column(len(rest)), np.arange(b.num_rows)
            row = np.repeat(row, pc.list_value_length(words).to_numpy(zero_copy_only=False))
            both, n = np.unique(row * dim + words.flatten().to_numpy(zero_copy_only=False), return_counts=True)
            row, v = both // dim, 1 + np.log(n)
            v /= np.sqrt(np.bincount(row, v**2, b.num_rows))[row]
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=b.num_rows))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(a)) for a in ((both % dim).astype(np.int32), v)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *lists], [*rest, "at", "x"])

    return found.mapInArrow(count, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "at array<int>", "x array<double>"]))


def _logits(weights: np.ndarray, at: pa.Array, x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, value of each filled cell; logits of each row); the last row of weights is the bias."""
    sizes = np.diff(at.offsets.to_numpy())
    row, cell, value = np.repeat(np.arange(len(at)), sizes), at.flatten().to_numpy(), x.flatten().to_numpy()
    out = np.tile(weights[-1], (len(at), 1))
    for label in range(weights.shape[1]):
        out[:, label] += np.bincount(row, value * weights[cell, label], len(at))
    return row, cell, value, out


def _pass(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float, int, np.ndarray]:
    """(sum of the training rows' gradients, their loss, their number; tp, fp, fn of each label in the validation rows)."""
    held = rows.sparkSession.sparkContext.broadcast(weights)  # dim + 1 rows
    labels = weights.shape[1]
    size = weights.size + 2 + 3 * labels

    def add(total: np.ndarray, b: pa.RecordBatch) -> None:
        weights = held.value
        row, cell, value, logits = _logits(weights, b.column(1), b.column(2))
        truth = b.column(0).flatten().to_numpy().reshape(b.num_rows, labels)
        train = np.array([p == "train" for p in b.column(3).to_pylist()])
        error = (1 / (1 + np.exp(-logits)) - truth) * train[:, None]
        gradient = total[: weights.size].reshape(weights.shape)
        for label in range(labels):
            gradient[:-1, label] += np.bincount(cell, value * error[row, label], len(weights) - 1)
        gradient[-1] += error.sum(0)
        loss = np.logaddexp(0, logits) - truth * logits
        total[weights.size : weights.size + 2] += loss[train].sum(), train.sum()
        guess, true = (logits >= 0)[~train], truth[~train] == 1
        total[weights.size + 2 :] += np.concatenate([(guess & true).sum(0), (guess & ~true).sum(0), (~guess & true).sum(0)])

    wanted = rows.where("part in ('train', 'val')").select("labels", "at", "x", "part")
    total = summed(wanted, size, add, CHUNK)
    held.destroy()
    n = weights.size
    return total[:n].reshape(weights.shape), float(total[n]), int(total[n + 1]), total[n + 2 :].reshape(3, labels)


def weighted_f1(counts: np.ndarray) -> float:
    """From tp, fp, fn of each label."""
    tp, fp, fn = counts
    f1 = np.divide(2 * tp, 2 * tp + fp + fn, out=np.zeros(len(tp)), where=2 * tp + fp + fn > 0)
    return float((f1 * (tp + fn)).sum() / (tp + fn).sum()) if (tp + fn).sum() else 0.0


@dataclass
class MultiLabelModel:
    """weights: dim + 1 rows; history: (epoch, mean loss, weighted F1 of the validation rows)."""

    weights: np.ndarray
    history: list[tuple[int, float, float]] = field(default_factory=list)

    def predict(self, rows: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
        """rows with logits and predicted (0 or 1 for each label)."""
        held = rows.sparkSession.sparkContext.broadcast(self.weights)
        found = features(rows.withColumn("__text", F.col(text)), len(self.weights) - 1, "__text")
        rest = rows.columns
        at = found.columns.index("at")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                logits = _logits(held.value, b.column(at), b.column(at + 1))[3] if b.num_rows else np.zeros((0, 1))
                yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(logits.tolist(), pa.list_(pa.float64()))], [*rest, "logits"])

        out = found.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in found.dtypes[:at]) + ", logits array<double>")
        return out.withColumn("predicted", predicted(F.col("logits"), threshold))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, row.tolist()) for i, row in enumerate(self.weights) if row.any()]
        Versioned(spark, path).publish({"weights": spark.createDataFrame(rows, "at int, w array<double>")}, {"kind": "multilabel", "rows": len(self.weights), "labels": self.weights.shape[1]})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MultiLabelModel:
        store = Versioned(spark, path)
        weights = np.zeros((store.about()["rows"], store.about()["labels"]))
        for r in store.read("weights").collect():  # dim + 1 rows at most
            weights[r["at"]] = r.w
        return cls(weights)


def fit(rows: DataFrame, n_labels: int, dim: int = DIM, epochs: int = EPOCHS, steps: int = STEPS, patience: int = PATIENCE, rate: float = RATE, decay: float = DECAY) -> MultiLabelModel:
    """rows: text, labels (0 or 1 for each of ``n_labels``), part (train, val; others are left out). Rows without labels go."""
    good = rows.where(F.size("labels") == n_labels).where("forall(labels, x -> x is not null)")
    data = stored(features(good.select("text", F.col("labels").cast("array<int>").alias("labels"), "part"), dim), "features")
    weights, best = np.zeros((dim + 1, n_labels)), None
    m, v, t, history = np.zeros_like(weights), np.zeros_like(weights), 0, []
    gradient, loss, n, counts = _pass(data, weights)
    for epoch in range(1, epochs + 1):
        for _ in range(steps):
            g = gradient / max(n, 1) + decay * np.vstack([weights[:-1], np.zeros((1, n_labels))])
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            weights = weights - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            gradient, loss, n, counts = _pass(data, weights)
        score = weighted_f1(counts)
        history.append((epoch, loss / max(n, 1), score))
        if best is None or score > best[0]:
            best = (score, epoch, weights.copy())
        if epoch - best[1] >= patience:
            break
    forget(data)
    return MultiLabelModel(best[2] if best else weights, history)

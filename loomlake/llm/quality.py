"""Operator 4, quality classifier: a factorisation machine.

A text becomes hashed words (L2-normed presence), structure statistics and one metadata figure (the stored length
against the real one). The score is sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all
pairwise interactions in time linear in the text, by the sum-of-squares identity.

Training takes at most ``MAX_TRAIN`` labelled rows, those with the smallest id hashes; they are a bounded number of
sparse rows on the driver. Scoring reads every text whole. A null text is scored as an empty one; without labels of
both kinds all scores are the share of label 1, or 0.5 without labels. The label of an id is the mean of its labels,
rounded up from a half. Labels, lang, source and doc_id are never inputs. Repeated rows are trained on once and each
scored; an empty table gives no rows; a null id has a score and is not held out; other columns, whatever their names,
are not read, and ``keep_good`` hands them on.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import text_batches
from .bpe import Memo

BUCKETS = 1 << 14
#: Words that a worker remembers, and bytes of a batch of texts.
MEMO, BATCH = 1 << 16, 1 << 21
MAX_TRAIN = 8000
THRESHOLD = 0.7
RANK = 8
EPOCHS = 12
#: Rows whose crc32(doc_id as text) has this remainder are held out.
FOLDS, HELD_OUT = 4, 2

_BYTES = np.zeros((256, 6))
for _b in range(256):
    _c = chr(_b)
    _BYTES[_b] = [_c.isascii() and _c.islower(), _c.isascii() and _c.isupper(), _b in range(48, 58), _c in ".,;:?'\"-()", _b > 32 and _b < 127 and not _c.isalnum() and _c not in ".,;:?'\"-()", _b > 127]


def statistics(text: str, n_chars: int | None) -> list[float]:
    """Structure of the text, and how the stored length differs from the real one."""
    data = text.encode("utf-8", "surrogatepass")
    shares = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _BYTES) / max(1, len(data))
    words = text.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = text.split("\n")
    line_counts = Counter(lines)
    pairs = len(set(zip(words, words[1:]))) / max(1, len(words) - 1)
    triples = len(set(zip(words, words[1:], words[2:]))) / max(1, len(words) - 2)
    real = [w for w in words if w[0].isalpha()]
    return [
        *shares,
        math.log1p(len(words)),
        sum(map(len, words)) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        pairs,
        triples,
        len(real) / n,
        sum(not w[-1].isalnum() for w in words) / n,
        sum(w.isupper() for w in words) / n,
        math.log1p(len(lines)),
        len(line_counts) / len(lines),
        text.count("http") / n,
        math.log1p(abs((n_chars if n_chars is not None else len(text)) - len(text))),
        1.0 if not words else 0.0,
    ]


def features(text: str, n_chars: int | None, buckets: int, memo: Memo) -> tuple[np.ndarray, np.ndarray, list[float]]:
    stats = statistics(text, n_chars)
    hashed = np.fromiter(map(memo.__getitem__, set(text.split())), np.int32)
    index = np.unique(hashed)
    return index, np.full(len(index), 1 / math.sqrt(max(1, len(index)))), stats


def word_memo(buckets: int) -> Memo:
    return Memo(lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets, MEMO)


@dataclass
class FactorisationMachine:
    mean: np.ndarray
    scale: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray
    buckets: int = BUCKETS
    losses: list[float] = field(default_factory=list)

    def joined(self, index: np.ndarray, value: np.ndarray, stats: list[float]) -> tuple[np.ndarray, np.ndarray]:
        dense = np.clip((np.array(stats) - self.mean) / self.scale, -6, 6) / math.sqrt(len(stats))
        return np.concatenate([index, self.buckets + np.arange(len(dense))]), np.concatenate([value, dense])

    def raw(self, index: np.ndarray, value: np.ndarray) -> float:
        picked = self.v[index] * value[:, None]
        return float(self.w0 + self.w[index] @ value + 0.5 * (picked.sum(0) ** 2 - (picked**2).sum(0)).sum())

    def score(self, text: str | None, n_chars: int | None, memo: Memo) -> float:
        index, value = self.joined(*features(text or "", n_chars, self.buckets, memo))
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, self.raw(index, value)))))


def train(rows: list[tuple[np.ndarray, np.ndarray, list[float]]], labels: np.ndarray, buckets: int = BUCKETS, rank: int = RANK, epochs: int = EPOCHS, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> FactorisationMachine:
    """AdaGrad on the logistic loss, classes weighted alike up to a factor of four."""
    width = len(statistics("", 0))
    stats = np.array([r[2] for r in rows]).reshape(-1, width)
    mean = stats.mean(0) if len(rows) else np.zeros(width)
    scale = stats.std(0) + 1e-6 if len(rows) else np.ones(width)
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    model = FactorisationMachine(mean, scale, math.log(max(share, 1e-6) / max(1 - share, 1e-6)), np.zeros(buckets + width), rng.normal(0, 0.02, (buckets + width, rank)), buckets)
    if not len(labels) or not 0 < share < 1:
        model.v[:] = 0
        return model
    data = [model.joined(*r) for r in rows]
    weight = np.where(labels == 1, min(4.0, max(1.0, (1 - share) / share)), min(4.0, max(1.0, share / (1 - share))))
    g0, gw, gv = 1e-6, np.full(len(model.w), 1e-6), np.full(model.v.shape, 1e-6)
    for _ in range(epochs):
        total = 0.0
        for batch in np.array_split(rng.permutation(len(data)), max(1, len(data) // 64)):
            ids, values = (np.concatenate([data[i][k] for i in batch]) for k in (0, 1))
            sizes = np.array([len(data[i][0]) for i in batch])
            starts = np.cumsum(sizes) - sizes
            picked = model.v[ids] * values[:, None]
            sums = np.add.reduceat(picked, starts)
            raw = model.w0 + np.add.reduceat(model.w[ids] * values, starts) + 0.5 * (sums**2 - np.add.reduceat(picked**2, starts)).sum(1)
            p = 1 / (1 + np.exp(-np.clip(raw, -35, 35)))
            y = labels[batch]
            total -= float((weight[batch] * np.log(np.where(y == 1, p, 1 - p) + 1e-12)).sum())
            error = weight[batch] * (p - y) / len(batch)
            each = np.repeat(error, sizes) * values
            spots, place = np.unique(ids, return_inverse=True)
            dw = np.bincount(place, each) + decay * model.w[spots]
            dv_rows = each[:, None] * (np.repeat(sums, sizes, 0) - picked)
            dv = np.stack([np.bincount(place, dv_rows[:, f]) for f in range(model.v.shape[1])], 1) + decay * model.v[spots]
            g0 += error.sum() ** 2
            gw[spots] += dw**2
            gv[spots] += dv**2
            model.w0 -= rate * error.sum() / math.sqrt(g0)
            model.w[spots] -= rate * dw / np.sqrt(gw[spots])
            model.v[spots] -= rate * dv / np.sqrt(gv[spots])
        model.losses.append(total / len(data))
    return model


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_labels(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """__id, __label of the ids that are not held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    return known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("__label"))


def labelled_sample(docs: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """docs' columns (doc_id, text, ...) and __label of at most ``most`` rows with a training label: those with the
    smallest id hashes. Rows equal in id and text count once; of many texts of one id those with the smallest hashes."""
    own = docs.select(F.col("doc_id").alias("__id")).distinct()
    ids = known.join(own, "__id").orderBy(F.xxhash64("__id"), "__id").limit(most)
    same = F.col("doc_id") == F.col("__id")
    texts = docs.join(F.broadcast(ids), same).select("__id", "__label", F.xxhash64("text").alias("__h")).distinct()  # at most ``most`` ids
    picked = texts.orderBy(F.xxhash64("__id"), "__id", "__h").limit(most)
    rows = docs.join(F.broadcast(picked), same & (F.xxhash64("text") == F.col("__h")))  # at most ``most`` rows
    once = rows.groupBy("__id", "__h").agg(F.first(F.struct(*docs.columns, "__label")).alias("__row"))
    return once.select("__row.*")


def _inputs(docs: DataFrame) -> DataFrame:
    text_batches(docs.sparkSession, BATCH)
    length = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), length.alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> FactorisationMachine:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo(BUCKETS)
        for b in batches:
            rows = [features(t or "", n, BUCKETS, memo) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            packed = [[r[0].astype("<i4").tobytes() for r in rows], [np.array(r[2], "<f8").tobytes() for r in rows]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), *(pa.array(p, pa.binary()) for p in packed)], ["doc_id", "label", "words", "stats"])

    sample = labelled_sample(_inputs(docs), training_labels(labels, "quality", FOLDS, HELD_OUT), most)
    held = sample.mapInArrow(run, "doc_id long, label int, words binary, stats binary").toPandas()  # at most ``most`` rows
    held = held.sort_values(["doc_id", "words", "stats"], kind="stable")
    rows = []
    for words, stats in zip(held["words"], held["stats"], strict=True):
        index = np.frombuffer(words, "<i4")
        rows.append((index, np.full(len(index), 1 / math.sqrt(max(1, len(index)))), list(np.frombuffer(stats, "<f8"))))
    return train(rows, held["label"].to_numpy(np.float64))


def score_documents(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS * (RANK + 1) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, fm = word_memo(BUCKETS), held.value
        for b in batches:
            scores = [fm.score(t, n, memo) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = _inputs(docs).mapInArrow(run, "doc_id long, score double")
    out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, all columns as they are."""
    model = fit(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema, at = docs.schema, docs.columns.index("text")
    meta = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, fm = word_memo(BUCKETS), held.value
        for b in batches:
            lengths = b.column(meta).to_pylist() if meta is not None else [None] * b.num_rows
            scores = [fm.score(t, n, memo) for t, n in zip(b.column(at).to_pylist(), lengths, strict=True)]
            yield b.filter(pa.array([s >= threshold for s in scores], pa.bool_()))

    text_batches(docs.sparkSession, BATCH)
    return docs.mapInArrow(run, schema)

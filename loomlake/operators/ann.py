"""Approximate vector search: an inverted file of cells, with a measured recall.

Cells are the nearest-centroid regions of mini-batch k-means. Vectors are stored by cell, a folder each; a cell that holds
many is dealt to several files. A query reads the ``nprobe`` cells whose centroids have the greatest inner product with
it; cells that no query of a batch asks for are pruned before the scan. A task keeps the k best rows of each query,
so only k rows for each query and task are moved. ``calibrate`` measures recall against a full scan and finds the least
``nprobe`` that reaches a target.
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
from .sparse import top

#: Rows of a training batch for each cell; a round reads one batch, drawn by the hash of the id.
BATCH_PER_CELL, ROUNDS = 32, 12
#: Rows of one file of a cell, and most cells: centroids travel to every task.
FILE_ROWS, MOST_CELLS = 1_000_000, 16_384
#: Query vectors that travel to every task at once.
QUERY_ROWS = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Cells by Euclidean distance; ties go to the smaller number."""
    return (np.einsum("ij,ij->i", centroids, centroids)[None] - 2 * v @ centroids.T).argmin(1)


def _sums(rows: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many rows (v) each cell has, and their sum: added up in the tasks and then by cell."""
    held = rows.sparkSession.sparkContext.broadcast(centroids)  # MOST_CELLS rows at most

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = held.value
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape)
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column(0))
                near = _nearest(v, centroids)
                counts += np.bincount(near, minlength=len(centroids))
                np.add.at(sums, near, v)
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(counts[cells]), pa.array(sums[cells].tolist(), pa.list_(pa.float64()))], ["cell", "n", "s"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for cell, n, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _matrix(b.column(2)) if b.num_rows else (), strict=True):
                old = total.get(cell, (0, 0.0))
                total[cell] = (old[0] + n, old[1] + s)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t[0] for t in total.values()], pa.int64()), pa.array([t[1].tolist() for t in total.values()], pa.list_(pa.float64()))], ["cell", "n", "s"])

    kind = "cell int, n long, s array<double>"
    found = rows.select("v").mapInArrow(add, kind).repartition("cell").mapInArrow(merge, kind).collect()  # a row for each cell
    held.destroy()
    counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape)
    for cell, n, s in found:
        counts[cell], sums[cell] = n, s
    return counts, sums


def train(vectors: DataFrame, cells: int, rounds: int = ROUNDS, batch_per_cell: int = BATCH_PER_CELL, seed: int = 0) -> np.ndarray:
    """Centroids of vectors (id, v) by mini-batch k-means: each round assigns one batch, of about ``batch_per_cell`` rows for each
    cell, and moves each centroid towards its rows' mean by their share of all rows it has seen. Cells that have seen no
    row start anew from rows of the batch."""
    cells = min(cells, MOST_CELLS)
    n = vectors.count()
    share = min(1.0, cells * batch_per_cell / max(1, n))
    draw = lambda r: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(r)), F.lit(1 << 30)) < int(share * (1 << 30))
    order = lambda r: F.xxhash64("id", F.lit(seed + 1), F.lit(r))
    start = vectors.where(draw(0)).orderBy(order(0), "id").limit(cells).collect()
    if not start:
        return np.zeros((0, 0))
    centroids = np.array([r.v for r in start], np.float64)
    seen = np.zeros(len(centroids), np.int64)
    for r in range(1, rounds + 1):
        batch = vectors.where(draw(r))
        counts, sums = _sums(batch, centroids)
        seen += counts
        hit = counts > 0
        centroids[hit] += (sums[hit] - counts[hit, None] * centroids[hit]) / seen[hit, None]
        lost = np.flatnonzero(seen == 0)
        if len(lost) and r < rounds:
            fresh = batch.orderBy(order(r), "id").limit(len(lost)).collect()
            for cell, row in zip(lost, fresh, strict=False):
                centroids[cell] = row.v
    return centroids


@dataclass
class CellIndex:
    """A versioned folder: ``vectors`` (id, v, more), partitioned by cell, and ``cells`` (cell, centroid)."""

    spark: SparkSession
    path: str

    @property
    def store(self) -> Versioned:
        return Versioned(self.spark, self.path)

    def centroids(self) -> np.ndarray:
        rows = self.store.read("cells").orderBy("cell").collect()  # MOST_CELLS rows at most
        return np.array([r.centroid for r in rows], np.float64) if rows else np.zeros((0, 0))

    def vectors(self) -> DataFrame:
        return self.store.read("vectors")

    def release(self) -> None:
        self.store.delete()


def _by_cell(vectors: DataFrame, centroids: np.ndarray, file_rows: int) -> DataFrame:
    """vectors with their cells, dealt out so that a cell's rows make files of about ``file_rows`` rows."""
    held = vectors.sparkSession.sparkContext.broadcast(centroids)
    fields = vectors.columns
    at = fields.index("v")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = _nearest(_matrix(b.column(at)), held.value) if b.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], [*fields, "cell"])

    schema = ", ".join(f"`{f}` {t}" for f, t in vectors.dtypes) + ", cell int"
    found = stored(vectors.mapInArrow(assign, schema), "assigned")
    sizes = found.groupBy("cell").agg(F.ceil(F.count("*") / file_rows).cast("int").alias("__files"))  # a row for each cell
    dealt = found.join(F.broadcast(sizes), "cell").withColumn("__file", F.pmod(F.xxhash64("id"), F.col("__files")))
    return dealt.repartition("cell", "__file").select(*fields, "cell")


def _checked(vectors: DataFrame, dim: int | None = None) -> int | None:
    size = vectors.agg(F.min(F.size("v")).alias("lo"), F.max(F.size("v")).alias("hi")).first()
    if size.lo != size.hi or (dim is not None and size.hi is not None and size.hi != dim):
        raise ValueError(f"vectors of {size.lo} to {size.hi} components{f', and the index has {dim}' if dim else ''}")
    return size.hi


def build(vectors: DataFrame, path: str, cells: int | None = None, rounds: int = ROUNDS, file_rows: int = FILE_ROWS, seed: int = 0) -> CellIndex:
    """An index of vectors (id, v, more columns) in a new version of ``path``. cells: by default the root of their number."""
    spark = vectors.sparkSession
    rows = vectors.where("id is not null and v is not null")
    dim = _checked(rows)
    centroids = train(rows, cells or max(1, round(rows.count() ** 0.5)), rounds, seed=seed)
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>")
    by_cell = _by_cell(rows, centroids, file_rows) if dim else rows.withColumn("cell", F.lit(0))
    Versioned(spark, path).publish({"vectors": by_cell, "cells": table}, {"kind": "cells", "dim": dim or 0}, partition_by={"vectors": ["cell"]} if dim else {})
    return CellIndex(spark, path)


def append(index: CellIndex, vectors: DataFrame, file_rows: int = FILE_ROWS) -> CellIndex:
    """More vectors, into the cells as they are. An index of nothing has no cells, and has to be built anew."""
    rows = vectors.where("id is not null and v is not null")
    about = index.store.about()
    _checked(rows, about["dim"])
    by_cell = _by_cell(rows, index.centroids(), file_rows)
    index.store.publish({"vectors": by_cell}, about, append=True, partition_by={"vectors": ["cell"]})
    return index


def probed(index: CellIndex, queries: DataFrame, nprobe: int) -> DataFrame:
    """query_id, qv, cells: the ``nprobe`` cells of each query."""
    held = index.spark.sparkContext.broadcast(index.centroids())
    kind = dict(queries.dtypes)["query_id"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = np.argsort(-_matrix(b.column(1)) @ held.value.T, axis=1, kind="stable")[:, :nprobe]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["query_id", "qv", "cells"])

    return queries.select("query_id", F.col("qv").cast("array<double>").alias("qv")).mapInArrow(pick, f"query_id {kind}, qv array<double>, cells array<int>")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, clamp: bool = False, places: int | None = None) -> DataFrame:
    """query_id, id, score, rank of the k greatest inner products of queries (query_id, qv, maybe cells) with vectors (id, v, with
    cells: cell); ties, of scores rounded to ``places`` if given, go to the smaller id. Queries travel in blocks of
    QUERY_ROWS, one pass over the vectors for each."""
    spark = vectors.sparkSession
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["id"]
    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double"
    probing = "cells" in queries.columns
    asked = stored(queries, "query-vectors")
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()  # about QUERY_ROWS rows
        if not rows:
            continue
        source = vectors
        if probing:
            source = source.where(F.col("cell").isin(sorted({c for r in rows for c in r.cells})))  # prunes folders
        part = _scanned(source, rows, probing, k, clamp, places, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema + ", rank int")
    if places is None:
        return top(found, k)
    return top(found.withColumn("__s", F.round("score", places)), k, "__s").drop("__s")


def _scanned(source: DataFrame, rows: list, probing: bool, k: int, clamp: bool, places: int | None, schema: str) -> DataFrame:
    own = {}
    for i, r in enumerate(rows):
        for c in r.cells if probing else [None]:
            own.setdefault(c, []).append(i)
    held = source.sparkSession.sparkContext.broadcast(([r.query_id for r in rows], np.array([r.qv for r in rows], np.float64), {c: np.array(q) for c, q in own.items()}))
    fields = ["id", "v", "cell"] if probing else ["id", "v"]
    id_kind = [f.split()[1] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, own = held.value
        best: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(1))
            ids = b.column(0)
            cell = b.column(2).to_numpy(zero_copy_only=False) if probing else None
            for c, asked in own.items():
                here = np.arange(len(v)) if c is None else np.flatnonzero(cell == c)
                if not len(here):
                    continue
                scores = matrix[asked] @ v[here].T
                scores = np.maximum(scores, 0.0) if clamp else scores
                keys = scores if places is None else np.round(scores, places)
                for q, key, score in zip(asked.tolist(), keys, scores, strict=True):
                    kth = best[q][-1][0] if len(best.get(q, ())) == k else -np.inf
                    if len(key) > k:
                        kth = max(kth, np.partition(key, -k)[-k])
                    hits = np.flatnonzero(key >= kth)
                    more = zip(key[hits].tolist(), ids.take(pa.array(here[hits])).to_pylist(), score[hits].tolist(), strict=True)
                    best[q] = sorted([*best.get(q, []), *more], key=lambda r: (-r[0], r[1]))[:k]
        out = [(names[q], r[1], r[2]) for q, found in best.items() for r in found]
        arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], arrow[t]) for i, t in enumerate(id_kind)], ["query_id", "id", "score"])

    return source.select(*fields).mapInArrow(run, schema)


def search(index: CellIndex, queries: DataFrame, k: int = 10, nprobe: int = 8, clamp: bool = True) -> DataFrame:
    """query_id, id, score, rank of the k best rows in each query's cells. queries: query_id, qv."""
    return nearest(index.vectors(), probed(index, queries, nprobe), k, clamp)


def recall(found: DataFrame, exact: DataFrame, k: int = 10) -> float:
    """The share of the exact k best that was found; a row counts if its score is not below the exact k-th."""
    kth = exact.where(F.col("rank") <= k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    good = found.join(kth, "query_id").where(F.col("score") >= F.col("least") - 1e-9).groupBy("query_id").agg(F.count("*").alias("hits"))
    return kth.join(good, "query_id", "left").agg(F.avg(F.least(F.coalesce("hits", F.lit(0)), F.col("n")) / F.col("n"))).first()[0] or 0.0


def calibrate(index: CellIndex, target: float = 0.9, k: int = 10, queries: int = 200, seed: int = 0) -> tuple[int, float]:
    """(nprobe, its recall): the least number of cells with which ``queries`` rows of the index, drawn by hash, find the target's
    share of their k best. A bisection, each step measured against one full scan."""
    rows = index.vectors()
    asked = stored(rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(queries).select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "probes")
    exact = stored(nearest(rows, asked, k), "exact")
    low, high, best = 1, len(index.centroids()), (len(index.centroids()), 1.0)
    while low <= high:
        middle = (low + high) // 2
        share = recall(search(index, asked, k, middle, clamp=False), exact, k)
        if share >= target:
            best, high = (middle, share), middle - 1
        else:
            low = middle + 1
    forget(asked, exact)
    return best

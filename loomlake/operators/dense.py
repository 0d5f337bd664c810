"""Vector search: exact scores of query vectors against all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import small_batches
from .sparse import top

#: Query rows whose vectors may travel to every task at once.
QUERY_ROWS = 10_000


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def scores(vectors: DataFrame, queries: DataFrame, clamp: bool = False, where: Column | None = None) -> DataFrame:
    """query_id, id, score. vectors: id, v; queries: query_id, qv; both of unit length. ``where`` is applied before
    the search. Queries are counted: blocks of QUERY_ROWS are broadcast, one pass over the vectors for each block."""
    rows = vectors if where is None else vectors.where(where)
    value = dot(F.col("qv"), F.col("v"))
    value = F.greatest(F.lit(0.0), value) if clamp else value
    blocks = max(1, -(-queries.count() // (QUERY_ROWS // 2)))
    numbered = queries.withColumn("__b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        part = rows.crossJoin(F.broadcast(numbered.where(F.col("__b") == b))).select("query_id", "id", value.alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, clamp: bool = True, where: Column | None = None) -> DataFrame:
    return top(scores(vectors, queries, clamp, where), k)


def score_range(scored: DataFrame) -> DataFrame:
    return scored.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("avg_score"))


def _hashes(text: Column) -> Column:
    from ..functions.text import tokenize

    return F.transform(tokenize(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))


def _cells(hashes: pa.Array, dim: int) -> np.ndarray:
    """rows x 2 x dim: the sums of the signs of a row's tokens by cell, and the tokens' number by cell."""
    n, h = len(hashes), hashes.flatten().to_numpy(zero_copy_only=False)
    place = np.repeat(np.arange(n), pc.list_value_length(hashes).to_numpy(zero_copy_only=False)) * dim + h % dim
    counts = np.bincount(place, minlength=n * dim)
    sums = 2 * np.bincount(place[(h >> 40) % 2 == 0], minlength=n * dim) - counts
    return np.stack([sums.reshape(n, dim), counts.reshape(n, dim)], 1)


def _unit_rows(cells: np.ndarray) -> pa.Array:
    v = np.where(cells[:, 0].any(1, keepdims=True), cells[:, 0], cells[:, 1]).astype(np.float64)
    length = np.sqrt((v**2).sum(1, keepdims=True))
    return _listed(v / np.where(length > 0, length, 1))


def _listed(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """``hashed_vectors`` of a row's own text, where the row is read: nothing moves."""

    @F.arrow_udf(returnType="array<double>")
    def vector(hashes: pa.Array) -> pa.Array:
        return _unit_rows(_cells(hashes, dim))

    return vector(_hashes(text))


def hashed_vectors(rows: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """The default embedder: hashed tokens, signed, at length 1. id, v. Rows of one key are one text; a text without tokens
    has the zero vector; where the signs of all tokens cancel, the cells' counts stand for their sums. A row's tokens are counted
    where it is read, and only its cells are moved, as one row."""
    small_batches(rows.sparkSession)

    @F.arrow_udf(returnType="array<long>")
    def cells(hashes: pa.Array) -> pa.Array:
        return _listed(_cells(hashes, dim).reshape(len(hashes), 2 * dim))

    @F.arrow_udf(returnType="array<double>")
    def vector(cells: pa.Array) -> pa.Array:
        return _unit_rows(cells.flatten().to_numpy(zero_copy_only=False).reshape(len(cells), 2, dim))

    listed = rows.select(F.col(key).alias("id"), cells(_hashes(F.col(text))).alias("c")).groupBy("id").agg(F.collect_list("c").alias("l"))
    rest = F.slice("l", F.lit(2), F.size("l"))
    whole = F.when(F.size("l") == 1, F.element_at("l", 1)).otherwise(F.aggregate(rest, F.element_at("l", 1), lambda s, c: F.zip_with(s, c, lambda x, y: x + y)))
    return listed.select("id", vector(whole).alias("v"))

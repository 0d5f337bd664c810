"""Operator 9, exact top-k by inner product: a forest of M-trees, searched best first.

Vectors become integers, floor(1024 * x). One more component, sqrt(M - |v|^2) for stored vectors (M the largest
squared norm) and 0 for queries, turns the largest inner product into the smallest Euclidean distance. Rows are dealt
at random to trees of about ``TREE_ROWS`` rows, which are built once and stored, a row each; an inner node holds, for
each child, a centre, the covering radius and the distance to its own centre, and a leaf is a page of rows. The search
opens the node with the least lower bound; a child is passed over without computing its distance when the stored
distance to the parent already shows, by the triangle inequality, that it is too far. Scores are exact integer products
of the leaf rows.

Queries travel in blocks of about half ``QUERY_BLOCK`` rows, one block after the other: a block is searched in some trees
first, as many as there are cores, so that all of them have work; the k-th scores so far are the bounds with which it
goes to all others, so that these return little. A block's best rows are stored before the next one begins; nothing but
one block and its bounds is on the driver.

Vectors that are null or hold null or non-finite components take no part, nor do null ids; only vectors of one length
are compared. Components of ``HUGE`` and more are scanned without bounds, in Python's integers; scores that a long can't
hold are returned as its ends and rank alike there. Repeated rows are candidates each. The rows of one id are no
candidates of each other, and where an id has several query rows its k best are over all of them. Ties go to the smaller
id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import release, scratch_path, stash, text_batches

SCALE = 1024
TREE_ROWS = 8192
PAGE = 256
FANOUT = 16
QUERY_BLOCK = 8192
EXACT = 2**53
#: Scaled components from here on leave the trees' floating-point bounds.
HUGE = 2.0**26
LONG = 2**63


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as int64, or as Python's integers where those don't hold them."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * float(SCALE))
    if (np.abs(scaled) < 2.0**62).all():
        return scaled.astype(np.int64)
    flat = [int(y) if np.isfinite(y) else int(x) * SCALE for x, y in zip(vectors.ravel().tolist(), scaled.ravel(), strict=True)]
    return np.array(flat, object).reshape(vectors.shape)


class MTree:
    """Bulk-loaded; deterministic for the same rows in the same order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float):
        order = np.lexsort((*vectors.T[::-1][:4], ids))
        self.ids, self.vectors = ids[order], vectors[order]
        self.pages, self.top, self.most = [], largest, max(map(abs, vectors.ravel().tolist()), default=0)
        if self.most >= HUGE:  # one leaf, which is scanned
            self.root, self.floats = ("leaf", (0, len(ids))), None
            return
        norms = (self.vectors.astype(np.float64) ** 2).sum(1)
        self.points = np.column_stack([self.vectors, np.sqrt(np.maximum(largest - norms, 0))])
        self.rng = np.random.default_rng(0)
        self.root = self._node(np.arange(len(ids)), None)
        order = np.concatenate(self.pages) if self.pages else np.arange(0)  # a page's rows stand together
        self.ids, self.vectors, self.points = self.ids[order], self.vectors[order], None
        self.floats = self.vectors.astype(np.float64)

    def _far(self, rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - centre) ** 2).sum(1))

    def _node(self, rows: np.ndarray, centre: np.ndarray) -> tuple:
        """("leaf", places) or ("node", children's centres, radii, distances to this node's centre, children)."""
        if len(rows) <= PAGE:
            first = sum(map(len, self.pages))
            self.pages.append(rows)
            return ("leaf", (first, first + len(rows)))
        pivots = self.points[self.rng.choice(rows, min(FANOUT, -(-2 * len(rows) // PAGE)), replace=False)]
        near = ((pivots**2).sum(1)[None] - 2 * self.points[rows] @ pivots.T).argmin(1)
        groups = [rows[near == g] for g in range(len(pivots)) if (near == g).any()]
        if len(groups) == 1 or max(map(len, groups)) > 0.95 * len(rows):  # copies: no pivot parts them
            groups = np.array_split(rows, min(FANOUT, -(-len(rows) // PAGE)))
        centres = np.array([self.points[g].mean(0) for g in groups])
        radii = np.array([self._far(g, c).max() for g, c in zip(groups, centres, strict=True)])
        stored = np.sqrt(((centres - centre) ** 2).sum(1)) if centre is not None else np.zeros(len(groups))
        return ("node", centres, radii, stored, [self._node(g, c) for g, c in zip(groups, centres, strict=True)])

    def search(self, query: np.ndarray, own: int, k: int, least: int | None = None) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id) but ``own``, of those with a score of ``least`` or more, and the number of distances computed."""
        huge = self.floats is None or max(map(abs, query.tolist()), default=0) >= HUGE
        point = None if huge else np.append(query.astype(np.float64), 0.0)
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        reach = np.inf if least is None or huge else self._reach(query, least)
        seen, tick = 0, itertools.count()
        queue = [(0.0, next(tick), None, self.root)]
        while queue:
            bound, _, parent_far, node = heapq.heappop(queue)
            if bound > reach:
                break
            if node[0] == "leaf":
                low, high = node[1]
                scores, ids = self._scores(low, high, query), self.ids[low:high]
                seen += high - low
                keep = ids != own
                if least is not None:
                    keep &= (scores >= least).astype(bool)
                if len(best) == k:
                    keep &= ((scores > best[0][0]) | ((scores == best[0][0]) & (ids < -best[0][1]))).astype(bool)
                for at in np.flatnonzero(keep):
                    pair = (int(scores[at]), -int(ids[at]))
                    if len(best) < k:
                        heapq.heappush(best, pair)
                    elif pair > best[0]:
                        heapq.heapreplace(best, pair)
                if len(best) == k and not huge:
                    reach = min(reach, self._reach(query, best[0][0]))
                continue
            _, centres, radii, stored, children = node
            open_ = np.arange(len(children))
            if huge:
                for child in children:
                    heapq.heappush(queue, (0.0, next(tick), None, child))
                continue
            if parent_far is not None:
                open_ = open_[np.abs(parent_far - stored) - radii <= reach]
            far = np.sqrt(((centres[open_] - point) ** 2).sum(1))
            seen += len(open_)
            for c, d in zip(open_, far, strict=True):
                if (low := max(0.0, d - radii[c])) <= reach:
                    heapq.heappush(queue, (low, next(tick), d, children[c]))
        return [(s, -i) for s, i in sorted(best, reverse=True)], seen

    def _reach(self, query: np.ndarray, score: int) -> float:
        """The distance of a score, with room for rounding."""
        return float(np.sqrt(max(self._largest(query) - 2.0 * score, 0.0)) * (1 + 1e-9) + 1e-6)

    def _scores(self, low: int, high: int, query: np.ndarray) -> np.ndarray:
        """Exact integer inner products: floats hold them up to 2**53, Python's integers beyond."""
        if self.floats is not None and self.most * max(map(abs, query.tolist()), default=0) * len(query) < EXACT:
            return (self.floats[low:high] @ query.astype(np.float64)).astype(np.int64)
        return np.array([sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in self.vectors[low:high]], object)

    def _largest(self, query: np.ndarray) -> float:
        return float((query.astype(np.float64) ** 2).sum()) + self.top

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> MTree:
        huge = len(ids) and max(map(abs, vectors.ravel().tolist()), default=0) >= HUGE
        return cls(ids, vectors, float((vectors.astype(np.float64) ** 2).sum(1).max()) if len(ids) and not huge else 0.0)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v array<double>, dim, of the rows that take part."""
    good = F.expr("embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(good)
    return rows.select("vec_id", F.col("embedding").alias("v"), F.size("embedding").alias("dim"))


def _matrix(rows, dim: int) -> np.ndarray:
    return whole(np.stack(rows) if dim else np.zeros((len(rows), 0)))


def build_forest(rows: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """tree, dim, data (the tree): about ``tree_rows`` rows each; vectors with huge components have trees of their own."""
    trees = max(1, -(-rows.count() // tree_rows))
    dealt = stash(rows.withColumn("tree", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(trees))), "dealt-vectors")
    huge = F.exists("v", lambda x: F.abs(x) >= HUGE / SCALE)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        tree = MTree.of(pdf["vec_id"].to_numpy(), _matrix(pdf["v"].to_list(), dim))
        return pd.DataFrame({"tree": [int(pdf["tree"].iloc[0])], "dim": [dim], "data": [pickle.dumps(tree)]})

    spark = rows.sparkSession
    text_batches(spark)  # a batch of trees holds a few
    return stash(dealt.withColumn("huge", huge).groupBy("tree", "dim", "huge").applyInPandas(build, "tree long, dim int, data binary"), "forest")


def _searched(forest: DataFrame, queries: dict[int, tuple], k: int) -> DataFrame:
    """query_id, vec_id, score of the k best in each tree. queries: by dim, (ids, matrix, least scores)."""
    held = forest.sparkSession.sparkContext.broadcast(queries)  # QUERY_BLOCK rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tree, found = pickle.loads(data), []
                for q, v, least in zip(*held.value.get(dim, ((), (), ())), strict=True):
                    found += [(q, i, max(-LONG, min(LONG - 1, s))) for s, i in tree.search(v, q, k, least)[0]]
                yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], pa.int64()) for n in range(3)], ["query_id", "vec_id", "score"])

    out = stash(forest.select("dim", "data").mapInArrow(run, "query_id long, vec_id long, score long"), "nearest")
    held.destroy()
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, tree_rows: int = TREE_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = stash(usable(vectors), "vectors")
    forest = build_forest(rows, tree_rows)
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    blocks = max(1, -(-asked.count() // max(1, query_block // 2)))
    asked = stash(asked.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))), "queries")
    trees = max(1, spark.sparkContext.defaultParallelism)
    done = scratch_path(spark, "best")
    for block in range(blocks):  # one after the other
        queries: dict[int, tuple] = {}
        for r in asked.where(F.col("block") == block).orderBy("vec_id").collect():  # about half of query_block rows
            queries.setdefault(r.dim, ([], []))
            queries[r.dim][0].append(r.vec_id)
            queries[r.dim][1].append(np.array(r.v, np.float64))
        if not queries:
            continue
        queries = {dim: (ids, list(_matrix(rows_, dim)), [None] * len(ids)) for dim, (ids, rows_) in queries.items()}
        near = _searched(forest.where(F.col("tree") < trees), queries, k)
        # the k-th score so far; an id that has several query rows is bounded by its best ones together
        least = {r.query_id: r.score for r in _best(near, k).where(F.col("rank") == k).collect()}  # at most a row for each query
        queries = {dim: (ids, rows_, [None if abs(least.get(i, LONG)) >= LONG - 1 else least[i] for i in ids]) for dim, (ids, rows_, _) in queries.items()}
        far = _searched(forest.where(F.col("tree") >= trees), queries, k)
        _best(near.unionByName(far), k).select("query_id", "vec_id", "score").write.mode("append").parquet(done)
        release(near, far)
    schema = "query_id long, vec_id long, score long"
    found = spark.read.schema(schema).parquet(done) if asked.take(1) else spark.createDataFrame([], schema)
    return _best(found, k).select("query_id", "rank", "vec_id", "score")  # an id's rows may lie in several blocks

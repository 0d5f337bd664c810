"""Hybrid ranking: normalised sparse and dense candidates, fused, deduplicated, optionally reranked."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import sigmoid
from ..functions.text import collapsed, words
from ..plans.plugins import Embedder, PairScorer
from ..sources.scratch import stored
from .dense import dot
from .sparse import top


def normalized(scored: DataFrame, score: str = "score") -> Column:
    """Min-max over each query's candidates; 0.5 for all where they hardly differ."""
    per = Window.partitionBy("query_id")
    low, high = F.min(score).over(per), F.max(score).over(per)
    return between(F.col(score), low, high)


def between(score: Column, low: Column, high: Column) -> Column:
    """Where a score stands from 0 at low to 1 at high; 0.5 where these hardly differ."""
    return F.when(high - low < 1e-8, F.lit(0.5)).otherwise((score - low) / (high - low))


def fuse(sparse: DataFrame, dense: DataFrame, alpha: float = 0.7) -> DataFrame:
    """Full outer join of two candidate lists (query_id, id, score); a missing side counts 0."""
    a = sparse.select("query_id", "id", F.col("score").alias("score_raw_sparse"), normalized(sparse).alias("score_sparse"))
    b = dense.select("query_id", "id", F.col("score").alias("score_raw_dense"), normalized(dense).alias("score_dense"))
    both = a.join(b, ["query_id", "id"], "full_outer").fillna(0.0, ["score_raw_sparse", "score_sparse", "score_raw_dense", "score_dense"])
    return both.withColumn("score_hybrid", alpha * F.col("score_sparse") + (1 - alpha) * F.col("score_dense"))


def drop_same_text(ranked: DataFrame, texts: DataFrame, score: str = "score_hybrid") -> DataFrame:
    """Of candidates with one text (white space collapsed) the best stays. texts: id, text. Candidates are stored, and only
    their texts move: as long as the candidates' ids are small, other texts are dropped where they are read."""
    ranked = stored(ranked, "candidates")
    wanted = stored(ranked.select("id").distinct(), "candidate-ids")
    rows = ranked.join(texts.select("id", "text").join(wanted, "id", "left_semi"), "id", "left")
    key = F.coalesce(F.sha2(collapsed(F.col("text")), 256), F.col("id").cast("string"))
    order = Window.partitionBy("query_id", key).orderBy(F.desc(score), "id")
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def rerank(candidates: DataFrame, scorer: PairScorer) -> DataFrame:
    """scorer adds score_rerank to (query_id, id, text, ...); the sigmoid of it is kept, too."""
    return scorer(candidates).withColumn("score_rerank_norm", sigmoid(F.col("score_rerank")))


def hybrid(sparse_scores: DataFrame, dense_scores: DataFrame, texts: DataFrame, k: int = 10, alpha: float = 0.7, scorer: PairScorer | None = None, rerank_k: int | None = None) -> DataFrame:
    """query_id, id, text, the scores, rank. Each side gives twice the candidates that are kept before reranking."""
    keep = (rerank_k or 3 * k) if scorer else k
    fused = drop_same_text(fuse(top(sparse_scores, 2 * keep), top(dense_scores, 2 * keep), alpha), texts)
    best = top(fused, keep, "score_hybrid")
    if scorer is None:
        return best
    return top(rerank(best.drop("rank"), scorer), k, "score_rerank")


def compare(k: int = 5, **methods: DataFrame) -> DataFrame:
    """method, query_id, rank, id, score: the best k of each method side by side."""
    parts = [top(df, k).select(F.lit(name).alias("method"), "query_id", "rank", "id", "score") for name, df in methods.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overlap(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """How many candidates of each query both sides, only sparse, only dense have."""
    both = sparse.select("query_id", "id", F.lit(1).alias("s")).join(dense.select("query_id", "id", F.lit(1).alias("d")), ["query_id", "id"], "full_outer")
    return both.groupBy("query_id").agg(F.count_if(F.expr("s = 1 and d = 1")).alias("in_both"), F.count_if(F.expr("d is null")).alias("only_sparse"), F.count_if(F.expr("s is null")).alias("only_dense"))


def documents(ranked: DataFrame, score: str = "score_hybrid", metadata: bool = True) -> DataFrame:
    """query_id, rank, page_content, score, and metadata: a struct of all other columns of a ranking that has text. What
    callers that want documents with metadata need, from the fields as they are."""
    rest = [c for c in ranked.columns if c not in ("query_id", "rank", "text")]
    out = [F.col("query_id"), F.col("rank"), F.coalesce("text", F.lit("")).alias("page_content"), F.col(score).alias("score")]
    return ranked.select(*out, *[F.struct(*rest).alias("metadata")] * metadata)


def as_json(ranked: DataFrame, alpha: float, k: int) -> DataFrame:
    """query_id, result: one JSON document for each query, rows by rank."""
    row = F.struct("rank", "id", "score_hybrid", "score_sparse", "score_dense", "score_raw_dense")
    rows = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("results"))
    return rows.select("query_id", F.to_json(F.struct("query_id", F.lit(alpha).alias("alpha"), F.lit(k).alias("top_k"), "results")).alias("result"))


def late_interaction_scorer(queries: DataFrame, embed: Embedder | None = None, dim: int = 64) -> PairScorer:
    """A pair scorer by late interaction: for each distinct token of the query its best cosine with a token of the text, summed
    over the query's tokens and divided by their number. Only the candidates' tokens are looked at. embed: vectors of
    tokens, each made once; by default ``trigram_vector``. queries: query_id, query.

    A query without tokens scores 0, and so does a text without any.
    """
    tokens = lambda c: F.array_distinct(words(F.lower(F.coalesce(F.col(c), F.lit("")))))

    def by_trigrams(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vector = lru_cache(100_000)(lambda token: trigram_vector(token, dim))
            for b in batches:
                scores = []
                for q, t in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                    both = q and t and np.array([vector(x) for x in q]) @ np.array([vector(x) for x in t]).T
                    scores.append(float(both.max(1).mean()) if q and t else 0.0)
                yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(scores, pa.float64())], [*b.schema.names[:-2], "score_rerank"])

        schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-2]) + ", score_rerank double"
        return rows.mapInArrow(run, schema)

    def score(candidates: DataFrame) -> DataFrame:
        asked = queries.select("query_id", tokens("query").alias("__q"))
        if embed is None:
            rows = candidates.join(asked, "query_id").withColumn("__t", tokens("text"))
            return by_trigrams(rows.select(*candidates.columns, "__q", "__t"))
        rows = stored(candidates, "reranked")
        near = asked.join(rows.select("query_id").distinct(), "query_id", "left_semi").select("query_id", F.explode("__q").alias("token"))
        texts = stored(rows.select("id", "text").dropDuplicates(["id"]).select("id", F.explode(tokens("text")).alias("token")), "candidate-tokens")
        vectors = stored(embed(near.select("token").unionByName(texts.select("token")).distinct(), "token", "token").select(F.col("id").alias("token"), "v"), "token-vectors")
        left = near.join(vectors, "token").groupBy("query_id").agg(F.collect_list("v").alias("__q"))
        right = texts.join(vectors, "token").groupBy("id").agg(F.collect_list("v").alias("__t"))
        met = rows.join(left, "query_id", "left").join(right, "id", "left")
        best = F.transform("__q", lambda q: F.array_max(F.transform("__t", lambda t: dot(q, t))))
        total = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size("__q")
        return met.withColumn("score_rerank", F.coalesce(F.when(F.size("__t") > 0, total), F.lit(0.0))).drop("__q", "__t")

    return score


def trigram_vector(token: str, dim: int = 64) -> np.ndarray:
    """The unit vector of a token's character trigrams, with a mark at both ends, each counted in the cell that the first two
    bytes of its MD5 give."""
    marked, v = f"<{token}>", np.zeros(dim)
    for i in range(len(marked) - 2):
        v[int.from_bytes(hashlib.md5(marked[i : i + 3].encode("utf-8", "surrogatepass")).digest()[:2], "big") % dim] += 1
    return v / np.sqrt((v**2).sum())


def overlap_scorer(queries: DataFrame) -> PairScorer:
    """The default pair scorer: share of the query's words that the text has. queries: query_id, query."""
    def score(candidates: DataFrame) -> DataFrame:
        rows = candidates.join(queries.select("query_id", "query"), "query_id")
        asked = F.array_distinct(words(F.lower("query")))
        return rows.withColumn("score_rerank", F.size(F.array_intersect(asked, words(F.lower("text")))) / F.greatest(F.size(asked), F.lit(1)).cast("double")).drop("query")

    return score

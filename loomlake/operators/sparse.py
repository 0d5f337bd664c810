"""BM25: an inverted index as tables, and batches of queries against it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..sources.versions import Versioned

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Postings, in multiples of k, that the first bound is taken from, and what sums in another order may differ by.
FIRST_ROWS, MARGIN = 50, 1e-6


@dataclass
class SparseIndex:
    """docs: id, dl. postings: id, dl, token, tf. terms: token, df, max_tf. stats: n, avgdl (one row). All may be read from
    Parquet."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame
    stats: DataFrame

    def save(self, path: str) -> None:
        """As a new version; until it is whole, the old one is loaded."""
        tables = {name: getattr(self, name) for name in ("docs", "postings", "terms", "stats")}
        Versioned(self.docs.sparkSession, path).publish(tables, {"kind": "postings"})

    @classmethod
    def load(cls, spark, path: str) -> SparseIndex:
        return cls(*(Versioned(spark, path).read(name) for name in ("docs", "postings", "terms", "stats")))

    def release(self) -> None:
        """Let go of what ``build`` held."""
        self.docs.unpersist()
        self.postings.unpersist()


def build(chunks: DataFrame, key: str, text: str = "text", keep: bool = True) -> SparseIndex:
    """keep: hold postings and lengths (memory, then disk) while jobs read them several times, until ``release``; a saved
    index that is loaded needs no such thing. Every token carries its row's length, so that scoring needs no join for it."""
    tokens = chunks.select(F.col(key).alias("id"), tokenize(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    sized = tokens.select("id", F.size("w").cast("long").alias("dl"), "w")
    docs = sized.select("id", "dl")
    postings = sized.select("id", "dl", F.explode("w").alias("token")).groupBy("id", "dl", "token").agg(F.count("*").alias("tf"))
    if keep:
        docs, postings = docs.persist(), postings.persist()
    terms = postings.groupBy("token").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"))
    stats = docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return SparseIndex(docs, postings, terms, stats)


def counted(chunks: DataFrame, text: str = "text") -> DataFrame:
    """n, avgdl, n_terms, n_tokens of the chunks (one row): tokens are counted in the tasks, and only a row for each distinct one
    that a task has moves. No index is made."""
    tokens = chunks.select(F.posexplode_outer(tokenize(F.coalesce(F.col(text), F.lit("")))).alias("i", "token"))
    each = tokens.groupBy("token").agg(F.count("token").alias("tf"), F.count_if(F.coalesce("i", F.lit(0)) == 0).alias("n"))
    n = F.coalesce(F.sum("n"), F.lit(0))
    return each.agg(n.alias("n"), (F.sum("tf") / F.sum("n")).alias("avgdl"), F.count("token").alias("n_terms"), F.sum("tf").alias("n_tokens"))


def idf(df: Column, n: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5))


def term_weights(index: SparseIndex, floor: str = "epsilon") -> DataFrame:
    """token, df, max_tf, idf. Floors for terms in more than half of the rows: 'epsilon' (a quarter of the mean idf), 'none',
    'plus_one' (the logarithm of one more)."""
    if floor not in ("epsilon", "none", "plus_one"):
        raise ValueError("floor is one of epsilon, none, plus_one")
    raw = index.terms.crossJoin(F.broadcast(index.stats)).withColumn("idf", idf(F.col("df"), F.col("n")))  # one row of two numbers
    if floor == "none":
        return raw.select("token", "df", "max_tf", "idf")
    if floor == "plus_one":
        return raw.select("token", "df", "max_tf", F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    mean = raw.agg(F.avg("idf").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("token", "df", "max_tf", F.when(F.col("idf") < 0, EPSILON * F.col("mean")).otherwise(F.col("idf")).alias("idf"))


def _asked(index: SparseIndex, queries: DataFrame, query_id: str, query: str, floor: str) -> DataFrame:
    """query_id, token, weight (times asked * idf), df, max_tf."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokenize(F.col(query))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    return asked.join(term_weights(index, floor), "token").withColumn("weight", F.col("times") * F.col("idf")).drop("times", "idf")


def _parts(hits: DataFrame, index: SparseIndex, k1: float, b: float) -> DataFrame:
    """hits (query_id, id, weight, tf, dl) to query_id, id, score."""
    tf, norm = F.col("tf"), k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    rows = hits.crossJoin(F.broadcast(index.stats))  # one row of two numbers
    return rows.groupBy("query_id", "id").agg(F.sum(F.col("weight") * tf * (k1 + 1) / (tf + norm)).alias("score"))


def scores(index: SparseIndex, queries: DataFrame, query_id: str, query: str, floor: str = "epsilon", k1: float = K1, b: float = B) -> DataFrame:
    """query_id, id, score of every row that shares a token. Repeated query tokens count repeatedly.

    Postings are cut to the queries' vocabulary before they meet anything else; whether small sides are broadcast is
    left to their measured size. ``best`` is the way to the first k of them.
    """
    return _parts(_asked(index, queries, query_id, query, floor).join(index.postings, "token"), index, k1, b)


def best(index: SparseIndex, queries: DataFrame, query_id: str, query: str, k: int = 10, floor: str = "epsilon", k1: float = K1, b: float = B) -> DataFrame:
    """query_id, id, score of the k best rows of each query and of others that come near, exact and without scoring all rows.

    A query's terms are ordered from rare to common, each with the most that it can add to a score. The rarest ones are
    scored first; their k-th sum is a bound that the k best rows reach. Common terms whose most adds up to less than the
    bound bring in no row of their own: they are looked up only for rows whose score from the other terms can still reach
    it. Where a term can lower a score (idf below zero) all terms count from the start.
    """
    asked = _asked(index, queries, query_id, query, floor)
    order = Window.partitionBy("query_id").orderBy("df", "token")
    most = F.greatest(F.col("weight"), F.lit(0.0)) * (k1 + 1) * F.col("max_tf") / (F.col("max_tf") + k1 * (1 - b))
    terms = asked.withColumns({
        "before": F.coalesce(F.sum("df").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum(most).over(order.rowsBetween(0, Window.unboundedFollowing)),
        "lowers": F.min("weight").over(Window.partitionBy("query_id")) < 0,
    })
    first = _parts(terms.where(F.col("before") < FIRST_ROWS * k).join(index.postings, "token"), index, k1, b)
    bound = top(first, k).groupBy("query_id").agg(F.min("score").alias("bound"), F.count("*").alias("n")).where(F.col("n") == k).select("query_id", (F.col("bound") - MARGIN).alias("bound"))
    marked = terms.join(bound, "query_id", "left").withColumn("opens", F.col("lowers") | F.col("bound").isNull() | (F.col("rest") >= F.col("bound")))
    closed = marked.where(~F.col("opens"))
    left = closed.groupBy("query_id").agg(F.max("rest").alias("left"), F.max("bound").alias("bound"))
    opened = _parts(marked.where("opens").join(index.postings, "token"), index, k1, b)
    able = opened.join(left, "query_id", "left").where(F.col("left").isNull() | (F.col("score") + F.col("left") >= F.col("bound"))).select("query_id", "id", "score")
    wanted = able.select("query_id", "id").join(closed.select("query_id", "token", "weight"), "query_id")
    more = _parts(wanted.join(index.postings, ["id", "token"]), index, k1, b)
    return able.unionByName(more).groupBy("query_id", "id").agg(F.sum("score").alias("score"))


def top(scored: DataFrame, k: int = 10, score: str = "score", tie: str = "id") -> DataFrame:
    """The k best of each query with their rank from 1; ties go to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: SparseIndex, queries: DataFrame, query_id: str, query: str, k: int = 10, floor: str = "epsilon", fill: bool = False, prune: bool = False) -> DataFrame:
    """query_id, id, score, rank. ``fill``: queries with fewer hits are filled up with rows of score 0, ids ascending.
    ``prune``: by bounds (see ``best``), for short queries with rare words; passages as long as the rows themselves share
    common words with nearly all rows, and scoring these once is cheaper."""
    found = best(index, queries, query_id, query, k, floor) if prune else scores(index, queries, query_id, query, floor)
    if fill:
        firsts = index.docs.select("id").orderBy("id").limit(k)  # k rows; negative scores rank below them
        more = queries.select(F.col(query_id).alias("query_id")).distinct().crossJoin(F.broadcast(firsts))
        found = found.unionByName(more.join(found, ["query_id", "id"], "left_anti").withColumn("score", F.lit(0.0)))
    return top(found, k)

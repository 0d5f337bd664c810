"""Retrieval metrics as one aggregation over judged results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.scratch import stored
from .dense import QUERY_ROWS

CUTS = (1, 3, 5, 10)


def load_truth(rows: DataFrame, key: str = "id", fields: tuple[str, ...] = ("text", "label_answer", "answer")) -> DataFrame:
    """query_id, answer: the first field that is there and not empty; rows without an id or an answer go, and id 0 stays. Of
    rows with one id the one with the greatest answer counts."""
    there = [F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields if f in rows.columns]
    found = rows.select(F.col(key).alias("query_id"), (F.coalesce(*there) if there else F.lit(None).cast("string")).alias("answer"))
    return found.where("query_id is not null and answer is not null").groupBy("query_id").agg(F.max("answer").alias("answer"))


def containment(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str) -> DataFrame:
    """query_id, id of the documents that hold an item word for word.

    A text that holds an item has each of its inner words (all but the first and the last) between blanks. Documents and
    items meet by the item's rarest inner word, as counted over all documents; an item one of whose inner words is nowhere
    meets none. Then only the texts that were met move, each once. Items of one or two words may lie inside other words and
    are compared with every text, in blocks.
    """
    asked = items.select(F.col(item_id).alias("query_id"), F.col(item_text).alias("q"))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(doc_text).alias("t"))
    own = words(F.col("q"))
    keyed = asked.where("q is not null").withColumn("w", F.array_distinct(F.slice(own, 2, F.greatest(F.size(own) - 2, F.lit(0)))))
    inner = stored(keyed.where("size(w) > 0").select("query_id", F.explode("w").alias("w")), "item-words")
    texts = rows.select("id", F.explode(F.array_distinct(words(F.col("t")))).alias("w"))
    counts = texts.join(inner.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count("*").alias("df"))
    rarest = inner.join(counts, "w", "left").groupBy("query_id").agg(F.min(F.struct("df", "w")).alias("r"), F.count_if(F.col("df").isNull()).alias("missing"))
    rarest = stored(rarest.where("missing = 0").select("query_id", "r.w"), "rarest-words")
    met = stored(texts.join(rarest, "w").select("id", "query_id").distinct(), "met")
    near = rows.join(stored(met.select("id").distinct(), "met-ids"), "id", "left_semi")
    found = near.join(met, "id").join(asked, "query_id").where(F.contains("t", F.col("q"))).select("query_id", "id").distinct()
    short = keyed.where("size(w) = 0").drop("w")
    blocks = -(-short.count() // (QUERY_ROWS // 2))
    numbered = short.withColumn("__b", F.pmod(F.xxhash64("query_id"), F.lit(max(1, blocks))))
    for b in range(blocks):
        part = rows.crossJoin(F.broadcast(numbered.where(F.col("__b") == b))).where(F.contains("t", F.col("q")))
        found = found.unionByName(part.select("query_id", "id").distinct())
    return found


def judge(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """ranked (query_id, id, rank, ...) with rel 0/1 and n_rel; queries without truth are left out. truth: query_id, id."""
    facts = truth.select("query_id", "id").distinct()
    counts = facts.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    marked = ranked.join(facts.withColumn("rel", F.lit(1)), ["query_id", "id"], "left").fillna(0, ["rel"])
    return marked.join(counts, "query_id")


def metrics(judged: DataFrame, cuts: tuple[int, ...] = CUTS, gain: str | None = None, ap_denominator: str = "retrieved") -> DataFrame:
    """One row for each query: precision, recall, hit rate and NDCG at the cuts, reciprocal rank, average precision.

    gain: a column that weighs NDCG's gains (default 1). ap_denominator: 'retrieved' divides by the relevant rows that
    were retrieved, 'relevant' by all relevant rows.
    """
    seen = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = judged.withColumn("__p", F.sum("rel").over(seen) / F.col("rank"))
    value = F.col(gain) if gain else F.lit(1.0)
    n_rel = F.first("n_rel")
    out = []
    for k in cuts:
        hits = F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0))
        dcg = F.sum(F.when((F.col("rank") <= k) & (F.col("rel") == 1), value / F.log2(F.col("rank") + 1)).otherwise(0.0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(n_rel, F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
        out += [(hits / k).alias(f"precision_{k}"), (hits / n_rel).alias(f"recall_{k}"), (hits > 0).cast("double").alias(f"hit_{k}"), (dcg / ideal).alias(f"ndcg_{k}")]
    first = F.min(F.when(F.col("rel") == 1, F.col("rank")))
    total = F.sum(F.when(F.col("rel") == 1, F.col("__p")))
    below = n_rel if ap_denominator == "relevant" else F.sum("rel")
    return rows.groupBy("query_id").agg(*out, F.coalesce(1 / first, F.lit(0.0)).alias("rr"), F.coalesce(total / F.nullif(below, F.lit(0)), F.lit(0.0)).alias("ap"))


def summary(per_query: DataFrame) -> DataFrame:
    """metric, mean, std (of the population) over the queries."""
    names = [c for c in per_query.columns if c != "query_id"]
    long = per_query.select("query_id", F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("double"))])).alias("metric", "value"))
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"))


def relevant_by_similarity(answers: DataFrame, candidates: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Truth (query_id, id) from vectors: chunks whose cosine with the true answer reaches the threshold. answers:
    query_id, av; candidates: query_id, id, v; unit vectors."""
    from .dense import dot

    return candidates.join(answers, "query_id").where(dot(F.col("av"), F.col("v")) >= threshold).select("query_id", "id")

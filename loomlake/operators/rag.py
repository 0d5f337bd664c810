"""From ranked chunks to answers: context, relevance gate, extractive fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions import text as T
from ..plans.plugins import Generator

NO_ANSWER = "The knowledge base holds no sufficient answer."
JOINT = "\n\n---\n\n"


def pack_context(ranked: DataFrame, most: int = 4000, shortest: int = 20, label: str = "source") -> DataFrame:
    """query_id, context, n_blocks. ranked: query_id, rank, text, and title, kb_family where there are any. Blocks are
    numbered by rank, corrupt and short ones are left out, and the one that overflows is cut and is the last."""
    title = F.coalesce("title", F.lit("")) if "title" in ranked.columns else F.lit("")
    family = F.coalesce("kb_family", F.lit("")) if "kb_family" in ranked.columns else F.lit("")
    text = F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(f"[{label} "), F.col("rank").cast("string"), F.lit("]"), F.when((title != "") & (family != "qa_pair"), F.concat(F.lit(" "), title)).otherwise(F.lit("")), F.lit("\n"))
    good = ranked.where(~T.is_heavily_corrupt(text) & (F.length(T.strip(text)) >= shortest))
    order = Window.partitionBy("query_id").orderBy("rank")
    blocks = good.withColumn("__first", F.row_number().over(order) == 1).withColumn("__block", F.concat(F.when(F.col("__first"), "").otherwise(F.lit(JOINT)), T.strip(F.concat(head, T.strip(text)))))
    before = F.coalesce(F.sum(F.length("__block")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = blocks.withColumn("__left", F.lit(most) - before).where("__left > 0").withColumn("__block", F.expr("substring(__block, 1, cast(__left as int))"))
    rows = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "__block"))).alias("b"))
    return rows.select("query_id", T.strip(F.array_join(F.transform("b", lambda x: x["__block"]), "\n")).alias("context"), F.size("b").cast("long").alias("n_blocks"))


def relevance(ranked: DataFrame, threshold: float = 0.5, score: str = "score_hybrid") -> DataFrame:
    """query_id, top_score, avg_top_score (of the first three), used_kb."""
    first = F.when(F.col("rank") <= 3, F.col(score))
    rows = ranked.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col(score))).alias("top_score"), F.avg(first).alias("avg_top_score"))
    return rows.withColumn("used_kb", F.col("avg_top_score") >= threshold)


def _first_sentences(text: Column, n: int = 3) -> Column:
    parts = F.filter(F.transform(F.slice(F.split(text, r"\."), 1, n), T.strip), lambda s: s != "")
    return F.array_join(parts, ". ")


def fallback_answers(queries: DataFrame, ranked: DataFrame, message: str = NO_ANSWER) -> DataFrame:
    """query_id, answer: the first sentences of the chunk that holds the most words of the query. queries: query_id,
    query; ranked: query_id, rank, text."""
    asked = F.array_distinct(T.words(F.lower("query")))
    rows = queries.select("query_id", "query").join(ranked.select("query_id", "rank", F.coalesce("text", F.lit("")).alias("text")), "query_id", "left")
    hits = F.size(F.filter(asked, lambda w: F.contains(F.lower("text"), w)))
    scored = rows.withColumn("hits", F.when(F.col("rank").isNull(), F.lit(0)).otherwise(hits))
    best = F.max_by("text", F.struct("hits", -F.col("rank")))
    picked = scored.groupBy("query_id").agg(best.alias("best"), F.max("hits").alias("hits"), F.min_by("text", "rank").alias("first"))
    sentences, head = _first_sentences(F.col("best")), T.strip(F.substring("first", 1, 200))
    answer = F.when((F.col("hits") > 0) & (sentences != ""), F.concat(sentences, F.lit("."))).when(head != "", F.concat(head, F.lit("..."))).otherwise(F.lit(message))
    return picked.select("query_id", answer.alias("answer"))


def answer(queries: DataFrame, ranked: DataFrame, threshold: float = 0.5, most: int = 4000, generate: Generator | None = None, shortest: int = 20) -> DataFrame:
    """query_id, query, answer, used_kb, top_score, avg_top_score, used_chunks for a batch of questions.

    ``generate`` adds ``generated`` to (query_id, prompt); without it, or where its text is short, the extractive
    answer stands.
    """
    gate = relevance(ranked, threshold)
    rows = queries.select("query_id", "query").join(gate, "query_id", "left").join(pack_context(ranked, most), "query_id", "left").join(fallback_answers(queries, ranked), "query_id")
    used = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("used_chunks"))
    rows = rows.join(used, "query_id", "left").withColumn("used_kb", F.coalesce("used_kb", F.lit(False)))
    prompt = F.when(F.col("used_kb"), prompts.answer_prompt(F.col("query"), F.col("context"))).otherwise(prompts.fill(prompts.PLAIN_TEMPLATE, query=F.col("query")))
    rows = rows.withColumn("prompt", prompt)
    if generate is not None:
        made = generate(rows.select("query_id", "prompt")).select("query_id", T.clean_answer(F.col("generated")).alias("generated"))
        rows = rows.join(made, "query_id", "left").withColumn("answer", F.when(F.length("generated") >= shortest, F.col("generated")).otherwise(F.col("answer")))
    chunks = F.when(F.col("used_kb"), F.col("used_chunks"))
    return rows.select("query_id", "query", "answer", "used_kb", "top_score", "avg_top_score", chunks.alias("used_chunks"))

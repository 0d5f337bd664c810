"""Multi-label data sets: metrics, exact splits, balance plans, augmentation quotas."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import text as T
from .ranks import numbered


def samples(rows: DataFrame, text: str, codes: str, code_table: dict[str, str], names: list[str]) -> DataFrame:
    """rows (with id) to id, text, labels, label_indices; rows without text or labels go."""
    own = T.strip(F.col(text))
    found = rows.select("id", own.alias("text"), L.parse_codes(F.col(codes), code_table, names).alias("label_indices"))
    good = found.where("text is not null and text <> '' and lower(text) <> 'nan' and size(label_indices) > 0")
    return good.select("id", "text", L.multi_hot(F.col("label_indices"), len(names)).alias("labels"), "label_indices")


#: What each task reads: its text column, label codes and names.
TASKS = {
    "qtypes": ("question", "final_QT", L.QUESTION_CODES, L.QUESTION_LABELS),
    "atypes": ("answer", "final_AS", L.ANSWER_CODES, L.ANSWER_LABELS),
}


def prepare(rows: DataFrame, task: str, folder: str | None = None) -> DataFrame:
    """Samples of a task with their part (train, val, test) of a 60/20/20 split; with a folder, one folder of JSON lines for
    each part and the label list are written there, too."""
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}: one of {', '.join(TASKS)}")
    text, codes, table, names = TASKS[task]
    parted = split(samples(rows, text, codes, table, names))
    if folder:
        for part in ("train", "val", "test"):
            parted.where(F.col("part") == part).drop("part").write.mode("overwrite").json(f"{folder}/{task}/{part}")
        rows.sparkSession.createDataFrame(list(enumerate(names)), "label int, name string").coalesce(1).write.mode("overwrite").json(f"{folder}/{task}/label_list")
    return parted


def label_counts(rows: DataFrame, labels: str = "labels") -> DataFrame:
    """label, n of the labels that occur."""
    return rows.select(F.posexplode(labels).alias("label", "v")).where("v = 1").groupBy("label").agg(F.count("*").alias("n"))


def multilabel_metrics(rows: DataFrame, truth: str = "labels", guess: str = "predicted") -> DataFrame:
    """f1_micro, f1_weighted, jaccard (mean over samples); a division by zero is 0."""
    cells = rows.select(F.posexplode(F.arrays_zip(F.col(truth).alias("t"), F.col(guess).alias("p"))).alias("label", "c")).select("label", "c.t", "c.p")
    per = cells.groupBy("label").agg(F.sum(F.expr("t * p")).alias("tp"), F.sum(F.expr("(1 - t) * p")).alias("fp"), F.sum(F.expr("t * (1 - p)")).alias("fn"))
    zero = F.lit(0.0)
    per = per.withColumn("f1", F.coalesce(2.0 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), zero)).withColumn("support", F.col("tp") + F.col("fn"))
    total = per.agg(
        F.coalesce(2.0 * F.sum("tp") / F.nullif(2 * F.sum("tp") + F.sum("fp") + F.sum("fn"), F.lit(0)), zero).alias("f1_micro"),
        F.coalesce(F.sum(F.col("f1") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0)), zero).alias("f1_weighted"),
    )
    both = F.size(F.filter(F.arrays_zip(F.col(truth).alias("t"), F.col(guess).alias("p")), lambda x: (x["t"] == 1) & (x["p"] == 1)))
    either = F.size(F.filter(F.arrays_zip(F.col(truth).alias("t"), F.col(guess).alias("p")), lambda x: (x["t"] == 1) | (x["p"] == 1)))
    share = rows.agg(F.coalesce(F.avg(F.coalesce(both / F.nullif(either, F.lit(0)), zero)), zero).alias("jaccard"))
    return total.crossJoin(F.broadcast(share))  # one row each


def split_sizes(n: int) -> dict[str, int]:
    """60/20/20 with the rest rounded up, and half of it rounded up to the test part."""
    rest = math.ceil(n * 4 / 10)
    test = math.ceil(rest / 2)
    return {"train": n - rest, "val": rest - test, "test": test}


def split(rows: DataFrame, key: str = "id", seed: int = 42, buckets: int = 4096) -> DataFrame:
    """rows with ``part``: sizes are exact, membership goes by the hash of key and seed. Ranks are counted in buckets of
    the hash, so that no task orders the whole table."""
    h = F.xxhash64(F.col(key).cast("string"), F.lit(seed))
    hashed = rows.withColumn("__h", h).withColumn("__b", F.floor(F.shiftrightunsigned("__h", 1) / F.lit(2**63 // buckets)).cast("int"))
    sizes = hashed.groupBy("__b").count()
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))  # one row for each bucket
    n = rows.count()
    parts = split_sizes(n)
    inside = Window.partitionBy("__b").orderBy("__h", key)
    ranked = hashed.withColumn("__i", F.row_number().over(inside)).join(F.broadcast(bases), "__b").withColumn("__r", F.col("__base") + F.col("__i"))
    part = F.when(F.col("__r") <= parts["train"], "train").when(F.col("__r") <= parts["train"] + parts["val"], "val").otherwise("test")
    return ranked.withColumn("part", part).drop("__h", "__b", "__base", "__i", "__r")


def balance_plan(rows: DataFrame, labels: str = "labels", target: int | None = None) -> DataFrame:
    """label, n, target, needed of the labels under the upper median of the counts."""
    counts = label_counts(rows, labels)
    stats = counts.agg(F.array_sort(F.collect_list("n")).alias("c")).select(F.expr("element_at(c, cast(size(c) div 2 + 1 as int))").alias("m"))
    total = rows.agg(F.count("*").alias("total"))
    every = counts.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(total))  # one row each
    goal = F.lit(target) if target is not None else F.ceil((1 - F.col("n") / F.col("total")) * F.col("m"))
    return every.where("n < m").withColumn("target", goal.cast("long")).select("label", "n", "target", F.greatest(F.col("target") - F.col("n"), F.lit(0)).alias("needed"))


def balance_sources(rows: DataFrame, plan: DataFrame, key: str = "id", labels: str = "labels") -> DataFrame:
    """label, key, place: the rows that can be varied for each label in need, those whose labels are all in need first."""
    wanted = plan.where("needed > 0").select("label")
    scarce = plan.agg(F.collect_set("label").alias("scarce"))  # as many numbers as labels
    own = rows.withColumn("__i", L.hot_indexes(F.col(labels))).crossJoin(F.broadcast(scarce))
    each = own.select(key, F.explode("__i").alias("label"), (F.size(F.array_except("__i", "scarce")) == 0).alias("only_scarce")).join(F.broadcast(wanted), "label")
    placed = numbered(each, ["label"], [F.desc("only_scarce"), F.col(key)], "place")
    return placed.select("label", key, "only_scarce", F.col("place").cast("int").alias("place"))


def augmented(rows: DataFrame, plan: DataFrame, variants: DataFrame, key: str = "id", labels: str = "labels", most_per_sample: int = 20) -> DataFrame:
    """New rows label, source, text, labels from a generator's variants (key, n, text): sources in order, at most
    ``most_per_sample`` texts each, until the label's need is met. The new labels are the target and the source's
    other labels in need."""
    scarce = plan.agg(F.collect_set("label").alias("scarce"))
    texts = variants.where(F.col("n") <= min(most_per_sample, 20)).withColumnRenamed("text", "new_text")
    picked = balance_sources(rows, plan, key, labels).join(texts, key)
    picked = numbered(picked, ["label"], [F.col("place"), F.col("n")], "made").join(F.broadcast(plan.select("label", "needed")), "label").where("made <= needed")
    whole = picked.join(rows.select(key, F.col(labels).alias("__l")), key).crossJoin(F.broadcast(scarce))
    new = F.transform("__l", lambda v, i: F.when((i == F.col("label")) | ((v == 1) & F.array_contains("scarce", i)), 1).otherwise(0))
    return whole.select("label", F.col(key).alias("source"), F.col("new_text").alias("text"), new.alias("labels"))

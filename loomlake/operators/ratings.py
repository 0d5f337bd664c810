"""Manual ratings of answers: upsert, progress, navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(ratings: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (id, rating, comment): a rating is set where given, a comment where not empty."""
    new = changes.select("id", F.col("rating").alias("__r"), F.nullif("comment", F.lit("")).alias("__c"))
    rows = ratings.join(new, "id", "left")
    return rows.withColumns({"manual_rating": F.coalesce("__r", "manual_rating"), "manual_comment": F.coalesce("__c", "manual_comment")}).drop("__r", "__c")


def progress(ratings: DataFrame) -> DataFrame:
    rows = ratings.agg(F.count("*").alias("total"), F.count("manual_rating").alias("evaluated"), F.round(F.avg("manual_rating"), 6).alias("mean_rating"))
    return rows.withColumns({"remaining": F.col("total") - F.col("evaluated"), "percent": F.round(100.0 * F.col("evaluated") / F.greatest("total", F.lit(1)), 6)})


def move(place: int, total: int, step: str | int) -> int:
    """The place after first, last, next, previous or a jump, kept inside the list."""
    to = {"first": 0, "last": total - 1, "next": place + 1, "previous": place - 1}.get(step, step)
    return min(max(0, to), max(0, total - 1))

"""Label codes and multi-hot vectors as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label order and codes of the two tasks.
QUESTION_LABELS = ["diagnosis", "treatment", "anatomy", "epidemiology", "healthy_lifestyle", "provider_choice", "other"]
QUESTION_CODES = {"A": "treatment", "B": "diagnosis", "C": "anatomy", "D": "healthy_lifestyle", "E": "epidemiology", "F": "provider_choice", "Z": "other"}
ANSWER_LABELS = ["information", "direct_guidance", "emotional_support"]
ANSWER_CODES = {"1": "information", "2": "direct_guidance", "3": "emotional_support"}


def parse_codes(c: Column, codes: dict[str, str], labels: list[str]) -> Column:
    """Sorted distinct label indexes of a bracketed or comma-separated code list; unknown codes are dropped."""
    raw = F.coalesce(c, F.lit(""))
    halfopen = (raw.startswith("[") != raw.endswith("]")) | (raw.startswith("[") & ~raw.rlike(r"^\[\s*(?:('[^']*'|\"[^\"]*\"|\d+)\s*(,\s*('[^']*'|\"[^\"]*\"|\d+)\s*)*,?\s*)?\]$"))
    parts = F.transform(F.split(F.regexp_replace(raw, r"^\[|\]$", ""), ","), lambda x: F.trim(F.regexp_replace(F.trim(x), "^['\"]+|['\"]+$", "")))
    table = F.create_map(*[F.lit(v) for k, name in codes.items() for v in (k, labels.index(name))])
    known = F.filter(F.transform(parts, lambda x: F.try_element_at(table, x)), lambda x: x.isNotNull())
    none = F.array().cast("array<int>")
    return F.when(raw.startswith("[") & halfopen, none).otherwise(F.array_sort(F.array_distinct(known)))


def multi_hot(indexes: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_contains(indexes, i.cast("int")).cast("int"))


def hot_indexes(vector: Column) -> Column:
    return F.filter(F.transform(vector, lambda x, i: F.when(x == 1, i)), lambda i: i.isNotNull())


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def predict(logits: Column, threshold: float = 0.5) -> Column:
    return F.transform(logits, lambda x: (sigmoid(x) >= threshold).cast("int"))

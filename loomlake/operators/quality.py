"""Validation, first-occurrence dedup, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

ARTICLE_FIELDS = ["doc_id", "content_type", "url", "title", "clean_text"]
BOOK_FIELDS = ["doc_id", "content_type", "url", "title"]


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string") != "", F.lit(False))


def _has(docs: DataFrame, name: str) -> Column:
    return _filled(name) if name in docs.columns else F.lit(False)


def _text(docs: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")


def _messages(*pairs: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*[F.when(when, F.lit(m) if isinstance(m, str) else m) for when, m in pairs]))


# The wording of issues and warnings.
def _common(docs: DataFrame, fields: list[str]) -> tuple[list, list, Column]:
    missing = [(~_has(docs, f), f"Missing or empty required field: {f}") for f in fields]
    url, title = F.coalesce(_text(docs, "url"), F.lit("")), F.length(_text(docs, "title"))
    bad_url = [((url != "") & ~T.is_url(url), F.concat(F.lit("Invalid URL format: "), url))]
    short = [(_has(docs, "title") & (title < 3), F.format_string("Title very short (%d chars)", title))]
    return missing + bad_url, short, F.coalesce(F.length(_text(docs, "clean_text")), F.lit(0))


def validate_articles(docs: DataFrame) -> DataFrame:
    """docs with issues and warnings (arrays of messages); a field that the table lacks is missing in every row.
    Where docs have valid_utf8 (see ``records.read_checked_jsonl``), a false one is an issue."""
    issues, warnings, n = _common(docs, ARTICLE_FIELDS)
    rows = docs.withColumn("__w", T.words(_text(docs, "clean_text")))  # split once for all tests
    words, distinct = F.size("__w"), F.size(F.array_distinct("__w"))
    title = F.length(_text(docs, "title"))
    issues = [*issues, (n == 0, "No text content (clean_text is empty)")]
    if "valid_utf8" in docs.columns:
        issues.append((~F.coalesce("valid_utf8", F.lit(True)), "Invalid UTF-8 encoding"))
    warnings = [
        *warnings,
        (_has(docs, "title") & (title > 200), F.format_string("Title very long (%d chars)", title)),
        ((n > 0) & (n < 50), F.format_string("Text content very short (%d chars)", n)),
        ((n >= 50) & (n < 100), F.format_string("Text content short (%d chars)", n)),
        ((n > 0) & (words < 10), F.format_string("Very few words (%d words)", words)),
        (T.too_few_distinct(words, distinct), "Possible repetitive content detected"),
    ]
    return rows.withColumns({"issues": _messages(*issues), "warnings": _messages(*warnings)}).drop("__w")


def validate_books(docs: DataFrame) -> DataFrame:
    issues, warnings, n = _common(docs, BOOK_FIELDS)
    pdf = _has(docs, "pdf_path")
    warnings = [
        ((n == 0) & ~pdf, "No text content and no PDF path"),
        ((n == 0) & pdf, "No extracted text (PDF might need manual processing)"),
        ((n > 0) & (n < 50), F.format_string("Text content very short (%d chars)", n)),
        *warnings,
    ]
    return docs.withColumns({"issues": _messages(*issues), "warnings": _messages(*warnings)})


def with_text(docs: DataFrame, text: str = "clean_text") -> DataFrame:
    """The rows that have a text."""
    return docs.where(F.coalesce(F.col(text), F.lit("")) != "")


def repeats_after_first(docs: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key occurred before, in the given order."""
    return docs.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n > 1").drop("__n")


def first_of(docs: DataFrame, key: Column, order: str | Column) -> DataFrame:
    """The first row of each key."""
    return docs.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")


def validation_summary(checked: DataFrame) -> DataFrame:
    """One row of counters over validated rows; a field that the table lacks counts as empty."""
    n, title = (F.coalesce(F.length(_text(checked, c)), F.lit(0)) for c in ("clean_text", "title"))
    url = _text(checked, "url")
    rows = checked.agg(
        F.count("*").alias("total"), F.count_if(F.size("issues") == 0).alias("valid"), F.count_if(F.size("issues") > 0).alias("with_issues"), F.count_if(F.size("warnings") > 0).alias("with_warnings"),
        (F.count(url) - F.countDistinct(url)).alias("duplicate_urls"), F.min(n).cast("long").alias("min_text"), F.max(n).cast("long").alias("max_text"), F.round(F.avg(n), 6).alias("avg_text"), F.round(F.avg(title), 6).alias("avg_title"),
    )
    return rows.withColumn("valid_percent", F.round(100.0 * F.col("valid") / F.greatest("total", F.lit(1)), 6)).withColumn("passed", F.col("with_issues") == 0)


def top_messages(checked: DataFrame, column: str = "warnings", n: int = 10) -> DataFrame:
    counts = checked.select(F.explode(column).alias("message")).groupBy("message").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "message").limit(n)


def change_report(before_after: DataFrame, before: str, after: str) -> DataFrame:
    """Characters before and after a cleaning step, and how many rows changed."""
    return before_after.agg(F.sum(F.length(before)).alias("chars_before"), F.sum(F.length(after)).alias("chars_after"), F.count_if(~F.col(before).eqNullSafe(F.col(after))).alias("changed"))


def family_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("kb_family").agg(F.count("*").alias("n"))


def index_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"), F.countDistinct("kb_family").alias("n_families"), F.countDistinct("parent_doc_id").alias("n_docs"))

"""Operator 8, line dedup (DataFrame functions only).

Lines become 128-bit line ids, and prefix doubling over the documents' id sequences gives the intervals of suffixes that
share their first lines (see ``repeats``). A run of lines of at least ``min_words`` words that stands, as a whole, at an
earlier place (by doc_id, then by line) is deleted; so every line that goes has a copy that stays, the first one, and
lines that repeat in shorter runs stay. A run that overlaps its own earlier copy, as in a line that stands three times in
a row, is deleted like any other.

Lines end at a line feed; words are what blanks separate. Lines without words don't count in the sequences: a run goes on
over them, however many they are in each copy, and those between deleted lines are deleted with them. Null texts stay
null and empty ones empty; null ids come first. Rows equal in id and text are one document: both lose the same lines.
Rows that share an id but not the text are ordered by the text's hash. Very long texts are cut into lines as wholes; an
empty table gives none. Other columns are kept by ``dedup_documents``, whatever their names (but for ``__n_lines`` and
``__n_removed``, which it adds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import key_of, stash, text_of
from .repeats import outside, repeated_runs

MIN_WORDS = 50


def _words(line: Column) -> Column:
    return F.size(F.array_remove(F.split(line, r"[ \t\r\f]+"), ""))


def line_symbols(docs: DataFrame) -> DataFrame:
    """d, h, i (number among the lines with words), l (number among all lines), a, b, n (words) of each line with words."""
    lines = F.transform(F.split(text_of(), "\n"), lambda x, l: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.reverse(x), F.crc32(x.cast("binary"))).alias("b"), _words(x).alias("n"), l.alias("l")))
    rows = docs.select(key_of("doc_id").alias("d"), F.xxhash64(text_of()).alias("h"), F.posexplode(F.filter(lines, lambda x: x["n"] > 0)).alias("i", "x"))
    return rows.select("d", "h", "i", "x.l", "x.a", "x.b", "x.n")


def repeated_line_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, h, start, end (exclusive line numbers) of what is to go."""
    return repeated_runs(stash(line_symbols(docs), "lines"), min_words)


def dedup_documents(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the deleted lines gone from ``text``, and __n_lines, __n_removed."""
    runs = repeated_line_runs(docs, min_words)
    per_doc = runs.groupBy(F.col("d").alias("__d"), F.col("h").alias("__h")).agg(F.collect_list(F.struct("start", "end")).alias("__runs"))
    # texts are dealt out at every size: a broadcast would hold only for small corpora
    joined = docs.join(stash(per_doc, "line-runs").hint("shuffle_hash"), (key_of("doc_id") == F.col("__d")) & (F.xxhash64(text_of()) == F.col("__h")), "left")
    lines = F.split(docs["text"], "\n")
    text = F.when(F.col("__runs").isNull(), docs["text"]).otherwise(F.array_join(outside(lines, F.col("__runs")), "\n"))
    removed = F.aggregate(F.coalesce("__runs", F.array()), F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    n_lines = F.when(docs["text"].isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    return joined.withColumns({"__n_lines": n_lines, "__n_removed": removed}).withColumn("text", text).drop("__d", "__h", "__runs")


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    narrow = docs.select("doc_id", "text")
    return dedup_documents(narrow, min_words).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text")

"""Search inside documents, and look-ups."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find(docs: DataFrame, term: str, key: str = "doc_id", text: str = "text", case_sensitive: bool = False, around: int = 100) -> DataFrame:
    """key, start, end, context of all occurrences, overlapping ones included. Only texts that hold the term leave the
    JVM; there a text is looked through once, from hit to hit."""
    if not term:
        raise ValueError("an empty term occurs everywhere")
    own, n = F.col(text), len(term)
    low, want = (own, F.lit(term)) if case_sensitive else (F.lower(own), F.lower(F.lit(term)))
    hits = docs.where(F.contains(low, want)).select(F.col(key), own.alias("t"), low.alias("l"), want.alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, whole, lowered, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = lowered.find(wanted)
                while at >= 0:
                    rows.append((k, at, at + n, whole[max(0, at - around) : at + n + around]))
                    at = lowered.find(wanted, at + 1)
            kinds = (b.column(0).type, pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [key, "start", "end", "context"])

    return hits.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, start long, end long, context string")


def by_id(docs: DataFrame, value, key: str = "doc_id") -> DataFrame:
    return docs.where(F.col(key) == F.lit(value))


def at_place(docs: DataFrame, place: int, order: str = "doc_id") -> DataFrame:
    """The row at a place (from 0) of an order: a top-k and its last row."""
    if place < 0:
        raise ValueError("places count from 0")
    return docs.orderBy(order).offset(place).limit(1)

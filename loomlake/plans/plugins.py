"""What a model can be plugged in as. Each takes and returns a DataFrame; the defaults need no model."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame


class Embedder(Protocol):
    """id, v (unit length) of rows; default: operators.dense.hashed_vectors."""

    def __call__(self, rows: DataFrame, key: str, text: str) -> DataFrame: ...


class PairScorer(Protocol):
    """Adds score_rerank to query_id, id, text; default: operators.retrieval.overlap_scorer."""

    def __call__(self, candidates: DataFrame) -> DataFrame: ...


class Generator(Protocol):
    """Adds generated to query_id, prompt; default: the extractive answer of operators.rag."""

    def __call__(self, prompts: DataFrame) -> DataFrame: ...


class HtmlExtractor(Protocol):
    """key, title, clean_text of pages; default: sources.html.parse_articles."""

    def __call__(self, pages: DataFrame, key: str, html: str) -> DataFrame: ...


class Paraphraser(Protocol):
    """key, n, text variants of rows; default: none."""

    def __call__(self, rows: DataFrame, key: str, text: str) -> DataFrame: ...

"""Vector collections: chunks with their embeddings as Parquet, with what they were made by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dense import hashed_vector, hashed_vectors
from ..plans.plugins import Embedder
from .scratch import forget, small_batches, stored
from .versions import Versioned

METRIC = "cosine"
FIELDS = ["text", "parent_doc_id", "kb_family", "content_type", "title", "url", "language", "chunk_index"]


def embedded(chunks: DataFrame, embed: Embedder = hashed_vectors, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """Chunks with their unit vectors: chunk_id, embedding and those of ``FIELDS`` that the chunks have. Repeated ids count once."""
    rows = chunks.select(F.col(key).alias("chunk_id"), *[F.col(text).alias("text") if f == "text" else f for f in FIELDS if f == "text" or f in chunks.columns])
    if embed is hashed_vectors:  # made in its row, so that no text has to move for it
        small_batches(chunks.sparkSession)
        return rows.withColumn("embedding", hashed_vector(F.col("text")).cast("array<float>")).dropDuplicates(["chunk_id"])
    rows = rows.dropDuplicates(["chunk_id"])
    vectors = embed(rows, "chunk_id", "text").select(F.col("id").alias("chunk_id"), F.col("v").cast("array<float>").alias("embedding"))
    return rows.join(vectors, "chunk_id")


class VectorCollection:
    """Versions of ``vectors`` with what they were made by: metric, model, dimension."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Versioned(spark, self.path)

    def there(self) -> bool:
        return self.store.there()

    def delete(self) -> None:
        self.store.delete()

    def _publish(self, rows: DataFrame, model: str, dim: int | None, append: bool) -> None:
        rows = stored(rows, "embedded")
        sizes = rows.agg(F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).first()
        if sizes.lo != sizes.hi or (dim and sizes.hi is not None and sizes.hi != dim):
            raise ValueError(f"vectors of {sizes.lo} to {sizes.hi} components for a collection of {dim or 'one size'}")
        self.store.publish({"vectors": rows}, {"metric": METRIC, "model": model, "dim": sizes.hi or dim or 0}, append)
        forget(rows)

    def build(self, chunks: DataFrame, embed: Embedder = hashed_vectors, model: str = "hashed", force: bool = False) -> DataFrame:
        """The collection, made anew if it is not there, is empty, or ``force`` is given. Until the new version is whole, the
        old one is read."""
        if not force and self.there() and self.count():
            return self.load()
        self._publish(embedded(chunks, embed), model, None, False)
        return self.load()

    def add(self, chunks: DataFrame, embed: Embedder = hashed_vectors, model: str = "hashed") -> DataFrame:
        """Chunks whose id the collection lacks are embedded and appended as a segment. Another model, or vectors of another
        size, are an error."""
        old, about = self.load(), self.store.about()
        if model != about["model"]:
            raise ValueError(f"the collection's model is {about['model']}, and not {model}")
        fresh = embedded(chunks.join(old.select("chunk_id"), "chunk_id", "left_anti"), embed)
        if not fresh.isEmpty():
            self._publish(fresh, model, about["dim"], True)
        return self.load()

    def add_batches(self, chunks: DataFrame, embed: Embedder = hashed_vectors, model: str = "hashed", batches: int = 10) -> DataFrame:
        """``add`` in parts, each its own version: what is done when a part fails stays, and a second call goes on from there."""
        for b in range(batches):
            self.add(chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(batches)) == b), embed, model)
        return self.load()

    def load(self) -> DataFrame:
        if not self.there():
            raise FileNotFoundError(self.path)
        metric = self.store.about()["metric"]
        if metric != METRIC:
            raise ValueError(f"the collection's metric is {metric}, and not {METRIC}")
        return self.store.read("vectors")

    def count(self) -> int:
        return self.load().count()

    def stats(self) -> DataFrame:
        """n, n_docs, dim, metric, model, path: one row."""
        about = self.store.about()
        counts = self.load().agg(F.count("*").alias("n"), F.countDistinct("parent_doc_id").alias("n_docs"))
        return counts.select("*", *[F.lit(about[c]).alias(c) for c in ("dim", "metric", "model")], F.lit(self.path).alias("path"))

"""Incremental ingestion: new record files, each id once, appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versioned

BUCKETS = 256
#: Batches after which the ids of all of them are written as one segment.
COMPACT = 32


def ingest_jsonl(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "doc_id", form: str = "parquet", compact: int = COMPACT):
    """Runs until the files that are there now have been taken in; the checkpoint keeps what was done.

    Every batch has a folder of its own in the target (``form``: parquet or json), which a batch that is run again writes
    anew. Ids are kept beside the target, a segment of a versioned store for each batch, by buckets of their hash: a batch
    reads those of its own buckets only, and ``compact`` segments become one. Ids that an earlier batch has are left
    out, ids repeated in a batch are taken once, and rows without an id go.
    """
    ids = Versioned(spark, target.rstrip("/") + "_ids")

    def append(batch: DataFrame, number: int) -> None:
        fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).persist()
        buckets = [r[0] for r in fresh.select("__bucket").distinct().collect()]  # at most BUCKETS numbers
        new = fresh
        if buckets and ids.there():
            seen = ids.read("ids").where(F.col("__bucket").isin(buckets) & (F.col("batch") != number))
            new = fresh.join(seen.select(key), key, "left_anti")
        new.drop("__bucket").write.mode("overwrite").format(form).save(f"{target}/batch={number}")
        if buckets:  # one file for each bucket at most
            ids.publish({"ids": new.select(key, F.lit(number).cast("long").alias("batch"), "__bucket").repartition("__bucket")}, {"key": key}, append=True, partition_by={"ids": ["__bucket"]})
            if len(ids.manifest()["segments"]) >= compact:
                ids.compact()
                ids.clean()
        fresh.unpersist()

    stream = spark.readStream.schema(schema).json(source)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Stored steps leave no shuffle files."""

import glob
import os

from pyspark.sql import functions as F

from loomlake.llm import base
from loomlake.sources import scratch


def _files(spark) -> set[str]:
    """Of this application's block managers."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {os.path.basename(f) for d in manager.localDirs() for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}


def test_shuffle_files_go_with_the_write(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old, rows = spark.conf.get(key), spark.range(100_000).repartition(3, F.col("id"))
    for store in (base.stash, scratch.stored):
        before = _files(spark)
        kept = store(rows, "step")
        assert not _files(spark) - before
        assert kept.count() == 100_000
    assert spark.conf.get(key) == old

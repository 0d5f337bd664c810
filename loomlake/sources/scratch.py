"""Steps stored in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: set[str] = set()
#: For tables of wide rows: a scan holds a row group's columns unpacked, many times their size in the file, and a writer a whole row
#: group. So these are small, and their size is looked at after a few rows instead of the usual hundred.
WIDE = {"parquet.block.size": str(1 << 22), "parquet.page.size.row.check.min": "4", "parquet.page.size.row.check.max": "16"}


def folder(spark: SparkSession) -> str:
    """The application's own folder under spark.checkpoint.dir, which goes when the application ends. Where that is unset, a
    session whose executors are threads of the driver gets a temporary folder, and any other session an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that driver and executors share (master {spark.sparkContext.master})")
        base = "file://" + tempfile.mkdtemp(prefix="loomlake-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base.rstrip('/')}/steps/{spark.sparkContext.applicationId}"
    if own not in _OWN:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _OWN.add(own)
    return own


def small_batches(spark: SparkSession, most_bytes: int = 1 << 23) -> None:
    """Keep Arrow batches below ``most_bytes`` (or one row): wide rows have to fit in a Python worker. Plans read the setting when
    they run, so it stays; a smaller one is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > most_bytes:
        spark.conf.set(key, str(most_bytes))


@contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is run inside go when it ends, and not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def stored(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """df written and read back: the lineage ends, lost executors don't matter, and the planner knows the size, so that it
    broadcasts the table only below spark.sql.autoBroadcastJoinThreshold. options: the Parquet writer's."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    with own_shuffles(spark):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*dfs: DataFrame) -> None:
    """Delete what ``stored`` wrote."""
    for df in dfs:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)

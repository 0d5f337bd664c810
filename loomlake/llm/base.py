"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import own_shuffles

#: Stands for a null id inside an operator, so that keys can be joined by equality.
NULL_ID = -(2**63)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a session whose executors
    are threads of the driver gets a temporary folder, and any other session an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that driver and executors share (master {master})")
        base = "file://" + tempfile.mkdtemp(prefix="loomlake-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/") + "/loomlake"


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the application's own folder, which goes when the application ends."""
    own = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if own not in _MARKED:
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _MARKED.add(own)
    return f"{own}/{tag}-{uuid.uuid4().hex}"


_MARKED: set[str] = set()


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write a step to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the planner the real size in bytes, so that a join
    broadcasts the table only when it is known to be below spark.sql.autoBroadcastJoinThreshold. Its shuffle files go at once.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    with own_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def release(*stashed: DataFrame) -> None:
    """Delete what ``stash`` wrote, when everything that was made of it is stored itself."""
    for df in stashed:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_batches(spark: SparkSession, most_bytes: int = 1 << 23) -> None:
    """Keep the Arrow batches of texts below ``most_bytes`` (or one text): they have to fit in a Python worker. Plans read
    the setting when they run, so it stays; a smaller one is left alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > most_bytes:
        spark.conf.set(key, str(most_bytes))


#: Keys that hold more than a thousandth of all rows, and more than this many, are met in parts. They are fewer than a thousand.
HOT_SHARE, HOT_ROWS = 1000, 1000


def meet(rows: DataFrame, facts: DataFrame, keys: list[str], salt: list[str]) -> DataFrame:
    """rows joined with facts (keys, c: how many rows have them, more) by the keys; the rows of a hot key are dealt to parts
    by the salt columns, each with a copy of the key's one fact. facts has to be stored: it is read several times."""
    total = facts.agg(F.sum("c")).first()[0] or 0
    part = max(HOT_ROWS, total // HOT_SHARE)
    hot = F.broadcast(facts.where(F.col("c") > part).select(*keys, F.ceil(F.col("c") / part).cast("int").alias("__parts")))  # below HOT_SHARE rows
    dealt = rows.join(hot, keys, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*salt), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    spread = facts.join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts", "c")
    return dealt.join(spread, [*keys, "__part"]).drop("__part")


def key_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def id_of(key: str) -> Column:
    return F.when(F.col(key) != NULL_ID, F.col(key))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts without other characters take the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))

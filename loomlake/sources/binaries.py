"""Files of any kind in a folder: size, digest, type, and which of them are the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Leading bytes, in hex, of what is told apart.
LEADING = [("255044462D", "pdf"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("504B0304", "zip"), ("1F8B", "gzip"), ("50415231", "parquet"), ("D0CF11E0A1B11AE1", "ole"), ("49492A00", "tiff"), ("4D4D002A", "tiff")]


def kind_of(content: Column) -> Column:
    """By leading bytes; else html or text if they are UTF-8 without NUL, else binary; null for no bytes."""
    head = F.hex(F.substring(content, 1, 8))
    start = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    plain = F.is_valid_utf8(content.cast("string")) & ~F.contains(start, F.lit("\0"))
    known = F.when(F.length(content) == 0, F.lit(None).cast("string"))
    for bytes_, kind in LEADING:
        known = known.when(head.startswith(bytes_), kind)
    return known.when(plain & start.rlike(r"(?is)^\s*(?:<!doctype html|<html)"), "html").when(plain, "text").otherwise("binary")


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, name, modified, size, sha256, kind, content. Columns that aren't asked for are not made; listing and sizes need no
    content. Spark's reader passes empty files over."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), kind_of(F.col("content")).alias("kind"), "content")


def distinct_files(files: DataFrame) -> DataFrame:
    """path, name, size, sha256, kind, copies of the first file (by path) of each content. Contents are hashed where they are
    read, and don't move."""
    narrow = files.where("size > 0").groupBy("sha256").agg(F.min(F.struct("path", "name", "size", "kind")).alias("f"), F.count("*").alias("copies"))
    return narrow.select("f.path", "f.name", "f.size", "sha256", "f.kind", "copies")


def missing_files(wanted: DataFrame, files: DataFrame, url: str = "url") -> DataFrame:
    """The addresses whose last path segment is the name of no file that holds something: what is still to be fetched."""
    name = F.regexp_extract(F.regexp_replace(F.col(url), r"[?#].*$", ""), r"([^/]*)$", 1)
    return wanted.where(F.col(url).isNotNull()).withColumn("__name", name).join(files.where("size > 0").select(F.col("name").alias("__name")).distinct(), "__name", "left_anti").drop("__name")

"""Places in an order, without one task that orders a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def numbered(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with ``name``, their place (from 1) in their group: the rows are sorted in ranges, numbered in each, and the counts
    of a group's earlier ranges are added. ``order`` has to be total but for equal rows."""
    by = [*map(F.col, group), *order]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__g"))
    ranged = stored(ranged, "ranges")
    if not group:  # a row for each range and no more
        parts = ranged.groupBy("__p").agg(F.min("__g").alias("__lo"), F.count("*").alias("__c"))
        before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        bases = parts.select("__p", (F.coalesce(F.sum("__c").over(before), F.lit(0)) - F.col("__lo") + 1).alias("__base"))
        return ranged.join(F.broadcast(bases), "__p").withColumn(name, F.col("__g") + F.col("__base")).select(*rows.columns, name)
    parts = ranged.groupBy(*group, "__p").agg(F.min("__g").alias("__lo"), F.count("*").alias("__c"))
    before = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = parts.select(*group, "__p", (F.coalesce(F.sum("__c").over(before), F.lit(0)) - F.col("__lo") + 1).alias("__base"))
    return ranged.join(bases, [*group, "__p"]).withColumn(name, F.col("__g") + F.col("__base")).select(*rows.columns, name)

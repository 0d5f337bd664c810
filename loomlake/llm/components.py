"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import meet, release, stash


def connected_components(edges: DataFrame, tag: str = "star", most_rounds: int = 60) -> DataFrame:
    """edges: x, y (longs, x <> y). Returns node, root: the least node that is reachable, for every node but the roots. The
    neighbours of a node that has very many are met in parts."""
    graph = stash(edges.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), tag)
    mark = _mark(graph)
    for _ in range(most_rounds):
        both = graph.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(graph.select("lo", "hi"))
        least = stash(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c"), f"{tag}-least")
        large = meet(both.where("v > u"), least, ["u"], ["v"]).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = stash(large, tag)
        small = stash(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("c")), f"{tag}-small")
        linked = meet(large, small, ["hi"], ["lo"]).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        old, graph = graph, stash(linked.union(small.select("hi", F.col("m").alias("lo"))).distinct(), tag)
        release(old, least, large, small)
        now = _mark(graph)
        if now == mark:
            return graph.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
        mark = now
    raise RuntimeError("components did not settle")


def _mark(graph: DataFrame) -> tuple:
    """Tells edge sets apart: their number, and two sums of 64-bit hashes."""
    h = F.xxhash64("hi", "lo")
    return tuple(graph.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())

"""Distributed prefix doubling over integer sequences (DataFrame functions only), shared by operators 6 and 8.

A sequence is the symbols of one document or page. The suffix that starts at place i has, at depth k, a name for its
first 2**k symbols; equal names are equal symbol runs, so the suffixes under one name are one interval of the suffix
array whose common prefix is at least 2**k. A round joins the names at i and i + 2**k. Names are 128-bit fingerprints
instead of dense ranks, which spares a global numbering in each round. Suffixes whose name occurs once are discarded:
no longer run of theirs repeats. What remains shrinks from round to round.

A run counts from a weight on (words of lines, number of tokens). The shortest runs of that weight that start, or end,
at each place are looked up: one of L symbols is named by the two names of depth 2**k <= L < 2**(k + 1) at its first
place and at L - 2**k further on, so that the suffixes under such a name are the interval whose common prefix is at
least L. Any longer run of that weight is made of these, and each of them has one source of its whole length: runs
from different sources are never added up to reach the weight.

Names that hold many places are met in salted parts, so that no task has all places of a common symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import meet, stash

PLACE = ["d", "h", "i"]
ROUNDS = 40


def _repeated(rows: DataFrame, across: str | None, tag: str) -> DataFrame:
    """rows whose name occurs at two places, or at two values of ``across``, with later: not its first place. Counted
    before the shuffle."""
    place = F.struct(*PLACE)
    spread = F.col(across) if across else place
    names = rows.groupBy("a", "b").agg(F.min(place).alias("first"), F.min(spread).alias("lo"), F.max(spread).alias("hi"), F.count("*").alias("c"))
    names = stash(names.where("lo <> hi").select("a", "b", "first", "c"), f"{tag}-names")
    met = meet(rows, names, ["a", "b"], PLACE).withColumn("later", place > F.col("first")).drop("first")
    return stash(met, f"{tag}-places")


def _hash_of(*parts: str) -> dict[str, Column]:
    return {"a": F.xxhash64(*parts), "b": F.xxhash64(*reversed(parts), F.lit(len(parts)))}


def _shortest_runs(places: DataFrame, least: int) -> DataFrame:
    """d, h, i, len, start, end of the shortest runs of weight ``least`` that start or end at each place, inside stretches
    of neighbouring places. start and end (exclusive) count by l."""
    line = Window.partitionBy("d", "h").orderBy("i")
    stretch = Window.partitionBy("d", "h", "s")
    rows = places.withColumn("s", F.col("i") - F.row_number().over(line))
    rows = rows.withColumn("z", F.sum("n").over(stretch.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))).withColumn("y", F.col("z") - F.col("n"))
    ahead, back = stretch.orderBy("y").rangeBetween(0, least - 1), stretch.orderBy("z").rangeBetween(-(least - 1), 0)
    found = rows.select(
        *PLACE, "y", "z", "l",
        F.max("i").over(ahead).alias("ahead_i"), F.max("z").over(ahead).alias("ahead_z"), F.max("l").over(ahead).alias("ahead_l"),
        F.min("i").over(back).alias("back_i"), F.min("y").over(back).alias("back_y"), F.min("l").over(back).alias("back_l"),
    )
    # a run that ends here and would do without its last place is no shortest run that starts where it does
    run = lambda i, n, start, end: F.struct(i.cast("int").alias("i"), n.cast("int").alias("len"), start.cast("int").alias("start"), end.cast("int").alias("end"))
    both = F.array(
        F.when(F.col("ahead_z") - F.col("y") >= least, run(F.col("i"), F.col("ahead_i") - F.col("i") + 1, F.col("l"), F.col("ahead_l") + 1)),
        F.when(F.col("y") - F.col("back_y") >= least, run(F.col("back_i"), F.col("i") - F.col("back_i") + 1, F.col("back_l"), F.col("l") + 1)),
    )
    return found.select("d", "h", F.explode(F.array_compact(both)).alias("r")).select("d", "h", "r.*")


def repeated_runs(symbols: DataFrame, least: int, across: str | None = None, all_copies: bool = False) -> DataFrame:
    """Runs (d, h, start, end) of symbols that repeat, of weight ``least`` or more, laid together where they overlap or touch.

    symbols: d, h, i (place in the sequence, without gaps), l (number in the source, by which start and end count), a, b
    (128-bit name of the symbol), n (weight, 1 or more), and ``across`` if given. Without ``across`` a run repeats if it
    stands at an earlier place, too, and places are ordered by d, h, i; a run may overlap its earlier copy. With
    ``across`` it stands under two values of that column. all_copies: first copies are returned with the others.
    Rows equal in d, h, i are one place.
    """
    level = _repeated(symbols.dropDuplicates(PLACE), across, "depth-0")
    runs = stash(_shortest_runs(level, least), "shortest-runs")
    deepest = runs.agg(F.max("len")).first()[0] or 0
    wanted = F.lit(True) if all_copies else F.col("later")
    found, k = None, 0
    while k < ROUNDS and 2**k <= deepest:
        if k:
            far = Window.partitionBy("d", "h").orderBy("i").rangeBetween(2 ** (k - 1), 2 ** (k - 1))
            ahead = level.withColumns({"a2": F.first("a").over(far), "b2": F.first("b").over(far)}).where("a2 is not null")
            level = _repeated(ahead.withColumns(_hash_of("a", "b", "a2", "b2")).drop("a2", "b2", "later", "n", "l"), across, f"depth-{k}")
        names = level.select(*PLACE, "a", "b", "later", *[across] * bool(across))
        whole = runs.where(F.col("len") == 2**k).join(names, PLACE).where(wanted).select("d", "h", "i", "len", "start", "end")
        found = whole if found is None else found.unionByName(whole)
        if k and deepest > 2**k:
            inner = runs.where((F.col("len") > 2**k) & (F.col("len") < 2 ** (k + 1)))
            ends = names.select("d", "h", (F.col("i") + 2**k).alias("stop"), F.col("a").alias("a2"), F.col("b").alias("b2"))
            named = inner.withColumn("stop", F.col("i") + F.col("len")).join(names.drop("later"), PLACE).join(ends, ["d", "h", "stop"])
            part = _repeated(named.withColumns(_hash_of("len", "a", "b", "a2", "b2")).drop("stop", "a2", "b2"), across, f"between-{k}")
            found = found.unionByName(part.where(wanted).select("d", "h", "i", "len", "start", "end"))
        k += 1
    if found is None:
        return symbols.select("d", "h", F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)
    return _laid_together(found)


def _laid_together(runs: DataFrame) -> DataFrame:
    """Runs that overlap or touch as one."""
    ends = runs.withColumn("e", F.col("i") + F.col("len"))
    order = Window.partitionBy("d", "h").orderBy("i", "e")
    fresh = ends.withColumn("reach", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    marked = fresh.withColumn("run", F.sum(F.when(F.col("i") <= F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("d", "h", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def outside(items: Column, runs: Column) -> Column:
    """The items of an array that no run (structs of start and end, apart from each other) covers: slices between the
    runs, so that the work is linear in both."""
    ordered = F.sort_array(runs)
    begins = F.concat(F.array(F.lit(0)), F.transform(ordered, lambda r: r["end"]))
    stops = F.concat(F.transform(ordered, lambda r: r["start"]), F.array(F.size(items)))
    return F.flatten(F.zip_with(begins, stops, lambda a, z: F.slice(items, a + 1, F.greatest(z - a, F.lit(0)))))

"""Operator 11, MinHash near-dedup: bottom-k sketches of shingle sets, by one hash function.

A text's shingles are hashed once, to 64 bits; its sketch is the SKETCH least hashes (all of them, if it has fewer).
Texts with one shingle set form a class, and only classes are compared. A hash that is among the least of the union of
two sets and lies in both is in both sketches, so two sets of a similarity of ``percent`` share at least ``least_overlap``
retained values, but for a chance of LOSS, which the binomial tail bounds; sets within their sketches share what they
share. The inverted lists of the retained values give the overlaps. Each class posts its rarest values only (by the
length of their lists, then by hash): all but the need - MEET most frequent ones, so that two linked classes still meet in
MEET lists. A pair that met goes by the union sketch: the k least values of both sketches, of which enough have to be
common. What passes is verified once, on whole sets.

Groups of near copies are never spelled out as all pairs. Round 1 tests each posting against one class of its list; which
one, changes with the value, so that a class meets several others of its group. Round 2 looks at the lists whose classes
still lie in different components, as operator 5 does: short lists by their pairs, those longer than HOT by cells of two
blocks of classes, never between blocks of one component. So no link between components is lost.

Null or empty texts have no shingles, are linked with nothing and are their own component; rows of equal text share a
component; null ids are kept in their row but are nobody's component id (``kept`` is true for a null id if its component
has no other). Very long texts are shingled whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import NULL_ID, id_of, meet, release, stash
from .components import connected_components
from .jaccard_join import HOT, Shingler, _alike, _family_seats, _linked, _open, _pair_seats, _texts, _to_reps, names_of

SHINGLE = 4
#: Similarity as a fraction, 100 * intersection >= 80 * union.
PERCENT = 80
SKETCH = 64
#: The chance that a linked pair shares fewer retained values than it is asked for.
LOSS = 1e-12
#: Lists in which a linked pair meets, at least (or as many as it shares values).
MEET = 4
#: Orders from which a list's class of round 1 is taken.
ORDERS = 8


def least_overlap(k: int = SKETCH, percent: int = PERCENT, loss: float = LOSS) -> int:
    """The most values that sets of a similarity of ``percent`` share among the k least of their union, but for ``loss``."""
    p, tail = percent / 100, 0.0
    for m in range(k):
        tail += math.comb(k, m) * p**m * (1 - p) ** (k - m)
        if tail > loss:
            return max(1, m)
    return k


def _sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    """d, cls, alt (two names of the shingle set), n (its size), low (its k least hashes, ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for b in batches:
            sets = shingler.many(b.column(1).to_pylist())
            both = [names_of(s) if len(s) else (None, None) for s in sets]
            names = [pa.array([n[i] for n in both], pa.int64()) for i in (0, 1)]
            low = pa.array([s[:k].tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *names, pa.array([len(s) for s in sets], pa.int32()), low], ["d", "cls", "alt", "n", "low"])

    return stash(_texts(docs).mapInArrow(run, "d long, cls long, alt long, n int, low binary"), "sketches")


def _postings(classes: DataFrame) -> DataFrame:
    """(s value, cls, n) of the retained values of each class, once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            cls, n, low = (c.to_pylist() for c in b.columns)
            fresh = [i for i, c in enumerate(cls) if not (c in seen or seen.add(c))]
            if not fresh:
                continue
            values = np.frombuffer(b"".join(low[i] for i in fresh), np.int64)
            lengths = np.array([len(low[i]) // 8 for i in fresh])
            own = [np.repeat(np.array([x[i] for i in fresh], t), lengths) for x, t in ((cls, np.int64), (n, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(values), *map(pa.array, own)], ["s", "cls", "n"])

    return classes.select("cls", "n", "low").where("cls is not null").mapInArrow(run, "s long, cls long, n int")


def _need(least: int, percent: int) -> str:
    """Values that a class of n shingles shares with any linked one."""
    return f"least({least}, ({percent}L * n + 99) div 100)"


def _lists(classes: DataFrame, least: int, percent: int) -> DataFrame:
    """(s, cls, n): the inverted lists of the rarest retained values of the classes that share enough of them."""
    posts = _postings(classes)
    values = posts.groupBy("s").agg(F.count("*").alias("c"), F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi")
    values = stash(values.select("s", "c", F.col("c").alias("df")), "list-lengths")
    shared = meet(posts, values, ["s"], ["cls"])
    own = shared.groupBy("cls").agg(F.max("n").alias("n"), F.sort_array(F.collect_set(F.struct("df", "s"))).alias("own"))  # SKETCH values at most
    need = _need(least, percent)
    able = own.where(f"size(own) >= {need}").select("cls", "n", F.explode(F.expr(f"slice(own, 1, cast(size(own) - {need} + least({MEET}, {need}) as int))")).alias("x"))
    lists = stash(able.select("x.s", "cls", "n"), "lists")
    release(values)
    return lists


def _estimated(pairs: DataFrame, sketches: DataFrame, k: int, least: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose union sketch allows a link."""
    met = sketches.join(_pair_seats(pairs), "cls").repartition("a", "b").sortWithinPartitions("a", "b", F.col("y").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.empty(0, np.uint64)
        for b in batches:
            out: list[tuple[int, int]] = []
            for a, y, low in zip(*(c.to_pylist() for c in b.columns), strict=True):
                other = np.frombuffer(low, np.uint64)
                if y is None:
                    centre = other
                    continue
                union = np.sort(np.concatenate([centre, other]))
                twice = union[1:][union[1:] == union[:-1]]
                size = len(union) - len(twice)
                if size < k:  # whole sets
                    able = 100 * len(twice) >= percent * size
                else:
                    last = union[np.concatenate([[True], union[1:] != union[:-1]])][k - 1]
                    able = np.searchsorted(twice, last, "right") >= least
                if able:
                    out.append((a, y))
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], ["x", "y"])

    return met.select("a", "y", "low").mapInArrow(run, "x long, y long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, k: int = SKETCH) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id, kept for each row of docs."""
    least = least_overlap(k, percent)
    found = _sketches(docs, shingle, k)
    # two sets in 2**64 names: about one pair of names at 10**10 documents
    clashes = found.groupBy("cls").agg(F.min("alt").alias("lo"), F.max("alt").alias("hi")).where("lo <> hi").select("cls")
    clashing = frozenset(r.cls for r in clashes.collect())
    renamed = F.when(F.col("cls").isin(list(clashing)), F.col("alt")).otherwise(F.col("cls")) if clashing else F.col("cls")
    rows = found.select("d", renamed.alias("cls"), "n", "low")
    members = rows.select("d", "cls", "n")
    reps = stash(members.where("cls is not null").groupBy("cls").agg(F.min(F.when(F.col("d") != NULL_ID, F.col("d"))).alias("known"), F.min("d").alias("any")).select("cls", F.coalesce("known", "any").alias("rep")), "representatives")

    lists = _lists(rows, least, percent)
    sketches = stash(rows.select("cls", "low").where("cls is not null").dropDuplicates(["cls"]).join(lists.select("cls").distinct(), "cls", "left_semi"), "able-sketches")
    turn = F.xxhash64("cls", F.pmod("s", F.lit(ORDERS)))
    pivots = lists.groupBy("s").agg(F.min(F.struct(turn.alias("o"), "cls", "n")).alias("p"), F.count("*").alias("c")).where("c > 1")
    pivots = stash(pivots.select("s", "c", F.col("p.cls").alias("pivot"), F.col("p.n").alias("pivot_n")), "pivots")
    met = meet(lists, pivots, ["s"], ["cls"]).where("cls <> pivot").select(F.least("cls", "pivot").alias("x"), F.greatest("cls", "pivot").alias("y"), F.col("n").alias("n1"), F.col("pivot_n").alias("n2"))
    met = met.where(_alike(percent)).groupBy("x", "y").agg(F.count("*").alias("met"), F.min(F.least("n1", "n2")).alias("n")).where(f"met >= least({MEET // 2}, {_need(least, percent)})")
    links = _linked(docs, reps, _pair_seats(_estimated(met.select("x", "y"), sketches, k, least, percent)), clashing, shingle, percent, "round-1")
    edges = _to_reps(links, reps)
    roots = connected_components(edges, "round-1")

    named = reps.join(roots, reps["rep"] == roots["node"], "left").select("cls", F.coalesce("root", "rep").alias("root"))
    posts = stash(lists.join(named, "cls"), "rooted-lists")
    release(lists, pivots)
    opened = stash(_met_enough(_open(posts, "open").drop("m"), least, percent), "open-lists")
    release(posts)
    able = stash(_open(opened, "able"), "able-lists")
    release(opened)
    short, hot = able.where(f"m <= {HOT}"), able.where(f"m > {HOT}")
    a = short.select("s", F.col("cls").alias("x"), F.col("n").alias("n1"), F.col("root").alias("r1"))
    b = short.select("s", F.col("cls").alias("y"), F.col("n").alias("n2"), F.col("root").alias("r2"))
    met = a.join(b, "s").where("x < y and r1 <> r2 and " + _alike(percent)).groupBy("x", "y").agg(F.count("*").alias("met"), F.min(F.least("n1", "n2")).alias("n"))
    pairs = _pair_seats(_estimated(met.where(f"met >= least({MEET}, {_need(least, percent)})").select("x", "y"), sketches, k, least, percent))
    more = _linked(docs, reps, pairs.unionByName(_family_seats(hot)), clashing, shingle, percent, "round-2")
    release(able, sketches)
    roots = connected_components(edges.union(_to_reps(more, reps)), "round-2")

    named = stash(reps.join(roots, reps["rep"] == roots["node"], "left").select("cls", "rep", F.coalesce("root", "rep").alias("root")), "named-classes")
    full = members.where("cls is not null").join(named, "cls").select("d", "n", "rep", "root")
    empty = members.where("cls is null").select("d", "n", F.col("d").alias("rep"), F.col("d").alias("root"))
    out = full.union(empty).select(id_of("d").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), id_of("rep").alias("class_id"), id_of("root").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _met_enough(posts: DataFrame, least: int, percent: int) -> DataFrame:
    """Posts of the classes that are in as many open lists as any linked pair meets in; a class has no more than SKETCH."""
    enough = posts.groupBy("cls").agg(F.max("n").alias("n"), F.count("*").alias("had")).where(f"had >= least({MEET}, {_need(least, percent)})")
    return posts.join(enough.select("cls"), "cls", "left_semi")

"""Operator 5, n-gram Jaccard join: near-duplicate classes and their components.

Texts with one shingle set form a class, and only classes are compared. A class lists its shingles rarest first (by a
count sketch over the whole corpus, then by hash: any total order is exact, the sketch makes it short of hot shingles)
and posts its prefix of n - ceil(t * n) + l of them, l = 1 + n / 20. Two linked classes share as many prefix shingles as
the smaller of their l. Postings meet by shingle; pairs then pass the length filter, the positional filter (what can
still match after this shingle), the count of shared prefix shingles and the suffix filter (shingles counted by hash
range), and are verified once, on whole sets.

Groups of near copies are never spelled out as all pairs. Round 1 tests each posting against the first and the
previous class of its shingle (pairs met a few times over) and joins what is linked, hot pivots dealt out by salts.
Round 2 looks at shingles whose classes still lie in different components. A class with fewer of them than any linked
pair of its size shares is settled and leaves. Where a shingle's classes are few, their pairs meet by a
join. Where they are more than HOT, the classes that such shingles connect form a family. Its classes are dealt to cells
of two blocks of about WIDE * BLOCK classes, but for cells whose classes all lie in one component already. To these move only
the shingles that are still open, half of each hash: a class goes on to the smaller cells in which another one shares as many
of them as a linked pair. Whole sets move to these, cells of two blocks of about BLOCK classes; a cell counts
intersections by matrix products and gives back a spanning forest of the links it found. A link missed by round 1 has its ends in one component or is tested in round 2, so no component
is lost, and no task holds more than a cell.

Shingles are 64-bit hashes of word 5-tuples; two different shingles of one compared pair collide with a chance of
about 1e-14. Null or empty texts have no shingles, are linked with nothing and are their own component; rows of equal
text share a component; null ids are kept in their row but are nobody's component id. Very long texts are shingled
whole; an empty table gives no rows; other columns, whatever their names, are ignored (``keep_first`` hands them on).
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import NULL_ID, id_of, key_of, meet, release, stash, text_batches, text_of
from .components import connected_components

SHINGLE = 5
#: Similarity as a fraction, 100 * intersection >= 75 * union.
PERCENT = 75
SKETCH = 1 << 16
CHUNK = 1 << 14
#: Characters that are shingled at a time, and bytes of a batch of texts.
PART, BATCH = 1 << 19, 1 << 21
STAR = 256
HOT = 32
#: Bits of the filter over representatives: 2 to the power of LEAST_FILTER at least, MOST_FILTER at most.
LEAST_FILTER, MOST_FILTER = 20, 1 << 28
BLOCK = 384
#: Blocks of whole sets in a block of open shingles.
WIDE = 3
#: Ranges of hashes whose postings are moved one after the other, so that only one range's lie on disk.
RANGES = 2
#: An n-shingle set posts n / EXTRA more than it must, and its pairs have to meet as many times more.
EXTRA = 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Shingler:
    """Distinct shingle hashes of texts, ascending: word hashes times powers of an odd number, summed and mixed. Words are
    hashed anew each time, which is faster than a memo of them and holds none; a word in a list takes many times its bytes,
    so no more than ``PART`` characters (or one text) are cut into words at a time."""

    def __init__(self, size: int = SHINGLE):
        self.size = size

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        out, low, held = [], 0, 0
        for at, text in enumerate(texts):
            if held and held + len(text or "") > PART:
                out += self._part(texts[low:at])
                low, held = at, 0
            held += len(text or "")
        return out + self._part(texts[low:])

    def _part(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]  # bytes: only A-Z and ASCII blanks count
        ends = np.cumsum([0, *map(len, cut)])
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(cut)), np.uint64, int(ends[-1]))
        whole = self._summed(h, self.size) if len(h) >= self.size else h[:0]
        out = []
        for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            own = np.sort(whole[a : z - self.size + 1] if z - a >= self.size else self._summed(h[a:z], z - a) if z > a else h[:0])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own)
        return out

    @staticmethod
    def _summed(h: np.ndarray, size: int) -> np.ndarray:
        total = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            total *= _MIX[0]
            total += h[k : len(h) - size + 1 + k]
        total = (total ^ (total >> np.uint64(30))) * _MIX[1]
        total = (total ^ (total >> np.uint64(27))) * _MIX[2]
        return total ^ (total >> np.uint64(31))

    def __call__(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]


def class_of(shingles: np.ndarray, clashing: frozenset[int] = frozenset()) -> int:
    """The 64-bit name of a set; sets of which two have one name go by another."""
    name, other = names_of(shingles)
    return other if name in clashing else name


def names_of(shingles: np.ndarray) -> tuple[int, int]:
    data = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(data[:8], "little", signed=True), int.from_bytes(data[8:], "little", signed=True)


def _texts(docs: DataFrame) -> DataFrame:
    text_batches(docs.sparkSession, BATCH)
    return docs.select(key_of("doc_id").alias("d"), F.col("text").cast("string").alias("text"))


def _classes(docs: DataFrame, size: int) -> DataFrame:
    """(d, cls, alt, n) of each row; and, at each task's end, its counts (chunk, counts) of hashed shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts, names = Shingler(size), np.zeros(SKETCH, np.uint64), ["d", "cls", "alt", "n", "chunk", "counts"]
        for b in batches:
            sets = shingler.many(b.column(1).to_pylist())
            if sets:
                counts += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint64)
            both = [names_of(s) if len(s) else (None, None) for s in sets]
            rows = [b.column(0), *(pa.array([n[k] for n in both], pa.int64()) for k in (0, 1)), pa.array([len(s) for s in sets], pa.int32())]
            yield pa.RecordBatch.from_arrays([*rows, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names)
        rows = [(None, None, None, None, k, counts[k * CHUNK : (k + 1) * CHUNK].tobytes()) for k in range(SKETCH // CHUNK) if counts.any()]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return stash(_texts(docs).mapInArrow(run, "d long, cls long, alt long, n int, chunk int, counts binary"), "classes")


def _sketch(found: DataFrame) -> np.ndarray:
    """Counts over the corpus: a fixed number of cells, summed in the tasks and then by chunk."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(data, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["chunk", "counts"])

    parts = found.where("chunk is not null").select("chunk", "counts").mapInArrow(add, "chunk int, counts binary")
    rows = parts.repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect()
    out = np.zeros(SKETCH, np.uint64)
    for k, data in rows:
        out[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(data, np.uint64)
    return out


def _prefixes(docs: DataFrame, sketch: np.ndarray, clashing: frozenset[int], size: int, percent: int) -> list[DataFrame]:
    """(s shingle, cls, n, pos): the rarest shingles of each class, once in each task. A table for each of RANGES ranges of s."""
    ranges = RANGES
    places = np.empty(SKETCH, np.uint64)
    places[np.argsort(sketch, kind="stable")] = np.arange(SKETCH)  # the cells from rare to frequent
    held = docs.sparkSession.sparkContext.broadcast(places << np.uint64(64 - SKETCH.bit_length() + 1))  # SKETCH cells whatever the corpus holds

    def run(batches: Iterator[pa.RecordBatch], own_range: int) -> Iterator[pa.RecordBatch]:
        shingler, cells, seen = Shingler(size), held.value, set()
        for b in batches:
            s, cls, n, pos = [], [], [], []
            for own in shingler.many(b.column(1).to_pylist()):
                if not len(own) or (c := class_of(own, clashing)) in seen:
                    continue
                seen.add(c)
                keys = cells[(own & np.uint64(SKETCH - 1)).astype(np.int64)] | (own >> np.uint64(SKETCH.bit_length() - 1))
                order = np.argsort(keys, kind="stable")
                p = min(len(own), len(own) + (-percent * len(own)) // 100 + 1 + len(own) // EXTRA)  # n - ceil(percent * n / 100) + l
                s.append(own[order[:p]])
                cls.append(c)
                n.append(len(own))
                pos.append(p)
            if s:
                lengths = np.array(pos)
                places = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                s = np.concatenate(s)
                keep = (s >> np.uint64(32)) % np.uint64(ranges) == own_range
                rows = (s.view(np.int64), np.repeat(np.array(cls, np.int64), lengths), np.repeat(np.array(n, np.int32), lengths), places.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in rows], ["s", "cls", "n", "pos"])

    return [_texts(docs).mapInArrow(partial(run, own_range=k), "s long, cls long, n int, pos int") for k in range(ranges)]


def _shared(postings: DataFrame) -> DataFrame:
    """Postings whose shingle another class has too, each with the first and the previous class of its shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lone: tuple | None = None  # the last row, with its run's first class: all that the next batch needs
        names = ["s", "cls", "n", "pos", "first", "first_n", "first_pos", "prev", "prev_n", "prev_pos"]
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if lone is not None:
                cols = [np.concatenate([np.array([v], c.dtype), c]) for v, c in zip(lone[0], cols, strict=True)]
            s, cls = cols[0], cols[1]
            keep = np.ones(len(s), bool)
            keep[1:] = (s[1:] != s[:-1]) | (cls[1:] != cls[:-1])
            s, cls, n, pos = (c[keep] for c in cols)
            starts = np.ones(len(s), bool)
            starts[1:] = s[1:] != s[:-1]
            first = np.maximum.accumulate(np.where(starts, np.arange(len(s)), 0))
            heads = [c[first] for c in (cls, n, pos)]
            if lone is not None and lone[1] is not None:  # the carried row is not its run's first
                inside = first == 0
                for k in range(3):
                    heads[k] = np.where(inside, lone[1][k], heads[k])
            follows = ~starts
            out = [c[follows] for c in (s, cls, n, pos, *heads)] + [c[np.flatnonzero(follows) - 1] for c in (cls, n, pos)]
            run_head = tuple(int(h[-1]) for h in heads)
            lone = ((int(s[-1]), int(cls[-1]), int(n[-1]), int(pos[-1])), None if run_head[0] == int(cls[-1]) else run_head) if len(s) else lone
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names)

    schema = "s long, cls long, n int, pos int, first long, first_n int, first_pos int, prev long, prev_n int, prev_pos int"
    return stash(postings.repartition("s").sortWithinPartitions("s", "cls").mapInArrow(run, schema), "shared-shingles")


def _alike(percent: int) -> str:
    """Length filter."""
    return f"100L * least(n1, n2) >= {percent}L * greatest(n1, n2)"


def _reaches(percent: int) -> str:
    """Positional filter: this shingle and all after it would suffice. True at the first common shingle of a linked pair."""
    return f"least(n1 - p1, n2 - p2) >= ceil({percent}D * (n1 + n2) / {100 + percent} - 1e-9)"


def _least_met() -> str:
    """Prefix shingles that a linked pair shares."""
    return f"least(n1, n2) div {EXTRA} + 1"


def _filter_of(reps: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of ``bits`` bits, packed, over document keys, two bits each."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for place in _bits(b.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(flags, place >> 3, (1 << (place & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([flags.tobytes()], pa.binary())], ["flags"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for data in b.column(0).to_pylist():
                whole |= np.frombuffer(data, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([whole.tobytes()], pa.binary())], ["flags"])

    rows = reps.mapInArrow(add, "flags binary").repartition(4).mapInArrow(merge, "flags binary").collect()  # four filters
    whole = np.zeros(bits // 8, np.uint8)
    for (data,) in rows:
        whole |= np.frombuffer(data, np.uint8)
    return whole


def _bits(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    c = keys.astype(np.int64).view(np.uint64) * _MIX[0]
    c = (c ^ (c >> np.uint64(30))) * _MIX[1]
    return (c & np.uint64(bits - 1)).astype(np.int64), ((c >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _sets(docs: DataFrame, wanted: DataFrame, clashing: frozenset[int], size: int) -> DataFrame:
    """(cls, own): whole sets of the classes whose representatives stand in wanted.rep, and of some others. Up to
    MOST_FILTER bits a filter with 16 bits for each representative goes to the texts, which stay where they are, and only
    what it lets through is shingled; beyond that, texts and representatives meet by a join."""
    bits = 1 << max(LEAST_FILTER, (16 * wanted.count() - 1).bit_length())
    texts, held = _texts(docs), None
    if bits <= MOST_FILTER:
        held = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted.select("rep"), bits))
    else:
        texts = texts.join(wanted.select(F.col("rep").alias("d")).distinct().hint("shuffle_hash"), "d", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for b in batches:
            able = b.column(1)
            if held is not None:
                one, two = _bits(b.column(0).to_numpy(zero_copy_only=False), bits)
                flags = held.value
                able = able.filter(pa.array(((flags[one >> 3] >> (one & 7)) & (flags[two >> 3] >> (two & 7)) & 1).astype(bool)))
            own = [s for s in shingler.many(able.to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(s, clashing) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], ["cls", "own"])

    return texts.mapInArrow(sets, "cls long, own binary").dropDuplicates(["cls"])


def _pair_seats(pairs: DataFrame) -> DataFrame:
    """Where the set of cls has to be for the distinct pairs (x, y): at (x, salt), the centre with a null y. A class with
    many partners is dealt out with salts, each with one copy of its set."""
    pairs = stash(pairs, "pairs")
    deals = pairs.groupBy("x").agg(F.ceil(F.count("*") / STAR).cast("int").alias("deals"))
    salted = pairs.join(deals, "x").select(F.col("y").alias("cls"), F.col("x").alias("a"), F.pmod(F.xxhash64("y"), F.col("deals")).cast("int").alias("b"), "y")
    centres = deals.select(F.col("x").alias("cls"), F.col("x").alias("a"), F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("b"), F.lit(None).cast("long").alias("y"))
    return salted.unionByName(centres).select("*", F.lit(-1).alias("c"), F.lit(None).cast("long").alias("root"), F.lit(None).cast("int").alias("block"))


def _family_seats(hot: DataFrame, wide: int = 1) -> DataFrame:
    """Where the sets of the classes of hot shingles (s, cls, root) have to be: at (family, block, other block). A root with as
    many classes as a block, ``wide`` times BLOCK, has blocks of its own, and these never meet each other: only what may join two
    roots is moved."""
    size = wide * BLOCK
    firsts = stash(hot.groupBy("s").agg(F.min("cls").alias("y"), F.count("*").alias("c")), "family-firsts")
    bonds = meet(hot, firsts, ["s"], ["cls"]).where("cls <> y").select(F.col("cls").alias("x"), "y").distinct()
    family = connected_components(bonds, "families")
    members = hot.select("cls", "root").distinct().join(family.select(F.col("node").alias("cls"), F.col("root").alias("family")), "cls", "left")
    members = stash(members.withColumn("family", F.coalesce("family", "cls")), "family-members")
    roots = members.groupBy("family", "root").agg(F.count("*").alias("c"))
    roots = stash(roots.withColumn("own", F.when(F.col("c") >= size, F.col("root"))), "family-roots")
    groups = roots.groupBy("family", "own").agg(F.ceil(F.sum("c") / size).cast("int").alias("blocks"))
    before = Window.partitionBy("family").orderBy("own").rowsBetween(Window.unboundedPreceding, -1)  # a row for each large root of a family
    groups = stash(groups.withColumn("base", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int")), "family-groups")
    dealt = meet(members, roots, ["family", "root"], ["cls"])
    own = groups.select("family", F.col("own").alias("own_"), "blocks", "base")
    placed = dealt.join(own, (dealt["family"] == own["family"]) & dealt["own"].eqNullSafe(own["own_"])).select("cls", "root", dealt["family"], "own", (F.col("base") + F.pmod(F.xxhash64("cls"), F.col("blocks"))).cast("int").alias("block"))
    others = groups.select(F.col("family").alias("f"), F.col("own").alias("o"), F.col("blocks").alias("n"), F.col("base").alias("from"))
    met = placed.join(others, (F.col("family") == F.col("f")) & ~F.coalesce(F.col("own") == F.col("o"), F.lit(False)))
    cells = met.select("cls", "root", "family", "block", F.explode(F.expr("sequence(`from`, `from` + n - 1)")).alias("j"))
    return cells.select("cls", F.col("family").alias("a"), F.least("block", "j").alias("b"), F.col("cls").alias("y"), F.greatest("block", "j").alias("c"), "root", "block")


def _near_seats(seats: DataFrame, posts: DataFrame, percent: int) -> DataFrame:
    """Of wide cells (seats of _family_seats) the smaller ones in which a class may be linked with another: it shares as many open
    shingles with it as their lengths ask. posts: s, cls, n of these. Shingles are told apart by half of their hash; where two
    are taken for one, more is counted, and not less."""
    parts, seats = WIDE, stash(seats, "wide-seats")
    wanted = posts.join(seats.select("cls").distinct(), "cls", "left_semi")
    lists = wanted.groupBy("cls").agg(F.first("n").alias("n"), F.collect_list(F.shiftright("s", 32).cast("int")).alias("own"))
    met = lists.join(seats, "cls").repartition("a", "b", "c").sortWithinPartitions("a", "b", "c").select("cls", "a", "b", "c", "root", "block", "n", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cell(at: tuple[int, int, int], held: list[tuple]) -> pa.RecordBatch:
            cls, root, block, n = (np.array([h[k] for h in held], np.int64) for k in range(4))
            mixed = (cls.view(np.uint64) * _MIX[0]) >> np.uint64(40)
            block = block * parts + (mixed % np.uint64(parts)).astype(np.int64)
            found = []
            shared = _common([h[4] for h in held])
            for i in range(len(held)):
                least, most = np.minimum(n, n[i]), np.maximum(n, n[i])
                near = (shared[i] > least // EXTRA) & (100 * least >= percent * most) & (root != root[i])
                if at[1] != at[2]:
                    near &= block // parts != block[i] // parts
                found += [(i, int(j)) for j in np.unique(block[near])]
            own, other = np.array(found, np.int64).reshape(-1, 2).T
            columns = (cls[own], np.full(len(own), at[0]), np.minimum(block[own], other).astype(np.int32), cls[own], np.maximum(block[own], other).astype(np.int32), root[own], block[own].astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cls", "a", "b", "y", "c", "root", "block"])

        at, held = None, []
        for batch in batches:
            lists = batch.column(7)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for k, (cls, a, b, c, root, block, n) in enumerate(zip(*(column.to_pylist() for column in batch.columns[:7]), strict=True)):
                if held and at != (a, b, c):
                    yield cell(at, held)
                    held = []
                at = (a, b, c)
                held.append((cls, root, block, n, values[ends[k] : ends[k + 1]].copy()))
        if held:
            yield cell(at, held)

    found = stash(met.mapInArrow(run, "cls long, a long, b int, y long, c int, root long, block int"), "near-seats")
    release(seats)
    return found


def _linked(docs: DataFrame, reps: DataFrame, seats: DataFrame, clashing: frozenset[int], size: int, percent: int, tag: str) -> DataFrame:
    """Links (x, y) among the sets that meet at a seat (a, b, c): each set is made once and moved to its seats."""
    seats = stash(seats, f"{tag}-seats")
    wanted = stash(reps.join(seats.select("cls").distinct(), "cls").select("rep"), f"{tag}-wanted")
    met = _sets(docs, wanted, clashing, size).join(seats, "cls").repartition("a", "b", "c").sortWithinPartitions("a", "b", "c", F.col("y").asc_nulls_first())
    fields = ["a", "b", "c", "y", "root", "block", "own"]

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cell() -> list[tuple[int, int]]:
            found = _cell_links([h[1] for h in held], [h[3] for h in held], [h[2] for h in held], percent)
            return [tuple(sorted((held[i][0], held[j][0]))) for i, j in found]

        def packed(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in links], pa.int64()) for k in (0, 1)], ["x", "y"])

        centre, bins, at, held = np.empty(0, np.uint64), None, None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for a, b, c, y, root, block, data in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                other = np.frombuffer(data, np.uint64)
                if c >= 0:  # a cell of a family
                    if held and at != (a, b, c):
                        out += cell()
                        held = []
                    at = (a, b, c)
                    held.append((y, other, root, block))
                    continue
                counts = np.bincount((other >> np.uint64(58)).astype(np.int64), minlength=64)
                if y is None:
                    centre, bins = other, counts
                    continue
                need = math.ceil(percent * (len(centre) + len(other)) / (100 + percent) - 1e-9)
                if np.minimum(bins, counts).sum() < need:  # suffix filter: no more can match, range by range
                    continue
                both = len(np.intersect1d(centre, other, assume_unique=True))
                if 100 * both >= percent * (len(centre) + len(other) - both):
                    out.append((a, y))
            yield packed(out)
        if held:
            yield packed(cell())

    links = stash(met.select(*fields).mapInArrow(test, "x long, y long"), f"{tag}-links")
    release(seats, wanted)
    return links


def _open(posts: DataFrame, tag: str) -> DataFrame:
    """Posts (s, cls, n, pos, root) of the shingles that still lie in different components, with m, the classes of s."""
    split = posts.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo <> hi")
    return meet(posts, stash(split.select("s", F.col("c").alias("m"), "c"), tag), ["s"], ["cls"])


def _able(posts: DataFrame, percent: int) -> DataFrame:
    """Posts of the classes that have as many as any linked pair of theirs must share; a class has no more than its text."""
    whole = Window.partitionBy("cls")
    return posts.withColumn("had", F.count("*").over(whole)).where(f"had > ({percent}L * n + 99) div 100 div {EXTRA}").drop("had")


def _common(own: list[np.ndarray], slab: int = 2048) -> np.ndarray:
    """How many values each two lists share; one that stands in a list repeatedly counts as many times."""
    where = np.unique(np.concatenate(own), return_inverse=True)[1]
    rows = np.repeat(np.arange(len(own)), [len(s) for s in own])
    counts = np.bincount(where)
    place = np.cumsum(counts > 1) - 1  # shingles of one row can't be shared
    keep = counts[where] > 1
    rows, where = rows[keep], place[where[keep]]
    order = np.argsort(where, kind="stable")
    rows, where = rows[order], where[order]
    shared = np.zeros((len(own), len(own)), np.float32)
    for low in range(0, int(where[-1]) + 1 if len(where) else 0, slab):
        a, z = np.searchsorted(where, [low, low + slab])
        flags = np.zeros((len(own), slab), np.float32)
        np.add.at(flags, (rows[a:z], where[a:z] - low), 1)
        shared += flags @ flags.T
    return shared


def _cell_links(own: list[np.ndarray], blocks: list[int], roots: list[int], percent: int, slab: int = 8192) -> list[tuple[int, int]]:
    """A spanning forest (positions) of the links between rows of different roots; of different blocks, if there are two."""
    n, shared = np.array([len(s) for s in own]), _common(own, slab)
    total, root, block = n[:, None] + n[None, :] - shared, np.array(roots), np.array(blocks)
    linked = (100 * shared.astype(np.float64) >= percent * total.astype(np.float64)) & (root[:, None] != root[None, :])
    if len(set(blocks)) > 1:
        linked &= block[:, None] != block[None, :]
    tree = list(range(len(own)))
    out = []
    for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
        i, j = int(i), int(j)
        ends = []
        for k in (i, j):
            while tree[k] != k:
                tree[k] = tree[tree[k]]
                k = tree[k]
            ends.append(k)
        if ends[0] != ends[1]:
            tree[ends[0]] = ends[1]
            out.append((i, j))
    return out


def _to_reps(links: DataFrame, reps: DataFrame) -> DataFrame:
    a, b = reps.select(F.col("cls").alias("x"), F.col("rep").alias("rx")), reps.select(F.col("cls").alias("y"), F.col("rep").alias("ry"))
    return links.join(a, "x").join(b, "y").where("rx <> ry").select(F.col("rx").alias("x"), F.col("ry").alias("y"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id for each row of docs."""
    found = _classes(docs, shingle)
    rows = found.where("chunk is null")
    # two sets in 2**64 names: about one pair of names at 10**10 documents
    clashes = rows.groupBy("cls").agg(F.min("alt").alias("lo"), F.max("alt").alias("hi")).where("lo <> hi").select("cls")
    clashing = frozenset(r.cls for r in clashes.collect())
    renamed = F.when(F.col("cls").isin(list(clashing)), F.col("alt")).otherwise(F.col("cls")) if clashing else F.col("cls")
    members = rows.select("d", renamed.alias("cls"), "n")
    reps = stash(members.where("cls is not null").groupBy("cls").agg(F.min(F.when(F.col("d") != NULL_ID, F.col("d"))).alias("known"), F.min("d").alias("any")).select("cls", F.coalesce("known", "any").alias("rep")), "representatives")
    ranges = [_shared(posts) for posts in _prefixes(docs, _sketch(found), clashing, shingle, percent)]
    shared = reduce(DataFrame.union, ranges)
    one = shared.select(F.col("first").alias("x"), F.col("cls").alias("y"), F.col("first_n").alias("n1"), F.col("first_pos").alias("p1"), F.col("n").alias("n2"), F.col("pos").alias("p2"))
    two = shared.where("prev <> first").select("prev", "cls", "prev_n", "prev_pos", "n", "pos")
    met = one.union(two).where(_alike(percent)).groupBy("x", "y").agg(F.count("*").alias("met"), F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.max(F.expr(_reaches(percent))).alias("ok"))
    links = _linked(docs, reps, _pair_seats(met.where(f"ok and 4 * met >= {_least_met()}").select("x", "y")), clashing, shingle, percent, "round-1")
    edges = _to_reps(links, reps)
    roots = connected_components(edges, "round-1")

    all_posts = shared.select("s", "cls", "n", "pos").union(shared.where("prev = first").select("s", "first", "first_n", "first_pos"))
    named = reps.join(roots, reps["rep"] == roots["node"], "left").select("cls", F.coalesce("root", "rep").alias("root"))
    posts = stash(_able(all_posts.join(named, "cls"), percent), "rooted-shingles")
    release(*ranges)
    opened = stash(_able(_open(posts, "open").drop("m"), percent), "open-shingles")
    release(posts)
    able = stash(_open(opened, "able"), "able-shingles")
    release(opened)
    left, hot = able.where(f"m <= {HOT}"), able.where(f"m > {HOT}")
    a = left.select("s", F.col("cls").alias("x"), F.col("n").alias("n1"), F.col("pos").alias("p1"), F.col("root").alias("r1"))
    b = left.select("s", F.col("cls").alias("y"), F.col("n").alias("n2"), F.col("pos").alias("p2"), F.col("root").alias("r2"))
    met = a.join(b, "s").where("x < y and r1 <> r2 and " + _alike(percent))
    met = met.groupBy("x", "y").agg(F.count("*").alias("met"), F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.max(F.expr(_reaches(percent))).alias("ok"))
    pairs = _pair_seats(met.where(f"ok and met >= {_least_met()}").select("x", "y"))
    near = _near_seats(_family_seats(hot, WIDE), able, percent)
    more = _linked(docs, reps, pairs.unionByName(near), clashing, shingle, percent, "round-2")
    release(able)
    roots = connected_components(edges.union(_to_reps(more, reps)), "round-2")

    named = stash(reps.join(roots, reps["rep"] == roots["node"], "left").select("cls", "rep", F.coalesce("root", "rep").alias("root")), "named-classes")
    full = members.where("cls is not null").join(named, "cls").select("d", "n", "rep", "root")
    empty = members.where("cls is null").select("d", "n", F.col("d").alias("rep"), F.col("d").alias("root"))
    return full.union(empty).select(id_of("d").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), id_of("rep").alias("class_id"), id_of("root").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component: the first by id and then by the text's hash, null ids last. Rows equal in id and
    text are one document and are kept together; without an id, one of the rows of a text with words is kept."""
    first, other = F.xxhash64(key_of("doc_id"), text_of()), F.xxhash64(F.lit(1), text_of(), key_of("doc_id"))
    names = docs.select(first.alias("own"), other.alias("alt"))
    # two rows in 2**64 names: a few pairs at 10**10 documents
    clashes = names.groupBy("own").agg(F.min("alt").alias("lo"), F.max("alt").alias("hi")).where("lo <> hi").select("own")
    clashing = [r.own for r in clashes.collect()]
    own = F.when(first.isin(clashing), other).otherwise(first) if clashing else first
    rows = docs.select(own.alias("own"), key_of("doc_id").alias("d"), F.xxhash64(text_of()).alias("h"))
    found = near_duplicates(docs.select(own.alias("doc_id"), "text"))
    linked = stash(found.where("component_id <> doc_id").select(F.col("doc_id").alias("own"), F.col("component_id").alias("c")).distinct(), "linked-copies")
    members = stash(linked.union(linked.select("c", "c")).distinct().join(rows, "own").distinct(), "component-members")
    place = F.struct((F.col("d") == NULL_ID).alias("nameless"), "d", "h", "own")
    least = members.groupBy("c").agg(F.min(place).alias("x")).select("x.own")
    gone = stash(members.join(least, "own", "left_anti").select(F.col("own").alias("__gone")), "near-copies")
    nameless = F.col("doc_id").isNull() & text_of().rlike(r"[^ \t\n\x0B\f\r]")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = docs.where(nameless).groupBy(own.alias("__own")).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("__row")).select("__row.*")
    return docs.where(~nameless).unionByName(once).join(gone.hint("shuffle_hash"), own == F.col("__gone"), "left_anti")

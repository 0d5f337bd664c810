"""Operator 13, centroid clustering: Lloyd's rounds with Yinyang bounds, exact in integers.

Components become integers, floor(64 * x). The centroids start as the kept vectors whose ids hash lowest and are grouped
once, into about k / GROUP groups. Each vector keeps its centroid, an upper bound of the distance to it and one lower
bound for each group, of the distance to the group's other centroids. After a round the bounds give way by what the
centroids moved. A vector whose lower bounds all lie above its upper bound stays where it is (the global filter; the
upper bound is made exact once before it is given up); then groups above it are passed over, then centroids whose own
move leaves them above it; what survives is scanned exactly. Bounds are floats with room for rounding; they only decide
what is scanned. Ties are scanned and go to the smaller number.

A round is one pass over the stored rows, from table to table, without a shuffle of vectors. Tasks add up what vectors
bring to and take from each component of each centroid; these sums, a row for each component and task at most, meet by
key and give the new centroids as exact integers: nothing but k centroids is on the driver or sent to the tasks.

Vectors take part if they have ``dim`` components, none null or not finite. Rows of one id are vectors each; a null id is
kept in its row, but such a row is no first centroid unless there are too few others. Vectors of one id start in the
order of their components. With fewer vectors than centroids there are as many centroids as vectors; an empty table gives
no rows. Components of any size are exact: rows or centroids with components of HUGE and more go through Python's
integers; distances and inertia that a long can't hold are returned as the greatest long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import release, stash, text_batches

SCALE = 64
DIM = 64
CLUSTERS = 16
ROUNDS = 3
SEED = 1
#: Centroids in a group, about.
GROUP = 4
#: Scaled components from here on leave the floats: below, squared distances of 64 components are exact in them.
HUGE = 2**22
LIMB = 40
LONG = 2**63 - 1
SLACK = 1e-12


def limbs(x: int) -> list[tuple[int, int]]:
    """x as (i, part), x = the sum of part * 2**(LIMB * i); parts can be added up apart."""
    out, half = [], 1 << (LIMB - 1)
    while not -half <= x < half:
        out.append((len(out), x & ((1 << LIMB) - 1)))
        x >>= LIMB
    return [*out, (len(out), x)]


def _root(square: int) -> float:
    """A square root that isn't too small."""
    try:
        return math.sqrt(square) * (1 + SLACK)
    except OverflowError:
        return math.inf


def whole(x: float) -> int:
    return int(x) * SCALE if abs(x) >= 2**53 else math.floor(x * SCALE)


def squared(a: list[int], b: list[int]) -> int:
    return sum((p - q) ** 2 for p, q in zip(a, b, strict=True))


def grouped(centroids: list[list[int]], group: int = GROUP) -> list[int]:
    """The group of each centroid: a few plain rounds over the centroids themselves."""
    seeds = centroids[: max(1, -(-len(centroids) // group))]
    for _ in range(5):
        near = [min(range(len(seeds)), key=lambda g: (squared(c, seeds[g]), g)) for c in centroids]
        own = [[c for c, n in zip(centroids, near, strict=True) if n == g] for g in range(len(seeds))]
        seeds = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else s for o, s in zip(own, seeds, strict=True)]
    return near


class Assigner:
    """One assignment of all vectors: ``moved`` is what each centroid moved since the last, None if there was none."""

    def __init__(self, centroids: list[list[int]], groups: list[int], moved: list[int] | None):
        self.centroids, self.groups = centroids, np.array(groups, np.int64)
        self.count = int(self.groups.max()) + 1 if len(groups) else 0
        self.small = all(abs(x) < HUGE for c in centroids for x in c)
        self.points = np.array(centroids, np.float64) if self.small else None
        self.drift = None if moved is None else np.array([_root(m) for m in moved])
        if moved is not None:
            self.far = np.array([self.drift[self.groups == g].max(initial=0) for g in range(self.count)])

    def _distances(self, v: np.ndarray, c: int) -> np.ndarray:
        return ((v - self.points[c]) ** 2).sum(1)

    def __call__(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int], int]:
        """(centroid, upper, lower, squared distances if ``exact``, distances computed) of rows x."""
        with np.errstate(over="ignore"):
            v = np.floor(x * SCALE)
        hard = (np.abs(v) >= HUGE).any(1) if self.small else np.ones(len(x), bool)
        now, up, low = own.copy(), np.full(len(x), np.inf), np.zeros((len(x), self.count))
        squares: list[int] = [0] * len(x)
        scanned = 0
        easy = np.flatnonzero(~hard)
        if len(easy):
            now[easy], up[easy], low[easy], found, scanned = self._bounded(v[easy], own[easy], upper[easy], lower[easy], exact)
            if exact:
                for i, d in zip(easy.tolist(), found.tolist(), strict=True):
                    squares[i] = int(d)
        for i in np.flatnonzero(hard).tolist():
            row = list(map(whole, x[i].tolist()))
            far = [squared(row, c) for c in self.centroids]
            now[i] = far.index(min(far))
            squares[i] = min(far)
            scanned += len(far)
        return now, up, low, squares, scanned

    def _bounded(self, v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, exact: bool) -> tuple:
        k, scanned = len(self.centroids), 0
        if self.drift is None:
            far = np.stack([self._distances(v, c) for c in range(k)], 1)
            now = far.argmin(1)
            return now, *self._bounds(far, now, None), far[np.arange(len(v)), now], far.size
        with np.errstate(invalid="ignore"):
            up = (upper + self.drift[own]) * (1 + SLACK)
            low = (lower - self.far) - SLACK * (np.abs(lower) + self.far)
            each = (lower[:, self.groups] - self.drift) - SLACK * (np.abs(lower[:, self.groups]) + self.drift)
        up, low, each = (np.nan_to_num(a, nan=n, posinf=np.inf, neginf=-np.inf) for a, n in ((up, np.inf), (low, -np.inf), (each, -np.inf)))
        now, squares = own.copy(), np.zeros(len(v))
        open_ = np.flatnonzero(np.full(len(v), exact) | (up >= low.min(1)))  # the global filter
        for c in np.unique(own[open_]).tolist():
            rows = open_[own[open_] == c]
            squares[rows] = self._distances(v[rows], c)
        scanned += len(open_)
        up[open_] = np.sqrt(squares[open_]) * (1 + SLACK)
        open_ = open_[up[open_] >= low[open_].min(1)]
        if len(open_):
            reach = up[open_, None]
            wanted = (reach >= low[open_][:, self.groups]) & (reach >= each[open_])  # by group, then by centroid
            wanted[np.arange(len(open_)), own[open_]] = False
            far = np.full((len(open_), k), np.inf)
            far[np.arange(len(open_)), own[open_]] = squares[open_]
            for c in range(k):
                rows = np.flatnonzero(wanted[:, c])
                far[rows, c] = self._distances(v[open_[rows]], c)
            scanned += int(wanted.sum())
            now[open_] = far.argmin(1)
            squares[open_] = far[np.arange(len(open_)), now[open_]]
            up[open_], low[open_] = self._bounds(far, now[open_], each[open_])
        return now, up, low, squares, scanned

    def _bounds(self, far: np.ndarray, now: np.ndarray, each: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower bounds after a scan: centroids that weren't scanned (inf) keep what their own move left."""
        at = np.arange(len(far))
        bound = np.sqrt(far) * (1 - SLACK)
        if each is not None:
            bound = np.where(np.isinf(far), each, bound)
        bound[at, now] = np.inf
        low = np.stack([bound[:, self.groups == g].min(1, initial=np.inf) for g in range(self.count)], 1)
        return np.sqrt(far[at, now]) * (1 + SLACK), low


def usable(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    return rows.where(f"size(embedding) = {dim} and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def _first(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = rows.select(name.alias("name"), "embedding").orderBy(F.col("name").asc_nulls_last(), "embedding").limit(k).collect()  # k rows
    return [list(map(whole, r.embedding)) for r in found]


def _assigned(state: DataFrame, assigner: Assigner, first: bool, last: bool, tag: str) -> DataFrame:
    """The rows with their new centroids and bounds, or, at the last time, distances; and each task's sums (c, j, limb, part)
    for component j of centroid c: j = -1 counts vectors, -2 adds up squared distances, and c = j = -3 counts distances."""
    kind = "float" if dict(state.dtypes)["embedding"] == "array<float>" else "double"
    own = "distance long" if last else f"embedding array<{kind}>, upper double, lower array<double>"
    schema = f"vec_id long, cluster int, {own}, c int, j int, limb int, part long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], int] = {}

        def add(c: int, j: int, x: int) -> None:
            sums[c, j] = sums.get((c, j), 0) + x

        def packed(n: int, columns: dict, added: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            kinds = {"vec_id": pa.int64(), "cluster": pa.int32(), "distance": pa.int64(), "upper": pa.float64(), "lower": pa.list_(pa.float64()), "embedding": pa.list_(pa.float32() if kind == "float" else pa.float64()), "c": pa.int32(), "j": pa.int32(), "limb": pa.int32(), "part": pa.int64()}
            names = [x.split()[0] for x in schema.split(", ")]
            extra = {name: pa.array([a[i] for a in added], kinds[name]) for i, name in enumerate(("c", "j", "limb", "part"))} if added else {}
            return pa.RecordBatch.from_arrays([(columns | extra)[name] if name in columns or name in extra else pa.nulls(n, kinds[name]) for name in names], names)

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            column = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            x = column["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
            if first:
                before, upper, lower = np.full(n, -1), np.full(n, np.inf), np.zeros((n, assigner.count))
            else:
                before, upper = column["cluster"].to_numpy(zero_copy_only=False).astype(np.int64), column["upper"].to_numpy(zero_copy_only=False)
                lower = column["lower"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            now, upper, lower, squares, scanned = assigner(x, before, upper, lower, last)
            add(-3, -3, scanned)
            moved = np.flatnonzero(now != before) if not last else np.empty(0, np.int64)
            with np.errstate(over="ignore"):
                v = np.floor(x[moved] * SCALE)
            hard = (np.abs(v) >= HUGE).any(1)
            for sign, where in ((1, now[moved]), (-1, before[moved])):
                for c in np.unique(where[where >= 0]).tolist():
                    rows = np.flatnonzero((where == c) & ~hard)
                    total = list(map(int, v[rows].sum(0).tolist()))
                    for i in np.flatnonzero((where == c) & hard).tolist():
                        total = [t + whole(y) for t, y in zip(total, x[moved[i]].tolist(), strict=True)]
                    for j, t in enumerate(total):
                        add(c, j, sign * t)
                    add(c, -1, sign * int((where == c).sum()))
            out = {"vec_id": column["vec_id"], "cluster": pa.array(now.astype(np.int32))}
            if last:
                for c in np.unique(now).tolist():
                    add(c, -2, sum(squares[i] for i in np.flatnonzero(now == c).tolist()))
                out["distance"] = pa.array([min(s, LONG) for s in squares], pa.int64())
            else:
                ends = pa.array(np.arange(0, n * assigner.count + 1, assigner.count, dtype=np.int32))
                out |= {"embedding": column["embedding"], "upper": pa.array(upper), "lower": pa.ListArray.from_arrays(ends, pa.array(lower.ravel()))}
            yield packed(n, out, [])
        added = [(c, j, i, part) for (c, j), total in sums.items() for i, part in limbs(total)]
        yield packed(len(added), {}, added)

    text_batches(state.sparkSession)
    return stash(state.mapInArrow(run, schema), tag)


def _sums(assigned: DataFrame) -> dict[tuple[int, int], int]:
    """The tasks' sums by (c, j): a few rows for each component of each centroid."""
    parts = assigned.where("c is not null").groupBy("c", "j", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    out: dict[tuple[int, int], int] = {}
    for c, j, limb, part in parts.collect():
        out[c, j] = out.get((c, j), 0) + (int(part) << (LIMB * limb))
    return out


def clusters(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED, group: int = GROUP) -> tuple[DataFrame, dict]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector; figures): figures holds the
    centroids, and how many distances each assignment computed."""
    spark, rows = vectors.sparkSession, usable(vectors, dim)
    centroids = _first(rows, k, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"), {"centroids": [], "distances": []}
    groups, moved, state, made = grouped(centroids, group), None, rows, None
    counts, totals, distances = [0] * len(centroids), [[0] * dim for _ in centroids], []
    for r in range(rounds):
        old, made = made, _assigned(state, Assigner(centroids, groups, moved), r == 0, False, f"round-{r}")
        if old is not None:
            release(old)
        sums = _sums(made)
        distances.append(sums.get((-3, -3), 0))
        for c in range(len(centroids)):
            counts[c] += sums.get((c, -1), 0)
            totals[c] = [t + sums.get((c, j), 0) for j, t in enumerate(totals[c])]
        new = [[t // counts[c] for t in totals[c]] if counts[c] else centroids[c] for c in range(len(centroids))]
        moved, centroids = [squared(a, b) for a, b in zip(centroids, new, strict=True)], new
        state = made.where("cluster is not null").select("vec_id", "cluster", "embedding", "upper", "lower")
    final = _assigned(state, Assigner(centroids, groups, moved), rounds == 0, True, "assigned")
    if made is not None:
        release(made)
    sums = _sums(final)
    distances.append(sums.get((-3, -3), 0))
    inertia = [sums.get((c, -2), 0) for c in range(len(centroids))]
    facts = [(c, min(inertia[c], LONG), min(sum(inertia), LONG), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in range(len(centroids))]
    held = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # k rows
    found = final.where("cluster is not null").select("vec_id", "cluster", "distance").join(held, "cluster")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), {"centroids": centroids, "distances": distances}

"""Operator 13 against plain Lloyd rounds in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from loomlake.llm import yinyang

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows, k=16, rounds=3, dim=64):
    kept = [(i, [int(x) * 64 if abs(x) > 2**60 else math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((i for i in range(len(kept)) if kept[i][0] is not None), key=lambda i: (hashlib.sha256(f"1:{kept[i][0]}".encode()).hexdigest(), kept[i][1]))
    order += sorted((i for i in range(len(kept)) if kept[i][0] is None), key=lambda i: kept[i][1])
    centroids = [kept[i][1] for i in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda: [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in kept]
    for _ in range(rounds):
        near = nearest()
        for c in range(len(centroids)):
            own = [v for (_, v), n in zip(kept, near, strict=True) if n == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    near = nearest()
    found = [(i, n, far(v, centroids[n])) for (i, v), n in zip(kept, near, strict=True)]
    most = 2**63 - 1
    inertia = {c: sum(d for _, n, d in found if n == c) for c in range(len(centroids))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, n, min(d, most), min(inertia[n], most), min(sum(inertia.values()), most), names[n]) for i, n, d in found], key=repr)


def of(spark, rows, kind="double", **options):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    found, figures = yinyang.clusters(table.repartition(3), **options)
    return sorted([tuple(r[c] for c in COLUMNS) for r in found.collect()], key=repr), figures


@pytest.mark.parametrize("kind", ["float", "double"])
def test_blobs(spark, kind):
    """Separated groups: the bounds spare most distances, and the result is that of a full scan."""
    rng = np.random.default_rng(0)
    middles = rng.normal(size=(16, 64)) * 3
    rows = [(i, (middles[i % 16] + rng.normal(size=64) * 0.2).astype(np.float32).tolist()) for i in range(800)]
    got, figures = of(spark, rows, kind, rounds=5)
    assert got == plain(rows, rounds=5)
    assert figures["distances"][0] == 800 * 16 and figures["distances"][-2] < 800 * 6 and figures["distances"][-1] < 800 * 6


@pytest.mark.parametrize("seed", [1, 2])
def test_ties_and_copies(spark, seed):
    """Small integers: ties everywhere, equal rows and equal centroids."""
    rng = np.random.default_rng(seed)
    rows = [(int(i) % 150, (rng.integers(-1, 2, 64) * (rng.random(64) < 0.05) / 64).tolist()) for i in range(300)]
    assert of(spark, rows)[0] == plain(rows)


def test_bounds_of_one_batch_hold():
    """After every step the stored bounds enclose the true distances."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 64))
    points = [[int(a) for a in row] for row in rng.integers(-64, 64, (16, 64))]
    groups, moved = yinyang.grouped(points), None
    own, upper, lower = np.full(400, -1), np.full(400, np.inf), np.zeros((400, max(groups) + 1))
    for step in range(4):
        own, upper, lower, _, _ = yinyang.Assigner(points, groups, moved)(x, own, upper, lower, False)
        v = np.floor(x * 64)
        far = np.sqrt(((v[:, None] - np.array(points)[None]) ** 2).sum(2))
        assert (far.argmin(1) == own).all() and (far[np.arange(400), own] <= upper).all()
        for g in range(max(groups) + 1):
            others = np.where((np.array(groups) == g)[None] & (np.arange(16)[None] != own[:, None]), far, np.inf)
            assert (lower[:, g] <= others.min(1)).all()
        new = [[int(a + rng.integers(-9, 9)) for a in p] for p in points]
        moved, points = [yinyang.squared(a, b) for a, b in zip(points, new, strict=True)], new


def test_odd_rows(spark):
    good = lambda x: [float(x)] * 64
    rows = [(1, good(1)), (1, good(2)), (None, good(5)), (2, None), (3, [1.0] * 63), (4, [*[1.0] * 63, None]), (5, [*[1.0] * 63, math.nan]), (6, [*[1.0] * 63, math.inf]), (7, good(-0.3)), (8, [])]
    assert of(spark, rows)[0] == plain(rows)
    assert of(spark, [(2, None)])[0] == [] and of(spark, [])[0] == []
    table = spark.createDataFrame([(1, good(1), 5)], "vec_id long, embedding array<double>, cluster int")
    assert [r.cluster for r in yinyang.clusters(table)[0].collect()] == [0]


def test_huge_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=64) * 10.0 ** int(rng.integers(0, 12))).tolist()) for i in range(60)] + [(100, [1e300] * 64), (101, [-1.7e308] * 64), (102, [1e300] * 63 + [0.0])]
    assert of(spark, rows)[0] == plain(rows)
    assert yinyang.limbs(-(2**100) + 5) and all(sum(p << (40 * i) for i, p in yinyang.limbs(x)) == x for x in (0, -1, 2**39, -(2**39), 12345 * 2**77, -(2**1030) + 1))

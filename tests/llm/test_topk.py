"""Operator 9 against all pairs, in Python's integers."""

import math
from collections import defaultdict

import numpy as np

from loomlake.llm import topk


def integers(v):
    return [math.floor(1024 * x) if abs(x) < 1e290 else int(x) * 1024 for x in v]


def check(spark, rows, kind="array<float>", **settings):
    read = (lambda x: float(np.float32(x))) if kind == "array<float>" else float
    used = [(i, integers(map(read, v))) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(read(x)) for x in v)]
    docs = spark.createDataFrame([(i, v, "k", 1) for i, v in rows], f"vec_id long, embedding {kind}, tree string, dim int")
    got = defaultdict(list)
    for r in topk.top_k(docs, **settings).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    want = defaultdict(list)
    for q, v in used:
        if q % 100 == 0:
            want[q] += [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in used if i != q and len(v) == len(w)]
    assert dict(got) == {q: [(i, -s) for s, i in sorted(p)[:10]] for q, p in want.items() if p}


def test_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(700)] + [(900 + i, [0.5] * 6) for i in range(300)]
    rows += [(2000, None), (2100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2200, [float("nan")] * 6), (None, [0.1] * 6), (2300, [1.0, 2.0]), (2400, [3.0, float("inf")]), (2500, [])]
    check(spark, rows, tree_rows=256)
    check(spark, rows, tree_rows=100, query_block=4)  # many trees and blocks


def test_repeated_ids_and_few_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(100, [float(x) for x in rng.normal(size=4)]) for _ in range(40)] + [(i, [float(x) for x in rng.normal(size=4)]) for i in range(30)]
    check(spark, rows + rows[:3] + rows[-3:], tree_rows=16, query_block=8)
    check(spark, [(0, [1.0]), (100, [1.0]), (-100, [2.0])])


def test_huge_components(spark):
    rows = [(100 * i, [x, 1.5]) for i, x in enumerate((1e300, -1e300, 1e308, 3e15, 70000.0, 65535.9, 0.25, -2.0**21))] + [(i, [float(i), -0.5]) for i in range(1, 40)]
    check(spark, rows, "array<double>", tree_rows=8)


def test_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert topk.top_k(spark.createDataFrame([(7, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_bounds_spare_distances():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 8)) * 20
    vectors = topk.whole((centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 8)) * 0.05))
    tree = topk.MTree.of(np.arange(8000), vectors)
    found, seen = tree.search(vectors[17], 17, 10)
    scores = vectors @ vectors[17]
    assert found == [(int(scores[i]), i) for i in sorted(set(range(8000)) - {17}, key=lambda i: (-scores[i], i))[:10]]
    assert seen < 4000
    bounded, less = tree.search(vectors[17], 17, 10, found[-1][0])
    assert bounded == found and less <= seen

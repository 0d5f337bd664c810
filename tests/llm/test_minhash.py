"""Operator 11 against all pairs."""

import numpy as np
import pytest
from test_jaccard_join import groups

from loomlake.llm import base, jaccard_join, minhash


def plain(rows, size=4, percent=80):
    """{id: (set size, smallest id reachable)}."""
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    ids = sorted(sets)
    links = {i: {j for j in ids if j != i and sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])} for i in ids}
    out = {}
    for i in ids:  # from the smallest on
        todo = [] if i in out else [i]
        while todo:
            j = todo.pop()
            if j not in out:
                out[j] = (len(sets[j]), i)
                todo += links[j]
    return out


def of(spark, rows, **options):
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert len(found) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in found}


def test_least_overlap_is_the_binomial_tail():
    assert minhash.least_overlap(64, 80, 1e-12) == 26
    assert minhash.least_overlap(4, 80, 1e-12) == 1
    assert minhash.least_overlap(16, 100) == 16
    rng = np.random.default_rng(0)
    shares = []
    for _ in range(300):  # sets of a similarity of 0.8, hashed at random
        values = rng.permutation(1000)
        a, b = set(values[:900].tolist()), set(np.r_[values[:800], values[900:]].tolist())
        shares.append(len({*sorted(a)[:64]} & {*sorted(b)[:64]} & {*sorted(a | b)[:64]}))
    assert min(shares) >= 26 and 48 < np.mean(shares) < 55


@pytest.mark.parametrize("blocks,hot", [(384, 32), (16, 6)])
def test_near_copies(spark, monkeypatch, blocks, hot):
    monkeypatch.setattr(jaccard_join, "BLOCK", blocks)
    monkeypatch.setattr(minhash, "HOT", hot)
    monkeypatch.setattr(base, "HOT_ROWS", 20)
    monkeypatch.setattr(base, "HOT_SHARE", 50)
    rows = groups(3, [60, 20, 2, 2, 1])
    rows += [(9000 + i, t) for i, (_, t) in enumerate(groups(5, [25, 3], length=220))]  # longer than their sketches
    rows += [(9500, rows[0][1]), (9501, rows[0][1].upper()), (9502, None), (9503, "  "), (9504, "one two"), (9505, "One  two"), (9506, "one three")]
    assert of(spark, rows) == plain(rows)


def test_passages_that_many_share(spark, monkeypatch):
    """Half of each set is one passage: its lists are long, and no pair of them is a link."""
    monkeypatch.setattr(minhash, "HOT", 8)
    rng = np.random.default_rng(1)
    passage = [f"p{i}" for i in range(100)]
    rows = [(i, " ".join([*passage, *(f"u{i}_{k}" for k in range(int(rng.integers(5, 90))))])) for i in range(40)]
    rows += [(100 + i, t + " more") for i, t in rows[:10]]
    assert of(spark, rows) == plain(rows)


def test_nulls_ties_and_other_columns(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", 1), (7, "a b c d e f", 2), (7, "a b c d e f", 2), (3, None, 3), (None, "x y z q r", 4), (5, "", 5)], "doc_id long, text string, n int").withColumnRenamed("n", "cls")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(None, 3, 7, False), (7, 3, 7, True), (7, 3, 7, True), (3, 0, 3, True), (None, 2, None, True), (5, 0, 5, True)], key=repr)
    assert minhash.near_duplicates(docs.where("false")).collect() == []
    long = " ".join(f"w{i}" for i in range(60_000))
    assert of(spark, [(1, long), (2, long + " end"), (3, "short")]) == {1: (59997, 1), 2: (59998, 1), 3: (1, 3)}

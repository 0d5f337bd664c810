"""Operator 5 against all pairs: groups of near copies, hot shingles, blocks, the exact way past the filter."""

import tracemalloc

import numpy as np
import pytest

from loomlake.llm import base, jaccard_join
from loomlake.llm.components import connected_components


def all_pairs(rows):
    """{id: (set size, smallest id reachable)}."""
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def groups(seed, sizes, length=60):
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in enumerate(sizes):
        plain = [f"w{g}_{i}" for i in range(length)]
        for k in range(n):
            words = list(plain)
            for j in rng.choice(length, rng.integers(0, 4), replace=False):
                words[j] = f"e{g}_{k}_{j}"
            rows.append((1000 * g + k, " ".join(words)))
    return rows


@pytest.mark.parametrize("blocks,most_filter", [(384, 1 << 28), (16, 0)])
def test_near_copies(spark, monkeypatch, blocks, most_filter):
    monkeypatch.setattr(jaccard_join, "BLOCK", blocks)
    monkeypatch.setattr(jaccard_join, "MOST_FILTER", most_filter)
    monkeypatch.setattr(base, "HOT_ROWS", 20)
    monkeypatch.setattr(base, "HOT_SHARE", 50)
    rows = groups(blocks, (90, 60, 70)) + [(9000, "word " * 20000 + "end"), (9001, "word " * 19999 + "end"), (9002, ""), (9003, None), (9004, " \t\n"), (9005, "One Two"), (9006, "one two"), (9007, "one  two\n"), (9008, "Ärger one two three four"), (9009, "ärger one two three four")]
    docs = spark.createDataFrame([(*r, "k", 3, 4) for r in rows] + [(9005, "One Two", "k", 3, 4)], "doc_id long, text string, d string, cls int, n int")
    got = jaccard_join.near_duplicates(docs).collect()
    want = all_pairs(rows)
    assert len(got) == len(rows) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < len(rows) - 100  # there are large groups


def test_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "x"), (7, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()), key=repr)
    assert got == [(7, 2, 7), (None, 1, None), (None, 2, 7)]
    assert jaccard_join.near_duplicates(docs.limit(0)).count() == 0


def test_names():
    s = np.array([1, 2, 3], np.uint64)
    name, other = jaccard_join.names_of(s)
    assert name != other and jaccard_join.class_of(s) == name and jaccard_join.class_of(s, frozenset([name])) == other


def test_stars_and_chains(spark, monkeypatch):
    monkeypatch.setattr(base, "HOT_ROWS", 10)
    monkeypatch.setattr(base, "HOT_SHARE", 5)
    edges = [(i, i + 1) for i in range(40)] + [(500, 501 + i) for i in range(200)] + [(701 + i, 700) for i in range(150)] + [(700, 500)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 500 for i in [*range(501, 851)]}}


def test_star_around_the_greatest_node(spark, monkeypatch):
    """All edges end at one node of the greatest id, whose neighbours are met in parts."""
    monkeypatch.setattr(base, "HOT_ROWS", 10)
    monkeypatch.setattr(base, "HOT_SHARE", 5)
    edges = [(i, 900) for i in range(1, 300)] + [(i, i + 1) for i in range(400, 420)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**{i: 1 for i in [*range(2, 300), 900]}, **{i: 400 for i in range(401, 421)}}


def test_shingling_holds_no_batch_of_words():
    """Words of 4 MB of texts, as a list and in a memo, take many times that; the sets are those of the texts one by one."""
    words = np.random.default_rng(3).integers(0, 10**6, (2000, 300))
    texts = [" ".join(f"w{n}" for n in row) for row in words.tolist()] + [None, "", "one two", "x " * 300_000]
    tracemalloc.start()
    shingler = jaccard_join.Shingler()
    found = shingler.many(texts)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    own = sum(s.nbytes for s in found)
    assert held < own + (1 << 21) and peak < own + (40 << 20)
    assert all(np.array_equal(s, jaccard_join.Shingler()(t)) for s, t in zip(found[::97] + found[-4:], texts[::97] + texts[-4:], strict=True))
    assert [len(s) for s in found[-4:]] == [0, 0, 1, 1]


def test_families_move_few_sets(spark, monkeypatch):
    """One passage in the texts of many small groups makes them a family: sets move to cells with a class that they may be linked
    with, and not to those of all blocks; and postings lie in ranges of hashes."""
    moved, prefixes = {}, []
    linked, first = jaccard_join._linked, jaccard_join._shared
    monkeypatch.setattr(jaccard_join, "_linked", lambda docs, reps, seats, *rest: (moved.update({rest[-1]: seats.where("c >= 0").count()}), linked(docs, reps, seats, *rest))[1])
    monkeypatch.setattr(jaccard_join, "_shared", lambda posts: (prefixes.append(posts.count()), first(posts))[1])
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "SKETCH", 1 << 4)
    monkeypatch.setattr(jaccard_join, "CHUNK", 1 << 2)
    monkeypatch.setattr(jaccard_join, "HOT", 4)
    rng = np.random.default_rng(5)
    rows = []
    for g in range(150):
        passage = [f"p{i}" for i in range(12)]
        n = int(rng.integers(20, 200))
        plain = [f"w{g}_{i}" for i in range(n)]
        for k in range(2):
            rows.append((10 * g + k, " ".join([*plain[: n - 3 * k], *passage, *[f"z{g}{k}{i}" for i in range(k)]])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == all_pairs(rows)
    assert len(prefixes) == jaccard_join.RANGES and min(prefixes) > 0.4 * sum(prefixes)
    assert moved["round-2"] < 5 * len(rows)  # each of them meets 40 blocks and more otherwise

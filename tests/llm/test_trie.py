"""Operator 12 against a plain trie."""

import hashlib
import math
import random
import re
import zlib

import pytest

from loomlake.llm import base, trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    nodes = {}
    for c, q in rebuilt.items():
        for d in range(len(q) + 1):
            nodes.setdefault(tuple(q[:d]), []).append(c)
    out = set()
    for k, own in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        children = [x for x in below if len(x) == len(k) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        ends = ",".join(map(str, sorted(c for c in own if tuple(rebuilt[c]) == k)))
        out.add((min(own), len(k), min(nodes[k[:-1]]) if k else None, len(own), len(children), len(leaves), sum((len(nodes[x]) - 1) * words(x) for x in below), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def of(spark, rows, **options):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(table.repartition(3), **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("local,piece", [(8192, 64), (0, 64), (12, 2), (0, 3)])
def test_random_tables(spark, monkeypatch, local, piece):
    monkeypatch.setattr(trie, "PIECE", piece)
    monkeypatch.setattr(trie, "PACK", 3)
    monkeypatch.setattr(base, "HOT_ROWS", 5)
    monkeypatch.setattr(base, "HOT_SHARE", 20)
    rng = random.Random(local + piece)
    rows = []
    for c in rng.sample(range(70), 50):
        rows += [(c, None if t == 0 and c % 7 == 0 else t, rng.choice(["user", "assistant"][:1] if c % 3 else ["user", None]), rng.choice(["a b", "c", None])) for t in range(rng.choice([1, 1, 2, 3, 3, 5, 7]))]
    rows += [(200 + c, t, "user", f"same {t}") for c in range(0, 40) for t in range(4)]  # a group of copies
    rng.shuffle(rows)
    assert of(spark, rows, local=local) == plain(rows)


def test_long_common_beginning(spark):
    rows = [(c, t, "user", f"turn {t}") for c in (20, 21, 40) for t in range(150)] + [(40, 150, "user", "one more"), (21, 150, "user", "another")]
    assert of(spark, rows) == plain(rows)
    assert of(spark, rows[:330], local=100) == plain(rows[:330])


def test_odd_tables(spark):
    assert of(spark, []) == set()
    assert of(spark, [(None, 1, "user", "text")]) == set()
    # 21 takes all its turns from conversation 20, of which there is none: it has no turn left
    short = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    assert of(spark, [(short, 0, "user", "hello")]) == {(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())}
    rows = [(0, 1, "user", "x " * 50_000), (0, 1, "user", "x " * 50_000), (1, None, None, None), (-5, 2, "", "")]
    assert of(spark, rows) == plain(rows)
    table = spark.createDataFrame([(0, 1, "user", "a", 1), (0, 1, "user", "a", 2)], "conv_id long, turn int, role string, text string, len int")
    assert {tuple(r[c] for c in COLUMNS[:4]) for r in trie.prefix_trie(table).collect()} == {(0, 0, None, 1), (0, 1, 0, 1), (0, 2, 0, 1)}

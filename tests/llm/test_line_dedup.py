"""Operator 8 against brute force: every run of lines against every earlier place."""

import random

import pytest
from pyspark.sql import functions as F

from loomlake.llm import base, line_dedup


def brute(rows, least):
    """{(id, hash, text): (text without the lines, lines removed)}; rows: (id, hash, text)."""
    docs = []
    for d, h, t in sorted({(-(2**63) if d is None else d, h, t) for d, h, t in rows}, key=lambda r: r[:2]):
        lines = (t or "").split("\n")
        docs.append((d, h, t, lines, [k for k, x in enumerate(lines) if x.split()]))
    seen, gone = set(), [set() for _ in docs]
    places = [(n, i) for n, doc in enumerate(docs) for i in range(len(doc[4]))]
    for n, i in places:
        _, _, _, lines, own = docs[n]
        runs = [tuple(lines[k] for k in own[i:z]) for z in range(i + 1, len(own) + 1)]
        for run in runs:
            if run in seen and sum(len(x.split()) for x in run) >= least:
                gone[n].update(range(i, i + len(run)))
        seen.update(runs)
    out = {}
    for (d, h, t, lines, own), dead in zip(docs, gone, strict=True):
        place = {k: i for i, k in enumerate(own)}
        kept = []
        for k, x in enumerate(lines):
            before, after = max((i for q, i in place.items() if q < k), default=None), min((i for q, i in place.items() if q > k), default=None)
            cut = place[k] in dead if k in place else before in dead and after in dead
            if not cut:
                kept.append(x)
        out[d, h, t] = ("\n".join(kept) if t is not None else None, len(lines) - len(kept))
    return out


def check(spark, rows, least):
    docs = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "doc_id long, text string, d string, i int, `start` int")
    hashed = [(r.doc_id, r.h, r.text) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]
    want = brute(hashed, least)
    expected = sorted((want[-(2**63) if d is None else d, h, t] + (d,) for d, h, t in hashed), key=repr)
    cleaned = line_dedup.dedup_documents(docs, least)
    assert cleaned.columns == [*docs.columns, "__n_lines", "__n_removed"]
    got = cleaned.collect()
    assert sorted(((r.text, r["__n_removed"], r.doc_id) for r in got), key=repr) == expected
    assert all((r.d, r.i, r.start) == ("k", 1, 2) for r in got)


@pytest.mark.parametrize("seed,least", [(1, 6), (3, 1)])
def test_random_documents(spark, seed, least):
    rng = random.Random(seed)
    lines = [" ".join(f"{c}{k}" for k in range(n)) for c, n in zip("abcdefgh", (1, 2, 3, 3, 5, 6, 2, 12))] + ["", " \t"]
    rows = [(rng.choice([*range(30), None]), "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 14)))) for _ in range(40)]
    part = "\n".join(rng.choice(lines) for _ in range(40))
    rows += [(100, part), (101, "x\n" + part), (101, "x\n" + part), (102, part.replace("\n", "\n\n")), (50, None), (51, ""), (52, lines[0] + "\n" + "\n".join([lines[7]] * 5))]
    check(spark, rows, least)


def test_one_source_has_to_hold_the_whole_run(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(1, f"{a}\n{b}"), (2, f"{b}\n{c}"), (3, f"{a}\n{b}\n{c}"), (4, f"{a}\n{b}\n{c}\nend")]
    got = {r.doc_id: r.text for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: "end"}


def test_hot_lines_are_parted(spark, monkeypatch):
    monkeypatch.setattr(base, "HOT_ROWS", 3)
    monkeypatch.setattr(base, "HOT_SHARE", 20)
    hot = "the very common line of this table"
    check(spark, [(i, f"{hot}\nown {i}\n{hot}\n{hot}") for i in range(60)] + [(200 + i, f"new {i % 5}\n{hot}") for i in range(20)], 7)


def test_a_long_text_and_an_empty_table(spark):
    text = "\n".join(f"line {i % 900} has a few words" for i in range(6000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert line_dedup.report(docs).first().text == "\n".join(text.split("\n")[:900])
    assert line_dedup.report(docs.limit(0)).count() == 0

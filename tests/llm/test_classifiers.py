"""Operators 4 and 10: the model against naive sums, the automaton against edit distances, and odd tables."""

import random
import zlib

import numpy as np
import pytest
from plain import edit_distance
from pyspark.sql import functions as F

from loomlake.llm import quality, toxicity


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        bad, toxic = i % 4 == 0, i % 5 == 1
        text = list(rng.choice(words, 40))
        if toxic:
            text[3:3] = ["idiot", "moron"] if i % 2 else ["idiott", "idiot"]
        rows.append((i, " ".join(w + "$$$" if bad else w for w in text) if not toxic else " ".join(text), len(text)))
        labels.append((i, int(not bad or toxic), int(toxic)))
    rows += [(900, None, None), (901, "", 0), (None, "idiot moron", 3), (7, rows[7][1], rows[7][2]), (902, "word1 " * 30000, 5)]
    docs = spark.createDataFrame([(*r, "k", 1, 2.0) for r in rows], "doc_id long, text string, n_chars long, label string, __label int, score double")
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (11, 0, 0), (11, 1, 1)], "doc_id long, quality int, toxic int"), dict((i, (q, t)) for i, q, t in labels)


def test_pairwise_sum():
    rng = np.random.default_rng(2)
    width = len(quality.statistics("", 0))
    model = quality.FactorisationMachine(np.zeros(width), np.ones(width), 0.3, rng.normal(size=64 + width), rng.normal(size=(64 + width, 5)), 64)
    for n in (0, 1, 2, 17):
        index, value = np.sort(rng.choice(64, n, replace=False)), rng.normal(size=n)
        naive = model.w0 + sum(model.w[i] * x for i, x in zip(index, value, strict=True))
        naive += sum(float(model.v[index[a]] @ model.v[index[b]]) * value[a] * value[b] for a in range(n) for b in range(a + 1, n))
        assert abs(model.raw(index, value) - naive) < 1e-9


def test_quality(spark, tables):
    docs, marks, truth = tables
    model = quality.fit(docs, marks)
    rows = quality.score_documents(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    q = {r.doc_id: r for r in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in q if i is not None and q[i].held_out} == {i for i in q if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([q[i].predicted == truth[i][0] for i in held]) > 0.9 and q[900].score == quality.score_documents(docs.where("doc_id = 900").withColumn("text", F.lit("")), model).first().score
    kept = quality.keep_good(docs, marks)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i in q if q[i].score >= 0.7}
    for few in (marks.limit(0), marks.where("quality = 1")):
        flat = {r.score for r in quality.score_documents(docs, quality.fit(docs, few)).collect()}
        assert len(flat) == 1
    assert quality.score_documents(docs.limit(0), quality.fit(docs.limit(0), marks)).count() == 0


def test_samples_are_bounded_by_rows(spark):
    docs = spark.range(600).select(F.when(F.col("id") < 500, 1).otherwise(F.col("id")).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 300).alias("text"))
    known = quality.training_labels(spark.range(600).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality")), "quality", 4, 9)
    for most in (4, 50):
        rows = quality.labelled_sample(docs, known, most).collect()
        assert len(rows) <= most and len({(r.doc_id, r.text) for r in rows}) == len(rows)


def test_toxicity(spark, tables):
    docs, marks, truth = tables
    model = toxicity.fit(docs, marks)
    rows = toxicity.score_documents(docs, model).collect()
    t = {r.doc_id: r for r in rows}
    assert len(rows) == docs.count() and np.mean([t[i].predicted == truth[i][1] for i in truth]) > 0.95
    assert t[900].predicted == t[901].predicted == t[902].predicted == 0 and t[900].score == t[901].score and t[None].predicted == 1 and not t[None].held_out
    assert {i for i in t if t[i].held_out} == {i for i in t if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    assert toxicity.score_documents(docs, toxicity.fit(docs, marks.limit(0))).where("predicted = 1").count() == 0
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_automaton():
    a = toxicity.LexiconAutomaton({"idiot": 1.0, "scum": 1.0, "vequ*": 1.0})
    found = {w: a.match(w) for w in ("idiot", "idoit", "idiots", "diot", "scam", "vequra", "veq", "")}
    assert found["idiot"] == ("idiot", 0) and found["idiots"] == found["diot"] == ("idiot", 1)
    assert found["scam"] is None and found["vequra"] == ("vequ*", 0) and found["veq"] is None and found[""] is None


def test_automaton_against_edit_distance():
    rng = random.Random(3)
    word = lambda low, high: "".join(rng.choice("abc") for _ in range(rng.randrange(low, high)))
    for _ in range(15):
        terms = {word(3, 9) for _ in range(8)}
        a = toxicity.LexiconAutomaton(dict.fromkeys(terms, 1.0))
        for w in [word(0, 10) for _ in range(300)] + list(terms):
            far = sorted((d, t) for t in terms if (d := edit_distance(t, w)) == 0 or (d == 1 and len(t) >= toxicity.FUZZY_FROM))
            assert a.match(w) == (far[0][::-1] if far else None), (w, terms)


def test_context_windows():
    model = toxicity.ToxicityModel({"idiot": 1.0, "moron": 0.5}, np.zeros(8), np.zeros(7), np.ones(7))
    found, _ = model.matches("you idiot and moron")
    assert [(f["quoted"], f["distance"], f["around"]) for f in found] == [(False, 0, 0.5), (False, 0, 1.0)]
    for quoted in ('he said "you idiot" to me', "il dit «idiot» ici", "he wrote “an idiot” there"):
        assert [f["quoted"] for f in model.matches(quoted)[0]] == [True]
    for open_ in ('she said "hello" to the idiot', "idiot ”", '"idiot'):
        assert [f["quoted"] for f in model.matches(open_)[0]] == [False]
    assert model.matches("idiot " + "x " * 20 + "moron")[0][0]["around"] == 0 and model.matches(None) == ([], [0.0] * 7)


def test_a_step_follows_the_numeric_gradient():
    """One batch and one epoch of operator 4's fit: every weight moves by AdaGrad along the gradient of the weighted loss."""
    rng = np.random.default_rng(3)
    width, buckets, rank, rate, decay = len(quality.statistics("", 0)), 24, 3, 0.05, 1e-4
    rows = [(np.sort(rng.choice(buckets, 5, replace=False)), np.full(5, 5**-0.5), list(rng.normal(size=width))) for _ in range(40)]
    labels = (rng.random(40) < 0.3).astype(float)
    model = quality.train(rows, labels, buckets, rank, 1, rate, decay, seed=7)
    share = labels.mean()
    weight = np.where(labels == 1, min(4.0, (1 - share) / share), 1.0)
    start = quality.FactorisationMachine(model.mean, model.scale, np.log(share / (1 - share)), np.zeros(buckets + width), np.random.default_rng(7).normal(0, 0.02, (buckets + width, rank)), buckets)
    data = [start.joined(*r) for r in rows]

    def loss():
        raw = np.array([start.raw(*d) for d in data])
        return (weight * (np.logaddexp(0, raw) - labels * raw)).mean()

    for array, moved in ((start.w, model.w), (start.v, model.v)):
        for spot in [(0,), (7,), (buckets + 2,)] if array.ndim == 1 else [(0, 0), (9, 2), (buckets, 1)]:
            old = array[spot]
            array[spot] = old + 1e-5
            up = loss()
            array[spot] = old - 1e-5
            slope = (up - loss()) / 2e-5 + decay * old
            array[spot] = old
            assert abs(moved[spot] - (old - rate * slope / np.sqrt(1e-6 + slope**2))) < 2e-4

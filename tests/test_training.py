"""Multi-label fitting against plain numpy, and balancing until the quotas are met."""

import numpy as np
from pyspark.sql import functions as F

from loomlake.operators import augment, labels, training


def rows_of(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        y = [int(rng.random() < 0.5), int(rng.random() < 0.2), int(rng.random() < 0.05)]
        words = [f"common{int(x)}" for x in rng.integers(0, 30, 12)] + [f"mark{k}" for k in range(3) if y[k]] * 2
        out.append((i, " ".join(words), y, "train" if i % 5 < 3 else "val" if i % 5 == 3 else "test"))
    return spark.createDataFrame(out, "id long, text string, labels array<int>, part string").repartition(3)


def matrix(features, dim, labels=3):
    x, y = np.zeros((len(features), dim + 1)), np.zeros((len(features), labels))
    for i, r in enumerate(features):
        x[i, r["at"]] = r.x
        x[i, -1] = 1
        y[i] = r.labels
    return x, y


def test_a_pass_is_the_gradient(spark, monkeypatch):
    monkeypatch.setattr(training, "CHUNK", 50)
    rows = training.features(rows_of(spark), 64)
    data = rows.collect()
    weights = np.random.default_rng(1).normal(size=(65, 3))
    gradient, loss, n, counts = training._pass(rows, weights)
    x, y = matrix([r for r in data if r.part == "train"], 64)
    cost = lambda w: (np.logaddexp(0, x @ w) - y * (x @ w)).sum()
    assert n == len(x) and abs(loss - cost(weights)) < 1e-8
    assert np.allclose(gradient, x.T @ (1 / (1 + np.exp(-x @ weights)) - y), atol=1e-9)
    for cell in ((0, 0), (33, 1), (64, 2)):  # and of the loss, by differences
        step = np.zeros_like(weights)
        step[cell] = 1e-5
        assert abs((cost(weights + step) - cost(weights - step)) / 2e-5 - gradient[cell]) < 1e-4
    x, y = matrix([r for r in data if r.part == "val"], 64)
    guess = x @ weights >= 0
    assert np.array_equal(counts, [(guess & (y == 1)).sum(0), (guess & (y == 0)).sum(0), (~guess & (y == 1)).sum(0)])


def test_fit_is_plain_adam(spark, tmp_path):
    rows = rows_of(spark)
    model = training.fit(rows, 3, dim=64, epochs=4, steps=3)
    x, y = matrix(training.features(rows.where("part = 'train'"), 64).collect(), 64)
    w, m, v = np.zeros((65, 3)), 0.0, 0.0
    best = None
    vx, vy = matrix(training.features(rows.where("part = 'val'"), 64).collect(), 64)
    for t in range(1, 13):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(x) + training.DECAY * np.vstack([w[:-1], np.zeros((1, 3))])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - training.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t % 3 == 0:
            guess = vx @ w >= 0
            score = training.weighted_f1(np.array([(guess & (vy == 1)).sum(0), (guess & (vy == 0)).sum(0), (~guess & (vy == 1)).sum(0)], float))
            if best is None or score > best[0]:
                best = (score, w.copy())
    assert np.allclose(model.weights, best[1], atol=1e-7) and len(model.history) == 4
    model.save(spark, str(tmp_path / "m"))
    scored = training.MultiLabelModel.load(spark, str(tmp_path / "m")).predict(rows.where("part = 'test'"))
    logits = {r.id: r.logits for r in scored.collect()}
    test = training.features(rows.where("part = 'test'"), 64).collect()
    assert np.allclose([logits[r.id] for r in test], matrix(test, 64)[0] @ best[1], atol=1e-6)
    whole = training.fit(rows, 3, dim=1 << 12).predict(rows.where("part = 'test'"))
    assert labels.multilabel_metrics(whole).first().f1_micro > 0.9


def test_odd_rows_and_patience(spark):
    rows = spark.createDataFrame([(None, [1, 0], "train"), ("a b", [0, 1], "train"), ("", [0, 0], "val"), ("a", None, "val"), ("a", [1], "val"), ("b", [0, None], "train")], "text string, labels array<int>, part string")
    model = training.fit(rows, 2, dim=16, epochs=9, patience=2)
    assert len(model.history) == 3  # no label in the validation rows: no epoch is better than the first
    assert [len(r.predicted) for r in model.predict(rows).collect()] == [2] * 6
    assert training.fit(rows.where("false"), 2, dim=4, epochs=1).weights.shape == (5, 2)
    m = labels.multilabel_metrics(model.predict(rows.where("false"))).first()
    assert (m.f1_micro, m.f1_weighted, m.jaccard) == (0, 0, 0)


def test_quotas_are_met(spark):
    made = [(i, f"text number {i} with some words", [1, int(i % 3 == 0), int(i % 10 == 0), 0]) for i in range(60)]
    rows = spark.createDataFrame(made, "id long, text string, labels array<int>")
    plan = {r.label: r for r in labels.balance_plan(rows).collect()}
    whole = augment.balanced(rows).collect()
    new = [r for r in whole if r.source is not None]
    assert len(whole) - len(new) == 60 and sorted(r.id for r in new) == list(range(60, 60 + len(new)))
    assert len({r.text for r in whole}) == len(whole)  # all distinct
    assert len(new) == sum(p.needed for p in plan.values()) and set(plan) == {2}
    by_id = {i: y for i, _, y in made}
    assert all(r.labels[2] == 1 and by_id[r.source][2] == 1 for r in new)
    assert sum(r.labels[2] for r in whole) == plan[2].target


def test_passes_go_on_and_end(spark):
    calls = []

    def sparing(rows, key, text, number):
        """One line for each source and pass, the same in passes 2 and 3, none from pass 5 on."""
        calls.append(number)
        n = {3: 2}.get(number, number)
        return rows.select(key, F.concat(F.lit(f"variant {n} of "), text).alias("generated") if number < 5 else F.lit("x").alias("generated"))

    rows = spark.createDataFrame([(i, f"words of {i}", [1, int(i < 3)]) for i in range(40)], "id int, text string, labels array<int>")
    new = augment.balanced(rows, sparing, target=30).where("source is not null").collect()
    assert calls == list(range(1, 11))  # pass 3 brings nothing new, and none from 5 on does
    assert sorted({r.text.split(" of ")[0] for r in new}) == ["variant 1", "variant 2", "variant 4"] and len(new) == 9
    few = augment.balanced(rows, target=500, most_per_sample=2).where("source is not null").groupBy("source").count().collect()
    assert all(r["count"] == 2 for r in few) and len(few) == 3


def test_texts_are_not_ordered_by(spark, monkeypatch):
    """A sort by ranges sends samples of its keys to the driver; no text may be among them."""
    seen, plain = [], augment.numbered

    def watched(rows, group, order, name):
        asked = rows.select(*[c.alias(f"c{i}") for i, c in enumerate(order)])
        seen.extend(r for r in asked.collect())
        return plain(rows, group, order, name)

    monkeypatch.setattr(augment, "numbered", watched)
    rows = spark.createDataFrame([(i, f"number {i} " + "long text " * 30, [1, int(i < 3)]) for i in range(20)], "id int, text string, labels array<int>")
    assert augment.balanced(rows, target=6).where("source is not null").count() == 3
    assert seen and all(len(str(v)) <= 32 for r in seen for v in r)

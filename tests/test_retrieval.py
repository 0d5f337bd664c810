import json
import math
import random

from pyspark.sql import functions as F

from loomlake.operators import dense, evaluate, labels, rag, retrieval, sparse
from loomlake.plans import catalogue


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "red red fish"), (2, "blue fish"), (3, "green tea pot")], "id int, text string")
    q = spark.createDataFrame([(1, "red")], "item_id int, text string")
    got = sparse.scores(sparse.build(docs, "id"), q, "item_id", "text", floor="none").collect()
    avg = 8 / 3
    want = math.log(2.5 / 1.5) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / avg))
    assert [(r.id, round(r.score, 9)) for r in got] == [(1, round(want, 9))]
    assert sparse.search(sparse.build(docs, "id"), q, "item_id", "text", k=3, fill=True).count() == 3


def test_pruned_search_is_exact(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(words[min(59, int(rng.expovariate(0.12)))] for _ in range(n))
    docs = spark.createDataFrame([(i, text(rng.randrange(0, 40))) for i in range(400)], "id int, text string")
    asked = spark.createDataFrame([(i, text(rng.randrange(1, 8))) for i in range(25)] + [(90, "absent"), (91, None)], "item_id int, text string")
    index = sparse.build(docs, "id")
    for floor in ("epsilon", "none", "plus_one"):
        whole, pruned = (sparse.top(f.withColumn("score", F.round("score", 9)), 5) for f in (sparse.scores(index, asked, "item_id", "text", floor), sparse.best(index, asked, "item_id", "text", 5, floor)))
        rows = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())
        assert rows(whole) == rows(pruned)
    index.release()


def test_saved_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red red fish"), (2, "blue fish"), (3, None)], "id int, text string")
    q = spark.createDataFrame([(1, "red"), (2, "")], "item_id int, text string")
    sparse.build(docs, "id", keep=False).save(str(tmp_path))
    found = sparse.search(sparse.SparseIndex.load(spark, str(tmp_path)), q, "item_id", "text", 2, floor="plus_one", prune=True).collect()
    assert [(r.query_id, r.id) for r in found] == [(1, 1)]


def test_similar_chunks_are_relevant(spark):
    answers = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, av array<double>")
    chunks = spark.createDataFrame([(1, 1, [0.7, 0.714]), (1, 2, [0.69, 0.724]), (1, 3, [1.0, 0.0]), (2, 4, [1.0, 0.0])], "query_id int, id int, v array<double>")
    assert sorted(r.id for r in evaluate.relevant_by_similarity(answers, chunks).collect()) == [1, 3]


def test_answers_of_a_batch(spark):
    ranked = spark.createDataFrame([(1, 1, 10, 0.9, "Rivers flow. They end. In the sea. Always."), (1, 2, 11, 0.6, "Hills stand still and do not flow."), (2, 1, 12, 0.4, "Some other text that is long enough.")], "query_id int, rank int, id int, score_hybrid double, text string")
    asked = spark.createDataFrame([(1, "rivers"), (2, "none"), (3, "nothing found")], "query_id int, query string")
    got = {r.query_id: r for r in rag.answer(asked, ranked).collect()}
    assert got[1].used_kb and got[1].answer == "Rivers flow. They end. In the sea." and [c.id for c in got[1].used_chunks] == [10, 11]
    assert not got[2].used_kb and got[2].used_chunks is None and got[2].answer == "Some other text that is long enough...."
    assert got[3].answer == rag.NO_ANSWER and got[3].top_score is None
    say = lambda df: df.withColumn("generated", F.when(F.contains("prompt", F.lit("rivers")), "A generated answer of some length.").otherwise("short"))
    got = {r.query_id: r.answer for r in rag.answer(asked, ranked, generate=say).collect()}
    assert got[1] == "A generated answer of some length." and got[2] == "Some other text that is long enough...."


def test_result_json_and_documents(spark):
    ranked = spark.createDataFrame([(1, 2, 7, 0.5, 0.1, 0.2, 0.3, "b"), (1, 1, 8, 0.6, 0.1, 0.2, 0.3, None)], "query_id int, rank int, id int, score_hybrid double, score_sparse double, score_dense double, score_raw_dense double, text string")
    body = json.loads(retrieval.as_json(ranked, 0.7, 10).first().result)
    assert body["alpha"] == 0.7 and body["top_k"] == 10 and [r["id"] for r in body["results"]] == [8, 7] and body["results"][1]["score_hybrid"] == 0.5
    docs = retrieval.documents(ranked).orderBy("rank").collect()
    assert [(d.page_content, d.score, d.metadata.id) for d in docs] == [("", 0.6, 8), ("b", 0.5, 7)]


def test_prepared_data_set(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"question {i}" if i else " ", "Z" if i % 4 else "['A','B']") for i in range(21)] + [(50, "no label", ""), (51, "nan", "A")], "id int, question string, final_QT string")
    parts = labels.prepare(rows, "qtypes", str(tmp_path))
    assert {r.part: r["count"] for r in parts.groupBy("part").count().collect()} == {"train": 12, "val": 4, "test": 4}
    assert sum(spark.read.json(f"{tmp_path}/qtypes/{p}").count() for p in ("train", "val", "test")) == 20
    assert spark.read.json(f"{tmp_path}/qtypes/label_list").count() == 7


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1, 3.0), (1, 2, 1.0)], "query_id int, id int, score double")
    b = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.9)], "query_id int, id int, score double")
    rows = {r.id: r for r in retrieval.fuse(a, b, 0.7).collect()}
    assert abs(rows[1].score_hybrid - 0.7) < 1e-9 and abs(rows[2].score_hybrid - 0.15) < 1e-9 and abs(rows[3].score_hybrid - 0.15) < 1e-9


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0])], "id int, v array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, qv array<double>")
    assert [(r.id, r.score) for r in dense.search(v, q).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0), (3, 0.0)]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 9, 3)], "query_id int, id int, rank int")
    truth = spark.createDataFrame([(1, 8), (1, 99)], "query_id int, id int")
    r = evaluate.metrics(evaluate.judge(ranked, truth)).first()
    assert (r.precision_5, r.recall_5, r.rr, r.ap, r.hit_1) == (0.2, 0.5, 0.5, 0.5, 0.0)
    assert abs(r.ndcg_3 - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-12


def test_truth_of_short_items(spark):
    texts = {1: "red fish swim here", 2: "a redfish", 3: "tea", 4: "green tea pot", 5: "fish swim", 6: None}
    asked = {1: "fish", 2: "red fish", 3: "fish swim here", 4: " tea ", 5: "none", 6: None, 7: "green tea pot"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    items = spark.createDataFrame(list(asked.items()), "item_id int, text string")
    got = sorted((r.query_id, r.id) for r in evaluate.containment(docs, items, "doc_id", "text", "item_id", "text").collect())
    assert got == [(q, d) for q, a in asked.items() for d, t in texts.items() if a and t and a in t]
    ranked = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (5, 1, 1)], "query_id int, id int, rank int")
    assert {(r.query_id, r.n_rel) for r in evaluate.judge(ranked, evaluate.containment(docs, items, "doc_id", "text", "item_id", "text")).collect()} == {(1, 3), (2, 1)}


def test_context_and_fallback(spark):
    ranked = spark.createDataFrame([(1, 1, "a b c d e f g h i j k l"), (1, 2, "A fine text about rivers. It flows. It ends. More."), (1, 3, "short")], "query_id int, rank int, text string").withColumn("id", F.col("rank"))
    packed = rag.pack_context(ranked).first()
    assert packed.context == "[source 2]\nA fine text about rivers. It flows. It ends. More." and packed.n_blocks == 1
    q = spark.createDataFrame([(1, "rivers"), (2, "none")], "query_id int, query string")
    got = {r.query_id: r.answer for r in rag.fallback_answers(q, ranked).collect()}
    assert got[1] == "A fine text about rivers. It flows. It ends." and got[2] == rag.NO_ANSWER


def test_splits_and_balance(spark):
    assert labels.split_sizes(351)["train"] == 210
    rows = spark.createDataFrame([(i, [1, int(i < 2), int(i < 6)]) for i in range(10)], "id int, labels array<int>")
    parts = {r.part: r["count"] for r in labels.split(rows).groupBy("part").count().collect()}
    assert parts == {"train": 6, "val": 2, "test": 2}
    plan = labels.balance_plan(rows).collect()
    assert [(r.label, r.n, r.target, r.needed) for r in plan] == [(1, 2, 5, 3)]
    variants = spark.range(10).crossJoin(spark.range(1, 3).withColumnRenamed("id", "n")).selectExpr("cast(id as int) id", "cast(n as int) n", "concat('t', id, '_', n) text")
    made = labels.augmented(rows, labels.balance_plan(rows), variants).collect()
    assert len(made) == 3 and all(r.labels == [0, 1, 0] for r in made)

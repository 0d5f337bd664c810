"""Versioned storage, block-max postings, cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomlake.operators import ann, blockmax, dense, sparse
from loomlake.operators.ranks import numbered
from loomlake.sources import scratch, vectors
from loomlake.sources.versions import Versioned


def texts(seed, n, most=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [" ".join(words[min(59, int(rng.expovariate(0.12)))] for _ in range(rng.randrange(0, most))) for _ in range(n)]


def hits(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("floor", ["epsilon", "none", "plus_one"])
def test_blocks_give_the_scores_of_the_postings(spark, monkeypatch, floor):
    monkeypatch.setattr(blockmax, "QUERY_CELLS", 300)
    docs = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate([*texts(1, 300), "w1 " * 5000, None, ""])], "id int, text string, kind int").repartition(3)
    asked = spark.createDataFrame([*enumerate(texts(2, 25, 12)), (90, "absent"), (91, None)], "item_id int, text string")
    packed = blockmax.packed(docs, "id", near=[F.col("kind")], rows=8, tokens=2000)
    index = blockmax.BlockIndex(scratch.stored(packed, "blocks"))
    plain = sparse.build(docs, "id")
    want = hits(sparse.top(sparse.scores(plain, asked, "item_id", "text", floor).withColumn("score", F.round("score", 9)), 5))
    assert hits(blockmax.search(index, asked, "item_id", "text", 5, floor, places=9)) == want
    assert hits(blockmax.search(index, asked, "item_id", "text", 5, floor, places=9, skip=False)) == want
    terms = lambda t: sorted((r.token, r.df, r.max_tf) for r in t.collect())
    assert terms(index.terms) == terms(plain.terms) and index.stats.first().n == plain.stats.first().n
    assert index.blocks.agg(F.max("n")).first()[0] == 8
    plain.release()
    index.release()


def test_packing_sorts_nothing(spark, monkeypatch):
    """A task holds the begun block of each kind and not its rows; rows of one kind share blocks wherever they lie."""
    docs = spark.createDataFrame([(i, t, i % 7) for i, t in enumerate(texts(8, 400))], "id int, text string, kind int").repartition(2)
    packed = blockmax.packed(docs, "id", near=[F.col("kind")], rows=8)
    assert "Sort" not in packed._jdf.queryExecution().executedPlan().toString()
    blocks = packed.select(F.col("ids")).collect()
    assert sorted(i for b in blocks for i in b.ids) == list(range(400))
    assert all(len({i % 7 for i in b.ids}) == 1 for b in blocks) and len(blocks) <= 400 // 8 + 2 * 7
    monkeypatch.setattr(blockmax, "HELD_TOKENS", 50)
    closed = blockmax.packed(docs, "id", near=[F.col("kind")], rows=1000).select("ids").collect()
    assert sorted(i for b in closed for i in b.ids) == list(range(400)) and all(len({i % 7 for i in b.ids}) == 1 for b in closed)


def test_blocks_of_odd_tables(spark):
    none = spark.createDataFrame([], "id string, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert blockmax.search(blockmax.build(none, "id"), asked, "item_id", "text").collect() == []
    docs = spark.createDataFrame([("x", "a a"), ("y", "b"), ("y", "b"), ("z", "")], "id string, text string")
    index = blockmax.build(docs, "id")
    assert blockmax.search(index, asked.where("false"), "item_id", "text").collect() == []
    assert [r.id for r in blockmax.search(index, asked, "item_id", "text", 2, floor="plus_one").orderBy("rank").collect()] == ["x", "y"]


def test_an_appended_index_is_a_whole_one(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(texts(3, 120))), "id int, text string")
    asked = spark.createDataFrame(list(enumerate(texts(4, 10, 12))), "item_id int, text string")
    whole = blockmax.build(docs, "id")
    path = str(tmp_path / "index")
    blockmax.build(docs.where("id < 50"), "id").save(path)
    grown = blockmax.append(path, docs.where("id < 80"), "id")  # 30 new rows
    grown = blockmax.append(path, docs, "id")
    assert hits(blockmax.search(grown, asked, "item_id", "text", 7, places=9)) == hits(blockmax.search(whole, asked, "item_id", "text", 7, places=9))
    assert len(Versioned(spark, path).manifest()["segments"]) == 3 and Versioned(spark, path).read("blocks", 1).agg(F.sum("n")).first()[0] == 50


def test_versions(spark, tmp_path):
    store = Versioned(spark, str(tmp_path / "v"))
    rows = spark.range(10).withColumn("k", F.col("id") % 2)
    assert not store.there() and store.versions() == []
    with pytest.raises(FileNotFoundError):
        store.read("t")
    assert store.publish({"t": rows}, {"dim": 1}, partition_by={"t": ["k"]}) == 1
    broken = rows.select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")).alias("id"), "k")
    for df, about, check in ((broken, {"dim": 1}, None), (rows, {"dim": 2}, None), (rows, {"dim": 1}, lambda df: (_ for _ in ()).throw(ValueError("refused")))):
        with pytest.raises(Exception):
            store.publish({"t": df}, about, append=True, check=check)
        assert store.versions() == [1] and store.read("t").count() == 10
    assert store.publish({"t": rows.withColumn("id", F.col("id") + 10)}, {"dim": 1}, append=True, partition_by={"t": ["k"]}) == 2
    assert store.read("t").count() == 20 and store.read("t", 1).count() == 10
    assert store.compact() == 3 and store.read("t").count() == 20 and len(store.manifest()["segments"]) == 1
    assert (tmp_path / "v" / "segments" / store.manifest()["segments"][0] / "t" / "k=1").exists()
    assert store.clean() == 4 and store.versions() == [3] and store.read("t").count() == 20  # two old segments, and two of failed builds
    (tmp_path / "v" / "manifests" / "00000004.json").write_text('{"version": 4, "about": {"dim": 1}, "segments": [], "partition_by": {}}')
    with pytest.raises(RuntimeError):  # another writer came first
        store._commit([3], {}, [], {})


def test_collections_refuse_other_vectors(spark, tmp_path):
    chunks = lambda *ids: spark.createDataFrame([(i, f"text {i}", "d") for i in ids], "chunk_id string, text string, parent_doc_id string")
    wide = lambda rows, key, text: dense.hashed_vectors(rows, key, text, 16)
    store = vectors.VectorCollection(spark, str(tmp_path / "c"))
    store.build(chunks("a", "b"))
    with pytest.raises(ValueError):
        store.add(chunks("c"), wide)
    with pytest.raises(ValueError):
        store.add(chunks("c"), model="other")
    fail = lambda rows, key, text: wide(rows, key, text).withColumn("v", F.raise_error(F.lit("no model")).cast("array<double>"))
    with pytest.raises(Exception):
        store.build(chunks("z"), fail, force=True)
    assert store.count() == 2  # the old version is still there
    assert store.add_batches(chunks(*"abcdefgh"), batches=3).count() == 8
    assert store.stats().first().dim == 64 and store.add(chunks("a")).count() == 8


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    middles = rng.normal(size=(20, 32))
    v = middles[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 32)) * 0.5
    return v / np.linalg.norm(v, axis=1)[:, None]


def test_cells(spark, tmp_path, points):
    rows = spark.createDataFrame([(i, v.tolist(), int(i % 2)) for i, v in enumerate(points)], "id long, v array<double>, kind int").repartition(4)
    index = ann.build(rows.where("id < 2500"), str(tmp_path / "i"), cells=24, file_rows=100)
    ann.append(index, rows.where("id >= 2500"))
    assert index.vectors().count() == 3000 and len(index.centroids()) == 24
    with pytest.raises(ValueError):
        ann.append(index, spark.createDataFrame([(1, [0.5])], "id long, v array<double>"))
    nprobe, share = ann.calibrate(index, 0.95, queries=60)
    assert nprobe < 12 and share >= 0.95
    asked = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    exact = ann.nearest(rows, asked, 10)
    truth = np.argsort(-(points[::50] @ points.T), axis=1)[:, :10]
    assert [r.id for r in exact.orderBy("query_id", "rank").collect()] == truth.ravel().tolist()
    assert ann.recall(ann.search(index, asked, 10, nprobe, clamp=False), exact) >= 0.9
    assert ann.recall(ann.search(index, asked, 10, 24, clamp=False), exact) == 1.0
    one = ann.probed(index, asked.limit(1), nprobe).first().cells
    read = index.vectors().where(F.col("cell").isin(one))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") == 2 and "PartitionFilters: []" not in plan  # in both segments
    assert read.select(F.input_file_name()).distinct().count() < len(index.vectors().inputFiles()) / 2
    loose = np.random.default_rng(6).normal(size=(1500, 32))  # no groups at all: many cells are needed
    rows = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(loose)], "id long, v array<double>")
    index = ann.build(rows, str(tmp_path / "loose"))
    nprobe, share = ann.calibrate(index, 0.95, queries=100)
    asked = rows.where("id % 40 = 1").select(F.col("id").alias("query_id"), F.col("v").alias("qv"))
    assert share >= 0.95 and nprobe < len(index.centroids()) and ann.recall(ann.search(index, asked, 10, nprobe, clamp=False), ann.nearest(rows, asked)) >= 0.9


def test_an_index_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "id long, v array<double>")
    index = ann.build(none, str(tmp_path / "none"))
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, qv array<double>")
    assert index.vectors().count() == 0 and ann.nearest(index.vectors(), asked).collect() == []
    with pytest.raises(ValueError):
        ann.append(index, spark.createDataFrame([(1, [0.5])], "id long, v array<double>"))


def test_nearest_with_ties(spark):
    rows = spark.createDataFrame([(f"r{i}", [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(30)], "id string, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "query_id int, qv array<double>")
    got = ann.nearest(rows, asked, 3, clamp=True).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.score) for r in got] == [(1, "r1", 1.0), (1, "r11", 1.0), (1, "r13", 1.0), (2, "r0", 0.0), (2, "r1", 0.0), (2, "r10", 0.0)]
    assert ann.nearest(rows, asked.where("false"), 3).collect() == []


def test_numbers_in_ranges(spark):
    rows = spark.createDataFrame([(k, i % 7, i) for k in ("a", "b") for i in range(200 if k == "a" else 3)], "k string, x int, y int").repartition(5)
    got = {(r.k, r.n): (r.x, r.y) for r in numbered(rows, ["k"], [F.desc("x"), F.col("y")], "n").collect()}
    want = sorted(((i % 7, i) for i in range(200)), key=lambda t: (-t[0], t[1]))
    assert [got["a", n] for n in range(1, 201)] == want and got["b", 1] == (2, 2) and len(got) == 203

"""Cut references, cancelled tokens, and the sizes in which wide rows are stored and moved."""

import glob

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from loomlake.operators import blockmax, chunking, dense, sparse
from loomlake.sources import html, scratch, vectors


def test_a_reference_without_its_semicolon_stays(spark):
    """As in the SQL of page_text: a title may be cut inside a reference."""
    pages = spark.createDataFrame([(1, "<h1>a &amp;&amp</h1><article>b &amp; c &copy</article>")], "page_id long, html string")
    row = html.parse_articles(pages, title="h1", body="article").first()
    assert (row.title, row.clean_text) == ("a &&amp", "b & c &copy")


def test_tokens_that_cancel_have_a_unit_vector(spark):
    """Two tokens of one cell and opposite signs."""
    words = spark.range(200).select(F.concat(F.lit("w"), "id").alias("text"))
    alone = [(r.id, r.v) for r in dense.hashed_vectors(words.withColumn("k", F.col("text")), "k", "text").collect()]
    one, two = next((a, b) for a, v in alone for b, u in alone if sum(x * y for x, y in zip(u, v, strict=True)) == -1)
    rows = spark.createDataFrame([(1, f"{one} {two}"), (2, ""), (3, one)], "id long, text string")
    got = {r.id: sum(x * x for x in r.v) for r in dense.hashed_vectors(rows, "id", "text").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 1.0}


def test_blocks_are_stored_in_small_row_groups(spark):
    docs = spark.range(0, 6000, 1, 1).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.xxhash64("id", i).cast("string"))).alias("text"))
    index = blockmax.build(docs, "id")
    files = glob.glob(index.blocks.stored_at.removeprefix("file:").replace("//", "/", 1) + "/*.parquet")
    groups = [meta.row_group(i) for meta in (pq.ParquetFile(f).metadata for f in files) for i in range(meta.num_row_groups)]
    assert sum(g.num_rows for g in groups) > 40 and max(g.total_byte_size for g in groups) < 4 * int(scratch.WIDE["parquet.block.size"])
    index.release()


def test_all_scores_and_their_ranges_leave_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(blockmax, "QUERY_CELLS", 40)  # several groups
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 17}" for j in range(1, 9 + i % 5))) for i in range(90)] + [(99, None)], "id long, text string")
    asked = spark.createDataFrame([(q, f"w{q} w{q + 3} w{q} zz") for q in range(12)], "item_id long, text string")
    plain = sparse.build(docs, "id")
    want = {(r.query_id, r.id): round(r.score, 9) for r in sparse.scores(plain, asked, "item_id", "text").collect()}
    index = blockmax.build(docs, "id")
    whole, ends = blockmax.scores(index, asked, "item_id", "text")
    assert {(r.query_id, r.id): round(r.score, 9) for r in whole.collect()} == want
    per = {q: [v for (p, _), v in want.items() if p == q] for q, _ in want}
    assert {r.query_id: (round(r.low, 9), round(r.high, 9)) for r in ends.collect()} == {q: (min(v), max(v)) for q, v in per.items()}
    counted, stats = sparse.counted(docs).first(), plain.stats.first()
    assert (counted.n, counted.avgdl, counted.n_terms) == (stats.n, stats.avgdl, plain.terms.count())
    assert counted.n_tokens == plain.postings.agg(F.sum("tf")).first()[0]
    plain.release()


def test_texts_and_pages_travel_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        chunking.chunk_rows(spark.createDataFrame([(1, "a. b")], "doc_id long, text string"), "paragraph")
        assert int(spark.conf.get(key)) <= chunking.TEXT_BYTES
        spark.conf.unset(key)
        html.selectors(spark.createDataFrame([(1, "", "<p>x")], "page_id long, url string, html string"))
        assert int(spark.conf.get(key)) <= html.PAGE_BYTES
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def test_hashed_vectors_are_made_in_their_rows(spark):
    """No row for each token or cell, and in a collection no text that moves: one shuffle, that of ids and vectors."""
    rows = spark.createDataFrame([(f"c{i}", " ".join(f"w{i}_{j}" for j in range(i))) for i in range(20)] + [("none", None), ("two", "a b"), ("two", "b c c")], "chunk_id string, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan(dense.hashed_vectors(rows, "chunk_id", "text"))
    found = vectors.embedded(rows.where("chunk_id <> 'two'"))
    assert "Generate" not in plan(found) and "Join" not in plan(found)
    want = {r.id: r.v for r in dense.hashed_vectors(rows, "chunk_id", "text").collect()}
    assert {r.chunk_id: r.embedding for r in found.collect()} == {k: [float(np.float32(x)) for x in v] for k, v in want.items() if k != "two"}
    one = {r.id: r.v for r in dense.hashed_vectors(spark.createDataFrame([("two", "a b b c c")], "id string, text string"), "id", "text").collect()}
    assert want["two"] == one["two"] and not any(want["none"])

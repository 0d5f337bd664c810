import json

import pytest
from pyspark.sql import functions as F

from loomlake.operators import quality, ratings, search
from loomlake.sources import html, records, vectors
from loomlake.sources.versions import Versioned
from loomlake.streaming.ingest import ingest_jsonl


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"doc_id": "x"}\n\nnot json\n{"doc_id": "y"}\n')
    assert sorted(r.doc_id for r in records.read_jsonl(spark, str(p), "doc_id string").collect() if r.doc_id) == ["x", "y"]
    assert [(r.line_num, r.doc_id) for r in records.read_numbered_jsonl(spark, str(p), "doc_id string").orderBy("line_num").collect()] == [(1, "x"), (3, None), (4, "y")]


def test_html(spark):
    page = '<h1 class="content-title">T</h1><div class="content-info"><span>by</span><span>2020-01-02</span></div><div class="article">a<script>x</script><p>b</p></div><a href="/articals/1/">l</a><p class="article-title"><a href="/articals/2">m</a></p><script>const pdfUrl = "http://e/x.pdf"</script>'
    pages = spark.createDataFrame([(1, "http://e/p", page), (2, None, None)], "page_id int, url string, html string")
    r = html.parse_articles(pages).orderBy("page_id").collect()
    assert (r[0].title, r[0].clean_text, r[0].published_date_raw) == ("T", "a\nb", "2020-01-02") and r[1].title is None
    assert [x.link for x in html.page_links(pages).collect()] == ["http://e/articals/1"]
    assert pages.select(html.pdf_url(F.col("html")).alias("u")).first().u == "http://e/x.pdf"


def test_book_pages(spark):
    head = '<h1 class="text-center">Book</h1>'
    body = '<div class="book">a<script>x</script><p>b</p></div>'
    rows = [
        (1, "http://e/p/", head + body + "<script>var pdfUrl = '/f/one.pdf'; let x = 'no.pdf'</script><a href='z.pdf'>z</a>"),
        (2, "http://e/p/", head + '<div class="description">about</div><a href="q.pdf">q</a><a class="pdf" href="get?2">g</a>'),
        (3, "http://e/p/", '<a href="x.html">x</a><a title=t href=UP.PDF>u</a>'),
        (4, None, None),
        (5, "http://e/", "<script>const pdfUrl = \"page.html\"</script>" + body),
    ]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    read = spark.createDataFrame([("http://e/f/one.pdf", "from the file"), ("http://e/p/get?2", "")], "pdf_url string, text string")
    got = {r.page_id: tuple(r)[1:] for r in html.parse_books(pages, pdf_text=read).collect()}
    assert got == {
        1: ("Book", "http://e/f/one.pdf", "from the file", "pdf"),
        2: ("Book", "http://e/p/get?2", "about", "html"),
        3: (None, "http://e/p/UP.PDF", None, None),
        4: (None, None, None, None),
        5: (None, None, "a\nb", "html"),
    }


def test_links_and_texts(spark):
    rows = [(1, "http://e/a/b", '<a href="c/">1</a><a href="/d">2</a><a href="c">3</a><p class="article-title"><a href="/no">4</a></p>'), (2, "http://e", "no links"), (3, None, None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string")
    assert sorted((r.page_id, r.link) for r in html.page_links(pages).collect()) == [(1, "http://e/a/c"), (1, "http://e/d")]
    page = "<h1>T</h1><article>x<nav>n</nav><div>y<footer>f</footer></div></article><article>second</article>"
    r = html.parse_articles(spark.createDataFrame([(1, page)], "page_id int, html string"), title="h1", body="article", date="footer").first()
    assert (r.title, r.clean_text) == ("T", "x\ny")


def test_numbered_lines_over_blocks(spark, tmp_path):
    want = {}
    for f in ("a", "b"):
        lines = [f'{{"doc_id": "{f}{i}"}}' if i % 3 else "" for i in range(400)]
        (tmp_path / f"{f}.jsonl").write_text("\n".join(lines) + "\n")
        want |= {f"{f}{i}": i + 1 for i in range(400) if i % 3}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = records.read_numbered_jsonl(spark, str(tmp_path), "doc_id string").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.doc_id: r.line_num for r in rows} == want and len(rows) == len(want)


def test_loaders_and_reports(spark, tmp_path):
    (tmp_path / "books_all_fixed.jsonl").write_text('{"doc_id": "f", "title": "T"}\n')
    assert records.read_books(spark, str(tmp_path)).first().doc_id == "f"
    with pytest.raises(FileNotFoundError):
        records.read_books(spark, str(tmp_path), "books_all_ragclean.jsonl")
    with pytest.raises(FileNotFoundError):
        records.read_articles(spark, str(tmp_path))
    (tmp_path / "books_all_ragclean.jsonl").write_text('{"doc_id": "c"}\n')
    assert records.read_books(spark, str(tmp_path)).first().doc_id == "c"
    docs = spark.createDataFrame([(f"d{i}", "book" if i % 2 else "article", None if i == 1 else "x" * 500) for i in range(9)], "doc_id string, kb_family string, clean_text string")
    got = {r.kb_family: r for r in records.inspection(docs).collect()}
    assert got["book"].n_rows == 4 and [s.doc_id for s in got["article"].samples] == ["d0", "d2", "d4"] and len(got["article"].samples[0].clean_text) == 300
    records.write_json_array(docs.select("doc_id").orderBy("doc_id"), str(tmp_path / "out"))
    assert sorted(r.doc_id for r in records.read_json_array(spark, str(tmp_path / "out")).collect()) == [f"d{i}" for i in range(9)]


def test_vector_collection(spark, tmp_path):
    rows = spark.createDataFrame([("a", "red fish", "d1"), ("b", "", "d1"), ("b", "", "d1"), ("c", None, "d2")], "chunk_id string, text string, parent_doc_id string")
    store = vectors.VectorCollection(spark, str(tmp_path / "store"))
    assert not store.there()
    with pytest.raises(FileNotFoundError):
        store.load()
    assert store.build(rows).count() == 3 and store.stats().select("n", "n_docs", "dim", "metric").first() == (3, 2, 64, "cosine")
    lengths = {r.chunk_id: sum(x * x for x in r.embedding) for r in store.load().collect()}
    assert abs(lengths["a"] - 1) < 1e-6 and lengths["b"] == lengths["c"] == 0
    assert store.build(rows.limit(1)).count() == 3  # it is there
    more = spark.createDataFrame([("a", "other", "d9"), ("z", "new", "d9")], "chunk_id string, text string, parent_doc_id string")
    assert store.add(more).count() == 4 and store.load().where("chunk_id = 'a'").first().text == "red fish"
    assert store.build(more, force=True).count() == 2
    store.store.publish({"vectors": store.load()}, {"metric": "dot", "model": "hashed", "dim": 64})
    with pytest.raises(ValueError):
        store.load()
    store.delete()
    assert not store.there()


def test_validation_of_narrow_tables(spark):
    r = quality.validate_articles(spark.createDataFrame([("a", "x")], "doc_id string, clean_text string")).first()
    assert "Missing or empty required field: url" in r.issues and "Missing or empty required field: title" in r.issues
    assert quality.validate_books(spark.createDataFrame([("a",)], "doc_id string")).first().warnings == ["No text content and no PDF path"]
    assert quality.with_text(spark.createDataFrame([("a",), ("",), (None,)], "clean_text string")).count() == 1


def test_validate_and_find(spark):
    docs = spark.createDataFrame([("a", "article", "http://x/y", "Title", "too short"), (None, "article", "bad", "", None)], "doc_id string, content_type string, url string, title string, clean_text string")
    r = quality.validate_articles(docs).collect()
    assert r[0].issues == [] and "Text content very short (9 chars)" in r[0].warnings
    assert "Invalid URL format: bad" in r[1].issues and len(r[1].issues) == 5
    found = search.find(spark.createDataFrame([(1, "aAaa.*b")], "doc_id int, text string"), "aa").collect()
    assert [x.start for x in found] == [0, 1, 2]


def test_ratings_and_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, None), (2, 3, "ok")], "id int, manual_rating int, manual_comment string")
    new = spark.createDataFrame([(1, 5, "")], "id int, rating int, comment string")
    got = {r.id: (r.manual_rating, r.manual_comment) for r in ratings.upsert(rows, new).collect()}
    assert got == {1: (5, None), 2: (3, "ok")} and ratings.move(0, 3, "previous") == 0
    (tmp_path / "in").mkdir()
    for form in ("parquet", "json"):
        out, cp = str(tmp_path / f"out-{form}"), str(tmp_path / f"cp-{form}")
        for n, ids in enumerate(("aab", "bc", "", "cda")):
            (tmp_path / "in" / f"{form}{n}.json").write_text("".join(json.dumps({"doc_id": d, "n": n}) + "\n" for d in ids) + '{"n": 7}\n')
            ingest_jsonl(spark, str(tmp_path / "in"), "doc_id string, n int", out, cp, form=form, compact=3).awaitTermination()
        ids = Versioned(spark, out + "_ids")
        assert len(ids.manifest()["segments"]) < 3 and sorted(r.doc_id for r in ids.read("ids").collect()) == ["a", "b", "c", "d"]
        got = spark.read.format(form).load(out).collect()
        assert sorted(r.doc_id for r in got) == ["a", "b", "c", "d"]

"""Language profiles, byte-level checks, selectors, files, reports, learned vectors, late interaction, linear clean-up."""

import hashlib
import json
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomlake.functions import text as T
from loomlake.operators import chunking, dense, embed, language, quality, retrieval
from loomlake.plans import catalogue
from loomlake.plans.catalogue import QUERIES
from loomlake.sources import binaries, html, records

SMALL = "/root/testdata/sf0.001"


def test_strip_and_clean_up_are_linear(spark):
    docs = spark.createDataFrame([("a" + " " * 1_000_000 + "b",), ("\n" * 300_000 + " \t" * 300_000 + "x",), (" \n" * 300_000 + "y\n ",)], "t string")
    began = time.time()
    got = docs.select(F.length(T.strip(F.col("t"))).alias("s"), T.clean_ocr(F.col("t")).alias("c"), T.clean_for_rag(F.col("t")).alias("r")).collect()
    assert time.time() - began < 20
    assert [r.s for r in got] == [1_000_002, 1, 1] and [r.c for r in got] == ["a b", "x", "y"] and [r.r for r in got] == ["a b", "x", "y"]


def test_tidy_lines_by_hand(spark):
    cases = {" a \n\t b \n \n \n c\t ": "a\nb\n\nc", "\n\n\na": "a", "x \t y": "x y", "a\r\nb \r\n c": "a\nb\nc", " a \n b　": "a\nb", "": "", "a \n  \n  x": "a\n\nx"}
    rows = spark.createDataFrame(list(cases.items()), "t string, want string").select(T.clean_ocr(F.col("t")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in rows), rows


def test_narrow_tables_are_summed_up(spark):
    rows = spark.createDataFrame([("a", "some text"), ("b", None)], "doc_id string, clean_text string")
    r = quality.validation_summary(quality.validate_articles(rows)).first()
    assert (r.total, r.with_issues, r.duplicate_urls, r.max_text, r.avg_title) == (2, 2, 0, 9, 0)


def test_lines_are_checked_as_bytes(spark, tmp_path):
    good, cut = '{"doc_id": "é", "n": 1}'.encode(), b'{"doc_id": "x\xff\xfey", "n": 2}'
    (tmp_path / "a.jsonl").write_bytes(b"\n".join([good, cut, b"", b"not json", b'{"doc_id": "no end', b"[1]", b"\xc3", b'{"n": 3}']) + b"\n")
    found = records.read_checked_jsonl(spark, str(tmp_path), "doc_id string, n int").orderBy("line_num").collect()
    assert [(r.line_num, r.reason, r.r and r.r.doc_id, r.r and r.r.n) for r in found] == [
        (1, None, "é", 1), (2, "bad UTF-8", "x��y", 2), (4, "bad JSON", None, None), (5, "bad JSON", None, None), (6, "bad JSON", None, None), (7, "bad JSON", None, None), (8, None, None, 3),
    ]
    checked = records.read_checked_jsonl(spark, str(tmp_path), "doc_id string, n int")
    assert sorted((r.file.rsplit("/", 1)[1], r.line_num) for r in records.bad_lines(checked).collect()) == [("a.jsonl", n) for n in (2, 4, 5, 6, 7)]
    docs = checked.where("r is not null").select("r.doc_id", (F.coalesce("reason", F.lit("")) != "bad UTF-8").alias("valid_utf8"))
    issues = {r.doc_id: r.issues for r in quality.validate_articles(docs).collect()}
    assert "Invalid UTF-8 encoding" in issues["x��y"] and "Invalid UTF-8 encoding" not in issues["é"]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    contents = {"a.pdf": b"%PDF-1.7 x", "sub/b.bin": b"%PDF-1.7 x", "c.png": b"\x89PNG\r\n\x1a\nrest", "empty.pdf": b"", "sub/empty2": b"", "d.txt": "text é".encode(), "e.html": b" <!DOCTYPE HTML><p>", "f": b"a\x00b", "g": b"\xff\xfe\xfd", "h.docx": b"PK\x03\x04zip"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    files = binaries.read_files(spark, str(tmp_path))
    got = {r.name: r for r in files.drop("content").collect()}
    assert {n: r.kind for n, r in got.items()} == {"a.pdf": "pdf", "b.bin": "pdf", "c.png": "png", "d.txt": "text", "e.html": "html", "f": "binary", "g": "binary", "h.docx": "zip"}
    assert all(got[n.split("/")[-1]].sha256 == hashlib.sha256(d).hexdigest() and got[n.split("/")[-1]].size == len(d) for n, d in contents.items() if d)
    firsts = {r.name: r.copies for r in binaries.distinct_files(files).collect()}
    assert firsts == {"a.pdf": 2, "c.png": 1, "d.txt": 1, "e.html": 1, "f": 1, "g": 1, "h.docx": 1}
    wanted = spark.createDataFrame([("http://h/x/a.pdf?v=1",), ("http://h/empty.pdf",), ("http://h/new.pdf",), (None,)], "url string")
    assert sorted(r.url for r in binaries.missing_files(wanted, files).collect()) == ["http://h/empty.pdf", "http://h/new.pdf"]
    assert binaries.read_files(spark, str(tmp_path), "*.pdf").count() == 1


def test_text_report(spark, tmp_path):
    records.write_text_report(spark.createDataFrame([("b", 2, None), ("a", 1, "x\ty")], "k string, n int, s string"), str(tmp_path / "r"), "Title")
    part = next((tmp_path / "r").glob("part-*"))
    assert part.read_text() == "Title\nk\tn\ts\na\t1\tx y\nb\t2\t\n"


def test_selectors(spark):
    page = lambda n: f"<html><body><div class='box menu'><a href=x>m</a></div><h1 class='title'>Head {n}</h1><article class='post'><p>{'word ' * 30}{n}</p><p>two</p></article><script>no text</script></body></html>"
    rows = [(i, f"http://h{i % 3}/p", page(i)) for i in range(9)] + [(20, None, "plain"), (21, "http://h0/q", None), (22, "bad", "<article class='post'>short")]
    found = html.selectors(spark.createDataFrame(rows, "page_id long, url string, html string"))
    one = {r.selector: (r.n_elements, r.n_chars) for r in found.where("page_id = 0").collect()}
    body = len(("word " * 30 + "0").strip()) + 3
    assert one["p"] == (2, body) == (2, one["article.post"][1]) and one[".menu"] == (1, 1) == one["div.box"] and one["script"] == (1, 0)
    support = html.selector_support(found)
    post = support.where("selector = '.post'").first()
    assert (post.n_pages, post.n_hosts, post.n_elements, post.n_single) == (10, 4, 10, 10)
    best = {r.role: r.selector for r in html.candidate_selectors(support, 12).where("rank = 1").collect()}
    assert best == {"body": ".post", "title": ".title"}


def test_languages(spark):
    words = {"en": ["the", "house", "with", "thing"], "de": ["das", "haus", "und", "schön"], "fr": ["la", "maison", "où", "être"]}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[lang], 6)), lang) for i, lang in enumerate(["en", "de", "fr"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    profiles = language.learn(docs)
    assert profiles.languages == ["de", "en", "fr"] and profiles.grams.count() <= language.PROFILE
    asked = spark.createDataFrame([(1, "the thing"), (2, "SCHÖN und " + "x" * 100_000), (3, "maison"), (4, ""), (5, None), (6, "zzz")], "id int, text string")
    got = {r.id: (r.lang, r.margin) for r in language.detect(asked, profiles, "id").collect()}
    assert {i: g[0] for i, g in got.items()} == {1: "en", 2: "de", 3: "fr", 4: None, 5: None, 6: None} and got[1][1] > 0
    empty = language.learn(docs.where("false"))
    assert [r.lang for r in language.detect(asked, empty, "id").collect()] == [None] * 6
    cut = language.chunk_by_language(docs.unionByName(docs.limit(1).withColumn("lang", F.lit(None).cast("string"))), {"de": "backward", None: "recursive"})
    assert {(r.strategy, r.n) for r in cut.groupBy("strategy").agg(F.count("*").alias("n")).collect()} == {("backward", 20), ("recursive", 41)}
    with pytest.raises(ValueError):
        language.chunk_by_language(docs, {"de": "unknown"})


def test_learned_vectors(spark, tmp_path):
    rng = np.random.default_rng(1)
    topics = [[f"t{t}w{i}" for i in range(12)] for t in range(6)]
    topic = rng.integers(0, 6, 240)
    texts = [" ".join([*rng.choice(topics[t], 5), *rng.choice([f"c{i}" for i in range(20)], 3)]) for t in topic]
    rows = spark.createDataFrame([*enumerate(texts), (900, ""), (901, None)], "id int, text string").repartition(3)
    model = embed.fit(rows, dim=8, cells=512, passes=12)
    data = [r for r in embed.features(rows.orderBy("id"), 512).collect() if r["at"]]
    a = np.zeros((len(data), 512))
    for i, r in enumerate(data):
        a[i, r["at"]] = r.x
    a *= np.where((a > 0).any(0), np.log(len(data) / np.maximum((a > 0).sum(0), 1)), 0)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    values = np.linalg.svd(a)[1]
    assert np.allclose(model.values, values[:8], rtol=0.02) and np.allclose(model.values[:5], values[:5], rtol=1e-3)
    model.save(spark, str(tmp_path / "m"))
    found = {r.id: r.v for r in embed.LearnedEmbedder.load(spark, str(tmp_path / "m"))(rows, "id", "text").collect()}
    assert len(found) == 242 and not any(found[900]) and not any(found[901]) and abs(np.linalg.norm(found[0]) - 1) < 1e-9
    # texts of one topic hardly share words: the learned vectors find them, hashed words less so
    v = np.array([found[i] for i in range(240)])
    hashed = {r.id: r.v for r in dense.hashed_vectors(rows, "id", "text", 8).collect()}
    h = np.array([hashed[i] for i in range(240)])

    def right(m):
        s = m @ m.T - 9 * np.eye(240)
        return np.mean(topic[np.argsort(-s, axis=1)[:, :10]] == topic[:, None])

    assert right(v) > 0.9 > 0.6 > right(h)


def test_late_interaction(spark):
    asked = spark.createDataFrame([(1, "red houses"), (2, ""), (3, "blue")], "query_id int, query string")
    rows = spark.createDataFrame([(1, 10, "a red house"), (1, 11, "green fields"), (1, 12, "RED HOUSES"), (1, 13, None), (2, 10, "a red house"), (3, 12, "RED HOUSES")], "query_id int, id int, text string")
    got = {(r.query_id, r.id): r.score_rerank for r in retrieval.late_interaction_scorer(asked)(rows).collect()}
    assert abs(got[1, 12] - 1) < 1e-9 and got[1, 12] > got[1, 10] > 0.6 > got[1, 11] and got[1, 13] == 0 and got[2, 10] == 0

    def unit(token):
        g = np.zeros(64)
        m = f"<{token}>"
        for i in range(max(len(m) - 2, 1)):
            g[int(hashlib.md5(m[i : i + 3].encode()).hexdigest()[:4], 16) % 64] += 1
        return g / np.linalg.norm(g)

    by_hand = lambda rows, key, text: spark.createDataFrame([(r[0], unit(r[0]).tolist()) for r in rows.select(key).collect()], "id string, v array<double>")
    other = {(r.query_id, r.id): r.score_rerank for r in retrieval.late_interaction_scorer(asked, by_hand)(rows).collect()}
    assert other.keys() == got.keys() and all(abs(other[k] - got[k]) < 1e-9 for k in got)
    want = np.mean([max(unit(q) @ unit(t) for t in ("a", "red", "house")) for q in ("red", "houses")])
    assert abs(got[1, 10] - want) < 1e-9


def test_hashed_embeddings_by_hand(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    tokens = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", T.tokenize(F.col("text")).alias("w")).collect():
        tokens[r.doc_id] = r.w
    got = {r.id: r.v for r in catalogue.hashed_embeddings(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for i in list(docs)[:40]:
        v = np.zeros(64)
        for w in tokens[i]:
            h = xxhash.xxh64_intdigest(w.encode(), 42)
            h -= (h >> 63) << 64
            v[h % 64] += 1 if (h >> 40) % 2 == 0 else -1
        n = np.sqrt((v**2).sum())
        assert np.allclose(got[i], v / n if n else v, atol=2e-6)


def test_paragraph_chunks_by_hand(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}

    def plain(text):
        """Parts and flushes as a list of events, worked out from lengths alone."""
        out, held, before = [], [], 0

        def flush(joint, keep):
            nonlocal held, before
            n = sum(map(len, held))
            out.append((before, before + n, joint.join(held)))
            before, held = before + n, held[len(held) - keep :]

        for p in chunking.split_paragraphs(text):
            long = len(p) > 1500
            if long and held:
                flush("\n\n", 0)
            for part in chunking.split_sentences(p) if long else [p]:
                if held and sum(map(len, held)) + len(part) > 1500:
                    flush(" " if long else "\n\n", 1)
                held.append(part)
                if not long and sum(map(len, held)) >= 800:
                    flush("\n\n", 1)
        if len("\n\n".join(held)) >= 200:
            flush("\n\n", 0)
        return out

    got = {}
    for r in QUERIES["paragraph_chunks"](spark, SMALL).orderBy("chunk_number").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.text))
    want = {i: c for i, t in docs.items() if t and (c := plain(t))}
    assert got == want
    rows = {r.strategy: r for r in catalogue.strategy_comparison(spark, SMALL).collect()}
    sizes = [len(c[2]) for chunks in want.values() for c in chunks]
    assert rows["paragraph"].n_chunks == len(sizes) and abs(rows["paragraph"].avg_size - np.mean(sizes)) < 1e-6


def test_search_json_holds_the_hybrid_rows(spark):
    rows = {}
    for r in QUERIES["hybrid_topk"](spark, SMALL).collect():
        rows.setdefault(r.query_id, {})[r.id] = r
    found = {r.query_id: json.loads(r.result) for r in catalogue.search_json(spark, SMALL).collect()}
    assert set(found) == set(rows)
    for q, x in found.items():
        assert x["alpha"] == 0.7 and x["top_k"] == 10 and [e["rank"] for e in x["results"]] == list(range(1, len(x["results"]) + 1))
        assert {e["id"]: round(e["score_hybrid"], 5) for e in x["results"]} == {i: r.score_hybrid for i, r in rows[q].items()}


def test_rows_are_multiplied_in_blocks():
    rng = np.random.default_rng(3)
    table = rng.normal(size=(200, 12_000)) * (rng.random((200, 12_000)) < 0.01)
    table[50] = rng.normal(size=12_000)  # more than a block's places
    table[120:180] = 0
    row, cell = np.nonzero(table)
    w = rng.normal(size=(12_000, 5))
    assert np.allclose(embed._times(row, cell, table[row, cell], 200, w), table @ w)
    blocks = list(embed._blocks(row, cell, table[row, cell]))
    assert max(len(own) for own, *_ in blocks) <= embed.ROWS and sum(len(own) for own, *_ in blocks) == 140
    assert all(np.array_equal(part, table[np.ix_(own, cells)]) for own, cells, part in blocks)

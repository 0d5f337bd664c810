import pytest
from pyspark.sql import functions as F

from loomlake.functions import labels as L
from loomlake.functions import prompts as P
from loomlake.functions import text as T
from loomlake.operators import chunking as C


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_normalize_and_tokens(spark):
    assert one(spark, "مُدَرِّسٌ آخر", T.normalize_arabic) == "مدرس اخر"
    assert one(spark, " a  b\n c ", T.tokenize) == ["a", "b", "c"]
    assert one(spark, "", T.tokenize) == []


def test_repair_and_clean(spark):
    assert one(spark, "Uن هذا", T.repair) == "أن هذا"
    assert one(spark, "اUزمة", T.repair) == "الأزمة"
    assert one(spark, " a \n\n\n\n b\t c \n", T.clean_for_rag) == "a\n\nb c"
    assert one(spark, None, T.clean_for_rag) == ""
    assert one(spark, "x (cid:3) y", T.strip_cid) == "x y"


def test_repairs_by_hand(spark):
    """Pairs written down by hand, and texts that are left alone."""
    pairs = {"اUﺣﻮال": "الأحوال", "اUﻛﺜﺮ": "أكثر", "ا%ولية": "الأولية", "Uمل": "أمل", "قال Uن ": "قال أن ", "Uنت": "أنت", "UUن": "Uأن", "Uب Uت": "أب أت", "U S A 100%": "U S A 100%", "عربي": "عربي", "Uber عربي": "Uber عربي", "عربي 5%": "عربي 5%", "": ""}
    for before, after in pairs.items():
        assert one(spark, before, T.repair) == after
    assert one(spark, None, T.repair) is None


def test_logits(spark):
    rows = spark.createDataFrame([([0.0, -0.1, 5.0], 0.0)], "z array<double>, s double")
    r = rows.select(L.predict(F.col("z")).alias("p"), L.predict(F.col("z"), 0.9).alias("q"), L.sigmoid(F.col("s")).alias("h")).first()
    assert (r.p, r.q, r.h) == ([1, 0, 1], [0, 0, 1], 0.5)


def test_prompts_are_filled_once(spark):
    r = spark.createDataFrame([("why {context}?", "see {query} and {answer}", None)], "q string, c string, a string")
    got = r.select(P.answer_prompt(F.col("q"), F.col("c"), "{query}|{context}|{query}").alias("p"), P.training_example(F.col("q"), F.col("c"), F.col("a")).alias("t"), P.answer_prompt(F.col("q"), F.col("c"), "filtering").alias("f"), P.answer_prompt(F.col("q"), F.lit("x" * 3001), "{context}").alias("cut")).first()
    assert got.p == "why {context}?|see {query} and {answer}|why {context}?"
    assert got.t == "السؤال: why {context}?\n\nالنص:\nsee {query} and {answer}\n\nالإجابة: "
    assert "Pass over" in got.f and got.cut == "x" * 3000 + "..."
    with pytest.raises(ValueError):
        P.fill("{other}", query=F.lit(""))


def test_sentence_windows_at_their_limits():
    assert C.sentence_windows("aaaa. bbbbb", 11) == [(0, 11, "aaaa. bbbbb")]
    assert C.sentence_windows("aaaa. bbbbbb", 11, 0) == [(0, 5, "aaaa."), (5, 11, "bbbbbb")]
    s = "x" * 599 + "."
    assert [len(p[2]) for p in C.sentence_windows(f"{s} {s[1:]}")] == [1200] and [len(p[2]) for p in C.sentence_windows(f"{s} {s}")] == [600, 600]
    assert C.sentence_windows("a. b. " + "c" * 30, 10, 5) == [(0, 5, "a. b."), (-1, 35, "a. b. " + "c" * 30)]  # both are carried on
    assert C.sentence_windows("y" * 5000) == [(0, 5000, "y" * 5000)]


def test_groups_at_their_limits():
    s = lambda n: "x" * (n - 1) + "."
    assert [p[2] for p in C.sentence_groups(f"{s(400)} {s(400)} {s(300)}")] == [f"{s(400)} {s(400)}", f"{s(400)} {s(400)} {s(300)}", f"{s(400)} {s(300)}"]
    assert C.sentence_groups(s(199)) == [] and len(C.sentence_groups(s(200))) == 1
    assert [len(p[2]) for p in C.paragraph_groups(f"{s(900)}\n\n{s(700)}")] == [900, 900, 1602, 700]  # what is carried on comes again
    assert [(a, z) for a, z, _ in C.paragraph_groups(f"{s(300)}\n\n{s(300)}")] == [(0, 600)]
    assert [p[2] for p in C.paragraph_groups(f"{s(250)}\n\n{s(800)} {s(800)}")] == [s(250), s(800), f"{s(800)}\n\n{s(800)}"]


def test_windows_at_their_marks():
    text = "a" * 700 + ".\n" + "b" * 500
    assert [(a, z) for a, z, _ in C.boundary_windows(text)] == [(0, 701), (601, 1401)]
    assert [(a, z) for a, z, _ in C.boundary_windows("a" * 1000)] == [(0, 800), (700, 1500)]
    assert [(a, z) for a, z, _ in C.backward_windows("a" * 800 + "." + "b" * 100)] == [(0, 801), (801, 1601)]
    assert [(a, z) for a, z, _ in C.backward_windows("a" * 699 + "." + "b" * 300)] == [(0, 800), (800, 1600)]
    assert C.boundary_windows("") == C.backward_windows("  ") == []


def test_predicates(spark):
    assert one(spark, "a b c d e f g h i j k", T.is_heavily_corrupt)
    assert one(spark, "x " * 21, T.is_repetitive)
    assert not one(spark, "no url", T.is_url) and one(spark, "http://a.b/c", T.is_url)
    assert one(spark, "https://e.org/a/b-1!/", T.doc_id_of_url) == "b-1"


def test_label_codes(spark):
    f = lambda c: L.parse_codes(c, L.QUESTION_CODES, L.QUESTION_LABELS)
    assert one(spark, "['A','B']", f) == [0, 1]
    assert one(spark, "A, Z", f) == [1, 6]
    assert one(spark, "[A", f) == [] and one(spark, "nan", f) == []


def test_window_closed_form(spark):
    for n in (0, 1, 1199, 1200, 1201, 2200, 2201, 5000):
        text = ("abcdefghij" * 600)[:n]
        rows = C.char_chunks(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("chunk_index").collect()
        at, want = 0, []
        while n:
            want.append((at, min(at + 1200, n)))
            if at + 1200 >= n:
                break
            at += 1000
        assert [(r.char_start, r.char_end) for r in rows] == want
        assert all(r.text == text[r.char_start : r.char_end] for r in rows)


def test_chunkers_cover_the_text():
    text = " ".join(f"Sentence number {i} ends here." for i in range(300))
    for cut in (C.sentence_windows, C.sentence_groups, C.paragraph_groups, C.boundary_windows, C.backward_windows, C.recursive_windows):
        joined = " ".join(p[2] for p in cut(text))
        assert all(f"number {i} " in joined for i in range(295))
    assert "".join(text[a:min(z, len(text))] for a, z, _ in C.backward_windows(text)) == text
    assert C.sentence_windows("") == []


def test_strategies_compare_whole_texts(spark):
    texts = [" ".join(f"Sentence number {i} ends here." for i in range(n)) for n in (3, 20, 700)]
    docs = spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id int, text string")
    assert len(texts[2]) > 4 * 5000
    for first in (None, 5000):
        got = {r.strategy: (r.n_chunks, round(r.avg_size, 6)) for r in C.compare_strategies(docs, ["sentence", "recursive"], *([first] if first else [])).collect()}
        for name in got:
            sizes = [len(p[2]) for t in texts for p in C.STRATEGIES[name](t[:first])]
            assert got[name] == (len(sizes), round(sum(sizes) / len(sizes), 6))


def test_first_document_of_an_id_is_chunked(spark):
    rows = [("a", "qa_pair", "pair " * 300), ("a", "article", "article " * 300), ("b", "book", "one " * 400), ("b", "book", "one " * 400), ("c", "book", None), ("c", "book", "text"), ("d", "qa_pair", "short"), (None, "book", "x"), ("e", None, "y")]
    docs = spark.createDataFrame([(*r, r[1]) for r in rows], "doc_id string, kb_family string, clean_text string, content_type string")
    got = C.kb_chunks(docs).collect()
    assert sorted(r.chunk_id for r in got) == ["a_chunk_0", "a_chunk_1", "a_chunk_2", "b_chunk_0", "b_chunk_1", "c_chunk_0", "d_chunk_0", "e_chunk_0"]
    assert {r.kb_family for r in got if r.parent_doc_id == "a"} == {"article"} and all("pair" not in r.text for r in got)

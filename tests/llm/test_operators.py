"""Operators 2, 3, 7 and parts of 5 and 8 on small tables with nulls, empty and long texts, ties, repeats and clashing names. The
other operators and the pipeline have files of their own."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from plain import contamination
from pyspark.sql import functions as F

from loomlake.llm import bpe, decontaminate, jaccard_join, line_dedup, token_files

BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
TEXTS = [" ".join(BASE), " ".join(BASE), " ".join(BASE[:-1] + ["end"]), "", None, "one two", "ONE two", "x " * 5000, " ".join(BASE[5:20]) + " !! other words", "   ", "naïve café déjà 漢字 😀"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "d", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None, None, None), (5, "one two", "en", "s", 7, "d", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, d string, size int")


def test_bpe_round_trip(docs):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(bpe.RANKS_FILE), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.tokenizer(*bpe._vocabulary(None, None))
    for text in [t or "" for t in TEXTS] + ["a  b", " x\n\ny ", "it's\t\x1c <|endoftext|>", "aaaaaaaaab" * 40, "  \n x", "'\th\n "]:
        ids = [int(i) for p in own.pieces(text) for i in p[1].split()]
        assert ids == library.encode_ordinary(text) == own.encode(text)
        assert own.decode(ids) == text.encode()
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    ids = library.encode_ordinary(TEXTS[0])
    assert got[0].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got[4].n_tokens == 0 and got[4].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    other = bpe.tokenizer(bpe._vocabulary(None, None)[0], r"\w|\W")  # another pattern goes match by match
    assert [int(i) for p in other.pieces("ab c") for i in p[1].split()] == other.encode("ab c") == [i for c in "ab c" for i in library.encode_ordinary(c)]
    memo = bpe.Memo(len, 100, 50)
    assert [memo["x" * n] for n in range(40)] == list(range(40)) and memo.chars <= 50 + 40 and len(memo) < 40
    back = bpe.decode_documents(bpe.encode_documents(docs)).where("doc_id = 10").first()
    assert bytes(back.data).decode() == TEXTS[10]


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, " ".join(BASE[3:18]).upper()), (2, "two"), (3, None), (None, "one"), (4, "absent words here")], "item_id long, text string")
    got = {r.d: r for r in decontaminate.contamination(docs, items).collect()}
    assert (got[0].n_words, got[0].n_hit, got[0].n_items) == (24, 15, 1)
    assert got[0].items_sha256 == hashlib.sha256(b"1").hexdigest()
    assert (got[5].n_hit, got[5].contaminated) == (1, True) and (got[4].n_words, got[4].contaminated) == (0, False)
    assert got[8].n_hit == 13 and got[7].n_hit == 0
    kept = decontaminate.clean_documents(docs, items)
    assert kept.columns == docs.columns and not {0, 1, 2, 5, 6, 8} & {r.doc_id for r in kept.collect()}
    postings = decontaminate.build_index(docs, spark.createDataFrame([("alpha",), ("gamma",)], "t string"))
    assert {r.doc_id for r in decontaminate.proximity(postings, "alpha", "gamma", 2).collect()} == {0, 1, 2}
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_decontamination_against_a_plain_search(spark):
    rng = np.random.default_rng(9)
    words = [*"abcdef", "A", "B", "ü", "x1"]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [(i, text(n)) for i, n in enumerate((1, 2, 12, 13, 14, 30, 0))] + [(7, "a a a a a a a a a a a a a a"), (10, "b, c! -- d"), (None, "a"), (11, None)]
    texts = [text(n) for n in (0, 1, 5, 40, 300)] + [f"{text(20)} {items[5][1]}; {text(9)}", items[4][1], items[4][1], "a " * 5000, None, "...", "ü.Ü"]
    docs = spark.createDataFrame([(i, t, "k", 1, "t") for i, t in enumerate(texts)], "doc_id long, text string, d string, pos int, item string")
    want = contamination(texts, items)
    for drop in (0, 3):  # with short items nearly all is hit; without them, little
        own = items[drop:]
        got = {r.d: r for r in decontaminate.contamination(docs, spark.createDataFrame([(*i, "q") for i in own], "item_id long, text string, t string")).collect()}
        want = contamination(texts, own)
        assert [(got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) for i in range(len(texts))] == want


def test_keep_first_by_id_and_text(spark):
    a, b, c, e, f = (" ".join(f"{k}{i}" for i in range(40)) for k in "abcef")
    rows = [
        (1, a), (5, a + " end"), (5, b), (6, c), (6, c), (3, c + " end"),  # 5: one text is a copy, the other isn't
        (7, b + " end"), (None, e), (None, e), (None, e + " end"), (None, f), (None, f), (9, f), (None, ""), (None, None), (None, " "),
    ]
    docs = spark.createDataFrame([(*r, "k", i // 3) for i, r in enumerate(rows)], "doc_id long, text string, d string, size int")
    kept = jaccard_join.keep_first(docs)
    assert kept.schema == docs.schema
    got = [(r.doc_id, r.text) for r in kept.collect()]
    texts = {e, e + " end"} & {t for _, t in got}
    assert len(texts) == 1  # by the text's hash
    want = [(1, a), (5, b), (3, c + " end"), (9, f), (None, ""), (None, None), (None, " "), (None, texts.pop())]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r.doc_id for r in jaccard_join.keep_first(docs.where("doc_id = 6")).collect()} == {6} and jaccard_join.keep_first(docs.limit(0)).count() == 0


def test_line_dedup(spark):
    long_line, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, f"{long_line}\nmine\n{other}\n{other} x"), (2, f"first\n{long_line}\nlast"), (3, f"{other}\n{other} x\nend"), (4, None), (5, ""), (6, "mine\nend")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, d string")
    got = {r.doc_id: r for r in line_dedup.dedup_documents(docs).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "first\nlast" and got[3].text == "end"
    assert got[4].text is None and got[5].text == "" and got[6].text == "mine\nend" and got[2].d == "k"
    assert line_dedup.report(docs.limit(0)).count() == 0


def test_line_dedup_over_blank_lines(spark):
    parts = [" ".join(f"p{k}_{i}" for i in range(30)) for k in range(5)]
    short = parts[0]
    rows = [
        (1, "top\n\n" + "\n\n".join(parts) + "\n\nend"),
        (2, "\nhead\n\n" + "\n \t\n\n".join(parts) + "\n\ntail\n"),  # other blank lines between
        (3, f"one\n\n{short}\n\ntwo"),  # 30 words only
        (4, "\n".join(parts)),
        (5, f"{parts[3]}\n\n\n{parts[4]}\n\nnew"),
        (6, f"{parts[4]}\n\n{parts[3]}"),  # another order: two runs of 30 words
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.report(docs).collect()}
    assert {i: r.text for i, r in got.items()} == {1: rows[0][1], 2: "\nhead\n\n\ntail\n", 3: rows[2][1], 4: "", 5: "\nnew", 6: rows[5][1]}
    assert {i: r.n_removed for i, r in got.items()} == {1: 0, 2: 13, 3: 0, 4: 5, 5: 4, 6: 0}


def test_word_encoder_against_the_library():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_files.TOKENIZER_FILE)
    library, encoder = Tokenizer.from_file(path), token_files.WordEncoder(path, 2)
    rng = np.random.default_rng(11)
    letters = [chr(c) for c in range(1, 0x250)] + list("aaaeeetsdmlrv....!! 1239\n\t ") * 12
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(1, 0x250)]
    texts += ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice(list("abst'redvmlLL .,1\n "), rng.integers(0, 30))) for _ in range(3000)]
    texts += ["", " ", "'", "''s", "it's we'RE 's 'll'll x''s 1's 'd've", "<|endoftext|> <|ENDOFTEXT|>", "e\u0301 E\u0301", "\u4e2d\u6587 \U0001f600", "x" * 5000, "word " * 9000, None]
    for _ in range(2):  # the second time everything is in the table
        ids, counts = encoder.encode(pa.array(texts))
        ends = np.cumsum(counts)
        for text, a, z in zip(texts, ends - counts, ends, strict=True):
            assert ids[a:z].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2], text
    assert [len(x) for x in encoder.encode(pa.array([], pa.string()))] == [0, 0]


def test_token_files(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    for bits in (1, 5, 8, 13, 16, 20):
        ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
        assert (token_files.unpack(token_files.pack(ids, bits), bits, 1001) == ids).all()
    library = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER_FILE))
    more = spark.createDataFrame([(5, f"row {i % 7}") for i in range(60)] + [(None, t) for t in ("a b", "", None)], "doc_id long, text string")  # a hot id, ties
    rows = token_files.token_files(docs.unionByName(more, allowMissingColumns=True)).collect()
    texts = defaultdict(list)
    for r in [*docs.collect(), *more.collect()]:
        texts[r.doc_id].append([*library.encode(r.text or "", add_special_tokens=False).ids, 2])
    start, order = 0, []
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == start
        ids = next(x for x in texts[r.doc_id] if (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) == (r.n_tokens, r.ids_crc32))
        texts[r.doc_id].remove(ids)
        order.append(-1 if r.doc_id is None else r.doc_id)
        start += r.n_tokens
    assert not any(texts.values()) and order == sorted(order)
    assert token_files.token_files(docs.limit(0)).count() == 0


def test_empty_tables_and_repeated_rows(spark, docs):
    """Operators 2 and 3: no rows of no rows, and the same digests for each of the equal rows."""
    none = docs.where("false")
    items = spark.createDataFrame([(1, " ".join(BASE[:13]))], "item_id long, text string")
    assert bpe.digests(none).count() == 0 and decontaminate.contamination(none, items).count() == 0
    assert {(r.n_hit, r.contaminated) for r in decontaminate.contamination(docs, items.where("false")).collect()} == {(0, False)}
    twice = docs.unionByName(docs).where("doc_id in (0, 4, 7)")
    for found in (bpe.digests(twice).select("doc_id", "ids_sha256"), decontaminate.contamination(twice, items).select("d", "n_hit")):
        rows = found.collect()
        assert len(rows) == 6 and len(set(rows)) == 3


def test_equal_rows_lie_in_several_token_files(spark, tmp_path):
    rows = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text in each row").alias("text")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few bytes would make one file
    try:
        manifest = token_files.write_token_files(rows, f"file://{tmp_path}")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r.n_docs for r in manifest.collect()]
    assert sum(sizes) == 4000 and len(sizes) > 1 and max(sizes) < 3000
    read = token_files.read_token_files(manifest, f"file://{tmp_path}").collect()
    n = read[0].n_tokens
    assert sorted(r.start for r in read) == list(range(0, 4000 * n, n)) and len({r.ids_crc32 for r in read}) == 1

"""The corpus pipeline: every stage against a plain version, on what its predecessor kept."""

import base64
import hashlib
import random
from collections import Counter

import corpus_pipeline
import pytest
from plain import contamination
from pyspark.sql import functions as F
from test_jaccard_join import all_pairs
from test_line_dedup import brute

from loomlake.llm import bpe, line_dedup, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    words = [f"plain{i}" for i in range(300)]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(20, 70))) for _ in range(25)]
    items = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(4)] + [(9, None), (None, "x y")]
    texts = []
    for i in range(90):
        text = "\n".join([*(rng.choice(lines) for _ in range(rng.randrange(0, 3))), " ".join(rng.choice(words) for _ in range(60)), *([""] * (i % 3 == 0)), f"own {i}"])
        if i % 9 == 0:
            text += "\n" + items[i % 4][1]
        texts.append(" ".join(w + "$#%" for w in text.split(" ")) if i % 6 == 5 else text)
    rows = [(i, t) for i, t in enumerate(texts)]
    near = texts[1].split(" ")
    rows += [(200 + k, " ".join([*near[:-1], f"end{k}"])) for k in range(4)]
    rows += [(300, None), (301, ""), (302, " "), (None, texts[2]), (None, "without an id " + texts[3]), (4, texts[4]), (4, texts[7])]
    d = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int("$#%" not in (t or "")), 0) for i, t in rows if i is not None and i < 200], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def bag(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_bpe"]
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    steps, docs = [documents.collect()], documents
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if n < 4:
            assert out.schema == documents.schema
        out.write.parquet(f"{folder}/out-{n}")
        docs = spark.read.parquet(f"{folder}/out-{n}")
        steps.append(docs.collect())
    start, good, lines, single, clean, encoded = steps

    scored = quality.score_documents(documents, quality.fit(documents, spark.read.parquet(f"{folder}/labels.parquet"))).groupBy("doc_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect()
    sure = {r.doc_id: r.lo >= 0.7 for r in scored if (r.lo >= 0.7) == (r.hi >= 0.7)}
    assert all((bag(good)[r.doc_id, r.text] == bag(start)[r.doc_id, r.text]) == sure[r.doc_id] for r in start if r.doc_id in sure)
    plain_ids = {r.doc_id for r in start if r.doc_id is not None and r.doc_id < 90 and "$#%" not in r.text}
    assert plain_ids <= {r.doc_id for r in good} and not {r.doc_id for r in good} & {i for i in range(90) if i % 6 == 5 and i != 4}

    hashed = [(r.doc_id, r.h, r.text) for r in spark.createDataFrame([tuple(r) for r in good], SCHEMA).select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]
    cut = brute(hashed, line_dedup.MIN_WORDS)
    want = Counter()
    for d, h, t in hashed:
        text, gone = cut[-(2**63) if d is None else d, h, t]
        if not gone or text.strip(" "):
            want[d, text] += 1
    assert bag(lines) == want and len(lines) <= len(good) and any(gone for _, gone in cut.values())
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in lines)

    named = [(n, r) for n, r in enumerate(sorted(lines, key=lambda r: (r.doc_id is None, r.doc_id or 0)))]
    found = all_pairs([(n, r.text) for n, r in named])
    by: dict[int, set] = {}
    for n, r in named:
        if found[n][0]:
            by.setdefault(found[n][1], set()).add((r.doc_id, r.text))
    kept = set(bag(single))
    for group in by.values():  # one document of each group, the one with the smallest id
        stays = group & kept
        assert len(stays) == 1
        (stayed,) = stays
        ids = [i for i, _ in group if i is not None]
        assert stayed[0] == (min(ids) if ids else None)
    assert sum(not found[n][0] for n, _ in named) == sum(not (r.text or "").split() for r in single)

    facts = [contamination([r.text], [(i, t) for i, t in ((x.item_id, x.text) for x in spark.read.parquet(f"{folder}/benchmark.parquet").collect())])[0] for r in single]
    assert bag(clean) == bag([r for r, f in zip(single, facts, strict=True) if not f[4]]) and len(clean) < len(single)

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(bpe.RANKS_FILE), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((r.doc_id, len(ids := library.encode_ordinary(r.text or "")), digest(" ".join(map(str, ids)).encode()), digest((r.text or "").encode())) for r in clean)
    assert Counter(map(tuple, encoded)) == want

    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == want


def test_empty_table(spark, folder, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

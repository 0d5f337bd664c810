"""Chunkers: one document to many rows.

The character window is a closed form and stays in the JVM. The others are recurrences whose next step depends on
the last; they run row by row in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..sources.scratch import small_batches, stored
from .quality import first_of

PIECES = "start long, end long, text string"
# The order in which the sources are loaded.
FAMILIES = ["article", "book", "qa_pair"]
#: Texts that a Python worker cuts at once.
TEXT_BYTES = 1 << 22
# Where a recursive split may cut, from coarse to fine.
SEPARATORS = ["\n\n", "\n", ". ", "؟", "!", " ", ""]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often and in whatever inner function body names it."""
    return F.transform(F.array(value), body).getItem(0)


def explode_windows(docs: DataFrame, stripped: Column, size: Column, overlap: Column) -> DataFrame:
    """docs with __i, __n (windows), __a, __z (start, end), __p (piece): one row for each window of a stripped text. Pieces
    are cut inside the document's row, so that no row holds the whole text beside its piece."""

    def pieces(x: Column) -> Column:
        t, n, size, step = x["t"], x["n"], x["size"], x["step"]
        more = F.when(n > size, F.ceil((n - size) / step)).otherwise(0).cast("int")
        cut = lambda y: F.transform(F.sequence(F.lit(0), y), lambda i: F.struct(i.alias("i"), (y + 1).alias("n"), (i * step).cast("long").alias("a"), F.least(i * step + size, n).cast("long").alias("z"), strip(F.substring(t, i * step + 1, size)).alias("p")))
        return F.when(n > 0, _let(more, cut))

    own = _let(stripped, lambda t: F.struct(t.alias("t"), F.length(t).alias("n"), size.cast("int").alias("size"), (size - overlap).cast("int").alias("step")))
    rows = docs.select("*", F.explode(_let(own, pieces)).alias("__w"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"__w.{c}").alias(f"__{c}") for c in ("i", "n", "a", "z", "p")])


def char_chunks(docs: DataFrame, text: str = "text", size: int = 1200, overlap: int = 200) -> DataFrame:
    """docs' columns but the text, with chunk_index, num_chunks_total, char_start, char_end and the chunk as text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap has to be smaller than the chunk size")
    rest = [F.col(c) for c in docs.columns if c != text]
    rows = explode_windows(docs.select(*rest, F.col(text).alias("__text")), strip(F.col("__text")), F.lit(size), F.lit(overlap))
    return rows.select(*rest, F.col("__n").alias("num_chunks_total"), F.col("__i").alias("chunk_index"), F.col("__a").alias("char_start"), F.col("__z").alias("char_end"), F.col("__p").alias("text"))


def kb_chunks(docs: DataFrame, size: int = 1200, overlap: int = 200, article_size: int | None = None, article_overlap: int | None = None, qa_whole: int = 4000) -> DataFrame:
    """Chunks of a knowledge base: doc_id, content_type, kb_family, clean_text and more in, 15 chunk fields out.

    Rows without id or text go. Of rows with one doc_id the first counts: articles, books and pairs in this order, then
    by the text's hash, null texts last; so chunk ids don't repeat. A question-answer pair of up to ``qa_whole``
    characters is one chunk.
    """
    family = F.coalesce(F.array_position(F.array(*map(F.lit, FAMILIES)), F.nullif("kb_family", F.lit(""))), F.lit(0))
    place = F.struct(family == 0, family, F.col("clean_text").isNull(), F.xxhash64("clean_text"), F.col("clean_text"))
    named = docs.where("doc_id is not null and trim(doc_id) <> ''")
    repeated = stored(named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    firsts = first_of(named.join(repeated, "doc_id", "left_semi"), F.col("doc_id"), place)  # only these rows move
    good = named.join(repeated, "doc_id", "left_anti").unionByName(firsts).where("clean_text is not null")
    kind = F.coalesce(F.nullif("content_type", F.lit("")), F.nullif("kb_family", F.lit("")), F.lit("unknown"))
    own = F.when(kind == "article", F.lit(article_size or size)).when((kind == "qa_pair") & (F.length("__s") <= qa_whole), F.lit(qa_whole)).otherwise(F.lit(size))
    lap = F.when(kind == "article", F.lit(article_overlap if article_overlap is not None else overlap)).otherwise(F.lit(overlap))
    rows = explode_windows(good.withColumn("__s", strip(F.col("clean_text"))).drop("clean_text"), F.col("__s"), own, lap)
    return rows.select(
        F.concat_ws("_chunk_", "doc_id", F.col("__i").cast("string")).alias("chunk_id"),
        F.col("doc_id").alias("parent_doc_id"),
        F.coalesce(F.nullif("kb_family", F.lit("")), kind).alias("kb_family"),
        kind.alias("content_type"),
        *[F.col(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in (("source_site", "string"), ("url", "string"), ("title", "string"), ("language", "string"), ("published_date_raw", "string"), ("tags", "array<string>"))],
        F.col("__i").cast("long").alias("chunk_index"),
        F.col("__n").cast("long").alias("num_chunks_total"),
        F.col("__a").alias("char_start"),
        F.col("__z").alias("char_end"),
        F.col("__p").alias("text"),
    )


def sentence_windows(text: str, size: int = 1200, overlap: int = 200) -> list[tuple[int, int, str]]:
    """Groups of sentences and lines, joined by blanks, of at most ``size`` characters (or one part); the last parts that
    fit in ``overlap`` are carried on. With the lengths of all parts (and a blank after each) summed up, a group's end and
    the place from which it is carried on are look-ups in an ascending list. Offsets count the chunks' own lengths, as if
    laid end to end with the carried part overlapping."""
    marked = re.sub(r"(?<=[.!?؟])\s+", "\n", text or "")
    parts = [p for p in map(str.strip, marked.split("\n")) if p]
    upto = [0, *accumulate(len(p) + 1 for p in parts)]
    out: list[tuple[int, int, str]] = []
    first, last, at = 0, 0, 0
    while last < len(parts):
        last = min(len(parts), max(last + 1, bisect_right(upto, upto[first] + size + 1) - 1))
        chunk = " ".join(parts[first:last])
        out.append((at, at + len(chunk), chunk))
        first = bisect_left(upto, upto[last] - overlap - 1, first, last)
        at += len(chunk) - (upto[last] - upto[first])
    return out


def split_sentences(text: str) -> list[str]:
    """Sentences with the mark that ends them."""
    return [s for s in (p.strip() for p in re.split(r"(?<=[.!?؟])\s+", text)) if s]


def split_paragraphs(text: str) -> list[str]:
    return [s for s in (p.strip() for p in re.split(r"\n\s*\n", text)) if s]


class _Group:
    """Parts collected towards a chunk; size counts the parts without their joints."""

    def __init__(self):
        self.out: list[tuple[int, int, str]] = []
        self.parts: list[str] = []
        self.before = 0

    @property
    def size(self) -> int:
        return sum(map(len, self.parts))

    def flush(self, joint: str, keep: int) -> None:
        self.out.append((self.before, self.before + self.size, joint.join(self.parts)))
        self.before += self.size
        self.parts = self.parts[-keep:] if keep else []


def sentence_groups(text: str, target: int = 800, most: int = 1500, least: int = 200) -> list[tuple[int, int, str]]:
    g = _Group()
    for s in split_sentences(text):
        if g.parts and g.size + len(s) > most:
            g.flush(" ", 2)
        g.parts.append(s)
        if g.size >= target:
            g.flush(" ", 2)
    if len(" ".join(g.parts)) >= least:
        g.flush(" ", 0)
    return g.out


def paragraph_groups(text: str, target: int = 800, most: int = 1500, least: int = 200) -> list[tuple[int, int, str]]:
    """Paragraphs first; one longer than ``most`` falls into sentences, the last of which stay open."""
    g = _Group()
    for p in split_paragraphs(text):
        if len(p) > most:
            if g.parts:
                g.flush("\n\n", 0)
            for s in split_sentences(p):
                if g.parts and g.size + len(s) > most:
                    g.flush(" ", 1)
                g.parts.append(s)
            continue
        if g.parts and g.size + len(p) > most:
            g.flush("\n\n", 1)
        g.parts.append(p)
        if g.size >= target:
            g.flush("\n\n", 1)
    if len("\n\n".join(g.parts)) >= least:
        g.flush("\n\n", 0)
    return g.out


def _places(text: str, mark: str) -> list[int]:
    return [m.start() for m in re.finditer(mark, text)]


def _cut_at(text: str, starts_and_ends: Iterator[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Pieces between the given places, without those that hold nothing but white space."""
    return [(a, z, piece) for a, z in starts_and_ends if (piece := text[a:z].strip())]


def boundary_windows(text: str, size: int = 800, overlap: int = 100, look: int = 200) -> list[tuple[int, int, str]]:
    """Windows that end after the last sentence mark of their last ``look`` characters; ends are not clamped. Marks are
    looked up among their places, which are found once."""
    if overlap >= size - look:
        raise ValueError("overlap has to be smaller than the shortest window")
    dots, others = _places(text, r"\.\n"), _places(text, "[؟!]")

    def cuts() -> Iterator[tuple[int, int]]:
        start = 0
        while start < len(text):
            end = start + size
            if end < len(text):
                found = [at[n - 1] for at, n in ((dots, bisect_right(dots, end - 2)), (others, bisect_right(others, end - 1))) if n]
                end = max((p + 1 for p in found if p >= max(start, end - look)), default=end)
            yield start, end
            start = end - overlap if end < len(text) else end

    return _cut_at(text, cuts())


def backward_windows(text: str, size: int = 800, look: int = 100) -> list[tuple[int, int, str]]:
    """Windows without overlap that end after the nearest mark up to ``look`` characters back from where they would end."""
    marks = _places(text, r"[.\n؟]")

    def cuts() -> Iterator[tuple[int, int]]:
        start = 0
        while start < len(text):
            end = start + size
            if end < len(text) and (n := bisect_right(marks, end)) and marks[n - 1] > max(start, end - look):
                end = marks[n - 1] + 1
            yield start, end
            start = end

    return _cut_at(text, cuts())


def recursive_windows(text: str, size: int = 800, overlap: int = 150) -> list[tuple[int, int, str]]:
    """Pieces of at most ``size``, cut at the coarsest separator that the window holds; the next piece starts up to
    ``overlap`` characters before the cut, at a word."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            for mark in SEPARATORS[:-1]:
                if (at := text.rfind(mark, start + overlap + 1, end)) != -1:
                    end = at + len(mark)
                    break
        if piece := text[start:end].strip():
            out.append((start, end, piece))
        if end >= len(text):
            break
        back = max(start + 1, end - overlap)
        word = text.find(" ", back, end)
        start = word + 1 if word != -1 and overlap else max(start + 1, end - overlap)
    return out


STRATEGIES: dict[str, Callable[[str], list[tuple[int, int, str]]]] = {
    "sentence_window": sentence_windows,
    "sentence": sentence_groups,
    "paragraph": paragraph_groups,
    "hybrid": paragraph_groups,
    "boundary": boundary_windows,
    "backward": backward_windows,
    "recursive": recursive_windows,
}


def chunk_rows(docs: DataFrame, strategy: str, key: str = "doc_id", text: str = "text", least: int = 0) -> DataFrame:
    """key, chunk_number (from 1), start, end, text by a named strategy; texts shorter than ``least`` give none."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}: one of {', '.join(STRATEGIES)}")
    cut = STRATEGIES[strategy]
    small_batches(docs.sparkSession, TEXT_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, n, *c) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t and len(t.strip()) >= least for n, c in enumerate(cut(t), 1)]
            kinds = (b.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [key, "chunk_number", "start", "end", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, chunk_number long, {PIECES}")


def book_chunks(docs: DataFrame, strategy: str = "hybrid", least: int = 200) -> DataFrame:
    """The 15 fields of a book chunk, from doc_id, clean_text, title, url, language, content_type."""
    rows = chunk_rows(docs, strategy, "doc_id", "clean_text", least)
    totals = rows.withColumn("n", F.max("chunk_number").over(_by_doc()))
    extra = [c for c in ("title", "url", "language", "content_type") if c in docs.columns]
    out = totals.select(
        F.format_string("%s_chunk_%04d", F.col("doc_id").cast("string"), "chunk_number").alias("chunk_id"), "doc_id", "chunk_number", "text",
        F.length("text").alias("text_length"), F.length("text").alias("char_count"), F.size(F.split(strip(F.col("text")), r"(?U)\s+")).alias("word_count"),
        F.col("start").alias("start_position"), F.col("end").alias("end_position"), (F.col("chunk_number") > 1).alias("overlap_with_previous"), (F.col("chunk_number") < F.col("n")).alias("overlap_with_next"),
    )
    return out.join(docs.select("doc_id", *extra).dropDuplicates(["doc_id"]), "doc_id", "left")


def _by_doc():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id")


def compare_strategies(docs: DataFrame, strategies: list[str], first: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """strategy, n_chunks, avg_size over whole texts, or over the first ``first`` characters of each as a sample."""
    rows = docs.select(key, (F.col(text) if first is None else F.substring(text, 1, first)).alias("text"))
    parts = [chunk_rows(rows, s, key).groupBy().agg(F.count("*").alias("n_chunks"), F.avg(F.length("text")).alias("avg_size")).select(F.lit(s).alias("strategy"), "*") for s in strategies]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

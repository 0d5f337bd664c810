"""Operator 3, benchmark decontamination by a positional inverted index (DataFrame functions only).

The index stores, for each training document, the positions of every term that the test items use; it is partitioned
by document block, as the scan is, so that building it moves nothing. Phrase search takes the two rarest terms of
each window of 13 item words, turns their postings into alignments (document, item, position minus offset), keeps those
that both show, and intersects them with the offset-adjusted postings of the item's other terms; 13 offsets in a row
are an exact match. Proximity
search intersects the postings of two terms within a distance.

A document is keyed by its id and the hash of its text, so that rows that share an id stay apart; rows equal in both
are one document and give equal rows. A null or empty text has no words; a text of any length is indexed whole, a row for
each posting. Items without an id or words are not searched; an empty benchmark leaves every document clean, and an
empty table of documents gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import ascii_lower, id_of, key_of, stash, text_of

#: Fixed value: a word is a run of characters outside these.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
END = ""  # the term of the posting that ends every document; its position is the number of words


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), WORD_BREAK), "")


def item_terms(items: DataFrame) -> DataFrame:
    """item, ik (one for each row), o (offset), t, n (the item's words)."""
    rows = items.where("item_id is not null").select(
        F.col("item_id").cast("string").alias("item"), F.xxhash64(F.col("item_id"), text_of()).alias("ik"), words(text_of()).alias("w")
    )
    return rows.dropDuplicates(["item", "ik"]).select("item", "ik", F.size("w").alias("n"), F.posexplode("w").alias("o", "t"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (d, h, pos, t) of the terms in ``terms.t``, and one END posting for each document."""
    kept = terms.select("t").union(terms.sparkSession.range(1).select(F.lit(END).alias("t"))).distinct()
    tokens = docs.select(key_of("doc_id").alias("d"), F.xxhash64(text_of()).alias("h"), F.posexplode(F.concat(words(text_of()), F.array(F.lit(END)))).alias("pos", "t"))
    return stash(tokens.join(stash(kept, "terms"), "t").select("d", "h", "pos", "t"), "postings")


def rarest_of_windows(terms: DataFrame, postings: DataFrame, window: int = WINDOW) -> DataFrame:
    """The two rarest terms of each window, by occurrences in the corpus: distinct (ik, o, t, need). Windows with a term
    that the corpus lacks are left out. need: how many of an item's terms an alignment has to show (1 or 2)."""
    counts = postings.where(F.col("t") != END).groupBy("t").count()
    span = Window.partitionBy("ik").orderBy("o").rowsBetween(0, window - 1)
    term = F.struct(F.coalesce("count", F.lit(0)).alias("c"), F.col("t").alias("t"), F.col("o").alias("o"))
    starts = terms.join(counts, "t", "left").withColumn("r", F.slice(F.sort_array(F.collect_list(term).over(span)), 1, 2))
    starts = starts.where(F.col("o") <= F.greatest(F.col("n") - window, F.lit(0))).where("r[0].c > 0")
    return starts.select("ik", F.least("n", F.lit(2)).alias("need"), F.explode("r").alias("r")).select("ik", "r.o", "r.t", "need").distinct()


def phrase_hits(postings: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """Exact matches of any window: (d, h, pos, item), one row for each document word and item that hits it."""
    seeds = stash(rarest_of_windows(terms, postings, window), "seeds")
    marks = F.bit_count(F.bit_or(F.expr("shiftleft(1L, o % 63)")))  # the two terms of one window never share a bit
    shown = postings.join(seeds, "t").groupBy("d", "h", "ik", (F.col("pos") - F.col("o")).alias("at")).agg(marks.alias("shown"), F.max("need").alias("need"))
    found = stash(shown.where("shown >= need").select("d", "h", "ik", "at"), "alignments")
    near = postings.where(F.col("t") != END).join(stash(found.select("d", "h").distinct(), "aligned-docs"), ["d", "h"], "left_semi")
    wanted = found.join(terms, "ik").select("d", "h", (F.col("at") + F.col("o")).alias("pos"), "t", "ik", "item", "o", "n", "at")
    both = near.join(wanted, ["d", "h", "pos", "t"]).distinct()
    line = Window.partitionBy("d", "h", "ik", "at").orderBy("o")
    runs = both.withColumn("run", F.col("o") - F.row_number().over(line))
    whole = Window.partitionBy("d", "h", "ik", "at", "run")
    return runs.withColumn("len", F.count("*").over(whole)).where(F.col("len") >= F.least(F.col("n"), F.lit(window))).select("d", "h", "pos", "item").distinct()


def proximity(postings: DataFrame, first: str, second: str, distance: int) -> DataFrame:
    """Documents where ``second`` stands within ``distance`` words of ``first``: doc_id, pos_first, pos_second."""
    a = postings.where(F.col("t") == first).select("d", "h", F.col("pos").alias("pos_first"))
    b = postings.where(F.col("t") == second).select("d", "h", F.col("pos").alias("pos_second"))
    close = (F.abs(F.col("pos_first") - F.col("pos_second")) <= distance) & (F.col("pos_first") != F.col("pos_second"))
    return a.join(b, ["d", "h"]).where(close).select(id_of("d").alias("doc_id"), "pos_first", "pos_second").distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, per_hit: int = 20) -> DataFrame:
    """d, h, n_words, n_hit, n_items, items_sha256, contaminated (per_hit * n_hit >= n_words > 0) for each document row."""
    terms = stash(item_terms(items), "item-terms")
    postings = build_index(docs, terms)
    hits = stash(phrase_hits(postings, terms, window), "phrase-hits")
    count = hits.select("d", "h", "pos").distinct().groupBy("d", "h").agg(F.count("*").alias("n_hit"))
    ends = postings.where(F.col("t") == END).select("d", "h", F.col("pos").cast("long").alias("n_words"))
    found = F.coalesce(F.col("found"), F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0))
    return (
        ends.join(count.join(found_table(hits), ["d", "h"]), ["d", "h"], "left")
        .select("d", "h", "n_words", hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(found, ","), 256).alias("items_sha256"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (per_hit * F.col("n_hit") >= F.col("n_words")))
    )


def found_table(hits: DataFrame) -> DataFrame:
    """Sorted item ids of each document; a document holds no more of them than it has words."""
    return hits.select("d", "h", "item").distinct().groupBy("d", "h").agg(F.sort_array(F.collect_list("item")).alias("found"))


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows, all columns kept."""
    bad = contamination(docs, items).where("contaminated").select(F.col("d").alias("__d"), F.col("h").alias("__h")).distinct()
    bad = stash(bad, "contaminated").hint("shuffle_hash")  # texts are dealt out at every size
    return docs.join(bad, (key_of("doc_id") == F.col("__d")) & (F.xxhash64(text_of()) == F.col("__h")), "left_anti")

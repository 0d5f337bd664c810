"""Language detection by profiles of character trigrams, learnt from labelled texts and scored in the JVM.

A word counts with a mark at both ends. A profile is a table of the PROFILE most frequent trigrams of the training texts, each
with the logarithm of its smoothed share in each language; it is small, and texts are scored where they are read. Only a
number for each text and language moves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.scratch import stored
from .chunking import chunk_rows

#: Trigrams that a profile has at most.
PROFILE = 20_000


def _grams(word: Column) -> Column:
    """The trigrams of a marked word; a run of letters that is no word of a language may be long, and counts by its first 64."""
    marked = F.concat(F.lit("_"), F.substring(word, 1, 64), F.lit("_"))
    return F.transform(F.sequence(F.lit(1), F.length(marked) - 2), lambda i: F.substring(marked, i, F.lit(3)))


def _words(text: str) -> Column:
    return words(F.lower(F.coalesce(F.col(text), F.lit(""))))


@dataclass
class Profiles:
    """languages in order; grams: gram, shares (logarithms, one for each language)."""

    languages: list[str]
    grams: DataFrame


def learn(rows: DataFrame, text: str = "text", lang: str = "lang", most: int = PROFILE) -> Profiles:
    """Words are counted first, so that a frequent word is cut into trigrams once for each language."""
    counted = rows.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(_words(text)).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("c"))
    grams = counted.select("lang", "c", F.explode(_grams(F.col("w"))).alias("gram")).groupBy("gram", "lang").agg(F.sum("c").alias("c"))
    languages = sorted(r.lang for r in grams.select("lang").distinct().collect())
    per = grams.groupBy("gram").pivot("lang", languages).agg(F.sum("c")).fillna(0) if languages else grams.select("gram")
    total = sum((F.col(f"`{c}`") for c in languages), F.lit(0).cast("long"))
    kept = stored(per.withColumn("__n", total).orderBy(F.desc("__n"), "gram").limit(most).drop("__n"), "profile")
    sums = kept.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"`{c}`"), F.lit(0)).alias(c) for c in languages]).first()
    shares = [F.log((F.col(f"`{c}`") + 1) / F.lit(float(sums[c] + sums["n"]))) for c in languages]
    return Profiles(languages, kept.select("gram", (F.array(*shares) if shares else F.array().cast("array<double>")).alias("shares")))


def detect(rows: DataFrame, profiles: Profiles, key: str, text: str = "text") -> DataFrame:
    """key, lang, margin of each row: the language whose profile makes the text's trigrams likeliest, ties by name, and by how
    much more than the next one, for each trigram. Rows of one key count as one text; without a known trigram lang is null."""
    n = len(profiles.languages)
    grams = rows.select(key, F.explode_outer(_words(text)).alias("w")).select(key, F.explode_outer(_grams(F.col("w"))).alias("gram"))
    met = grams.join(F.broadcast(profiles.grams), "gram", "left")  # PROFILE rows at most
    sums = met.groupBy(key).agg(F.count("shares").alias("n"), *[F.sum(F.element_at("shares", i + 1)).alias(f"__{i}") for i in range(n)])
    if not n:
        return rows.select(key).distinct().select(key, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("margin"))
    ranked = F.sort_array(F.array(*[F.struct(F.col(f"__{i}").alias("s"), F.lit(-i).alias("i")) for i in range(n)]), asc=False)
    best, second = F.element_at("__r", 1), F.try_element_at(F.col("__r"), F.lit(2))
    names = F.array(*map(F.lit, profiles.languages))
    found = sums.withColumn("__r", ranked)
    known = F.col("n") > 0
    return found.select(key, F.when(known, F.element_at(names, 1 - best["i"])).alias("lang"), F.when(known, (best["s"] - F.coalesce(second["s"], best["s"])) / F.col("n")).alias("margin"))


def chunk_by_language(docs: DataFrame, strategies: dict[str | None, str], key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Chunks of each document by the strategy of its language; None is the strategy of all others. Languages without one, if
    there is no such strategy, give no chunks."""
    parts = []
    for strategy in sorted(set(strategies.values())):
        own = [name for name, s in strategies.items() if s == strategy and name is not None]
        wanted = F.col(lang).isin(own)
        if strategies.get(None) == strategy:
            wanted = wanted | F.col(lang).isNull() | ~F.col(lang).isin([name for name in strategies if name is not None])
        parts.append(chunk_rows(docs.where(wanted), strategy, key, text).withColumn("strategy", F.lit(strategy)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

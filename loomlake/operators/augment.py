"""Balancing by generation: passes of a paraphraser over the labels in need, until their quotas are met."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import stored
from .labels import balance_plan, balance_sources
from .ranks import numbered

PASSES, MOST_PER_SAMPLE = 10, 20


def reordered(rows: DataFrame, key: str, text: str, number: int) -> DataFrame:
    """The default paraphraser, which needs no model: key, generated. The lines of ``generated`` are the text with its words
    turned by a few places, other ones in each pass, and with two neighbours swapped."""
    w = T.words(F.col(text))
    n = F.size(w)

    def line(i: int):
        cut = F.pmod(F.xxhash64(F.col(key), F.lit(number), F.lit(i)), F.greatest(n - 1, F.lit(1))).cast("int") + 1
        return F.array_join(F.concat(F.slice(w, cut + 1, n), F.slice(w, 1, cut)), " ")

    return rows.select(key, F.when(n > 1, F.array_join(F.array(*[line(i) for i in range(4)]), "\n")).otherwise("").alias("generated"))


def balanced(rows: DataFrame, paraphrase: Callable[[DataFrame, str, str, int], DataFrame] = reordered, key: str = "id", text: str = "text", labels: str = "labels", passes: int = PASSES, most_per_sample: int = MOST_PER_SAMPLE, target: int | None = None) -> DataFrame:
    """rows (key, text, labels) and the generated ones, with ``source`` (null for the given ones).

    Every pass asks the paraphraser for lines of the sources of the labels that are still in need, keeps the lines that
    are long enough and not the source, drops those that any earlier pass, another source or the table has already, and takes
    what the quotas and ``most_per_sample`` leave open, sources in order. New rows have the target label and the
    source's other labels in need; a new row counts for its target. Ids go on from the greatest one. Where places are equal the
    text's hash decides, not the text: samples of what rows are ordered by go to the driver. It ends when
    all quotas are met, or after ``passes``; what then is missing stays missing.
    """
    plan = stored(balance_plan(rows, labels, target), "plan")
    need = {r.label: r.needed for r in plan.where("needed > 0").collect()}  # a row for each label
    scarce = [r.label for r in plan.collect()]
    sources = balance_sources(rows, plan, key, labels)
    places = stored(sources.join(rows.select(key, text), key), "sources")
    made, old = None, stored(rows.select(F.md5(text).alias("__h")).distinct(), "hashes")
    for number in range(1, passes + 1):
        open_ = [label for label, n in need.items() if n > 0]
        if not open_:
            break
        asked = places.where(F.col("label").isin(open_))
        lines = paraphrase(asked.select(key, text).dropDuplicates([key]), key, text, number)
        new = asked.join(lines, key).withColumn("line", T.paraphrase_lines(F.col("generated"), F.col(text), most_per_sample))
        new = new.select("label", key, "place", F.posexplode("line").alias("n", "__t")).withColumn("__h", F.md5("__t")).join(old, "__h", "left_anti")
        if made is not None:
            new = new.join(made.select("__h"), "__h", "left_anti")
        # one row for each text: the least label, then the first source
        first = new.groupBy("__h").agg(F.min(F.struct("label", "place", "n", key, "__t")).alias("s")).select("__h", "s.*")
        had = made.groupBy(key, "label").agg(F.count("*").alias("had")) if made is not None else first.select(key, "label", F.lit(0).alias("had")).where("false")
        first = numbered(first, ["label", key], [F.col("n"), F.col("__h")], "own").join(had, [key, "label"], "left").where(F.col("own") + F.coalesce("had", F.lit(0)) <= most_per_sample)
        placed = numbered(first.select("label", key, "place", "n", "__t", "__h"), ["label"], [F.col("place"), F.col("n"), F.col("__h")], "made")
        quota = F.create_map(*[F.lit(x) for item in need.items() for x in item])
        taken = stored(placed.where(F.col("made") <= quota[F.col("label")]).withColumn("pass", F.lit(number)).select("label", key, "place", "n", "__t", "__h", "pass"), f"pass-{number}")
        got = {r.label: r["count"] for r in taken.groupBy("label").count().collect()}  # a row for each label
        if not got:
            continue
        need = {label: n - got.get(label, 0) for label, n in need.items()}
        made = taken if made is None else stored(made.unionByName(taken), "made")
    whole = rows.withColumn("source", F.lit(None).cast(dict(rows.dtypes)[key]))
    if made is None:
        return whole
    last = rows.agg(F.max(key)).first()[0] or 0
    new = numbered(made, [], [F.col("pass"), F.col("label"), F.col("place"), F.col("n"), F.col("__h")], "__n").join(rows.select(key, F.col(labels).alias("__l")), key)
    own = F.transform("__l", lambda v, i: F.when((i == F.col("label")) | ((v == 1) & i.isin(scarce)), 1).otherwise(0))
    new = new.select((F.col("__n") + F.lit(last)).cast(dict(rows.dtypes)[key]).alias(key), F.col("__t").alias(text), own.cast(dict(rows.dtypes)[labels]).alias(labels), F.col(key).alias("source"))
    return whole.unionByName(new, allowMissingColumns=True)

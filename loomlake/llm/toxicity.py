"""Operator 10, toxicity: Levenshtein automata intersected with a lexicon trie, and scores of the context window.

The lexicon is learned from a bounded sample of labelled rows: words, and beginnings that many different words share,
whose documents are toxic almost without exception; support is counted in families of near copies, so that a copied
document doesn't teach its words. All terms stand in one trie. A word is read once by the product of the trie with
the Levenshtein automata of all terms (distance 1 for words of ``FUZZY_FROM`` letters or more); its states are sets
of (node, edits), made when first needed, and most words die after a few letters.

Each match has the term's weight, its distance, whether it is quoted, and the weight of the other matches among the
``WINDOW`` words around it. A logistic model over sums of these tells abuse from quotation. Null texts are scored as
empty; without labels of both kinds the score is the share of toxic labels, or 0. Labels, lang, source and doc_id are
never inputs. The label of an id is the mean of its labels, rounded up from a half. Repeated rows are learnt from once
and each scored; very long texts are read whole; an empty table gives no rows; a null id has a score and is not held
out; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import stash, text_batches
from .bpe import Memo
from .quality import fold, labelled_sample, training_labels

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
MAX_TOXIC, MAX_CLEAN = 4000, 4000
MAX_TERMS = 2000
FUZZY_FROM = 5
BEGINNINGS = (4, 5, 6)
WINDOW = 6
#: A term stands in this share of the toxic families at least, but in no more than MOST_FAMILIES of them need it stand:
#: so many are not toxic by chance, whatever the sample's size.
LEAST_SHARE, LEAST_FAMILIES, MOST_FAMILIES = 0.01, 4, 24
WORD = re.compile(r"[^\W_]+")
QUOTES = "\"'“”„«»‘’`"


class LexiconAutomaton:
    """terms: {term: weight}; a term that ends with * stands for all words that begin so."""

    def __init__(self, terms: dict[str, float]):
        self.weights = terms
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.begins: list[str | None] = [None]
        self.fuzzy: list[bool] = [False]
        for term in sorted(terms):
            stem, begins, node = term.removesuffix("*"), term.endswith("*"), 0
            fuzzy = not begins and len(stem) >= FUZZY_FROM
            for c in stem:
                self.fuzzy[node] |= fuzzy
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.begins.append(None)
                    self.fuzzy.append(False)
                node = self.children[node][c]
            self.fuzzy[node] |= fuzzy
            (self.begins if begins else self.word)[node] = term
        self.start = self._closed({(0, 0)})
        self.moves = Memo(self._move, 1 << 18)

    def _closed(self, states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With letters of the term that the word leaves out."""
        more = {(child, 1) for node, e in states if e == 0 for child in self.children[node].values() if self.fuzzy[child]}
        whole = states | more
        return frozenset(s for s in whole if s[1] == 0 or (s[0], 0) not in whole)

    def _move(self, key: tuple[frozenset[tuple[int, int]], str]) -> frozenset[tuple[int, int]]:
        states, letter = key
        out = set()
        for node, e in states:
            if (child := self.children[node].get(letter)) is not None and (e == 0 or self.fuzzy[child]):
                out.add((child, e))
            if e == 0 and self.fuzzy[node]:
                out.add((node, 1))  # one letter too many
                out.update((child, 1) for child in self.children[node].values() if self.fuzzy[child])  # another letter
        return self._closed(out)

    def match(self, word: str) -> tuple[str, int] | None:
        """The term and its distance; the exact ones first."""
        states = self.start
        for letter in word:
            states = self.moves[states, letter]
            if not states:
                return None
            for node, e in states:
                if e == 0 and self.begins[node]:
                    return self.begins[node], 0
        ends = [(e, self.word[node]) for node, e in states if self.word[node] and (e == 0 or len(self.word[node]) >= FUZZY_FROM)]
        return min(ends)[::-1] if ends else None


N_FEATURES = 7


@dataclass
class ToxicityModel:
    terms: dict[str, float]
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def __post_init__(self):
        self.ready()

    def ready(self) -> ToxicityModel:
        self.automaton = LexiconAutomaton(self.terms)
        self.memo = Memo(self.automaton.match)
        return self

    def __getstate__(self):
        return (self.terms, self.weights, self.mean, self.scale)

    def __setstate__(self, state):
        self.terms, self.weights, self.mean, self.scale = state
        self.ready()

    def features(self, text: str | None) -> list[float]:
        return self.matches(text)[1]

    def matches(self, text: str | None) -> tuple[list[dict], list[float]]:
        """The matches (word number, term, distance, quoted, around) and the document's figures."""
        low = (text or "").lower()
        words = WORD.findall(low)
        hits = [(i, m) for i, m in enumerate(map(self.memo.__getitem__, words)) if m]
        if not hits:
            return [], [0.0] * N_FEATURES
        spans = [m.span() for m in WORD.finditer(low)]
        own = {i: self.terms[t] * (1.0 if d == 0 else 0.5) for i, (t, d) in hits}
        found = []
        for i, (term, distance) in hits:
            a, z = spans[i]
            first, last = max(0, i - WINDOW), min(len(words) - 1, i + WINDOW)
            before, after = low[spans[first][0] : a], low[z : spans[last][1] + 1]
            quoted = any(before.count(q) % 2 == 1 and q in after for q in QUOTES if q not in "'“”„«»‘’") or (before.rfind("“") > before.rfind("”") and "”" in after) or (before.rfind("«") > before.rfind("»") and "»" in after)
            around = sum(own.get(j, 0.0) for j in range(first, last + 1)) - own[i]
            found.append({"word": i, "term": term, "distance": distance, "quoted": bool(quoted), "around": around, "weight": own[i]})
        sums = {(d, q): sum(f["weight"] for f in found if f["distance"] == d and f["quoted"] == q) for d in (0, 1) for q in (False, True)}
        far = math.log1p(len(words))
        plain = sums[0, False]
        figures = [math.log1p(plain), float(plain > 0), math.log1p(sums[1, False]), math.log1p(sums[0, True] + sums[1, True]), max(f["around"] + f["weight"] for f in found if not f["quoted"]) if any(not f["quoted"] for f in found) else 0.0, len({f["term"] for f in found if f["distance"] == 0}), sum(own.values()) / (1 + far)]
        return found, figures

    def score(self, text: str | None) -> float:
        x = (np.array(self.features(text)) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(self.weights[0] + x @ self.weights[1:], -35, 35))))


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps."""
    one = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(one.shape[1]), np.full(one.shape[1], ridge)
    keep[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -35, 35)))
        step = np.linalg.solve((one * (p * (1 - p))[:, None]).T @ one + np.diag(keep), one.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int) -> DataFrame:
    known = training_labels(labels, "toxic", FOLDS, HELD_OUT)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    toxic, clean = (labelled_sample(narrow, known.where(F.col("__label") == mark), most) for mark, most in ((1, most_toxic), (0, most_clean)))
    return toxic.unionByName(clean).select("text", "__label")


def learn_lexicon(sample: DataFrame, most_terms: int = MAX_TERMS) -> dict[str, float]:
    """sample: text, __label. Term weights in (0, 1]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = WORD.findall((text or "").lower())
                runs = {xxhash.xxh3_64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))}
                family = min(runs) >> 1
                for w in set(words):
                    out.append((w, w, family, label))
                    out.extend((w[:n] + "*", w, family, label) for n in BEGINNINGS if len(w) > n)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64(), pa.int32()))], ["term", "word", "family", "label"])

    terms = sample.mapInArrow(run, "term string, word string, family long, label int")
    toxic, clean = F.when(F.col("label") == 1, F.col("family")), F.when(F.col("label") == 0, F.col("family"))
    counts = terms.groupBy("term").agg(F.approx_count_distinct(toxic, 0.02).alias("t"), F.approx_count_distinct(clean, 0.02).alias("c"), F.approx_count_distinct("word", 0.02).alias("w"))
    families = sample.where("__label = 1").count()  # bounded by the sample
    least = max(LEAST_FAMILIES, min(MOST_FAMILIES, math.ceil(LEAST_SHARE * families)))
    good = counts.where(f"t >= {least} and t >= 25 * c and (term not like '%*' or w >= 5)")
    rows = good.orderBy(F.desc("t"), "term").limit(4 * most_terms).collect()  # a bounded list
    chosen: dict[str, float] = {}
    beginnings: set[str] = set()
    for r in sorted(rows, key=lambda r: (not r.term.endswith("*"), len(r.term), r.term)):
        stem = r.term.removesuffix("*")
        if r.term.endswith("*"):
            if any(stem[:n] in beginnings for n in range(1, len(stem))):
                continue
            beginnings.add(stem)  # the words under it stay, so that misspelt beginnings are found
        chosen[r.term] = round(1 - 1 / (1 + r.t), 6)
        if len(chosen) >= most_terms:
            break
    return chosen


def fit(docs: DataFrame, labels: DataFrame, most_toxic: int = MAX_TOXIC, most_clean: int = MAX_CLEAN) -> ToxicityModel:
    text_batches(docs.sparkSession)
    sample = stash(_sample(docs, labels, most_toxic, most_clean), "toxicity-sample")
    terms = learn_lexicon(sample)
    blank = ToxicityModel(terms, np.zeros(N_FEATURES + 1), np.zeros(N_FEATURES), np.ones(N_FEATURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [blank.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(rows, pa.list_(pa.float64()))], ["label", "x"])

    held = sample.mapInArrow(run, "label int, x array<double>").toPandas()  # at most most_toxic + most_clean rows
    y = held["label"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        blank.weights[0] = 35.0 if len(y) and y.min() == 1 else -35.0
        return blank
    x = np.stack(held["x"].to_numpy())
    shares = training_labels(labels, "toxic", FOLDS, HELD_OUT).agg(F.avg("__label")).first()[0]
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    model = ToxicityModel(terms, np.zeros(0), x.mean(0), x.std(0) + 1e-6)
    model.weights = _regression((x - model.mean) / model.scale, y)
    share = min(max(float(shares), 1e-3), 1 - 1e-3)
    model.weights[0] += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))  # back from the sample's share
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_TERMS terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([held.value.score(t) for t in b.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    text_batches(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding undoes disguise: lower case, homoglyphs of other scripts and full-width forms become Latin letters, digits and
signs inside words become the letters that they stand for, and everything but letters and digits becomes one space.
The lexicon holds whole words and word beginnings with their log-odds, learned from labelled rows; one automaton finds
them all in one pass over a text, whatever the lexicon's size. Exception phrases cover the terms inside them: a given
list, and pairs of words with a term that the sample has in clean texts no less often than in toxic ones. Weights of the
matches are summed and normalised by length, and calibrated.

The training sample is bounded: SAMPLE_ROWS labelled rows in the order of a hash of their id and SAMPLE_BYTES bytes,
whole texts of a megabyte at most, each text once. Term counts are sums of per-task counts; only terms that pass the
support and odds thresholds reach the driver, the TERMS strongest of them (`Model.passed` is how many there were). Every
row is scored whole.

Defined cases: null and empty texts have no match; labels that are null or belong to no document are ignored; a
document with several labels counts with the largest, and so does a text that several documents have; without labels of
both classes every score is the share of toxic labels (0.5 without any); repeated rows give equal rows; a very long text
is scored whole, in time and memory in proportion to its size; an empty table gives an empty result; other columns are
ignored, and `civil` keeps them, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fold_of, logistic, probability
from .quality import sample

SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 256 << 20
#: Terms of the lexicon, documents that a term needs, and its least log-odds.
TERMS, SUPPORT, ODDS = 2_000, 6, 3.0
#: Lengths of the word beginnings that can become terms.
STEMS = (4, 5, 6, 7)
FOLDS, HELD_OUT = 5, 0
CUT = 0.5
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection")

#: Letters of other scripts that look like Latin ones, and what digits and signs stand for.
HOMOGLYPHS = dict(zip("аеорсхуіјѕһԁԛԝкмтвнαεορντικυχ", "aeopcxyijshdqwkmtbhaeopvtikux"))
SUBSTITUTES = dict(zip("0134578@$!", "oieastbasi"))
_TABLE = str.maketrans(HOMOGLYPHS | {chr(c): chr(c - 0xFEE0).lower() for c in range(0xFF01, 0xFF5F)})
_INSIDE = re.compile(r"(?:(?<=[^\W\d_])|(?<![\w@$!])(?=[^\W_]*[@$!013457]?[^\W\d_]{2}))[0134578@$!]+(?=[^\W\d_])")
_OTHER = re.compile(r"[\W_]+")
_DIGIT = re.compile(r"[0134578@$!]")


def fold(text: str) -> str:
    """Folded words, each between single spaces."""
    t = text.lower()
    if not t.isascii():
        t = t.translate(_TABLE)
    if _DIGIT.search(t):
        t = _INSIDE.sub(lambda m: "".join(SUBSTITUTES[c] for c in m[0]), t)
    return f" {_OTHER.sub(' ', t).strip()} "


@dataclass
class Model:
    terms: dict[str, float]
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0])
    intercept: float = 0.0
    exceptions: tuple[str, ...] = EXCEPTIONS
    passed: int = 0

    def automaton(self):
        """Terms as ' word ' or ' stem'; an exception as (None, its length)."""
        found = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            found.add_word(term, (weight, len(term.strip())))
        for phrase in self.exceptions:
            found.add_word(fold(phrase), (None, len(fold(phrase).strip())))
        found.make_automaton()
        return found

    def features(self, texts: list[str]) -> np.ndarray:
        if not hasattr(self, "_found"):
            self._found = self.automaton()
        out = np.zeros((len(texts), 2))
        for i, text in enumerate(texts):
            folded = fold(text)
            best: dict[int, float] = {}  # by the beginning of a word, its heaviest term
            covered: list[tuple[int, int]] = []
            for end, (weight, size) in self._found.iter(folded):
                at = end - size + (folded[end] != " ")
                if weight is None:
                    covered.append((at, at + size))
                elif weight > best.get(at, 0):
                    best[at] = weight
            total = sum(best.values()) if not covered else _outside(best, covered)
            words = folded.count(" ") - 1
            out[i] = np.log1p(total), np.log1p(100 * total / (words + 50))
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return probability(self.features(texts), self.weights, self.intercept)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_found"}


def _outside(best: dict[int, float], covered: list[tuple[int, int]]) -> float:
    """The sum of the weights at places in none of the spans; both are swept once."""
    spans = sorted(covered)
    total, reach, i = 0.0, -1, 0
    for at in sorted(best):
        while i < len(spans) and spans[i][0] <= at:
            reach = max(reach, spans[i][1])
            i += 1
        total += best[at] * (at >= reach)
    return total


def candidates(text: str) -> set[str]:
    """The possible terms of a text: ' word ' and ' stem'."""
    words = set(fold(text).split())
    return {f" {w} " for w in words if 2 < len(w) < 32} | {f" {w[:n]}" for w in words for n in STEMS if len(w) > n}


def phrases(text: str, terms: dict[str, float]) -> set[str]:
    """The pairs of neighbouring words of a text that hold a term."""
    words = fold(text).split()
    hits = [i for i, w in enumerate(words) if f" {w} " in terms or any(f" {w[:n]}" in terms for n in STEMS if len(w) > n)]
    return {" ".join(words[a : a + 2]) for i in hits for a in (i - 1, i) if 0 <= a < len(words) - 1}


def _count(of):
    """Rows (text, label) to (term, label, n): the texts of each label that hold a term, where of(text) are a text's terms."""

    def run(batches):
        counts: Counter[tuple[str, int]] = Counter()

        def out():
            terms, labels = zip(*counts) if counts else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(labels, pa.int32()), pa.array(counts.values(), pa.int64())], ["term", "label", "n"])

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                counts.update((t, label) for t in of(text))
                if len(counts) > 400_000:
                    yield out()
                    counts.clear()
        yield out()

    return run


def _shorter(found: list[tuple[str, float]]) -> dict[str, float]:
    """Leaves out terms that a shorter stem among them covers with nearly the same odds."""
    kept: dict[str, float] = {}
    for term, odds in sorted(found, key=lambda x: (len(x[0]), x[0])):
        stems = [kept[s] for n in STEMS if (s := term[: n + 1]) in kept and len(s) < len(term)]
        if not stems or max(stems) < odds - 0.7:
            kept[term] = odds
    return kept


def _features(model: Model):
    def run(batches):
        for batch in batches:
            x = model.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column("label")], ["total", "rate", "label"])

    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    s = Scratch(spark, "toxicity")
    picked = s.write(sample(s, docs, labels, label_col, lambda c: fold_of(c, FOLDS) != HELD_OUT, SAMPLE_ROWS, SAMPLE_BYTES, id_col, text_col), "sample")
    sizes = dict(picked.groupBy("label").count().collect())
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        s.keep()
        share = min(max(pos / (pos + neg), 1e-6), 1 - 1e-6) if pos + neg else 0.5
        return Model({}, intercept=float(np.log(share / (1 - share))))
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("q") + 0.5) / (neg + 1))

    def counted(of) -> DataFrame:
        n = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
        return picked.mapInArrow(_count(of), "term string, label int, n long").groupBy("term").agg(n(1).alias("p"), n(0).alias("q")).withColumn("odds", odds)

    found = s.write(counted(candidates).filter((F.col("p") >= SUPPORT) & (F.col("odds") >= ODDS)), "terms")
    best = found.orderBy(F.desc(F.col("odds") * F.sqrt("p")), "term").limit(TERMS)
    terms = _shorter([(r.term, r.odds) for r in best.collect()])
    clean = counted(lambda text: phrases(text, terms)).filter((F.col("q") >= SUPPORT) & (F.col("odds") <= 0))
    clean = clean.orderBy(F.desc("q"), "term").limit(TERMS).collect()
    model = Model(terms, exceptions=(*EXCEPTIONS, *(r.term for r in clean)), passed=found.count())
    x = np.array(picked.mapInArrow(_features(model), "total double, rate double, label int").collect(), dtype=float)
    model.weights, model.intercept = logistic(x[:, :2], x[:, 2])
    s.keep()
    return model


def _scorer(model: Model):
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for lo in range(0, len(texts), 512):
                score = model.scores([t or "" for t in texts.slice(lo, 512).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, 512), pa.array(score)], ["id", "score"])

    return run


def scored(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, held_out, score, predicted of every row of docs; one scan, no shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_scorer(model), "id long, score double")
    held = F.coalesce(fold_of(F.col("id"), FOLDS) == HELD_OUT, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def civil(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the model does not reject; all columns. The score is taken beside the row, so nothing is joined."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield part.filter(pa.array(model.scores([t or "" for t in part.column(text_col).to_pylist()]) < CUT))

    return docs.mapInArrow(run, docs.schema)

"""Quality by compression: Zstandard dictionaries of good and of bad text.

Two dictionaries are trained on labelled text, one for each class. A text is compressed whole with either; the
normalised difference of the sizes, (bad - good) / (bad + good), says which class it resembles, and how far it can be
compressed at all says how much that difference means. A logistic regression on both, fitted on labelled rows that
the dictionaries have not seen, turns them into a calibrated score. That is done twice, with the two halves of the
sample in either part, and the mean counts, which depends less on the order of the sample than either.

The training sample is bounded: SAMPLE_ROWS labelled rows in the order of a hash of their id, of which SAMPLE_BYTES
bytes are used at most (whole texts of TEXT_BYTES at most; each text once). Everything else covers all rows.

Defined cases: null and empty texts get a score like any other, that of an empty string; labels that are null or that
belong to no document are ignored; a document with several labels counts with the largest, and so does a text that
several documents have; without labels of both classes every score is the share of good labels, or 0.5 without any;
rows that repeat give equal rows; a very long text is scored whole, in memory of a few times its size, but not learned
from; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fold_of, logistic, probability

SAMPLE_ROWS, SAMPLE_BYTES, TEXT_BYTES = 8_000, 32 << 20, 1 << 20
DICTIONARY_BYTES, LEVEL = 1 << 16, 3
FOLDS, HELD_OUT = 4, 2
CUT = 0.7


@dataclass
class Pair:
    """The dictionaries of both classes, and the calibration of what they tell."""

    good: bytes
    bad: bytes
    weights: list[float] = field(default_factory=lambda: [0.0] * 5)
    intercept: float = 0.0

    def features(self, texts: list[bytes]) -> np.ndarray:
        if not hasattr(self, "_by"):
            self._by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(d), write_content_size=False, write_dict_id=False) for d in (self.good, self.bad)]
        sizes = np.array([[len(t), *(len(c.compress(t)) for c in self._by)] for t in texts], dtype=float).reshape(-1, 3)
        n, good, bad = sizes.T
        lean, rate = (bad - good) / (bad + good), good / (n + 20)
        return np.stack([lean, rate, lean * rate, rate * rate, lean * lean], 1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return probability(self.features(texts), self.weights, self.intercept)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_by"}


@dataclass
class Model:
    pairs: list[Pair]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.mean([p.scores(texts) for p in self.pairs], axis=0)


def _dictionary(data: bytes):
    found = zstandard.ZstdCompressionDict(data)
    found.precompute_compress(level=LEVEL)
    return found


def _trained(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few or too alike to train one."""
    try:
        return zstandard.train_dictionary(max(256, min(DICTIONARY_BYTES, sum(map(len, samples)) // 4)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def sample(s: Scratch, docs: DataFrame, labels: DataFrame, label_col: str, training, rows: int, most: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text, label) of labelled training rows in the order of a hash of their ids, each text once, whatever the
    partitions: `rows` of them and `most` bytes at most. Rows are picked by ids and sizes before texts move."""
    marked = labels.select(F.col(id_col).alias("of"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isNotNull() & training(F.col("of")))
    marked = marked.groupBy("of").agg(F.max("label").alias("label")).orderBy(F.xxhash64("of"), "of").limit(rows)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.octet_length(text_col) <= TEXT_BYTES)
    found = s.write(found.join(F.broadcast(marked), F.col("id") == F.col("of")).select("id", "text", "label", F.sha2(F.col("text").cast("binary"), 256).alias("digest")), "labelled")
    each = found.groupBy("digest").agg(F.min("id").alias("id"), F.max("label").alias("label"), F.max(F.octet_length("text")).alias("size"))
    first = each.orderBy(F.xxhash64("id"), "id", "digest").limit(rows)
    sofar = F.sum("size").over(Window.orderBy(F.xxhash64("id"), "id", "digest").rowsBetween(Window.unboundedPreceding, 0))  # `rows` rows at most, without texts
    picked = first.withColumn("sofar", sofar).filter(F.col("sofar") <= most).select("digest", "label")
    return found.drop("label").join(F.broadcast(picked), "digest").groupBy("digest", "label").agg(F.min("id").alias("id"), F.any_value("text").alias("text")).select("id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    s = Scratch(docs.sparkSession, "quality")
    picked = sample(s, docs, labels, label_col, lambda c: fold_of(c, FOLDS) != HELD_OUT, SAMPLE_ROWS, SAMPLE_BYTES, id_col, text_col)
    rows = sorted(picked.collect(), key=lambda r: (zlib.crc32(str(r.id).encode()), r.id, r.text))  # SAMPLE_BYTES at most
    s.keep()
    texts, y = [r.text.encode() for r in rows], np.array([r.label for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        share = min(max(y.mean(), 1e-6), 1 - 1e-6) if len(y) else 0.5
        return Model([Pair(b"", b"", intercept=float(np.log(share / (1 - share))))])
    half = np.zeros(len(y), bool)
    for c in (0, 1):
        half[np.flatnonzero(y == c)[::2]] = True
    model = Model([])
    for seen in (half, ~half):
        pair = Pair(*(_trained([t for t, s, c in zip(texts, seen, y) if s and c == k]) for k in (1, 0)))
        rest = ~seen if len(set(y[~seen])) == 2 else np.ones(len(y), bool)
        pair.weights, pair.intercept = logistic(pair.features([t for t, r in zip(texts, rest) if r]), y[rest])
        model.pairs.append(pair)
    return model


def _scorer(model: Model):
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for lo in range(0, len(texts), 512):
                part = [(t or "").encode() for t in texts.slice(lo, 512).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, 512), pa.array(model.scores(part))], ["id", "score"])

    return run


def scored(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, held_out, score, predicted of every row of docs; one scan, no shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_scorer(model), "id long, score double")
    held = F.coalesce(fold_of(F.col("id"), FOLDS) == HELD_OUT, F.lit(False))
    return out.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))

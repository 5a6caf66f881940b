"""Shared parts of the training-data operators: scratch tables, vectorised word hashing, connected components."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.plans.scratch import Scratch

#: Bytes of text that one vectorised step handles; longer single texts are handled alone.
SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII punctuation besides white space, for texts whose words are to be compared without it.
_PUNCT = _SPACE.copy()
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Odd multipliers of the words of a run, one for each place, so that no structure of the run cancels out.
_PLACES = np.random.default_rng(20240601).integers(0, 1 << 64, 128, dtype=np.uint64) | np.uint64(1)
#: Bytes of the longest word that is hashed eight bytes at a time; longer ones go through BLAKE2b.
_LONG = 64


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- words ----------------------------------------------------------------------------------------


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the published splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges. Words of up to seven bytes are mapped one to one; longer ones are mixed eight bytes at
    a time, so that no combination of bytes cancels another, and very long ones are BLAKE2b digests."""
    size = end - start
    octets = np.lib.stride_tricks.as_strided(padded := np.r_[data, np.zeros(8, np.uint8)], (len(padded) - 7, 8), (1, 1))

    def chunk(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The eight bytes from a place as a number; those past the end of the word are zero."""
        found = octets[at].view("<u8").ravel().astype(np.uint64)
        return found & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - np.minimum(left, 8))).astype(np.uint64))

    out = chunk(start, np.minimum(size, 7)) if len(start) else np.zeros(0, np.uint64)
    out = mix(out | np.minimum(size, 8).astype(np.uint64) << np.uint64(56))
    rest = np.flatnonzero(size > 7)
    state, at = mix(size[rest].astype(np.uint64) ^ np.uint64(0xA0761D6478BD642F)), 0
    while len(rest):
        state = mix(state ^ chunk(start[rest] + at, size[rest] - at)) + np.uint64(0x9E3779B97F4A7C15)
        out[rest] = state
        at += 8
        more = (size[rest] > at) & (size[rest] <= _LONG)
        rest, state = rest[more], state[more]
    for i in np.flatnonzero(size > _LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def run_hashes(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of runs of words, at most 128 each: words[first[i]:first[i] + size[i]]."""
    out = size.astype(np.uint64)
    for lo in range(0, len(first), 4096):
        a, n = first[lo : lo + 4096], size[lo : lo + 4096]
        places = np.arange(n.max())
        inside = places < n[:, None]
        part = words[np.where(inside, a[:, None] + places, 0)] * _PLACES[places]
        out[lo : lo + 4096] += np.where(inside, part, np.uint64(0)).sum(1, dtype=np.uint64)
    return mix(out)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each position that has as many."""
    n = max(0, len(words) - k + 1)
    acc = words[:n] * _PLACES[0]
    for j in range(1, k):
        acc += words[j : n + j] * _PLACES[j]
    return mix(acc)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a slice of texts (with bare, ASCII punctuation parts words too), as hashes, byte
    ranges and document numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, bare: bool = False):
        self.n_docs = len(offsets) - 1
        self.data = data
        solid = ~(_PUNCT if bare else _SPACE)[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        inner = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[inner] |= solid[inner]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[last] |= solid[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        #: first[d]:first[d + 1] are the words of document d
        self.first = np.searchsorted(self.doc, np.arange(self.n_docs + 1))
        self.hash = word_hashes(_LOWER[data] if lower else data, self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each position, and whether all k are of one document (arrays over positions)."""
        n = len(self.hash)
        out = np.zeros(n, dtype=np.uint64)
        ok = np.zeros(n, dtype=bool)
        if n >= k:
            out[: n - k + 1] = gram_hashes(self.hash, k)
            ok[: n - k + 1] = self.doc[: n - k + 1] == self.doc[k - 1 :]
        return out, ok

    def shingles(self, d: int, k: int, hashes: np.ndarray) -> np.ndarray:
        """Sorted distinct k-shingles of document d; of a shorter one the whole sequence; of one without words none."""
        a, b = self.first[d], self.first[d + 1]
        if b - a >= k:
            return np.unique(hashes[a : b - k + 1])
        if b == a:
            return np.zeros(0, dtype=np.uint64)
        return np.array([whole_hash(self.hash[a:b])], dtype=np.uint64)


def whole_hash(words: np.ndarray) -> np.uint64:
    """Of a whole sequence that is shorter than a shingle; salted by its length so that it equals no shingle."""
    return mix(run_hashes(words, np.zeros(1, np.int64), np.array([len(words)])) ^ np.uint64(0xA0761D6478BD642F))[0]


def text_slices(texts: pa.Array, lower: bool, size: int = SLICE_BYTES, bare: bool = False):
    """Yields (first row, Words) over slices of about `size` bytes; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None and body.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        a, b = offsets[row], offsets[stop]
        yield row, Words(data[a:b], offsets[row : stop + 1] - a, lower, bare)
        row = stop


def word_count(col) -> F.Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, on the JVM; null counts as 0."""
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


# --- joins and components -------------------------------------------------------------------------

#: Rows of ids up to which a side is broadcast, beyond which the join shuffles: 25 MB, at the 100 bytes or less that Spark
#: holds for a key of two numbers.
BROADCAST_IDS = 250_000
#: Edges of one node up to which a single task may join them (1.6 MB).
SPLIT = 100_000


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids (one column, distinct). The ids are broadcast only below a counted size."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, key, "left_semi")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def repeats(keys: DataFrame, key: str) -> bool:
    """Whether a key occurs twice; null does not count."""
    return not keys.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected edges (a, b) of long ids.

    Alternating large-star and small-star rounds until only stars are left: every round is two aggregations and two
    joins over the edges and one written table, and the number of rounds grows with the logarithm of the longest path.
    Aggregations are partial, so a node with many edges costs one row a task. Where a node has more than SPLIT edges,
    minima are written before they are joined, so that Spark may split that node's edges over tasks. Nothing is
    collected but a number per round.
    """
    now = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        most = both.groupBy("u").count().agg(F.max("count")).first()[0] or 0
        keep = scratch.write if most > SPLIT else lambda df, name: df
        least = keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = keep(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        parent = keep(large.groupBy("u").agg(F.min("v").alias("m")), "parent")
        small = large.join(parent, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = scratch.write(small.filter("u <> v").distinct(), "stars")
        for done in (now, least, large, parent):
            scratch.drop(done)
        now = after
        # Only stars are left when no node has two parents and no parent has one.
        if now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and now.groupBy("u").count().filter("count > 1").isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def buckets(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


# --- labels and calibration -----------------------------------------------------------------------


def fold_of(ident, folds: int) -> F.Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(ident.cast("string").cast("binary")) % folds


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[list[float], float]:
    """Weights and intercept of a ridge logistic regression on raw features; Newton steps, halved until they improve."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    pull = np.r_[np.full(x.shape[1], ridge), 1e-6]
    w = np.zeros(z.shape[1])
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (z @ w)).sum() + 0.5 * (pull * w * w).sum()
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(pull), z.T @ (y - p) - pull * w)
        while (new := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w, change, now = w + step, now - new, new
        if change < 1e-9 * max(1.0, now):
            break
    raw = w[:-1] / scale
    return raw.tolist(), float(w[-1] - (raw * mean).sum())


def probability(x: np.ndarray, weights: list[float], intercept: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.array(weights) + intercept, -35, 35)))

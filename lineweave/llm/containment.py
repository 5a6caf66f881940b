"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingle sets.

A test item with n word shingles is sketched by its m = n - ceil(T * n) + 1 smallest shingle hashes. A document that
holds a share of T or more of the item's shingles lacks at most m - 1 of them, so it holds one of the sketch: the
search loses no document, however long it is and wherever in it the item's parts stand. Items are partitioned by size
(by the power of two below n); a document is only held against partitions whose items it is large enough to contain.
Candidates are verified on the full shingle sets.

Documents are only streamed. What is broadcast is the items' index, whose size is counted first: beyond INDEX_TOKENS
shingles the items are dealt into as many rounds as it takes, one broadcast each.

Words are runs of anything but white space and ASCII punctuation, A-Z lower-cased, so that a reset copy of an item is
still found.

Defined cases: null and empty texts and items match nothing; an item with fewer than k words is one shingle of its
whole sequence and matches where that stands contiguously; equal items match alike; repeated document rows each give
their rows; empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, buckets, mix, text_slices

K, NUM, DEN = 5, 80, 100
#: Shingles of all items of one round (8 bytes each, 32 MB).
INDEX_TOKENS = 4_000_000


def _item_rows(k: int):
    """item, width (words of its shingles), tokens (sorted distinct shingle hashes)."""

    def run(batches):
        for batch in batches:
            for row, w in text_slices(batch.column("text"), lower=True, bare=True):
                counts = w.counts()
                widths = np.minimum(counts, k)
                grams = {x: w.grams(int(x))[0] for x in np.unique(widths) if x}
                tokens = [np.unique(grams[x][a : a + n - x + 1]).view(np.int64) if x else np.zeros(0, np.int64) for x, a, n in zip(widths, w.first, counts)]
                yield pa.RecordBatch.from_arrays([batch.column("item").slice(row, len(counts)), pa.array(widths, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], ["item", "width", "tokens"])

    return run


class Index:
    """The items of one round: per width and size partition the sketch hashes with their items, and the full sets."""

    def __init__(self, items: list[tuple[int, int, np.ndarray]], num: int, den: int):
        self.items = items
        self.parts: dict[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = {}
        sized: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
        self.need = [-(-num * len(t) // den) for _, _, t in items]
        for i, (_, width, tokens) in enumerate(items):
            m = len(tokens) - self.need[i] + 1
            order = np.argsort(mix(tokens))[:m]
            sized.setdefault((width, len(tokens).bit_length()), []).append((tokens[order], i))
        for (width, size), found in sorted(sized.items()):
            hashes = np.concatenate([t for t, _ in found])
            owner = np.repeat([i for _, i in found], [len(t) for t, _ in found])
            order = np.argsort(hashes, kind="stable")
            table = np.zeros(1 << 20, dtype=bool)
            table[hashes >> np.uint64(44)] = True
            self.parts.setdefault(width, []).append((min(self.need[i] for _, i in found), hashes[order], owner[order], table))


def _matches(index: Index, texts: pa.Array):
    """Yields lists of (row, item, shingles, shared ones) over slices of texts."""
    for row, w in text_slices(texts, lower=True, bare=True):
        out: list[tuple[int, int, int, int]] = []
        for width, parts in index.parts.items():
            hashes, ok = w.grams(width)
            sizes = np.maximum(w.counts() - width + 1, 0)
            for need, keys, owner, table in parts:
                pos = np.flatnonzero(table[hashes >> np.uint64(44)] & ok)
                pos = pos[sizes[w.doc[pos]] >= need]
                lo, hi = np.searchsorted(keys, hashes[pos], "left"), np.searchsorted(keys, hashes[pos], "right")
                pairs = {(int(w.doc[p]), int(i)) for p, a, b in zip(pos, lo, hi) for i in owner[a:b]}
                sets: dict[int, np.ndarray] = {}
                for d, i in sorted(pairs):
                    if d not in sets:
                        sets = {d: np.unique(hashes[w.first[d] : w.first[d] + sizes[d]])}
                    item, _, tokens = index.items[i]
                    shared_n = len(np.intersect1d(tokens, sets[d], assume_unique=True))
                    if shared_n >= index.need[i]:
                        out.append((row + d, item, len(tokens), shared_n))
        yield out


def _searcher(shared):
    def run(batches):
        for batch in batches:
            for out in _matches(shared.value, batch.column("text")):
                if out:
                    at, item, n, m = map(list, zip(*out))
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at)), pa.array(item, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], ["id", "item", "n_shingles", "n_shared"])

    return run


def _cleaner(shared, text_col: str):
    """The rows of a batch that match nothing."""

    def run(batches):
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for out in _matches(shared.value, batch.column(text_col)):
                clean[[row for row, *_ in out]] = False
            yield batch.filter(pa.array(clean))

    return run


def _rounds(spark: SparkSession, s: Scratch, items: DataFrame, k: int, num: int, den: int, item_col: str, item_text: str, index_tokens: int):
    """Yields the broadcast indexes of the items, of about index_tokens shingles each."""
    prepared = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).mapInArrow(_item_rows(k), "item long, width int, tokens array<long>")
    prepared = s.write(prepared.filter("width > 0"), "items")
    rounds = buckets(prepared.agg(F.sum(F.size("tokens"))).first()[0] or 0, index_tokens)
    for r in range(rounds):
        part = prepared.filter(F.pmod(F.xxhash64("item", "tokens"), F.lit(rounds)) == r).orderBy("item").collect()  # about index_tokens shingles
        index = Index([(x.item, x.width, np.array(x.tokens, np.int64).view(np.uint64)) for x in part], num, den)
        yield spark.sparkContext.broadcast(index)


def contained(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = K, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", index_tokens: int = INDEX_TOKENS) -> DataFrame:
    """One row per document and item with den * |item ∩ document| >= num * |item| shingles:
    <id_col>, <item_col>, n_shingles (of the item), n_shared, containment."""
    s = Scratch(spark, "containment")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "id long, item long, n_shingles long, n_shared long"
    found = spark.createDataFrame([], schema)
    for index in _rounds(spark, s, items, k, num, den, item_col, item_text, index_tokens):
        found = found.union(rows.mapInArrow(_searcher(index), schema))
    s.keep()
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def clean_of(spark: SparkSession, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", index_tokens: int = INDEX_TOKENS) -> DataFrame:
    """The rows of docs that contain no item; all columns. It is decided beside the row, so ids do not matter. Between
    two rounds the rows are written, so that a task holds one index at a time."""
    s = Scratch(spark, "clean")
    held = None
    for index in _rounds(spark, s, items, K, NUM, DEN, "item_id", "text", index_tokens):
        if held is not None:
            before, docs = docs, s.write(held, "clean")
            s.drop(before)
        held = docs.mapInArrow(_cleaner(index, text_col), docs.schema)
    s.keep(docs)
    return held


#: DuckDB twin of `contained` over documents and benchmark, for items of five words or more.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D!-/:-@\[-`{-~]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D!-/:-@\[-`{-~]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) >= 5),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_shingles::BIGINT AS n_shingles, count(*)::BIGINT AS n_shared, count(*) / n_shingles AS containment
FROM bs JOIN ds USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING 100 * count(*) >= 80 * n_shingles
"""

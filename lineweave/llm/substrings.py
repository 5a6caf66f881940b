"""Substring dedup: words covered by a window of W consecutive words that also starts anywhere else are removed.

Suffix automata of bounded reference shards find the repeats by matching statistics. Which texts can share a window
is known from anchors: the anchor of a window is its smallest hash of K consecutive words, so equal windows have
equal anchors at equal places, and consecutive windows mostly share one. A piece is a run of consecutive windows of one
document with one anchor (at most W - K + 1 of them). All pieces of an anchor are one shard:

1. a scan emits each document's pieces (about 2 / (W - K + 2) of its words) and the digest of its words;
2. anchors that occur once are dropped; where all pieces of an anchor are equal, all its windows repeat;
3. of the other anchors, the distinct pieces, each once with its count, become a generalised suffix automaton that the
   same pieces are streamed through: a window repeats if its state has two or more occurrences;
4. a shard of more than SHARD distinct pieces is divided into smaller ones: windows that hold the anchor at places of one
   range are a part of a piece, and share a core, longer the shorter the range; equal windows are in parts of equal
   cores. All parts of a core are one shard, for which 2 to 4 hold in turn, up to ranges of one place.

The named method broadcasts the automata. Here every document is reference and query at once, which has no size
bound, so shards travel by shuffle to the pieces that they can match, and nothing is broadcast but checked lists of
document keys.

Defined cases: null, empty and short texts (fewer than W words) lose nothing; a null text has no words, and its digest
is that of the empty text; repeated rows are different documents, so all their windows repeat, whatever their ids; a very long text
is worked on whole, in one task, in memory of some 50 bytes for each of its words; other columns are ignored, whatever
their names. Words are compared as 64-bit hashes (one to one for words of up to seven bytes), windows as sequences of
those, pieces by the hash of their words under one anchor, and rows by 128 bits of their id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, fresh, gram_hashes, mix, only_ids, repeats, run_hashes, text_slices

W = 35
K = 8
#: Distinct pieces, or parts of pieces, of one shard: 24,000 words, some 20 MB of automaton, at most.
SHARD = 512

#: What tells rows apart: two hashes of id and text.
KEY = "struct<a: bigint, b: bigint>"


def key_of(ident: str, text: str) -> Column:
    return F.struct(F.xxhash64(ident, text).alias("a"), F.xxhash64(F.lit(1), ident, text).alias("b"))


class Automaton:
    """A generalised suffix automaton over words, with the number of occurrences of each state."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, word: int) -> int:
        """The state of p followed by word, as its longest string: split off if it also stands for longer ones."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int], times: int) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._split(last, word)
            else:
                new = self._state(self.length[last] + 1, 0, {})
                p = last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, word)
                last = new
            self.count[last] += times

    def close(self) -> None:
        """Adds up occurrences: a string also occurs wherever a longer one that ends in it does."""
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def repeated(self, words: list[int], window: int) -> list[bool]:
        """Streams words of a text that was added: whether each window occurs twice or more."""
        v, out = 0, []
        for i, word in enumerate(words):
            v = self.next[v][word]
            while self.length[self.link[v]] >= window:
                v = self.link[v]
            if i + 1 >= window:
                out.append(self.count[v] >= 2)
        return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def pieces(w: Words, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(document, anchor, piece hash, first word within the document, number of windows) of a slice's pieces."""
    n = len(w.hash)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    grams, _ = w.grams(k)
    anchor = _least(grams[: n - k + 1], window - k + 1)
    ok = w.doc[: n - window + 1] == w.doc[window - 1 :]
    doc = w.doc[: n - window + 1]
    # The anchor's place, the first in the window, so that a k-gram that occurs twice close by makes two pieces.
    at = np.flatnonzero(ok)
    if not len(at):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    place = _first_place(grams[: n - k + 1], anchor, window - k + 1)
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (place[at[1:]] != place[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])]
    first = at[new]
    count = np.diff(np.r_[np.flatnonzero(new), len(at)])
    piece = run_hashes(w.hash, first, count + window - 1)
    return doc[first], anchor[first], piece, first - w.first[doc[first]], count


def _first_place(grams: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Index of the first of `width` values from each position that equals their minimum."""
    n = len(least)
    place = np.full(n, -1, np.int64)
    open_ = np.arange(n)
    for step in range(width):
        hit = grams[open_ + step] == least[open_]
        place[open_[hit]] = open_[hit] + step
        open_ = open_[~hit]
        if not len(open_):
            break
    return place


def joined(text: str | None) -> bytes:
    """The words of a text, joined by one space (bytes.split() parts at exactly \\x20 and \\x09-\\x0D)."""
    return b" ".join((text or "").encode().split())


SCANNED = f"key {KEY}, n_words long, digest string, pieces array<struct<anchor: long, piece: long, at: int, windows: int>>"


def _scan(window: int, k: int):
    def run(batches):
        for batch in batches:
            keys, texts = batch.column("key"), batch.column("text")
            for row, w in text_slices(texts, lower=False):
                doc, anchor, piece, at, count = pieces(w, window, k)
                offsets = np.searchsorted(doc, np.arange(w.n_docs + 1))
                struct = pa.StructArray.from_arrays([pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(at, pa.int32()), pa.array(count, pa.int32())], ["anchor", "piece", "at", "windows"])
                digests = [hashlib.sha256(joined(t)).hexdigest() for t in texts.slice(row, w.n_docs).to_pylist()]
                yield pa.RecordBatch.from_arrays([keys.slice(row, w.n_docs), pa.array(w.counts()), pa.array(digests), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)], ["key", "n_words", "digest", "pieces"])

    return run


def _nested(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets by row, and the fields, of a column of structs in arrays; no Python object for each of them."""
    lists = batch.column(column)
    flat = lists.flatten()
    return lists.offsets.to_numpy() - lists.offsets[0].as_py(), {f.name: flat.field(f.name).to_numpy() for f in flat.type}


#: Places that one vectorised step cuts out or marks.
STEP = 8192


def _cut(window: int):
    """Rows (key, text, places) to the words of each place: anchor, piece, times, words."""

    def run(batches):
        for batch in batches:
            offsets, places = _nested(batch, "places")
            for row, w in text_slices(batch.column("text"), lower=False):
                lo, hi = offsets[row], offsets[row + w.n_docs]
                doc = np.repeat(np.arange(w.n_docs), np.diff(offsets[row : row + w.n_docs + 1]))
                for a in range(lo, hi, STEP):
                    part = slice(a, min(a + STEP, hi))
                    size = places["windows"][part] + window - 1
                    ends = np.cumsum(size)
                    start = w.first[doc[a - lo : part.stop - lo]] + places["at"][part]
                    words = w.hash[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(words.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([*(pa.array(places[c][part]) for c in ("anchor", "piece", "times")), lists], ["anchor", "piece", "times", "words"])

    return run


PARTS = "anchor long, piece long, times long, lo int, place int, core long, part long, words array<long>"


def _divide(window: int, k: int, width: int):
    """Pieces, or parts of wider ranges with the anchor's place in them, to parts: the windows that hold the anchor at
    places of one range of `width`. `core` hashes the words that all windows of the range share, `part` the part's words;
    `lo` is the part's first window, and `place` the anchor's place in the part."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                rows = batch.slice(at, STEP)
                lists = rows.column("words")
                offsets = lists.offsets.to_numpy().astype(np.int64)
                offsets = offsets - offsets[0]
                words, size = lists.flatten().to_numpy().view(np.uint64), np.diff(offsets)
                if "place" in rows.schema.names:
                    place = rows.column("place").to_numpy().astype(np.int64)
                else:
                    hits = np.flatnonzero(gram_hashes(words, k) == np.repeat(rows.column("anchor").to_numpy().view(np.uint64), size)[: len(words) - k + 1])
                    place = hits[np.searchsorted(hits, offsets[:-1])] - offsets[:-1]
                least = place - (size - window)  # the anchor's place in the last window
                n = place // width - least // width + 1
                row = np.repeat(np.arange(len(n)), n)
                span = (place // width)[row] - (np.arange(len(row)) - (np.cumsum(n) - n)[row])
                lo = place[row] - np.minimum(place[row], span * width + width - 1)
                last = place[row] - np.maximum(least[row], span * width)
                start, length = offsets[row] + lo, last - lo + window
                core = mix(run_hashes(words, offsets[row] + place[row] - span * width, np.full(len(row), window - width + 1)) ^ mix(span.astype(np.uint64)))
                part = run_hashes(mix(words ^ np.uint64(0xA0761D6478BD642F)), start, length)
                ends = np.cumsum(length)
                held = words[np.repeat(start - (ends - length), length) + np.arange(ends[-1])]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(held.view(np.int64)))
                old = [rows.column(c).take(pa.array(row)) for c in ("anchor", "piece", "times")]
                yield pa.RecordBatch.from_arrays([*old, pa.array(lo, pa.int32()), pa.array(place[row] - lo, pa.int32()), pa.array(core.view(np.int64)), pa.array(part.view(np.int64)), lists], ["anchor", "piece", "times", "lo", "place", "core", "part", "words"])

    return run


def _match(window: int):
    """Rows sorted by anchor: one automaton for each anchor; the mask has a bit for each repeated window of a piece."""

    def of(shard: list[tuple[int, int, int, list[int]]]):
        automaton = Automaton()
        for _, _, times, words in shard:
            automaton.add(words, times)
        automaton.close()
        return [(a, p, sum(1 << i for i, x in enumerate(automaton.repeated(words, window)) if x)) for a, p, _, words in shard]

    def batch_of(rows):
        a, p, m = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(p, pa.int64()), pa.array(m, pa.int64())], ["anchor", "piece", "mask"])

    def run(batches):
        shard: list = []
        for batch in batches:
            out: list = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "piece", "times", "words"))):
                if shard and shard[0][0] != row[0]:
                    out += of(shard)
                    shard = []
                shard.append(row)
            if out:
                yield batch_of(out)
        if shard:
            yield batch_of(of(shard))

    return run


def _remove(window: int):
    """Rows (key, text, spans) to key, n_removed, kept: the words outside all repeated windows, joined by one space."""

    def run(batches):
        for batch in batches:
            offsets, spans = _nested(batch, "spans")
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = []
                for i, text in enumerate(part.column("text").to_pylist(), lo):
                    words = (text or "").encode().split()
                    edges = np.zeros(len(words) + 1, np.int32)
                    at, mask = (spans[c][offsets[i] : offsets[i + 1]] for c in ("at", "mask"))
                    for bit in range(int(mask.max()).bit_length()):
                        first = at[(mask >> bit) & 1 == 1] + bit
                        np.add.at(edges, first, 1)
                        np.add.at(edges, first + window, -1)
                    gone = np.cumsum(edges[:-1]) > 0
                    out.append((int(gone.sum()), b" ".join(x for x, g in zip(words, gone.tolist()) if not g).decode()))
                n, t = zip(*out)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(n, pa.int64()), pa.array(t)], ["key", "n_removed", "kept"])

    return run


def _masks(s: Scratch, words: DataFrame, window: int, k: int, width: int) -> DataFrame:
    """(anchor, piece, mask) from the distinct pieces of shards, whose windows hold the anchor at `width` places."""
    large = s.write(words.groupBy("anchor").count().filter((F.col("count") > SHARD) & F.lit(width > 1)).select("anchor"), "large")
    shards = words.join(large, "anchor", "left_anti").select("anchor", "piece", "times", "words").repartition("anchor").sortWithinPartitions("anchor")
    masks = shards.mapInArrow(_match(window), "anchor long, piece long, mask long")
    if large.isEmpty():
        return masks
    width = -(-width // 4)
    parts = s.write(words.join(large, "anchor", "left_semi").mapInArrow(_divide(window, k, width), PARTS), "parts")
    cores = parts.groupBy("core").agg(F.sum("times").alias("n"), F.min("part").alias("least"), F.max("part").alias("most")).filter("n > 1").select("core", (F.col("least") == F.col("most")).alias("one"))
    cores = s.write(cores, "cores")  # written first, like the anchors
    met = s.write(parts.join(cores, "core"), "parts_met")
    unlike = met.filter(~F.col("one"))
    distinct = unlike.groupBy(F.col("core").alias("anchor"), F.col("part").alias("piece")).agg(F.sum("times").alias("times"), F.first("place").alias("place"), F.first("words").alias("words"))
    within = s.write(_masks(s, s.write(distinct, "parts_distinct"), window, k, width).filter("mask <> 0"), "masks")
    found = met.filter("one").select("anchor", "piece", "lo", F.expr(f"shiftleft(1L, size(words) - {window - 1}) - 1").alias("mask"))
    found = found.unionByName(unlike.join(within.select(F.col("anchor").alias("core"), F.col("piece").alias("part"), "mask"), ["core", "part"]).select("anchor", "piece", "lo", "mask"))
    return masks.unionByName(found.groupBy("anchor", "piece").agg(F.bit_or(F.expr("shiftleft(mask, lo)")).alias("mask")))


def _repeated(s: Scratch, texts_of: Callable[[DataFrame], DataFrame], scanned: DataFrame, window: int, k: int) -> DataFrame:
    """(key, spans): the repeated windows of each document that has any, as (at, mask)."""
    every = scanned.select("key", F.explode("pieces").alias("p")).select("key", "p.*")
    anchors = every.groupBy("anchor").agg(F.count("*").alias("n"), F.min("piece").alias("lo"), F.max("piece").alias("hi")).filter("n > 1").select("anchor", (F.col("lo") == F.col("hi")).alias("one"))
    anchors = s.write(anchors, "anchors")  # written first, so that the pieces of a very common anchor can be split over tasks
    met = s.write(every.join(anchors, "anchor"), "met")

    place = F.col("at").cast("long") * 64 + F.col("windows")
    unlike = met.filter(~F.col("one"))
    distinct = s.write(unlike.groupBy("anchor", "piece").agg(F.count("*").alias("times"), F.max("key").alias("key"), F.max_by(place, "key").alias("place")), "distinct")
    places = distinct.groupBy("key").agg(F.collect_list(F.struct("anchor", "piece", "times", F.shiftright("place", 6).alias("at"), F.pmod("place", F.lit(64)).alias("windows"))).alias("places"))
    texts = texts_of(distinct.select("key").distinct())
    words = s.write(texts.join(places, "key").mapInArrow(_cut(window), "anchor long, piece long, times long, words array<long>"), "words")
    masks = _masks(s, words, window, k, window - k + 1)
    masks = masks.filter("mask <> 0")
    spans = met.filter("one").select("key", "at", (F.expr("shiftleft(1L, windows) - 1")).alias("mask"))
    spans = spans.unionByName(unlike.join(masks, ["anchor", "piece"]).select("key", "at", "mask"))
    return spans.groupBy("key").agg(F.collect_set(F.struct("at", "mask")).alias("spans"))


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = W, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: <id_col>, n_words, n_removed, kept_sha256, and kept, the remaining words joined by one
    space, or null where nothing is removed. The windows are judged on the input, not on what is left."""
    ids, facts, cut = _parts(spark, docs, window, k, id_col, text_col)
    out = ids.join(facts, "key").join(cut, "key", "left")
    digest = F.coalesce(F.sha2(F.col("kept").cast("binary"), 256), F.col("digest"))
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), digest.alias("kept_sha256"), "kept")


def _parts(spark: SparkSession, docs: DataFrame, window: int, k: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """id and key of every row; n_words and digest of every key; n_removed and kept of the keys that lose words. The key
    is of id and text, so that rows without an id or with the same one are told apart by their texts."""
    if 2 * window - k > 128:
        raise ValueError("a piece may have 128 words at most")
    s = Scratch(spark, "substrings")
    rows = docs.select(key_of(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    scanned = s.write(rows.mapInArrow(_scan(window, k), SCANNED), "scanned")
    twice = repeats(scanned, "key")  # equal rows share a key; only then are texts sorted out by it

    def texts_of(keys: DataFrame) -> DataFrame:
        found = only_ids(rows, keys, "key")
        return found.dropDuplicates(["key"]) if twice else found

    spans = s.write(_repeated(s, texts_of, scanned, window, k), "spans")
    texts = texts_of(spans.select("key"))
    cut = texts.join(spans, "key").mapInArrow(_remove(window), f"key {KEY}, n_removed long, kept string")
    s.keep(scanned, spans)
    ids = docs.select(F.col(id_col).alias("id"), key_of(id_col, text_col).alias("key"))
    facts = scanned.select("key", "n_words", "digest")
    return ids, facts.dropDuplicates(["key"]) if twice else facts, cut


def without_repeats(spark: SparkSession, docs: DataFrame, window: int = W, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of docs with the repeated passages removed from the text (and n_chars, if there, set anew).
    A cut text goes to the rows of its id and text, so rows without an id or with the same one keep their own texts."""
    of, kept = fresh(docs, "of"), fresh(docs, "kept")
    cut = _parts(spark, docs, window, K, id_col, text_col)[2].filter("n_removed > 0").select(F.col("key").alias(of), F.col("kept").alias(kept))
    out = docs.join(cut, key_of(id_col, text_col) == F.col(of), "left")
    new = {text_col: F.coalesce(kept, text_col)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


#: DuckDB twin of `remove_repeats` over documents (without kept).
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS h FROM d WHERE len(w) >= 35),
r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
m AS (SELECT doc_id, i, 1 AS hit FROM g SEMI JOIN r USING (h)),
k AS (SELECT u.doc_id, u.i, word, coalesce(max(m.hit) OVER (PARTITION BY u.doc_id ORDER BY u.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone FROM u LEFT JOIN m ON m.doc_id = u.doc_id AND m.i = u.i),
a AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""

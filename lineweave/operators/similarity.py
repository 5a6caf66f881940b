"""Similarity of templates: equal bytes at equal places, as a share of the longer one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this ratio of lengths the ratio itself is the score, and contents are not compared.
SHORT = 0.7


def score(a: bytes, b: bytes) -> float:
    """0..100; 100 for equal templates."""
    longer, shorter = max(len(a), len(b)), min(len(a), len(b))
    if a == b or not longer:
        return 100.0
    if shorter / longer < SHORT:
        return shorter / longer * 100
    x, y = np.frombuffer(a, np.uint8, shorter), np.frombuffer(b, np.uint8, shorter)
    return int((x == y).sum()) / longer * 100


def score_column(a: Column, b: Column) -> Column:
    """The same score as an expression, on hexadecimal forms, so that bytes and not characters are compared."""
    la, lb = F.octet_length(a), F.octet_length(b)
    longer, shorter = F.greatest(la, lb), F.least(la, lb)
    ha, hb = F.hex(F.encode(a, "utf-8")), F.hex(F.encode(b, "utf-8"))
    same = F.aggregate(F.sequence(F.lit(0), shorter - 1), F.lit(0), lambda n, i: n + F.when(F.substring(ha, i * 2 + 1, F.lit(2)) == F.substring(hb, i * 2 + 1, F.lit(2)), 1).otherwise(0))
    ratio = shorter / longer
    return F.when(a == b, F.lit(100.0)).when(shorter == 0, F.lit(0.0)).when(ratio < SHORT, ratio * 100).otherwise(same / longer * 100)


#: Pairs of one vectorised step, and the ratio of lengths within a bucket.
STEP, SPREAD = 1 << 16, 1.15

_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


class Bucket:
    """Templates of about one length: places, sizes, and bytes, eight to a word, as (words, templates).

    Bytes past the end are zero, and zero bytes of a template are put as 255, which UTF-8 does not have; so all bytes
    that the longer of two templates has beyond the shorter one count as different, as they should.
    """

    def __init__(self, places: np.ndarray, templates: list[bytes]):
        self.places = places
        self.sizes = np.array([len(t) for t in templates], np.int64)
        matrix = np.zeros((len(templates), -(-int(self.sizes.max()) // 8) * 8), np.uint8)
        for row, t in zip(matrix, templates):
            row[: len(t)] = np.frombuffer(t.replace(b"\0", b"\xff"), np.uint8)
        self.words = np.ascontiguousarray(matrix.view(np.uint64).T)


def bucketed(templates: list[bytes]) -> list[Bucket]:
    places: dict[int, list[int]] = {}
    for i, t in enumerate(templates):
        places.setdefault(int(np.log(len(t) + 1) / np.log(SPREAD)), []).append(i)
    return [Bucket(np.array(p, np.int64), [templates[i] for i in p]) for _, p in sorted(places.items())]


def _most(low: int, high: int, threshold: int) -> np.ndarray:
    """The most different bytes that templates may have whose longer one has low, low + 1, .., high bytes."""
    longer = np.arange(low, high + 1)
    need = threshold * longer // 100
    for _ in range(2):  # the least number of equal bytes whose score, as it is rounded, reaches the threshold
        need += (need / np.maximum(longer, 1) * 100 < threshold) & (longer > 0)
    return (longer - need).astype(np.int32)


def _add_different(count: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Adds how many of the eight bytes of each pair of words differ."""
    d = a ^ b
    e = d & _LOW
    e += _LOW
    e |= d
    e &= _HIGH  # the high bit of every byte that is not zero
    count += np.bitwise_count(e)


def _similar(x: Bucket, rows: slice, y: Bucket, threshold: int, most_of: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of some of x and all of y that are similar; most_of has the most different bytes for lengths from low.

    All pairs are compared word by word until few are left that can still be similar, and then those alone. Bytes that
    only the longer one has are counted in advance while both go on, and as they come from there on."""
    a, b = x.sizes[rows], y.sizes
    longer = np.maximum(a[:, None], b[None, :])
    beyond = (2 * longer - a[:, None] - b[None, :]).astype(np.int32)
    most = most_of[longer - low]
    both = int(min(a.min(), b.min())) // 8
    by_length = None
    if min(a.min(), b.min()) < SHORT * max(a.max(), b.max()):
        ratio = (longer - beyond) / np.maximum(longer, 1)
        short = (ratio < SHORT) & (longer > 0)
        most[short] = -1
        by_length = np.nonzero(short & (ratio * 100 >= threshold))
    none = np.zeros(1, np.uint64)
    count = beyond.copy()
    i = j = None
    for k in range(max(len(x.words), len(y.words))):
        p = x.words[k, rows] if k < len(x.words) else none
        q = y.words[k] if k < len(y.words) else none
        if k == both:
            count -= beyond
        if i is None:
            _add_different(count, p[:, None], q[None, :])
        else:
            _add_different(count, p[i] if len(p) > 1 else p, q[j] if len(q) > 1 else q)
        if k % 2:
            left = count <= most
            if np.count_nonzero(left) * 8 < left.size:
                i, j = np.nonzero(left) if i is None else (i[left], j[left])
                count, most, beyond = count[left], most[left], beyond[left]
                if not len(i):
                    break
    left = count <= most
    i, j = np.nonzero(left) if i is None else (i[left], j[left])
    return (i, j) if by_length is None else (np.r_[i, by_length[0]], np.r_[j, by_length[1]])


def similar_pairs(a: list[Bucket], b: list[Bucket], threshold: int):
    """Yields arrays (places in a, places in b) of similar templates."""
    for x in a:
        for y in b:
            low, high = max(x.sizes.min(), y.sizes.min()), min(x.sizes.max(), y.sizes.max())
            if low and high / low * 100 < threshold:
                continue
            least = int(min(x.sizes.min(), y.sizes.min()))
            most_of = _most(least, int(max(x.sizes.max(), y.sizes.max())), threshold)
            step = max(1, STEP // len(y.places))
            for lo in range(0, len(x.places), step):
                i, j = _similar(x, slice(lo, lo + step), y, threshold, most_of, least)
                yield x.places[lo + i], y.places[j]


class Leaders:
    """Templates in order, against which batches of others are compared; the first similar one wins."""

    def __init__(self, ords: list[int], templates: list[bytes], threshold: int):
        self.ords, self.threshold = np.array(ords, np.int64), threshold
        self.buckets = bucketed(templates)

    @property
    def nbytes(self) -> int:
        return sum(b.words.nbytes + b.sizes.nbytes + b.places.nbytes for b in self.buckets)

    def first(self, ords: np.ndarray, templates: list[bytes]) -> np.ndarray:
        """Index of the first leader, not later than the template itself, that is similar to each template; or -1."""
        none = len(self.ords)
        out = np.full(len(templates), none, np.int64)
        for i, k in similar_pairs(bucketed(templates), self.buckets, self.threshold):
            fits = self.ords[k] <= ords[i]
            np.minimum.at(out, i[fits], k[fits])
        return np.where(out == none, -1, out)


def first_fit(ords: list[int], templates: list[bytes], threshold: int) -> Leaders:
    """The leaders among templates given in order: a template that is similar to no earlier leader leads."""
    buckets = bucketed(templates)
    pairs = [np.stack(p) for p in similar_pairs(buckets, buckets, threshold)] or [np.zeros((2, 0), np.int64)]
    i, j = np.concatenate(pairs, 1)
    i, j = i[j < i], j[j < i]
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    begins = np.searchsorted(i, np.arange(len(templates) + 1))
    leads = np.ones(len(templates), bool)
    for t in range(len(templates)):
        leads[t] = not leads[j[begins[t] : begins[t + 1]]].any()
    chosen = np.flatnonzero(leads)
    return Leaders([ords[c] for c in chosen], [templates[c] for c in chosen], threshold)

"""MinHash near-duplicates over SetSketch registers.

A document's word shingles become M registers: per register the smallest of the shingles' uniform hashes is read as
an exponential variate of rate A and stored as its truncated negative logarithm to the base B, so registers of a
union are the elementwise maxima. Runs of registers form bands; documents that agree on a band meet; the joint
likelihood of the registers estimates their similarity; the estimate's survivors are verified on full sets.

Defined cases: null and empty texts have no shingles and link with nothing; a text with fewer words than a shingle
is one shingle of its whole sequence; rows whose id is null link with nothing (component null, kept true); rows that
repeat an id are one document; a very long text is sketched whole, in one task, in memory of some 50 bytes a word; an
empty table gives an empty result; other columns are ignored, whatever their names. `one_of_each` goes by rows and not
by ids: of equal rows one stays, and rows without an id or with the same one are told apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Words, components, fresh, mix, only_ids, repeats, text_slices

#: Registers: BANDS runs of ROWS. At similarity 0.8 a pair is missed by all bands with probability 3e-5.
BANDS, ROWS = 26, 5
M = BANDS * ROWS
BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
#: Pairs whose estimate lies more than this below the threshold are not verified: five standard errors at 0.8.
MARGIN = 0.175

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, M, dtype=np.uint32)
_ODD = _rng.integers(0, 1 << 32, M, dtype=np.uint32) | np.uint32(1)
#: Order of ids in which the third meeting point of a bucket is the smallest.
_FLIP = 0x5A5A5A5A5A5A5A5A


def registers(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers (len(starts), M) of the consecutive runs of 64-bit shingle hashes that begin at starts."""
    h = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    least = np.empty((M, len(starts)), dtype=np.uint32)
    for i in range(M):
        v = h ^ _XOR[i]
        v *= _ODD[i]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        least[i] = np.minimum.reduceat(v, starts)
    x = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, Q + 1).astype(np.uint16).T


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def joint_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of register rows a and b of sets with n_a and n_b elements."""
    up, down = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - up - down
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = p(u - v * j), p(v - u * j)
    like = up * np.log(more) + down * np.log(less) + same * np.log(np.clip(1 - more - less, 1e-12, 1))
    return j[np.arange(len(j)), like.argmax(1)]


def _sets(w: Words, k: int) -> list[np.ndarray]:
    hashes, _ = w.grams(k)
    return [w.shingles(d, k, hashes) for d in range(w.n_docs)]


def _wrap(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


SKETCHED = "id long, n long, ha long, hb long, sketch binary"


def _sketcher(k: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for row, w in text_slices(texts, lower=True):
                sets = _sets(w, k)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                ha, hb = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                sketch: list[bytes | None] = [None] * len(n)
                if len(every):
                    full = np.flatnonzero(n)
                    starts = (np.cumsum(n) - n)[full]
                    ha[full] = np.add.reduceat(mix(every), starts)
                    hb[full] = np.add.reduceat(mix(every ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    for d, r in zip(full, registers(every, starts)):
                        sketch[d] = r.tobytes()
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(n)), pa.array(n), _wrap(ha), _wrap(hb), pa.array(sketch, pa.binary())], ["id", "n", "ha", "hb", "sketch"])

    return run


def _registers_of(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint16).reshape(len(col), M)


def _bander(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = _registers_of(batch.column("sketch")).astype(np.uint64)
        for b in range(BANDS):
            acc = np.full(len(regs), b + 1, dtype=np.uint64)
            for c in range(b * ROWS, (b + 1) * ROWS):
                acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + regs[:, c])
            yield pa.RecordBatch.from_arrays([_wrap(acc), batch.column("id"), batch.column("n")], ["band", "id", "n"])


def _estimator(least: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            est = joint_jaccard(_registers_of(batch.column("sa")), _registers_of(batch.column("sb")), na, nb)
            keep = pa.array(est >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(est).filter(keep)], ["a", "b", "est"])

    return run


def _tokenizer(k: int):
    def run(batches):
        for batch in batches:
            for row, w in text_slices(batch.column("text"), lower=True):
                sets = _sets(w, k)
                offsets = np.cumsum([0, *map(len, sets)])
                every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, len(sets)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _wrap(every))], ["id", "tokens"])

    return run


#: Members of one block; blocks of a cluster meet pairwise, except two of one component.
BLOCK = 512


def _blocks(members: DataFrame) -> DataFrame:
    """Deals (id, c, g) into blocks within the cluster g: a component of BLOCK members or more has its own blocks,
    smaller ones share. Adds block, and big: the component if it has its own blocks."""
    sizes = members.groupBy("g", "c").agg(F.count("*").alias("size"))
    own = F.col("size") >= BLOCK
    shared = sizes.groupBy("g").agg(F.sum(F.when(~own, F.col("size"))).alias("rest"))
    key = F.when(own, F.xxhash64(F.col("c"), F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK)))).otherwise(F.xxhash64(F.lit("shared"), F.pmod(F.xxhash64("c"), F.ceil(F.col("rest") / BLOCK))))
    return members.join(sizes, ["g", "c"]).join(shared, "g").select("id", "c", "g", key.alias("block"), F.when(own, F.col("c")).alias("big"))


def _block_meeting(num: int, den: int):
    """Verified links between members of different components of two blocks; one for each member and component."""

    def run(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy()
        ids, comp = table.column("id").to_numpy(), table.column("c").to_numpy()
        regs = _registers_of(table.column("sketch"))
        tokens = table.column("tokens").combine_chunks()
        flat, offsets = tokens.values.to_numpy().view(np.uint64), tokens.offsets.to_numpy()
        xs = np.flatnonzero(left)
        ys = np.flatnonzero(~left) if not left.all() else xs
        n = np.diff(offsets)
        linked: dict[tuple[int, int], tuple[int, int]] = {}
        for i in xs:
            same = (regs[ys] == regs[i]).sum(1)
            near = ys[(same >= (num / den - MARGIN) * M) & (comp[ys] != comp[i]) & (den * np.minimum(n[ys], n[i]) >= num * np.maximum(n[ys], n[i]))]
            if len(near):
                near = near[joint_jaccard(np.broadcast_to(regs[i], (len(near), M)), regs[near], np.full(len(near), n[i], float), n[near].astype(float)) >= num / den - MARGIN]
            mine = flat[offsets[i] : offsets[i + 1]]
            for j in near:
                if (ids[i], comp[j]) in linked:
                    continue
                common = len(np.intersect1d(mine, flat[offsets[j] : offsets[j + 1]], assume_unique=True))
                if den * common >= num * (n[i] + n[j] - common):
                    linked[ids[i], comp[j]] = (ids[i], ids[j])
        return pa.table({"a": pa.array([int(a) for a, _ in linked.values()], pa.int64()), "b": pa.array([int(b) for _, b in linked.values()], pa.int64())})

    return run


def _verifier(k: int, num: int, den: int):
    def one(texts: pa.Array) -> list[np.ndarray]:
        return [s for _, w in text_slices(texts, lower=True) for s in _sets(w, k)]

    def run(batches):
        last, kept = None, None  # rows come sorted by b, whose set serves many of them
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column("b").to_pylist()
                new = [i for i, x in enumerate(ids) if x != (ids[i - 1] if i else last)]
                fresh = dict(zip(new, one(part.column("tb").take(pa.array(new, pa.int64())))))
                good = []
                for i, (x, s) in enumerate(zip(ids, one(part.column("ta")))):
                    kept = fresh.get(i, kept)
                    last = x
                    common = len(np.intersect1d(s, kept, assume_unique=True))
                    good.append(den * common >= num * (len(s) + len(kept) - common))
                keep = pa.array(good)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], ["a", "b"])

    return run


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 2, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: <id_col>, n_shingles, component_id, kept; links where den*|A∩B| >= num*|A∪B|.

    Equal sets collapse to one class first, so that thousands of copies cost one sketch row each and one shared
    representative. Within a bucket nobody meets everybody: first all members meet three hubs (the smallest, the
    largest and a scrambled smallest id), and the best-estimated pairs are verified and contracted. Members of one
    bucket that are then still in different components, and only those, are compared block against block, where two
    blocks of one component or without a common bucket never meet and only links come out, so no link is lost and no
    pairs are listed.
    """
    s = Scratch(spark, "near")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = s.write(rows.mapInArrow(_sketcher(k), SKETCHED), "sketched")
    classes = sketched.filter("n > 0 and id is not null").groupBy("ha", "hb").agg(F.min("id").alias("rep"))
    reps = sketched.join(classes.select(F.col("rep").alias("id"), "ha", "hb"), ["id", "ha", "hb"], "left_semi").select("id", "n", "sketch")
    bands = s.write(reps.mapInArrow(_bander, "band long, id long, n long"), "bands")
    close = lambda x, y: den * F.least(x, y) >= num * F.greatest(x, y)

    flip = F.lit(_FLIP)
    hubs = bands.groupBy("band").agg(F.count("*").alias("members"), F.min("id").alias("h1"), F.max("id").alias("h2"), F.min(F.col("id").bitwiseXOR(flip)).bitwiseXOR(flip).alias("h3")).filter("members > 1")
    hubs = s.write(hubs, "hubs")  # written first, so that the members of a large bucket can be split over tasks
    met = s.write(bands.join(hubs, "band"), "met")
    pairs = met.select("id", F.explode(F.array_distinct(F.array("h1", "h2", "h3"))).alias("hub")).filter("id <> hub")
    pairs = s.write(pairs.select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct(), "pairs")

    side = lambda x: reps_of.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    reps_of = sketched.filter("n > 0")
    estimate = lambda p: p.join(side("a"), "a").join(side("b"), "b").filter(close(F.col("na"), F.col("nb"))).mapInArrow(_estimator(num / den - MARGIN), "a long, b long, est double")
    likely = s.write(estimate(pairs), "likely")

    twice = repeats(sketched, "id")

    def one_each(df: DataFrame) -> DataFrame:
        return df.dropDuplicates(["id"]) if twice else df

    def texts_of(p: DataFrame) -> DataFrame:
        ids = p.select(F.col("a").alias("id")).union(p.select(F.col("b").alias("id"))).distinct()
        return s.write(one_each(only_ids(rows, ids, "id")), "texts")

    def verify(p: DataFrame, texts: DataFrame) -> DataFrame:
        both = p.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        return both.mapInArrow(_verifier(k, num, den), "a long, b long")

    def apart(p: DataFrame, comps: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components."""
        c = lambda x: comps.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        return p.join(c("a"), "a", "left").join(c("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*p.columns)

    texts = texts_of(likely)
    best = likely.groupBy("a").agg(F.max_by("b", "est").alias("b"))
    links = s.write(verify(best, texts), "links")
    comps = components(s, links)
    rest = s.write(apart(likely, comps).join(best, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        links = s.write(links.union(verify(rest, texts)), "links")
        comps = components(s, links)

    # Members of one bucket that are still apart are compared in blocks of their cluster of buckets.
    marked = met.filter("members > 2").join(comps.withColumnRenamed("node", "id"), "id", "left").select("band", "id", "h1", F.coalesce("component", "id").alias("c"))
    marked = s.write(marked, "marked")
    split = marked.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("band")
    marked = s.write(marked.join(split, "band", "left_semi"), "apart")
    if not marked.isEmpty():
        clusters = components(s, marked.select(F.col("id").alias("a"), F.col("h1").alias("b")).distinct())
        members = marked.select("id", "c").distinct().join(clusters.withColumnRenamed("node", "id"), "id", "left").select("id", "c", F.coalesce("component", "id").alias("g"))
        blocked = s.write(_blocks(members), "blocks")
        wide = one_each(only_ids(rows, blocked.select("id"), "id")).mapInArrow(_tokenizer(k), "id long, tokens array<long>").join(one_each(sketched.select("id", "sketch")), "id")
        wide = s.write(blocked.join(wide, "id"), "wide")
        there = s.write(marked.select("band", "id").join(blocked, "id").select("band", "g", "block", "big").distinct(), "there")
        x, y = (there.select("band", "g", F.col("block").alias(f"block{p}"), F.col("big").alias(f"big{p}")) for p in "xy")
        meets = x.join(y, ["band", "g"]).filter((F.col("blockx") <= F.col("blocky")) & ~(F.col("bigx").isNotNull() & F.col("bigx").eqNullSafe(F.col("bigy"))))
        meets = meets.select("g", "blockx", "blocky").distinct()
        meets = meets.withColumn("meet", F.xxhash64("g", "blockx", "blocky"))
        ends = meets.select("meet", "g", F.explode(F.array_distinct(F.array("blockx", "blocky"))).alias("block"), "blockx")
        found = wide.join(ends, ["g", "block"]).select("meet", (F.col("block") == F.col("blockx")).alias("left"), "id", "c", "sketch", "tokens")
        found = found.groupBy("meet").applyInArrow(_block_meeting(num, den), "a long, b long")
        links = s.write(links.union(found), "links")
        comps = components(s, links)

    named = s.write(classes.join(comps, classes.rep == comps.node, "left").select("ha", "hb", F.coalesce("component", "rep").alias("component")), "named")
    s.keep(sketched, named)
    out = sketched.select("id", "n", "ha", "hb").join(named, ["ha", "hb"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id (of equal ids, and without any, any one of
    them), and all rows that link with nothing; all columns. Rows are numbered and written first, so that ids need
    neither be there nor be unique."""
    s = Scratch(spark, "one")
    row = fresh(docs, "row")
    rows = s.write(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(spark, rows.select(row, text_col), k, id_col=row, text_col=text_col).select(F.col(row).alias("at"), F.col("component_id").alias("group"))
    named = s.write(found.join(rows.select(F.col(row).alias("at"), F.col(id_col).alias("id")), "at"), "named")
    best = named.groupBy("group").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("best"))
    best = s.write(best.filter("n > 1").select("group", F.col("best.at").alias("stays")), "best")  # written first, so that a large group can be split
    drop = s.write(named.join(best, "group").filter("at <> stays").select(F.col("at").alias("of")), "drop")
    s.keep(rows, drop)
    return rows.join(drop, rows[row] == drop["of"], "left_anti").drop(row)


#: DuckDB twin of `near_duplicates` over documents with two words, for small tables: it lists all pairs.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY a, b),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

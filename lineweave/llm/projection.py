"""Embedding near-duplicates by sorted projection passes.

A pass draws random directions, concatenates the signs of a vector's projections into a code, sorts the vectors of a
label lexicographically by code, and compares each vector with the neighbours in a window behind it. Passes with
other directions bring other neighbours together; verified pairs of all passes are united into components. An exact
check follows: vectors of one label that are still in different components are compared, block against block, however
many there are, so that no link is lost. A last step counts every vector's links inside its component, block against
block, so that a component of near copies larger than a window loses no link and lists no pairs.

Defined cases: vectors whose label is null, and vectors that are null, zero, or hold null or non-finite components,
link with nothing (n_links 0, component_id their own id, kept); vectors of different lengths link with nothing;
equal vectors and repeated rows link with each other like any others; rows without an id link with nothing
(component null, kept true); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, Scratch, components

LEAST = 0.98
#: Passes, signs per code, and neighbours compared.
PASSES, SIGNS, WINDOW = 16, 48, 24
#: Vectors of one block.
BLOCK = 1024
#: Vectors of a label up to which its blocks have BLOCK vectors. Beyond, they grow with the label, so that a vector is
#: sent to some 16 meetings, while their components fit in ROOM (32 MB); the links found are the same.
WHOLE, ROOM = 16 * BLOCK, 1 << 22
SEED = 7919


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision; scaled by the largest component first, so nothing overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_size(batch: pa.RecordBatch):
    """Parts of a batch whose vectors are equally long."""
    sizes = np.array(batch.column("dim").to_numpy())
    for n in np.unique(sizes):
        yield batch.filter(pa.array(sizes == n)) if len(np.unique(sizes)) > 1 else batch


def _coder(passes: int, signs: int, seed: int):
    """Adds each vector's codes, one row for each pass: pass, code, and the vector."""

    def run(batches):
        for batch in batches:
            for part in _by_size(batch) if batch.num_rows else ():
                x = _unit(_matrix(part.column("vec")))
                for p in range(passes):
                    planes = np.random.default_rng([seed, p, x.shape[1]]).standard_normal((x.shape[1], signs))
                    code = ((x @ planes) >= 0) @ (np.uint64(1) << np.arange(signs, dtype=np.uint64)[::-1])
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(x), pa.int32()), pa.array(code.astype(np.int64)), *(part.column(c) for c in ("id", "label", "dim", "vec"))], ["pass", "code", "id", "label", "dim", "vec"])

    return run


def _neighbours(window: int, least: float):
    """Links between each vector and the window of vectors before it, in rows sorted by pass, label, length and code."""

    def run(batches):
        tail: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            old = tail.num_rows if tail is not None else 0
            rows = pa.concat_tables([tail, rows]).combine_chunks() if old else rows
            ids = rows.column("id").to_numpy()
            group = np.stack([rows.column(c).to_numpy().astype(np.int64) for c in ("pass", "label", "dim")])
            cuts = np.flatnonzero(np.r_[True, (group[:, 1:] != group[:, :-1]).any(0), True])
            out: list[np.ndarray] = []
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi <= old or hi - lo < 2:
                    continue
                x = _unit(_matrix(rows.column("vec").slice(lo, hi - lo).combine_chunks()))
                for step in range(1, min(window, hi - lo - 1) + 1):
                    i = np.flatnonzero(np.einsum("ij,ij->i", x[step:], x[:-step]) >= least) + step
                    i = i[i + lo >= old]
                    out.append(np.stack([ids[lo + i], ids[lo + i - step]]))
            tail = rows.slice(max(0, rows.num_rows - window))
            if out and (found := np.concatenate(out, 1)).size:
                found = _spanning(found)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    return run


def _spanning(pairs: np.ndarray) -> np.ndarray:
    """Pairs (id, root) that connect what the given pairs connect: at most one for each vector."""
    nodes, ends = np.unique(pairs, return_inverse=True)
    ends = ends.reshape(pairs.shape)
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[ends[0]], root[ends[1]])
        new = root.copy()
        for e in ends:
            np.minimum.at(new, root[e], least)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return np.stack([nodes[moved], nodes[root[moved]]])


def _hits(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of a link with which rows of b."""
    product = a @ b.T
    hit = product >= least
    # A product that a matrix kernel rounds differently from a plain sum is decided by the plain sum.
    for i, j in zip(*np.nonzero(np.abs(product - least) < 1e-12)):
        hit[i, j] = float((a[i] * b[j]).sum()) >= least
    return hit


def _block_links(least: float):
    """Links between components that have vectors in two blocks (or in one), as pairs of components that connect them."""

    def run(table: pa.Table) -> pa.Table:
        left, comp = table.column("left").to_numpy(), table.column("c").to_numpy()
        x = _unit(_matrix(table.column("vec").combine_chunks()))
        # Products of unit vectors in single precision err by less than what is taken off, and rule out most pairs.
        rough, bound = x.astype(np.float32), np.float32(least - (x.shape[1] + 4) * 2.0**-23)
        xs = np.flatnonzero(left)
        ys = np.flatnonzero(~left) if not left.all() else xs
        found = np.zeros((2, 0), np.int64)
        for lo in range(0, len(xs), BLOCK):
            for at in range(lo if ys is xs else 0, len(ys), BLOCK):
                i, j = xs[lo : lo + BLOCK], ys[at : at + BLOCK]
                near = rough[i] @ rough[j].T >= bound
                if not near.any():
                    continue
                near &= comp[i][:, None] != comp[j]
                i, j = i[near.any(1)], j[near.any(0)]
                a, b = np.nonzero(_hits(x[i], x[j], least) & (comp[i][:, None] != comp[j]))
                if a.size:
                    found = _spanning(np.concatenate([found, np.stack([comp[i[a]], comp[j[b]]])], 1))
        return pa.table({"a": found[0], "b": found[1]})

    return run


def _count_links(least: float):
    """Partial numbers of links of the vectors of two blocks (or of one with itself)."""

    def run(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy()
        ids = table.column("id").to_numpy()
        same = left.all()
        x = _unit(_matrix(table.column("vec").combine_chunks()))
        a, b = x[left], x if same else x[~left]
        hit = _hits(a, b, least)
        if same:
            np.fill_diagonal(hit, False)
            return pa.table({"row": table.column("row"), "links": pa.array(hit.sum(1))})
        rows = table.column("row").to_numpy()
        return pa.table({"row": pa.array(np.r_[rows[left], rows[~left]]), "links": pa.array(np.r_[hit.sum(1), hit.sum(0)])})

    return run


def _completed(s: Scratch, good: DataFrame, comps: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between the components of each label's vectors of one length: all that the windows did not find."""
    group = ["label", "dim"]
    marked = good.select(*group, "id").distinct().join(comps, F.col("id") == F.col("node"), "left").select(*group, "id", F.coalesce("component", "id").alias("c"))
    marked = s.write(marked, "marked")

    # A component that fills a block has its own blocks, which do not meet each other; smaller ones share.
    sizes = s.write(marked.groupBy(*group, "c").agg(F.count("*").alias("size")), "shares")
    grown = F.lit(BLOCK) * F.ceil(F.col("n") / max(WHOLE, BLOCK))
    each = F.least(grown, F.greatest(F.lit(BLOCK), F.floor(F.lit(ROOM) / F.col("dim"))))
    labels = sizes.groupBy(*group).agg(F.sum("size").alias("n"), F.count("*").alias("comps")).filter("comps > 1").select(*group, each.alias("each"))
    sizes = s.write(sizes.join(labels, group).withColumn("own", F.col("size") >= F.col("each")), "owned")
    shared = sizes.filter("not own").groupBy(*group).agg(F.sum("size").alias("rest"))
    key = F.when(F.col("own"), F.xxhash64(F.col("c"), F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / F.col("each"))))).otherwise(F.xxhash64(F.lit("shared"), F.pmod(F.xxhash64("c"), F.ceil(F.col("rest") / F.col("each")))))
    blocked = s.write(marked.join(sizes.join(shared, group, "left"), [*group, "c"]).select(*group, "id", "c", key.alias("block"), F.when(F.col("own"), F.col("c")).alias("big")), "blocked")
    names = s.write(blocked.groupBy(*group, "block").agg(F.min("big").alias("big")), "names")
    x, y = (names.select(*group, F.col("block").alias(f"block{p}"), F.col("big").alias(f"big{p}")) for p in "xy")
    meets = x.join(y, group).filter((F.col("blockx") <= F.col("blocky")) & ~(F.col("bigx").isNotNull() & F.col("bigx").eqNullSafe(F.col("bigy"))))
    ends = meets.select(F.xxhash64(*group, "blockx", "blocky").alias("meet"), *group, F.explode(F.array_distinct(F.array("blockx", "blocky"))).alias("block"), "blockx")
    met = good.join(blocked, [*group, "id"]).join(ends, [*group, "block"]).select("meet", (F.col("block") == F.col("blockx")).alias("left"), "c", "vec")
    return s.write(met.groupBy("meet").applyInArrow(_block_links(least), "a long, b long"), "completed")


def near_vectors(spark: SparkSession, vectors: DataFrame, least: float = LEAST, passes: int = PASSES, signs: int = SIGNS, window: int = WINDOW, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: <id_col>, n_links, component_id, kept.

    Sorting is a range partitioning by (pass, label, length, code), so a label with a third of all rows spreads over
    a third of the partitions; a window does not cross the border of two partitions, where other passes and the exact
    check serve. A window yields spanning links only: one row for each vector at most, in a dense cluster too.
    """
    s = Scratch(spark, "vectors")
    v = F.col("vec")
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vec"))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("dim", F.size("vec"))
    good = rows.filter("fine").select("id", "label", "dim", "vec")
    kind = dict(good.dtypes)["vec"]
    coded = good.mapInArrow(_coder(passes, signs, seed), f"pass int, code long, id long, label long, dim int, vec {kind}")
    order = ["pass", "label", "dim", "code", "id"]
    links = s.write(coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours(window, least), "a long, b long").distinct(), "links")
    comps = components(s, links)
    more = _completed(s, good, comps, least)
    if not more.isEmpty():
        comps = components(s, links.union(more))
    named = comps.union(comps.select(F.col("component").alias("node"), "component")).distinct()
    # Rows that repeat an id without any other link form a component of their own; they are found by counting.
    repeated = good.groupBy("id").count().filter("count > 1").select(F.col("id").alias("node"), F.col("id").alias("component")).join(named, "node", "left_anti")
    named = s.write(named.union(repeated), "named")

    # Links are counted among the vectors of one component and label, block against block.
    small = named.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    inside = good.join(F.broadcast(named) if small else named, good.id == named.node).drop("node").withColumn("row", F.monotonically_increasing_id())
    inside = s.write(inside, "inside")
    sizes = s.write(inside.groupBy("component", "label", "dim").agg(F.count("*").alias("size")), "sizes")
    inside = inside.join(sizes, ["component", "label", "dim"]).withColumn("group", F.xxhash64("component", "label", "dim")).withColumn("block", F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / BLOCK)))
    blocks = inside.select("group", "block").distinct()
    x, y = (blocks.select("group", F.col("block").alias(f"block{p}")) for p in "xy")
    meets = x.join(y, "group").filter("blockx <= blocky").withColumn("meet", F.xxhash64("group", "blockx", "blocky"))
    ends = meets.select("meet", "group", F.explode(F.array_distinct(F.array("blockx", "blocky"))).alias("block"), "blockx")
    met = inside.join(ends, ["group", "block"]).select("meet", (F.col("block") == F.col("blockx")).alias("left"), "row", "id", "vec")
    counted = met.groupBy("meet").applyInArrow(_count_links(least), "row long, links long").groupBy("row").agg(F.sum("links").alias("links"))
    linked = inside.select("row", "id", "component").join(counted, "row").select("id", "component", "links")
    linked = s.write(linked.groupBy("id").agg(F.min("component").alias("component"), F.max("links").alias("links")), "linked")

    s.keep(linked)
    out = rows.select(F.col("id"), "fine").join(linked.withColumnRenamed("id", "of"), F.col("fine") & (F.col("id") == F.col("of")), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


#: DuckDB twin of `near_vectors` over embeddings, for small tables: it compares all pairs of a label.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, e.b FROM reach r JOIN e ON r.other = e.a),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

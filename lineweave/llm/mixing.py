"""Mixing sources to target weights, with every source cut at its exact budget of words.

Each document gets a hash-random key. Within a source, keys are dealt into equal key ranges of about RANGE_ROWS
documents. Range totals, summed up in the order of ranges, tell in which range a source's budget ends; only that range is
sorted, and its prefix sums find the document at the cut. All documents before it, in the order of keys, are taken whole,
those behind it not, so that the last step is a projection beside the small table of sources: no task holds a whole
source, and texts are neither sorted nor shuffled.

Defined cases: a null or empty text has size 0 and takes nothing; a null source is a source of its own and comes
last; rows without an id take their key from their text; equal keys are ordered by id, size and a hash of the text, and
rows equal in all of these are interchangeable, so only how many of them are taken is defined; a very long text is
counted in one task, without a list of its words; an empty table gives an empty result; a source without words has
target 0; other columns are ignored, and `mixed` keeps those whose names clash. A document at the cut is taken in part:
`taken` counts its words, repeats included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave.plans.scratch import numbered

from .common import Scratch, fresh, word_count

WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
MOST = 3
SEED = "mix-1"
RANGE_ROWS = 8192
#: Source rows up to which the table of sources is broadcast (about 400 bytes each as Spark holds them, 20 MB).
BROADCAST_SOURCES = 50_000


def level(sources: DataFrame, most: int) -> float:
    """The water level: words per unit of weight of the sources that stay below `most` times their size.

    Every round is one aggregate of scalars: sources that the level takes beyond their stop are fixed there, and
    what they leave raises the level of the others, until no further source reaches its stop.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cut, now = -1, 0.0
    while True:
        full = F.col("source_size") * most < F.lit(now) * F.col("weight")
        n, fixed, weight = sources.agg(F.count_if(full), F.sum(F.when(full, F.col("source_size") * most)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == cut or not weight:
            return now
        cut, now = n, (total - (fixed or 0)) / weight


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: <id_col>, source, size, source_size, target, taken."""
    return _mix(spark, docs, weights, most, seed, id_col, text_col, source_col).withColumnRenamed("id", id_col)


def _mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...], most: int, seed: str, id_col: str, text_col: str, source_col: str, carry: bool = False) -> DataFrame:
    """id, source, size, source_size, target, taken; with carry, also row, the document's columns."""
    s = Scratch(spark, "mix")
    ident, text = F.col(id_col), F.col(text_col)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))).cast("binary"))
    columns = [ident.alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), key.alias("key"), F.xxhash64(text).alias("own")]
    place = F.struct("key", "id", "size", "own")
    sized = s.write(docs.select(*columns), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int"))
    weighed = s.write(numbered(s, totals, F.col("source").isNull(), "source").withColumn("weight", weight), "weighed")
    target = F.least(F.lit(level(weighed, most)) * F.col("weight"), (F.col("source_size") * most).cast("double"))
    budget = F.least(F.round("target").cast("long"), F.col("source_size") * most)
    sources = weighed.select(F.col("source").alias("of"), "source_size", "rows", target.alias("target"))
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    beside = lambda rows, table: rows.join(F.broadcast(table) if few else table, F.col("source").eqNullSafe(F.col("of"))).drop("of")

    # The range in which the rest of a budget ends, then the place in it; equal places count as one.
    share = F.conv(F.substring("key", 1, 12), 16, 10).cast("long") / F.lit(float(16**12))
    ranged = beside(sized, sources.select("of", "rows", "rest")).withColumn("range", F.floor(share * F.ceil(F.col("rows") / RANGE_ROWS)))
    sums = ranged.groupBy("source", "rest", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    ends = sums.filter("offset <= rest and rest < offset + words").select(F.col("source").alias("of"), F.col("range").alias("at"), "offset")
    inside = beside(ranged, s.write(ends, "ends")).filter("range = at").groupBy("source", "rest", "offset", place.alias("place")).agg(F.count("*").alias("copies"))
    before = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("left", F.col("rest") - F.col("offset") - F.coalesce(F.sum(F.col("place.size") * F.col("copies")).over(before), F.lit(0)))
    edge = inside.filter(F.col("left").between(0, F.col("place.size") * F.col("copies") - 1)).select(F.col("source").alias("cut"), F.col("place").alias("edge"), "copies", "left")
    plan = s.write(sources.drop("rows", "rest").join(edge, F.col("of").eqNullSafe(F.col("cut")), "left").drop("cut"), "plan")

    rows = docs.select(*columns, F.struct(*(docs[c] for c in docs.columns)).alias("row")) if carry else sized
    placed = beside(rows, plan)
    extra = F.when(place < F.col("edge"), F.col("size")).when(place.eqNullSafe(F.col("edge")), F.least("size", "left")).otherwise(0)
    tied = F.coalesce(place.eqNullSafe(F.col("edge")) & (F.col("copies") > 1), F.lit(False))
    keep = [sized, plan]
    if not plan.filter("copies > 1").isEmpty():
        # Copies at the cut are numbered: by the count of their own task, and of the tasks before.
        copies = s.write(placed.filter(tied).withColumn("n", F.monotonically_increasing_id()), "copies")
        tasks = copies.groupBy(copies["source"].alias("of"), F.shiftright("n", 33).alias("task")).agg(F.min("n").alias("least"), F.count("*").alias("rows"))
        tasks = tasks.withColumn("first", F.coalesce(F.sum("rows").over(Window.partitionBy("of").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        copies = copies.join(F.broadcast(tasks), F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("n", 33) == F.col("task")))  # a row for each task
        copies = copies.withColumn("left", F.greatest(F.lit(0), F.col("left") - (F.col("n") - F.col("least") + F.col("first")) * F.col("size")))
        placed = placed.filter(~tied).unionByName(copies.select(*placed.columns))
        keep.append(copies)
    s.keep(*keep)
    return placed.select("id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"), *["row"] * carry)


def mixed(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target and taken beside their columns (a
    column of docs that has one of these names stays, and the new one gets the prefix mix_). The columns go through the
    mix beside the counts, so rows without an id or with the same one stay, each with what is taken of it."""
    names = {c: fresh(docs, f"mix_{c}") if c in docs.columns else c for c in ("size", "source_size", "target", "taken")}
    plan = _mix(spark, docs, WEIGHTS, MOST, SEED, id_col, "text", "source", carry=True).filter("taken > 0")
    return plan.select("row.*", *(F.col(c).alias(n) for c, n in names.items()))


#: DuckDB twin of `mix` over documents. Sources reach their stop in the order of stop / weight, so the level is the
#: first one, in that order, that the next source does not exceed.
ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || doc_id::VARCHAR) AS key FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, sum(source_size) OVER () AS total, row_number() OVER w AS place,
         coalesce(sum(3 * source_size) OVER p, 0) AS fixed, sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS open
  FROM sources WINDOW w AS (ORDER BY 3.0 * source_size / weight, source),
    p AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
height AS (SELECT coalesce(arg_min((total - fixed)::DOUBLE / open, place) FILTER (WHERE (total - fixed)::DOUBLE / open * weight <= 3 * source_size), 0) AS h FROM ordered),
targets AS (SELECT source, source_size, least(h * weight, (3 * source_size)::DOUBLE) AS target FROM sources, height),
cuts AS (SELECT *, least(round(target)::BIGINT, 3 * source_size) AS budget, CASE WHEN source_size > 0 THEN least(round(target)::BIGINT, 3 * source_size) // source_size ELSE 0 END AS epochs FROM targets)
SELECT d.doc_id, d.source, d.size, c.source_size, c.target,
       (c.epochs * d.size + greatest(0, least(d.size, c.budget - c.epochs * c.source_size
         - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM sized d JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source
"""

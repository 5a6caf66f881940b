"""First-fit clustering of templates, as if line by line, but in distributed rounds.

A line joins the first existing group whose leader is similar to it. Leaders never change, so lines of one template
share a group, and it is enough to cluster distinct templates in the order of their first lines. They are taken range by
range of that order. A range is first compared with the leaders of those before it, in parallel. Then a round takes the
next BLOCK unassigned templates of the range (a bounded number of rows and bytes), finds their leaders by first fit,
broadcasts those and assigns all unassigned templates of the range in parallel. All templates of the block are assigned
then, and every leader of a round precedes all later ones, so the first similar leader of the first round that has one
is the first similar leader of all.

A template is compared once with each leader before it and written once for each round of its own range, whatever the
number of ranges. The templates of a range are dealt to all cores. Where one round was enough for a range, the next step
takes twice as many ranges at once. When the leaders that executors hold exceed HELD_BYTES, all templates left are compared with them, and they are let go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineweave.plans.scratch import Scratch

from .similarity import Leaders, first_fit

#: Templates of one round, and their bytes (a block holds one template at least).
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Templates of a range (BLOCK for each core, if that is more), and bytes of leaders that executors hold at once (and
#: those of one round more).
RANGE, HELD_BYTES = 16 * BLOCK, 48 << 20
#: Templates that are worth a task.
TASK = 256


def templates(normalized: DataFrame) -> DataFrame:
    """Distinct templates with the numbers of their first and last line and their lines: normalized, ord, last, n."""
    return normalized.groupBy("normalized").agg(F.min("line_no").alias("ord"), F.max("line_no").alias("last"), F.count("*").alias("n"))


_TEMPLATE = "normalized string, ord long, last long, n long, gid long"


def _assigner(shared: list):
    """Adds gid, the line of the first of the leaders, given by rounds, that is similar; null where none is."""

    def run(batches):
        for batch in batches:
            texts = [t.encode() for t in batch.column("normalized").to_pylist()]
            ords = batch.column("ord").to_numpy()
            gid, left = np.full(len(texts), -1, np.int64), np.arange(len(texts))
            for leaders in (s.value for s in shared):
                found = leaders.first(ords[left], [texts[i] for i in left])
                gid[left[found >= 0]] = leaders.ords[found[found >= 0]]
                left = left[found < 0]
                if not len(left):
                    break
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("normalized", "ord", "last", "n")), pa.array(gid, mask=gid < 0)], ["normalized", "ord", "last", "n", "gid"])

    return run


def _ranged(scratch: Scratch, found: DataFrame, size: int) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The templates, and (first ord, last ord, templates) of the ranges of about `size` of them, in order."""
    rest = scratch.write(found, "templates")
    low, high, total = rest.agg(F.min("ord"), F.max("ord"), F.count("*")).first()
    if total <= size:
        return rest, [(low, high, total)] if total else []
    dealt = scratch.write(rest.repartitionByRange(-(-total // size), "ord"), "dealt")
    scratch.drop(rest)
    ends = dealt.withColumn("file", F.input_file_name()).groupBy("file").agg(F.min("ord").alias("low"), F.max("ord").alias("high"), F.count("*").alias("n"))
    return dealt, sorted((r.low, r.high, r.n) for r in ends.collect())  # a row for each range


def clusters(spark: SparkSession, scratch: Scratch, found: DataFrame, threshold: int) -> DataFrame:
    """Templates with gid, the first line of their group: normalized, ord, last, n, gid."""
    cores = spark.sparkContext.defaultParallelism
    rest, ranges = _ranged(scratch, found, max(RANGE, cores * BLOCK))
    done: list[str] = []
    held, held_bytes = [], 0

    def spread(part: DataFrame, of: list) -> DataFrame:
        """Deals rows of these ranges to all cores."""
        return part.repartition(max(1, min(cores, sum(n for _, _, n in of) // TASK)))

    def compared(part: DataFrame, leaders: list) -> DataFrame:
        """Keeps what part has of groups of these leaders, and returns the others."""
        out = scratch.write(part.mapInArrow(_assigner(leaders), _TEMPLATE), "assigned")
        done.append(out._scratch_path)  # noqa: SLF001
        return out.filter("gid is null").drop("gid")

    at, taken = 0, 1
    while at < len(ranges):
        step = ranges[at : at + taken]
        low, high = step[0][0], step[-1][1]
        at += len(step)
        part = spread(rest.filter(F.col("ord").between(low, high)), step)
        if held:
            part = compared(part, held)
        rounds, last = 0, False
        while not last:
            block = part.orderBy("ord").limit(BLOCK)
            sofar = F.sum(F.octet_length("normalized")).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))  # over BLOCK rows
            rows = block.withColumn("sofar", F.coalesce(sofar, F.lit(0))).filter(F.col("sofar") <= BLOCK_BYTES).select("ord", "normalized").orderBy("ord").collect()
            if not rows:
                break
            texts = [r.normalized.encode() for r in rows]
            leaders = first_fit([r.ord for r in rows], texts, threshold)
            held.append(spark.sparkContext.broadcast(leaders))
            held_bytes += leaders.nbytes
            part = compared(part, held[-1:])
            rounds += 1
            last = len(rows) < BLOCK and sum(map(len, texts)) <= BLOCK_BYTES  # the block held all templates that were left
            if held_bytes > HELD_BYTES:
                if at < len(ranges):
                    rest = compared(spread(rest.filter(F.col("ord") > high), ranges[at:]), held)
                for shared in held:
                    shared.destroy()
                held, held_bytes = [], 0
        taken = taken * 2 if rounds <= 1 else max(1, taken // 2)
    for shared in held:
        shared.destroy()
    return spark.read.schema(_TEMPLATE).parquet(*done).filter("gid is not null") if done else spark.createDataFrame([], _TEMPLATE)

"""Scratch tables in the folder that driver and executors share, and positions over a distributed order."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where that is unset and driver and executors are one process, a folder of our own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lineweave-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


#: Bytes of an Arrow batch while a scratch table is written: two workers of an executor hold some copies of it each.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Holds Arrow batches to BATCH for the jobs run inside; the session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_folders: set[str] = set()


def _at(path: str):
    """The file system of a path, and the path; None without a session."""
    sc = SparkContext._active_spark_context  # noqa: SLF001
    if sc is None or sc._jsc is None:  # noqa: SLF001
        return None
    p = sc._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p  # noqa: SLF001


def _remove(path: str) -> None:
    if (found := _at(path)) is not None:
        found[0].delete(found[1], True)


def sweep() -> None:
    """Removes the scratch folders of all plans of this process. No DataFrame that a plan returned can be read then, so a
    long session calls it between jobs. What is left when the driver's JVM ends goes then."""
    for path in list(_folders):
        with contextlib.suppress(Exception):
            _remove(path)
        _folders.discard(path)


class Scratch:
    """Tables that cut lineage: a lost executor costs a reread, never a recomputation.

    Every plan takes a folder of its own. Tables that a returned DataFrame reads must stay; others go with `drop`,
    the whole folder with `clear`, and what is left with `sweep`.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/lineweave-{name}-{uuid.uuid4().hex}"
        self.n, self.paths = 0, []
        _folders.add(self.path)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        with small_batches(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        if self.n == 1 and (found := _at(self.path)) is not None:
            found[0].deleteOnExit(found[1])
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path  # noqa: SLF001
        self.paths.append(path)
        return out

    def drop(self, df: DataFrame | None) -> None:
        if df is not None and (path := getattr(df, "_scratch_path", None)):
            _remove(path)
            self.paths.remove(path)

    def keep(self, *tables: DataFrame) -> None:
        """Drops all tables but these: what a result still reads."""
        kept = {getattr(t, "_scratch_path", None) for t in tables}
        for path in [p for p in self.paths if p not in kept]:
            _remove(path)
            self.paths.remove(path)

    def clear(self) -> None:
        _remove(self.path)
        _folders.discard(self.path)


def numbered(scratch: Scratch, df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """Adds the 0-based position in an order: range-partitioned, numbered inside, offset by the partitions' counts.

    Only the counts, one row for each partition, are ever in one place.
    """
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = scratch.write(df.repartitionByRange(*cols).withColumn("__part", F.spark_partition_id()), "dealt")
    parts = dealt.groupBy("__part").agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("__part", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*cols))
    return dealt.withColumn("__inside", inside).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__inside") + F.col("__before") - 1).drop("__part", "__inside", "__before")

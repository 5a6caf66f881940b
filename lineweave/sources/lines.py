"""Log lines: (line_no, line), in an order that is data and not an accident of partitioning."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class NoInputError(Exception):
    """None of the inputs can be read."""


def from_strings(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """Lines that the driver already has (standard input)."""
    rows = [(i, x) for i, x in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "line_no long, line string")


def _readable(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    try:
        return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))  # noqa: SLF001
    except Exception as e:  # an unknown scheme or host is an unreadable input
        print(f"lineweave: {path}: {e.__class__.__name__}", file=sys.stderr)
        return False


def _text(spark: SparkSession, path: str, place: int) -> DataFrame:
    """Raw lines with the key that orders them: input, file, block of the file, row within the block."""
    rows = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return rows.select(F.lit(place).alias("place"), "file", "block", "id", F.regexp_replace("value", "\r$", "").alias("line"))


def read_lines(spark: SparkSession, paths: list[str], stdin: Iterable[str] | None = None) -> DataFrame:
    """The lines of text files, concatenated in argument order; '-' is standard input. Unreadable files are reported and
    skipped; without any readable input NoInputError is raised.

    Files are split as Spark likes. A line's number is its block's first number plus its place in the block: blocks,
    some per file, are counted and summed up; the lines themselves are neither sorted nor shuffled.
    """
    parts: list[DataFrame] = []
    for place, path in enumerate(paths):
        if path == "-":
            part = from_strings(spark, [x.rstrip("\n").removesuffix("\r") for x in (sys.stdin if stdin is None else stdin)])
            parts.append(part.select(F.lit(place).alias("place"), F.lit("-").alias("file"), F.lit(0).cast("long").alias("block"), F.col("line_no").alias("id"), "line"))
        elif _readable(spark, path):
            parts.append(_text(spark, path, place))
        else:
            print(f"lineweave: {path}: cannot be read", file=sys.stderr)
    if not parts:
        raise NoInputError("no valid input")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    blocks = rows.groupBy("place", "file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    earlier = Window.orderBy("place", "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return rows.join(blocks, ["place", "file", "block"]).select((F.col("id") - F.col("first") + F.col("before") + 1).alias("line_no"), "line")


# --- lines from tables ----------------------------------------------------------------------------


def _load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An application log from the events table."""
    level = F.when(F.col("event_type") == "error", "error").otherwise("info")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), level, F.lit("] user_id="), F.col("user_id").cast("string"), F.lit(" event="), "event_type", F.lit(" value="), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(" props="), "props")
    return _load(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("line_no"), line.alias("line"))


EVENT_LOG = """SELECT event_id + 1 AS line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END
  || '] user_id=' || user_id || ' event=' || event_type || ' value=' || CAST(value AS DECIMAL(18, 2)) || ' props=' || props AS line FROM events"""


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all documents: line_no is doc_id * 2**20 plus the place of the line in its document."""
    docs = _load(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return docs.select((F.col("doc_id") * (1 << 20) + F.col("pos") + 1).alias("line_no"), "line", "lang")


DOC_LINES = """SELECT doc_id * 1048576 + i AS line_no, ls[i] AS line, lang FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents) d, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i) u"""


def url_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An access log from the pages table."""
    pages = _load(spark, sf_dir, "pages")
    path = F.regexp_replace("url", "^https?://[^/]*", "")
    line = F.concat(F.lit('10.0.0.1 - - "GET '), path, F.lit(' HTTP/1.1" '), (F.col("page_id") % 5 * 100 + 100).cast("string"), F.lit(" "), F.octet_length("html").cast("string"))
    return pages.select((F.col("page_id") + 1).alias("line_no"), line.alias("line"))


URL_LOG = r"""SELECT page_id + 1 AS line_no, '10.0.0.1 - - "GET ' || regexp_replace(url, '^https?://[^/]*', '') || ' HTTP/1.1" ' || (page_id % 5 * 100 + 100) || ' ' || octet_length(encode(html)) AS line FROM pages"""


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A business log from the orders table."""
    line = F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" customer "), F.col("o_custkey").cast("string"), F.lit(" status "), "o_orderstatus", F.lit(" total "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return _load(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("line_no"), line.alias("line"))


ORDER_LOG = """SELECT o_orderkey + 1 AS line_no, 'order ' || o_orderkey || ' customer ' || o_custkey || ' status ' || o_orderstatus || ' total ' || CAST(o_totalprice AS DECIMAL(18, 2)) AS line FROM orders"""


def ansi_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log in terminal colours."""
    return event_log(spark, sf_dir).select("line_no", F.concat(F.lit("\x1b[1;31m"), "line", F.lit("\x1b[0m")).alias("line"))


ANSI_LOG = f"SELECT line_no, chr(27) || '[1;31m' || line || chr(27) || '[0m' AS line FROM ({EVENT_LOG})"


def cluster_log(spark: SparkSession, rows: int) -> DataFrame:
    """A generated cluster log of five shapes, for tests and benchmarks."""
    i = F.col("id")
    n = lambda m, a=0: (i * 7919 % m + a).cast("string")
    uid = F.concat(F.substring(F.md5(i.cast("string").cast("binary")), 1, 8), F.lit("-4f89-11d3-9a0c-"), F.substring(F.md5(i.cast("string").cast("binary")), 9, 12))
    shapes = [
        F.concat(F.lit("E1001 12:00:"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit(".123456 "), n(9000, 1000), F.lit(' reconciler.go:'), n(900, 100), F.lit('] "MountVolume failed" pod="monitoring/agent-'), F.substring(F.md5(i.cast("string").cast("binary")), 1, 5), F.lit('" uid='), uid),
        F.concat(F.lit("2024-03-01T10:00:00Z WARN transport: dial tcp 10.1."), n(250), F.lit("."), n(250, 1), F.lit(":2379 timed out after "), n(5000, 1), F.lit("ms")),
        F.concat(F.lit("lease renewal failed for node worker-"), n(50), F.lit(" attempt "), n(9, 1), F.lit(" status 503")),
        F.concat(F.lit("synced /var/lib/data/"), n(100000), F.lit("/state.db in "), n(300, 1), F.lit("."), n(9), F.lit("s")),
        F.concat(F.lit("configmap reloaded sha "), F.sha1(i.cast("string").cast("binary")), F.lit(" size "), n(900, 100), F.lit(" KB")),
    ]
    line = F.coalesce(*(F.when(i % 5 == k, s) for k, s in enumerate(shapes)))
    return spark.range(rows).select((i + 1).alias("line_no"), line.alias("line"))

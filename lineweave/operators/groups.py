"""Groups of lines, what varies inside them, and statistics. All of it aggregation; no group is ever held as a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineweave.config import FoldConfig

# Token types whose values identify something and are sampled; the others are only counted.
SAMPLED = "UUID IPV4 IPV6 PATH EMAIL HASH K8S_NAMESPACE K8S_VOLUME K8S_PLUGIN K8S_POD QUOTED_STRING NAME HTTP_STATUS HTTP_STATUS_CLASS BRACKET_CONTEXT JSON".split()
# Statistics buckets and their token types. E-mails have a bucket, but do not count as a category.
BUCKETS = {
    "timestamps": ["TIMESTAMP"],
    "ips": ["IPV4", "IPV6", "PORT"],
    "hashes": ["HASH"],
    "uuids": ["UUID"],
    "pids": ["PID", "THREAD_ID"],
    "durations": ["DURATION"],
    "http_status": ["HTTP_STATUS", "HTTP_STATUS_CLASS"],
    "sizes": ["SIZE"],
    "percentages": ["NUMBER", "QUOTED_STRING", "NAME", "BRACKET_CONTEXT", "KEY_VALUE", "LOG_WITH_MODULE", "STRUCTURED_MESSAGE"],
    "paths": ["PATH", "JSON"],
    "kubernetes": ["K8S_NAMESPACE", "K8S_VOLUME", "K8S_PLUGIN", "K8S_POD"],
    "emails": ["EMAIL"],
}
# Values tracked per group and type, values sampled, and values that a marker lists in full.
DISTINCT_CAP, SAMPLES, INLINE = 64, 7, 3


def sized(clusters: DataFrame) -> DataFrame:
    """Templates with their group: normalized, gid, count, last_no (of the group) and template, that of its first line.
    What a group's size and ends are is known from its templates, which are few against lines."""
    sizes = clusters.groupBy("gid").agg(F.sum("n").alias("count"), F.max("last").alias("last_no"), F.min_by("normalized", "ord").alias("template"))
    return clusters.select("normalized", "gid").join(sizes, "gid")


def assigned(normalized: DataFrame, templates: DataFrame, small: bool) -> DataFrame:
    """Lines with what `sized` says of their template; its table is broadcast if its size was checked."""
    return normalized.join(F.broadcast(templates) if small else templates, "normalized")


def groups(lines: DataFrame, min_collapse: int) -> DataFrame:
    """gid, count, first and last (line_no, line, normalized, tokens), and members: the lines of a group that is too
    small to be collapsed, so fewer than min_collapse. Only lines that are shown are moved, whatever a group's size."""
    shown = lines.filter((F.col("line_no") == F.col("gid")) | (F.col("line_no") == F.col("last_no")) | (F.col("count") < min_collapse))
    line = F.struct("line_no", "line", "normalized", "tokens")
    ends = shown.groupBy("gid", "count").agg(F.sort_array(F.collect_list(line)).alias("members"))
    first, last = F.element_at("members", 1), F.element_at("members", -1)
    return ends.select("gid", "count", first.alias("first"), last.alias("last"), F.when(F.col("count") < min_collapse, F.col("members")).alias("members"))


def place(line_no: str, pos: str) -> Column:
    """line_no * 2**31 + pos, exactly: one number, because the least of structs is found by sorting, not by hashing."""
    return F.col(line_no).cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col(pos).cast("decimal(10,0)")


def token_rows(lines: DataFrame, *keep: str) -> DataFrame:
    """gid, type, value and at, the place of every token in the order of lines and of tokens within them."""
    rows = lines.select("gid", *keep, "line_no", F.posexplode("tokens").alias("pos", "token"))
    return rows.select("gid", *keep, "token.type", "token.value", place("line_no", "pos").alias("at"))


def rollup(lines: DataFrame, min_collapse: int, cap: int = DISTINCT_CAP, k: int = SAMPLES) -> DataFrame:
    """Per collapsed group and token type: gid, type, distinct_count, samples, capped.

    Distinct values are counted in the order in which they first occur, up to `cap`; any token after the cap-th
    distinct value sets capped. Up to k values are shown: all of them, or those with the smallest hashes of
    (template, type, value). The window keeps cap rows for each key before the shuffle, so a group of any size moves
    `cap` values a task.
    """
    rows = token_rows(lines.filter(F.col("count") >= min_collapse), "template")
    last = rows.groupBy("gid", "type").agg(F.max("at").alias("last"))
    firsts = rows.groupBy("gid", "type", "value", "template").agg(F.min("at").alias("at"))
    ranked = firsts.withColumn("rank", F.row_number().over(Window.partitionBy("gid", "type").orderBy("at"))).filter(F.col("rank") <= cap)
    worthy = F.when(F.col("type").isin(SAMPLED), F.struct(F.md5(F.concat("template", "type", "value").cast("binary")).alias("key"), "value"))
    per = ranked.groupBy("gid", "type").agg(F.count("*").alias("distinct_count"), F.max("at").alias("capped_at"), F.array_sort(F.collect_list(worthy)).alias("drawn"))
    samples = F.array_sort(F.transform(F.slice("drawn", 1, k), lambda x: x["value"]))
    capped = (F.col("distinct_count") >= cap) & (F.col("last") > F.col("capped_at"))
    return per.join(last, ["gid", "type"]).select("gid", "type", "distinct_count", samples.alias("samples"), capped.alias("capped"))


def variation(rolled: DataFrame) -> DataFrame:
    """gid, and the rollup as entries (type, distinct_count, samples, capped) in the order of types."""
    return rolled.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("type", "distinct_count", "samples", "capped"))).alias("variation"))


def token_types(first: str = "first", last: str = "last") -> Column:
    """Sorted token types of the first and the last line."""
    return F.array_sort(F.array_union(F.col(f"{first}.tokens.type"), F.col(f"{last}.tokens.type")))


def first_timestamp(tokens: Column) -> Column:
    return F.get(F.filter(tokens, lambda t: t["type"] == "TIMESTAMP"), F.lit(0))["value"]


def token_hits(normalized: DataFrame) -> DataFrame:
    """One row: the tokens of each bucket."""
    count = lambda types: F.coalesce(F.sum(F.size(F.filter("tokens", lambda t: t["type"].isin(types)))), F.lit(0)).cast("long")
    return normalized.agg(*(count(types).alias(name) for name, types in BUCKETS.items()))


def stats(normalized: DataFrame, grouped: DataFrame, config: FoldConfig) -> DataFrame:
    """One row of statistics for the configured output."""
    text = config.output_format != "json"
    collapsed = (F.col("count") >= config.min_collapse) if not config.essence else F.lit(False)
    saved = F.greatest(F.col("count") - (3 if text else 1), F.lit(0))
    if config.essence:
        saved = (F.col("count") - 1) if text else F.lit(0)
        saved_where = F.lit(True)
    else:
        saved_where = collapsed
    # Lines as written: an empty last line does not count.
    shown = F.when(collapsed, 3).otherwise(F.col("count")) if text and not config.essence else F.lit(1)
    last_text = F.col("first.normalized") if config.essence else F.col("last.line")
    if text:
        shown = shown - F.when(last_text == "", 1).otherwise(0)
    per_group = grouped.agg(
        F.coalesce(F.sum(F.when(collapsed, 1)), F.lit(0)).cast("long").alias("collapsed_groups"),
        F.coalesce(F.sum(F.when(saved_where, saved)), F.lit(0)).cast("long").alias("lines_saved"),
        F.coalesce(F.sum(shown), F.lit(0)).cast("long").alias("output_lines"),
        F.count("*").alias("groups"),
    )
    per_line = normalized.agg(F.count("*").alias("input_lines"), F.count_if(F.size("tokens") > 0).alias("patterns_detected"), *(F.coalesce(F.sum(F.size(F.filter("tokens", lambda t: t["type"].isin(types)))), F.lit(0)).cast("long").alias(name) for name, types in BUCKETS.items()))
    both = per_line.withColumn("one", F.lit(1)).join(per_group.withColumn("one", F.lit(1)), "one").drop("one")
    ratio = F.when(F.col("input_lines") > 0, F.col("lines_saved") / F.col("input_lines") * 100).otherwise(0.0)
    size = F.when(F.col("input_lines") > 0, (F.col("input_lines") - F.col("output_lines")) / F.col("input_lines") * 100).otherwise(0.0)
    categories = sum((F.col(b) > 0).cast("int") for b in BUCKETS if b != "emails")
    return both.select("input_lines", "output_lines", ratio.alias("compression_ratio"), size.alias("markdown_ratio"), "groups", "collapsed_groups", "lines_saved", "patterns_detected", categories.alias("categories"), *BUCKETS)

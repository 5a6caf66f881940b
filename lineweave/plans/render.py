"""Output forms of groups: texts with markers, JSON records, reports. Expressions per group; reports on the driver."""

from __future__ import annotations

import datetime
import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.config import FoldConfig
from lineweave.operators import groups as g
from lineweave.operators import lines as ln

#: A sample of more bytes is cut to one character less and an ellipsis.
SAMPLE_LENGTH = 50
# What a plain marker calls the token types; types without a value of their own never vary.
VARYING = {
    "TIMESTAMP": "timestamp", "IPV4": "IP", "IPV6": "IP", "PORT": "port", "HASH": "hash", "UUID": "UUID", "PID": "PID", "THREAD_ID": "thread",
    "PATH": "path", "JSON": "json", "DURATION": "duration", "SIZE": "size", "NUMBER": "number", "HTTP_STATUS": "http_status", "QUOTED_STRING": "quoted_string",
    "NAME": "name", "K8S_NAMESPACE": "namespace", "K8S_VOLUME": "volume", "K8S_PLUGIN": "plugin", "K8S_POD": "pod", "HTTP_STATUS_CLASS": "http_status_class",
    "BRACKET_CONTEXT": "bracket_context", "KEY_VALUE": "key_value_pair", "EMAIL": "email", "LOG_WITH_MODULE": "log_with_module", "STRUCTURED_MESSAGE": "structured_message",
}
_NO_VALUE = ("LOG_WITH_MODULE", "STRUCTURED_MESSAGE")


def sample(value: Column) -> Column:
    return F.when(F.octet_length(value) <= SAMPLE_LENGTH, value).otherwise(F.concat(F.left(value, F.lit(SAMPLE_LENGTH - 1)), F.lit("…")))


def marker(hidden: Column, variation: Column, first_ts: Column, last_ts: Column, essence: bool = False, inline: int = g.INLINE) -> Column:
    """[+N similar | first → last | type×count {samples}, ...]"""
    shown = F.filter(variation, lambda e: ((F.size(e["samples"]) > 0) | (e["distinct_count"] <= inline)) & (e["distinct_count"] > 0))

    def entry(e: Column) -> Column:
        listed = (e["distinct_count"] <= inline) & ~e["capped"] & (F.size(e["samples"]) > 0)
        values = F.concat(F.lit(" {"), F.array_join(F.transform(e["samples"], sample), ", "), F.lit("}"))
        return F.concat(F.lower(e["type"]), F.lit("×"), e["distinct_count"].cast("string"), F.when(e["capped"], "+").otherwise(""), F.when(listed, values).otherwise(""))

    parts = F.array_join(F.transform(shown, entry), ", ")
    span = F.lit("") if essence else F.when(first_ts.isNotNull() & last_ts.isNotNull(), F.concat(F.lit(" | "), first_ts, F.lit(" → "), last_ts)).otherwise("")
    return F.concat(F.lit("[+"), hidden.cast("string"), F.lit(" similar"), span, F.when(parts != "", F.concat(F.lit(" | "), parts)).otherwise(""), F.lit("]"))


def varying(first: Column, last: Column, essence: bool = False) -> Column:
    """Sorted names of the types whose values differ between two token lists."""
    kinds = F.create_map(*(F.lit(x) for t, k in VARYING.items() if not (essence and t == "TIMESTAMP") for x in (t, k)))
    named = lambda tokens: F.transform(tokens, lambda t: F.struct(kinds[t["type"]].alias("kind"), F.when(t["type"].isin(*_NO_VALUE), "").otherwise(t["value"]).alias("value")))
    values = lambda tokens, kind: F.transform(F.filter(named(tokens), lambda t: t["kind"] == kind), lambda t: t["value"])
    there = F.array_compact(F.array_distinct(F.transform(F.concat(first, last), lambda t: kinds[t["type"]])))
    return F.array_sort(F.filter(there, lambda kind: values(first, kind) != values(last, kind)))


def plain_marker(hidden: Column, first: Column, last: Column, config: FoldConfig) -> Column:
    """The marker of a group in whose lines no token was found, or, if not compact, with its span of time."""
    if not config.compact:
        stamp = lambda t: F.coalesce(g.first_timestamp(t), F.lit("unknown"))
        return F.concat(F.lit("[...collapsed "), hidden.cast("string"), F.lit(" similar lines from "), stamp(first), F.lit(" to "), stamp(last), F.lit("...]"))
    names = varying(first, last, config.essence)
    return F.concat(F.lit("[+"), hidden.cast("string"), F.lit(" similar"), F.when(F.size(names) > 0, F.concat(F.lit(", varying: "), F.array_join(names, ", "))).otherwise(""), F.lit("]"))


def _line(line: Column, config: FoldConfig) -> Column:
    return ln.masked_by(line["line"], line["tokens"]) if config.sanitize else line["line"]


def texts(described: DataFrame, config: FoldConfig) -> DataFrame:
    """gid, count, normalized, text, folded."""
    first, last = F.col("first"), F.col("last")
    folded = F.col("count") >= config.min_collapse
    if config.essence:
        text = first["normalized"]
        folded = F.lit(False)
    else:
        stamps = [F.when(F.lit(config.sanitize), ln.masked(x)).otherwise(x) for x in (g.first_timestamp(first["tokens"]), g.first_timestamp(last["tokens"]))]
        rich = marker(F.col("count") - 2, F.col("variation"), *stamps)
        middle = F.when(F.size("variation") > 0, rich).otherwise(plain_marker(F.col("count") - 2, first["tokens"], last["tokens"], config))
        whole = F.array_join(F.transform("members", lambda m: _line(m, config)), "\n")
        text = F.when(folded, F.concat_ws("\n", _line(first, config), middle, _line(last, config))).otherwise(whole)
    return described.select("gid", "count", first["normalized"].alias("normalized"), text.alias("text"), folded.alias("folded"))


def record(config: FoldConfig) -> list[Column]:
    """The fields of a group record besides its id."""
    first, last = F.col("first"), F.col("last")
    masked = FoldConfig(sanitize=config.sanitize and not config.raw_json)
    entries = F.transform("variation", lambda e: F.struct(e["type"], F.struct(e["distinct_count"], e["samples"], e["capped"])))
    return [
        F.col("count").alias("count"),
        g.token_types().alias("token_types"),
        first["normalized"].alias("normalized"),
        F.struct(_line(first, masked).alias("line"), first["line_no"].alias("line_no")).alias("first"),
        F.struct(_line(last, masked).alias("line"), last["line_no"].alias("line_no")).alias("last"),
        F.struct(g.first_timestamp(first["tokens"]).alias("first_seen"), g.first_timestamp(last["tokens"]).alias("last_seen")).alias("time_range"),
        F.map_from_entries(entries).alias("variation"),
    ]


def records(described: DataFrame, config: FoldConfig) -> DataFrame:
    """id, record (JSON text with nulls kept)."""
    fields = F.struct(F.lit("group").alias("type"), "id", *record(config))
    return described.select("id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("record"))


# --- reports --------------------------------------------------------------------------------------


def report_time(epoch: str | None = None) -> str:
    """The time of a report: SOURCE_DATE_EPOCH, if that is a number, or now."""
    epoch = os.environ.get("SOURCE_DATE_EPOCH") if epoch is None else epoch
    try:
        at = datetime.datetime.fromtimestamp(int(epoch or ""), datetime.timezone.utc)
    except (ValueError, OverflowError, OSError):
        at = datetime.datetime.now(datetime.timezone.utc)
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


def stats_json(stats: dict, elapsed_ms: int = 0) -> dict:
    keys = ("input_lines", "output_lines", "compression_ratio", "collapsed_groups", "lines_saved", "patterns_detected")
    return {k: stats[k] for k in keys} | {"elapsed_ms": elapsed_ms, "pattern_hits": {b: stats[b] for b in g.BUCKETS}}


def summary_record(stats: dict, elapsed_ms: int = 0) -> str:
    return json.dumps({"type": "summary"} | stats_json(stats, elapsed_ms), separators=(",", ":"))


# Rows of the table of values: bucket, name, what it holds.
DISTRIBUTION = [
    ("timestamps", "Times", "points in time in any of the known formats"),
    ("ips", "Network", "addresses of either version, host names and ports"),
    ("hashes", "Hashes", "runs of hexadecimal digits"),
    ("uuids", "Identifiers", "UUIDs and the ids of requests, traces and sessions"),
    ("durations", "Durations", "spans of time and decimal numbers"),
    ("pids", "Processes", "numbers of processes and threads"),
    ("sizes", "Sizes", "amounts of bytes"),
    ("percentages", "Other values", "integers, quoted strings, names, contexts and pairs"),
    ("http_status", "Status codes", "HTTP statuses and their classes"),
    ("paths", "Paths", "paths, addresses of resources and objects in JSON"),
    ("kubernetes", "Cluster", "pods, namespaces, volumes and plugins"),
    ("emails", "E-mail", "e-mail addresses"),
]


#: Fixed value: folded groups from which on the report points to the largest.
MANY_GROUPS = 50


def stats_report(stats: dict, at: str | None = None) -> str:
    """The footer of a text fold."""
    ratio, total = stats["compression_ratio"], stats["input_lines"]
    level = "high" if ratio > 90 else "medium" if ratio > 70 else "low"
    out = ["", "---", "# Fold statistics", f"*lineweave, {at or report_time()}*", ""]
    out += [f"- lines read: {total}", f"- lines written: {stats['output_lines']}", f"- share folded away: {ratio:.1f}% ({level})"]
    out += [f"- lines with values: {stats['patterns_detected']}", f"- kinds of values: {stats['categories']}", f"- folded groups: {stats['collapsed_groups']}, which save {stats['lines_saved']} lines", ""]
    out += ["| Values | Count | What they are |", "|---|---|---|"]
    out += [f"| {name} | {stats[b]} | {text} |" for b, name, text in DISTRIBUTION if stats[b]]
    if stats["collapsed_groups"] > MANY_GROUPS:
        out += ["", f"More than {MANY_GROUPS} groups were folded: start with the largest (--top)."]
    return "\n".join([*out, "---"])


def markdown_head(stats: dict, at: str | None = None) -> str:
    return "\n".join(["# Log Analysis", f"*Generated by lineweave on {at or report_time()}*", "", "## Summary", "", f"- **Original lines**: {stats['input_lines']}", f"- **Compressed lines**: {stats['output_lines']}", f"- **Compression ratio**: {stats['markdown_ratio']:.1f}%", "", "## Compressed Logs", ""])


def markdown_entry(place: int, text: str) -> str:
    if "+" in text and "similar" in text:
        return f"### Entry {place} (Folded)\n\n```\n{text}\n```\n"
    return f"{text}\n"

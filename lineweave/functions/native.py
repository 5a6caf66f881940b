"""Detectors without context, as Catalyst expressions that give the same text as the Python ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import detectors as d


def _chain(column: Column, *steps: tuple[str, str]) -> Column:
    for pattern, put in steps:
        column = F.regexp_replace(column, pattern, put)
    return column


def hashes(column: Column) -> Column:
    return _chain(column, *((rf"\b[a-fA-F0-9]{{{n}}}\b", "<HASH>") for n in d.HEX_LENGTHS))


def emails(column: Column) -> Column:
    """Replaces addresses, except those whose local part ends in a dot."""
    return F.regexp_replace(column, d.EMAIL.pattern.replace("{0,63}@", "{0,63}(?<!\\.)@"), "<EMAIL>")


def identifiers(column: Column) -> Column:
    gate = column.rlike("-|req|trace|session") | ((F.octet_length(column) > 20) & column.rlike("[0-9a-fA-F]"))
    steps = ((d.UUID, "<UUID>"), (d.REQUEST_ID, "request_id=<UUID>"), (d.TRACE_ID, "trace=<UUID>"), (d.SESSION_ID, "session=<UUID>"), (d.CORRELATION_ID, "correlation_id=<UUID>"), (d.HEX_32, "<UUID>"))
    return F.when(gate, _chain(column, *((p.pattern, put) for p, put in steps))).otherwise(column)


def processes(column: Column) -> Column:
    steps = ((d.PID_BRACKET, "[pid=<PID>]"), (d.PID_EQUALS, "pid=<PID>"), (d.THREAD, "Thread-<TID>"), (d.TID, "tid=<TID>"), (d.THREAD_NAME, "[thread:<TID>]"), (d.ID_EQUALS, "id=<PID>"), (d.PID_PAREN, "(<PID>)"))
    return _chain(column, *((p.pattern, put) for p, put in steps))


def addresses(column: Column) -> Column:
    """IPv4 addresses, with and without ports."""
    return _chain(column, (d.IPV4_PORT.pattern, "<IP>:<PORT>"), (d.IPV4.pattern, "<IP>"))


def measures(column: Column) -> Column:
    gate = column.rlike("[.%smh]|KB|MB")
    status = r"(?i)((?:status|error|code|returned?)\s+)[1-5][0-9][0-9]\b"
    steps = ((d.DURATION_FIELD.pattern, "<DURATION_FIELD>"), (d.DURATION.pattern, "<DURATION>"), (d.ADDRESS.pattern, "<ADDR>"), (d.SIZE.pattern, "<SIZE>"), (status, "$1<HTTP_STATUS>"), (d.PERCENT.pattern, "<PCT>"), (d.DECIMAL.pattern, "<DECIMAL>"), (d.INTEGER.pattern, "<NUMBER>"))
    return F.when(gate, _chain(column, *steps)).otherwise(column)


def access_status(column: Column) -> Column:
    """Status codes of access-log requests as classes."""
    head = r'("(?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH)\s+[^"]*"\s+)'
    return _chain(column, *((rf"{head}{c}\d{{2}}(\s+\d+)", f"$1<HTTP_STATUS_{c}XX>$2") for c in "12345"), (rf"{head}[06-9]\d{{2}}(\s+\d+)", "$1<HTTP_STATUS_UNKNOWN>$2"))


def value_type(column: Column) -> Column:
    """The kind of a value; the first that fits."""
    ends = lambda *xs: column.rlike(f"(?:{'|'.join(xs)})\\z")
    octet = "(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}))"
    return (
        F.when(ends("%"), "percentage")
        .when(ends(*d.DURATION_ENDS, "[0-9]s"), "duration")
        .when(ends(*d.SIZE_ENDS), "size")
        .when(ends(*d.RATE_ENDS), "rate")
        .when(F.lower(column).isin(sorted(d.BOOLEANS)), "boolean")
        .when(column.rlike(r"\A[0-9.]*\z"), "number")
        .when(column.rlike(rf"\A{octet}(?:\.{octet}){{3}}\z") | column.rlike(r"\A[0-9a-fA-F]*:[0-9a-fA-F:]*\z"), "ip")
        .when(column.rlike(r"\A(?:http|https|ftp)://"), "url")
        .otherwise("string")
    )


def ipv6_plausible(column: Column) -> Column:
    size = F.octet_length(column)
    return (size >= 2) & (size <= 100) & column.rlike(r"\A[0-9a-fA-F:.]*\z") & F.contains(column, F.lit(":")) & ((column == "::") | column.rlike("[0-9a-fA-F]"))

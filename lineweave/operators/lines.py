"""Filters and projections of lines; all of them expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineweave.config import FoldConfig

#: Fixed value: terminal colour and cursor sequences.
ANSI = "\\x1b\\[[0-9;]*[a-zA-Z]"
#: Fixed value: the e-mail pattern, as for the detector.
EMAIL = r"\b[a-zA-Z0-9][a-zA-Z0-9._+-]{0,63}@[a-zA-Z0-9][a-zA-Z0-9.-]{0,253}\.[a-zA-Z]{2,}\b"


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first n lines by number; lines that a length limit would drop count too."""
    return lines.filter(F.col("line_no") <= n)


def short_lines(lines: DataFrame, most: int) -> DataFrame:
    """Lines of `most` bytes or fewer."""
    return lines.filter(F.octet_length("line") <= most)


def limited(lines: DataFrame, config: FoldConfig) -> DataFrame:
    if config.max_lines is not None:
        lines = first_lines(lines, config.max_lines)
    return lines if config.max_line_length is None else short_lines(lines, config.max_line_length)


def plain(column: Column) -> Column:
    """A line without colour sequences."""
    return F.regexp_replace(column, ANSI, "")


def any_match(lines: DataFrame, pattern: str) -> DataFrame:
    """One row: whether any raw line matches the pattern."""
    return lines.agg(F.coalesce(F.max(F.col("line").rlike(pattern)), F.lit(False)).alias("matched"))


def masked(column: Column) -> Column:
    """A text with every e-mail address as <EMAIL>."""
    return F.regexp_replace(column, EMAIL, "<EMAIL>")


def masked_by(column: Column, tokens: Column) -> Column:
    """A text with every occurrence of the e-mail addresses among its tokens as <EMAIL>."""
    found = F.array_distinct(F.transform(F.filter(tokens, lambda t: (t["type"] == "EMAIL") & (t["value"] != "")), lambda t: t["value"]))
    return F.aggregate(found, column, lambda text, value: F.replace(text, value, F.lit("<EMAIL>")))


def half_masked(column: Column) -> Column:
    """u***@e***.com for an address; texts without exactly one @ or with an empty part stay."""
    local, domain = F.substring_index(column, "@", 1), F.substring_index(column, "@", -1)
    dot = F.length(domain) - F.instr(F.reverse(domain), ".") + 1
    tld = F.when(F.instr(domain, ".") > 0, domain.substr(dot + 1, F.length(domain)))
    hidden = F.concat(F.left(local, F.lit(1)), F.lit("***@"), F.left(domain, F.lit(1)), F.lit("***"))
    one = (F.length(column) - F.length(F.replace(column, F.lit("@"), F.lit(""))) == 1) & (local != "") & (domain != "")
    return F.when(~one, column).when(tld.isNull(), hidden).when(tld == "", column).otherwise(F.concat(hidden, F.lit("."), tld))

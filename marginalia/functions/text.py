"""Text helpers with the semantics the section rules rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column | str) -> Column:
    """Without white space (Unicode's, so tabs, newlines and nbsp too) at both ends; trim() leaves those."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def code_point_slice(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] by code points, 0-based; empty if end <= start."""
    return F.substring(text, start.cast("int") + 1, F.greatest(end - start, F.lit(0)).cast("int"))


def blank(c: Column) -> Column:
    return strip(c) == ""


def yes_no(c: Column) -> Column:
    """'True' or 'False' for a flag; null counts as False."""
    return F.when(c, "True").otherwise("False")


def seeded_hash(seed: int, *cols: Column) -> Column:
    """A reproducible 32-bit hash of (seed, ids): the first eight hex digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("bigint")


def number(c: Column) -> Column:
    """As a double; what is not a number becomes null."""
    return c.try_cast("double")


def lines(c: Column) -> Column:
    """Distinct trimmed lines in order of first occurrence; a written-out \\n counts as a break; '' and '0' are dropped."""
    parts = F.transform(F.split(F.replace(c, F.lit("\\n"), F.lit("\n")), "\n"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: ~x.isin("", "0")))


def desktop(user_agent: Column) -> Column:
    """No mobile device named in a browser's user agent."""
    return ~user_agent.rlike("(?i)mobile|android|iphone|ipad|phone|tablet")


def escape_markup(c: Column) -> Column:
    c = F.trim(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.replace(c, F.lit("\n"), F.lit("<br />\n"))

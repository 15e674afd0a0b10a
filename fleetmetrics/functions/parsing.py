"""Parsing and cleaning expressions. All are built-in Spark functions."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import instant, utc

# Unicode white space, as trimmed from every field.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Control characters that are dropped (below 32, not tab, LF, CR).
CONTROL_CHARACTERS = "".join(chr(i) for i in range(32) if chr(i) not in "\t\n\r")

_FINITE = (
    r"[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
    r"|0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?\d+)"
)
_NUMBER = rf"\A(?:{_FINITE}|(?i:[+-]?(?:inf|infinity)|nan))\z"
_NOT_FINITE = r"(?i)(?:\A|\x01)(?:[+-]?inf(?:inity)?|nan)(?:\x01|\z)"
_RFC3339 = r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:\d\d)"
_SPACED = r"\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:[.,]\d+)?"
_RELATIVE = r"\Anow\s*([+-])\s*(\d+)\s*([smhd])\z"

# Seconds per unit of a relative time.
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def trim_space(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def _number_or_zero(text: Column, kind: str) -> Column:
    value = text.try_cast(kind)
    # Out of range reads as infinity, which only a literal may mean.
    overflow = (F.abs(value) == float("inf")) & ~F.lower(text).contains("inf")
    return F.when(text.rlike(_NUMBER) & ~overflow, value).otherwise(F.lit(0).cast(kind))


def finite32_or_zero(col: Column) -> Column:
    """:func:`to_float32_or_zero` where rows with literal infinities are rejected anyway."""
    value = col.try_cast("float")
    return F.when(col.rlike(rf"\A{_FINITE}\z") & (F.abs(value) < float("inf")), value).otherwise(
        F.lit(0).cast("float")
    )


def any_not_finite(*texts: Column) -> Column:
    """Whether any of the texts spells an infinity or not-a-number."""
    return F.concat_ws("\x01", *texts).rlike(_NOT_FINITE)


def to_float32_or_zero(col: Column) -> Column:
    """Text to a 32-bit float; empty, malformed and out-of-range text is 0."""
    return _number_or_zero(col, "float")


def to_float64_or_zero(col: Column) -> Column:
    """Text to a 64-bit float after stripping quotes; malformed text is 0."""
    return _number_or_zero(F.btrim(col, F.lit('"')), "double")


def clean_field(col: Column) -> Column:
    """White space off both ends, then quotes off both ends; null is empty."""
    return F.btrim(trim_space(F.coalesce(col, F.lit(""))), F.lit('"'))


def first_non_empty(*cols: Column) -> Column:
    """The first column that is not blank, else the empty string."""
    return F.coalesce(*[F.nullif(trim_space(c), F.lit("")) for c in cols], F.lit(""))


def sanitize(col: Column) -> Column:
    """Control characters other than tab, LF and CR removed, then trimmed."""
    return trim_space(F.translate(col, CONTROL_CHARACTERS, ""))


def parse_rfc3339(col: Column) -> Column:
    """RFC 3339 text to a timestamp, NULL for anything else."""
    text = F.regexp_replace(col, ",", ".")
    return F.when(col.rlike(rf"\A{_RFC3339}\z"), text.try_cast("timestamp"))


def parse_ts(col: Column, as_of: Column | datetime | str) -> Column:
    """RFC 3339, or ``YYYY-MM-DD HH:MM:SS`` in UTC, else ``as_of``."""
    spaced = F.concat(F.regexp_replace(col, ",", "."), F.lit("Z"))
    return F.coalesce(
        parse_rfc3339(col),
        F.when(col.rlike(rf"\A{_SPACED}\z"), spaced.try_cast("timestamp")),
        instant(as_of),
    )


def resolve_relative_time(expression: Column | str, as_of: Column | datetime | str):
    """``now``, or ``now`` plus or minus a number of seconds, minutes, hours or days.

    A column gives a timestamp column with NULL for malformed text; a string
    gives a datetime and raises ValueError.
    """
    if isinstance(expression, str):
        return _resolve_literal(expression, as_of)
    text = F.lower(trim_space(expression))
    base = instant(as_of)
    signed = F.regexp_replace(text, _RELATIVE, "$1$2").try_cast("decimal(20,0)")
    units = F.create_map(*[F.lit(x) for pair in UNIT_SECONDS.items() for x in pair])
    seconds = signed * F.try_element_at(units, F.right(text, F.lit(1)))
    # Beyond the years a timestamp may hold, the text counts as malformed.
    near = F.when(F.abs(seconds) < 10_000 * 366 * 86400, seconds.cast("long"))
    shifted = F.timestamp_seconds(F.unix_seconds(base) + near)
    moved = F.when(F.year(shifted).between(1, 9999), shifted + _fraction(base))
    return F.when(text == "now", base).when(text.rlike(_RELATIVE), moved)


def _fraction(ts: Column) -> Column:
    """What a timestamp has beyond whole seconds, as an interval."""
    return ts - F.date_trunc("second", ts)


def _resolve_literal(expression: str, as_of: datetime | str) -> datetime:
    text = expression.strip().lower()
    if text == "now":
        return utc(as_of)
    found = re.fullmatch(r"now\s*([+-])\s*([0-9]+)\s*([smhd])", text)
    if not found:
        raise ValueError(f"Invalid format: {text}")
    seconds = int(found[2]) * UNIT_SECONDS[found[3]]
    try:
        return utc(as_of) + timedelta(seconds=-seconds if found[1] == "-" else seconds)
    except OverflowError as error:
        raise ValueError(f"Invalid format: {text}") from error


def rfc3339(ts: Column) -> Column:
    """A timestamp as RFC 3339 text with whole seconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def headers_json(headers: Column) -> Column:
    """A header map as JSON text; no headers give ``{}``."""
    return F.to_json(F.coalesce(headers, F.create_map().cast("map<string,string>")))

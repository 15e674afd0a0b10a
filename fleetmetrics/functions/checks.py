"""Value checks. Each gives NULL when the value is fine, else (field, value, message)."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import instant, utc
from .parsing import _RFC3339, parse_rfc3339

# Limits, patterns and texts of the checks.
GPU_ID_MAX, HOSTNAME_MAX, CLUSTER_ID_MAX = 100, 253, 50
ID_PATTERN = r"\A[a-zA-Z0-9_-]+\z"
HOSTNAME_PATTERN = r"\A[a-zA-Z0-9][a-zA-Z0-9.-]*[a-zA-Z0-9]\z"
MAX_AGE_YEARS = 2
MAX_AHEAD = timedelta(hours=1)
MAX_SPAN = timedelta(days=30)
GPU_ID_REQUIRED = "GPU ID is required"
GPU_ID_LONG = "GPU ID must be less than 100 characters"
GPU_ID_INVALID = (
    "GPU ID contains invalid characters"
    " (only alphanumeric, hyphens, and underscores allowed)"
)
HOSTNAME_REQUIRED = "hostname is required"
HOSTNAME_LONG = "hostname must be less than 253 characters"
HOSTNAME_INVALID = "invalid hostname format"
CLUSTER_ID_REQUIRED = "cluster ID is required"
CLUSTER_ID_LONG = "cluster ID must be less than 50 characters"
CLUSTER_ID_INVALID = "cluster ID contains invalid characters"
START_INVALID = "invalid start_time format (must be RFC3339, e.g., 2024-01-01T00:00:00Z)"
END_INVALID = "invalid end_time format (must be RFC3339, e.g., 2024-01-01T00:00:00Z)"
START_OLD = "start_time cannot be more than 2 years in the past"
END_AHEAD = "end_time cannot be more than 1 hour in the future"
RANGE_REVERSED = "start_time must be before end_time"
RANGE_LONG = "time range cannot exceed 30 days"
LIMIT_INVALID = "limit must be a valid integer"
LIMIT_POSITIVE = "limit must be greater than 0"
LIMIT_LARGE = "limit cannot exceed {}"


class CheckError(ValueError):
    """A rejected argument."""

    def __init__(self, field: str, value: str, message: str):
        super().__init__(f"validation error on field '{field}': {message}")
        self.field, self.value, self.message = field, value, message


def _error(field: str, value: Column, message: str) -> Column:
    return F.struct(
        F.lit(field).alias("field"), value.alias("value"), F.lit(message).alias("message")
    )


def _check_id(col, field, pattern, longest, required, too_long, invalid) -> Column:
    text = F.coalesce(col, F.lit(""))
    return (
        F.when(text == "", _error(field, text, required))
        .when(F.octet_length(text) > longest, _error(field, text, too_long))
        .when(~text.rlike(pattern), _error(field, text, invalid))
    )


def check_gpu_id(col: Column) -> Column:
    return _check_id(
        col, "gpu_id", ID_PATTERN, GPU_ID_MAX, GPU_ID_REQUIRED, GPU_ID_LONG, GPU_ID_INVALID
    )


def check_hostname(col: Column) -> Column:
    return _check_id(
        col, "hostname", HOSTNAME_PATTERN, HOSTNAME_MAX,
        HOSTNAME_REQUIRED, HOSTNAME_LONG, HOSTNAME_INVALID,
    )


def check_cluster_id(col: Column) -> Column:
    return _check_id(
        col, "cluster_id", ID_PATTERN, CLUSTER_ID_MAX,
        CLUSTER_ID_REQUIRED, CLUSTER_ID_LONG, CLUSTER_ID_INVALID,
    )


def require_gpu_id(value: str) -> str:
    """The literal form of :func:`check_gpu_id`."""
    if not value:
        raise CheckError("gpu_id", value, GPU_ID_REQUIRED)
    if len(value.encode()) > GPU_ID_MAX:
        raise CheckError("gpu_id", value, GPU_ID_LONG)
    if not re.fullmatch(r"[a-zA-Z0-9_-]+", value):
        raise CheckError("gpu_id", value, GPU_ID_INVALID)
    return value


def _oldest_start(as_of: datetime | str) -> datetime:
    now = utc(as_of)
    try:
        return now.replace(year=now.year - MAX_AGE_YEARS)
    except ValueError:  # 29 February has no namesake
        return now.replace(year=now.year - MAX_AGE_YEARS, month=3, day=1)


def check_time_range(start, end, as_of: datetime | str):
    """Start no older than two years, end at most an hour ahead, in order, 30 days at most.

    Two columns of request text give an error column. Two strings give the pair
    of datetimes (None where empty) or raise :class:`CheckError`.
    """
    if not isinstance(start, Column):
        return _require_time_range(start or "", end or "", as_of)
    first, last = F.coalesce(start, F.lit("")), F.coalesce(end, F.lit(""))
    t0, t1 = parse_rfc3339(first), parse_rfc3339(last)
    both = F.concat(first, F.lit(" to "), last)
    return (
        F.when((first != "") & t0.isNull(), _error("start_time", first, START_INVALID))
        .when(t0 < instant(_oldest_start(as_of)), _error("start_time", first, START_OLD))
        .when((last != "") & t1.isNull(), _error("end_time", last, END_INVALID))
        .when(t1 > instant(utc(as_of) + MAX_AHEAD), _error("end_time", last, END_AHEAD))
        .when(t0 > t1, _error("time_range", both, RANGE_REVERSED))
        .when(t1 - t0 > F.lit(MAX_SPAN), _error("time_range", both, RANGE_LONG))
    )


def _moment(text: str) -> datetime | None:
    if not re.fullmatch(_RFC3339, text, re.ASCII):
        return None
    try:
        return utc(text.replace(",", "."))
    except ValueError:
        return None


def _require_time_range(start: str, end: str, as_of):
    t0, t1 = _moment(start), _moment(end)
    if start and t0 is None:
        raise CheckError("start_time", start, START_INVALID)
    if t0 and t0 < _oldest_start(as_of):
        raise CheckError("start_time", start, START_OLD)
    if end and t1 is None:
        raise CheckError("end_time", end, END_INVALID)
    if t1 and t1 > utc(as_of) + MAX_AHEAD:
        raise CheckError("end_time", end, END_AHEAD)
    if t0 and t1:
        if t0 > t1:
            raise CheckError("time_range", f"{start} to {end}", RANGE_REVERSED)
        if t1 - t0 > MAX_SPAN:
            raise CheckError("time_range", f"{start} to {end}", RANGE_LONG)
    return t0, t1


def check_limit(limit, max_limit: int | None = None):
    """A positive integer, at most ``max_limit`` where the caller sets one; empty means all rows.

    A column of request text gives an error column; a string gives the number,
    None where it is empty, or raises :class:`CheckError`.
    """
    if not isinstance(limit, Column):
        return _require_limit(limit or "", max_limit)
    text = F.coalesce(limit, F.lit(""))
    number = F.when(text.rlike(r"\A[+-]?\d+\z"), text.try_cast("long"))
    found = (
        F.when(text == "", F.lit(None))
        .when(number.isNull(), _error("limit", text, LIMIT_INVALID))
        .when(number <= 0, _error("limit", text, LIMIT_POSITIVE))
    )
    if max_limit is None:
        return found
    return found.when(number > max_limit, _error("limit", text, LIMIT_LARGE.format(max_limit)))


def limit_value(limit: Column, max_limit: int | None = None) -> Column:
    """The number behind an accepted limit, NULL for an empty or a rejected one."""
    text = F.coalesce(limit, F.lit(""))
    return F.when((text != "") & check_limit(limit, max_limit).isNull(), text.try_cast("long"))


def _require_limit(text: str, max_limit: int | None) -> int | None:
    if text == "":
        return None
    if not re.fullmatch(r"[+-]?[0-9]+", text) or abs(int(text)) >= 2**63:
        raise CheckError("limit", text, LIMIT_INVALID)
    if int(text) <= 0:
        raise CheckError("limit", text, LIMIT_POSITIVE)
    if max_limit is not None and int(text) > max_limit:
        raise CheckError("limit", text, LIMIT_LARGE.format(max_limit))
    return int(text)

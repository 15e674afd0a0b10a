"""The main query: readings of one GPU over a time range, newest first."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from ..functions.checks import check_limit, check_time_range, require_gpu_id
from ..functions.parsing import CONTROL_CHARACTERS, WHITESPACE
from ..operators.readings import match_gpu, newest_first, project_api_row, time_range


@dataclass(frozen=True)
class ReadingQuery:
    """Arguments as request text; empty means not given."""

    gpu: str
    start: str = ""
    end: str = ""
    limit: str = ""
    exact: bool = False


def select_readings(
    readings: DataFrame, query: ReadingQuery, as_of: datetime | str, max_limit: int | None = None
) -> DataFrame:
    """The stored rows the query asks for, all of them where it sets no limit.

    Raises ``CheckError`` on bad arguments.
    """
    dropped = str.maketrans("", "", CONTROL_CHARACTERS)
    gpu = require_gpu_id(query.gpu.translate(dropped).strip(WHITESPACE))
    start, end = check_time_range(query.start, query.end, as_of)
    limit = check_limit(query.limit, max_limit)
    found = time_range(match_gpu(readings, gpu, query.exact), start, end)
    return newest_first(found, limit)


def readings_by_gpu(
    readings: DataFrame, query: ReadingQuery, as_of: datetime | str, max_limit: int | None = None
) -> DataFrame:
    """:func:`select_readings` as answer rows."""
    return project_api_row(select_readings(readings, query, as_of, max_limit))

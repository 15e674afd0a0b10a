"""Pages by position, from a counted index of ranges."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batching import RANGE_ROWS, by_ranges
from .readings import Page


@dataclass(frozen=True)
class PageIndex:
    """Rows in even ranges of the newest-first order, and how many rows each range has, the newest range first."""

    rows: DataFrame
    counts: Sequence[tuple[int, int]]

    @property
    def total(self) -> int:
        return sum(n for _, n in self.counts)

    def page(self, limit: int, offset: int = 0) -> Page:
        """``limit`` rows after the first ``offset``; only the ranges that hold them are read and sorted.

        The summary comes from the counts and reads nothing.
        """
        wanted, before, skipped = [], 0, 0
        for number, n in self.counts:
            if before + n <= offset:
                skipped = before + n
            elif before < offset + limit:
                wanted.append(number)
            before += n
        found = self.rows.filter(F.col("_range").isin(wanted)) if wanted else self.rows.limit(0)
        ordered = found.orderBy(F.col("_second").desc(), F.col("_seq").desc())
        summary = self.rows.sparkSession.createDataFrame(
            [(self.total, self.total > limit + offset)], "total_count long, has_more boolean"
        )
        return Page(ordered.offset(offset - skipped).limit(limit).drop("_range", "_second", "_seq"), summary)


def index_pages(df: DataFrame, ts: str = "ts", seq: str = "seq", range_rows: int = RANGE_ROWS) -> PageIndex:
    """An index for pages of :func:`newest_first`: by whole second and within it by ``seq``, the latest first.

    The rows are written once, in ranges of about ``range_rows``, to the shared
    folder; the driver gets one count per range. Rows without a time or number
    come last.
    """
    placed = df.withColumn("_second", F.date_trunc("second", F.col(ts))).withColumn("_seq", F.col(seq))
    rows = by_ranges(placed, [], ["_second", "_seq"], range_rows)
    counts = {r["_range"]: r["n"] for r in rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()}
    return PageIndex(rows, tuple(sorted(counts.items(), reverse=True)))

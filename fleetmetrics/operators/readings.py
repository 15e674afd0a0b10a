"""Queries on readings: filters, newest and oldest rows, pages, the long/wide bridge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import telemetry_id
from ..functions.parsing import rfc3339
from ..schemas import ATTRIBUTES, IDENTITY, METRICS
from ..session import instant, instant_for, utc

# Exporter names of the metrics a wide reading has.
METRIC_MAP = {
    "DCGM_FI_DEV_GPU_UTIL": "gpu_utilization",
    "DCGM_FI_DEV_MEM_COPY_UTIL": "memory_utilization",
    "DCGM_FI_DEV_MEM_UTIL": "memory_utilization",
    "DCGM_FI_DEV_FB_USED": "memory_used_mb",
    "DCGM_FI_DEV_FB_FREE": "memory_free_mb",
    "DCGM_FI_DEV_GPU_TEMP": "temperature",
    "DCGM_FI_DEV_POWER_USAGE": "power_draw",
    "DCGM_FI_DEV_SM_CLOCK": "sm_clock_mhz",
    "DCGM_FI_DEV_MEM_CLOCK": "memory_clock_mhz",
}

# The columns of an answer row, in order.
API_COLUMNS = ("timestamp", "gpu_id", "hostname", *METRICS)


def match_gpu(df: DataFrame, gpu: str, exact: bool = False) -> DataFrame:
    """Readings whose GPU id or UUID equals or contains ``gpu``, case-sensitively.

    ``exact=True`` asks for equality, which parquet statistics can prune on.
    """

    def hit(column: str) -> Column:
        col = F.col(column)
        return col == gpu if exact else (col != "") & col.contains(gpu)

    return df.filter(hit("gpu_id") | hit("uuid"))


#: The most ids that a text is resolved to; a text that more GPUs contain is searched for in the rows.
RESOLVED_IDS = 1000


def match_known_gpu(df: DataFrame, known: DataFrame, gpu: str) -> DataFrame:
    """:func:`match_gpu`, with the text resolved to ids first, which prune the files of ``df``.

    ``known`` has every ``gpu_id`` and ``uuid`` that ``df`` has, as the registry's
    sightings do, and far fewer rows. Of it only the matching ids are read, at
    most RESOLVED_IDS of each kind; where there are more, the rows are searched.
    """

    def matching(column: str) -> list[str]:
        hit = (F.col(column) != "") & F.col(column).contains(gpu)
        return [r[0] for r in known.filter(hit).select(column).distinct().limit(RESOLVED_IDS + 1).collect()]

    ids, uuids = matching("gpu_id"), matching("uuid")
    if max(len(ids), len(uuids)) > RESOLVED_IDS:
        return match_gpu(df, gpu)
    return df.filter(F.col("gpu_id").isin(ids) | F.col("uuid").isin(uuids))


def time_range(
    df: DataFrame, start: datetime | str | None = None, end: datetime | str | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Rows whose whole second lies between ``start`` and ``end``, both included.

    Written as plain bounds on ``ts`` so that they reach the reader; where the
    table has ``event_date`` partitions the same bounds prune those.
    """
    dated = "event_date" in df.columns
    if start is not None:
        moment = utc(start)
        low = moment.replace(microsecond=0)
        if low < moment:
            low += timedelta(seconds=1)
        df = df.filter(F.col(ts) >= instant_for(df, ts, low))
        df = df.filter(F.col("event_date") >= F.lit(low.date())) if dated else df
    if end is not None:
        high = utc(end).replace(microsecond=0) + timedelta(seconds=1)
        df = df.filter(F.col(ts) < instant_for(df, ts, high))
        df = df.filter(F.col("event_date") <= F.lit(utc(end).date())) if dated else df
    return df


#: Up to how many rows one task picks the first ones of a table.
FIRST_ROWS = 100_000

#: Rows sampled, and bounds taken from them, to find where the first rows of a table end.
_SAMPLED, _BOUNDS = 4000, 32


def _first_rows(df: DataFrame, order: Sequence[Column], limit: int, descending: bool) -> DataFrame:
    """The first ``limit`` rows by ``order``, in that order: NULLs first, or last if ``descending``.

    Spark picks the first rows in one task, which reads as many from every other.
    So of more than FIRST_ROWS only the last few are picked: bounds from a sample
    part the rows, exact counts say between which two bounds the limit lies, and
    those between are parted again until they are few. Rows before them are all
    wanted and need no picking. Rows that agree in all of ``order`` stay together.
    """
    arranged = [c.desc() if descending else c.asc() for c in order]
    if limit <= FIRST_ROWS:
        return df.orderBy(*arranged).limit(limit)
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    # A place is compared as a whole, with its NULLs before any value.
    placed = df.withColumn("_place", place)
    kind = placed.schema["_place"].dataType
    before = lambda bound: F.col("_place") > bound if descending else F.col("_place") < bound

    def literal(row) -> Column:
        return F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind.fields)])

    first, last, sure, inside = None, None, 0, placed.count()
    if inside <= limit:
        return df.orderBy(*arranged)

    def between(start: Column | None, end: Column | None) -> DataFrame:
        found = placed if start is None else placed.filter(~before(start))
        return found if end is None else found.filter(before(end))

    while inside > FIRST_ROWS and sure < limit:
        band = between(first, last)
        sample = band.sample(min(1.0, _SAMPLED / inside), 7).select("_place.*").orderBy(
            *[F.desc(f.name) if descending else F.asc(f.name) for f in kind.fields]
        ).collect()
        picked = list(dict.fromkeys(sample[len(sample) * i // _BOUNDS] for i in range(1, _BOUNDS) if sample))
        bounds = [literal(row) for row in picked]
        counts = band.agg(*[F.count_if(before(b)).alias(f"n{i}") for i, b in enumerate(bounds)]).first() if bounds else ()
        # Between the last bound with at most the wanted rows before it, and the next.
        at = sum(n <= limit - sure for n in counts)
        done = counts[at - 1] if at else 0
        left = (counts[at] if at < len(counts) else inside) - done
        if left == inside:
            break  # they agree in all of the order, or nearly
        first, last = bounds[at - 1] if at else first, bounds[at] if at < len(counts) else last
        sure, inside = sure + done, left
    picked_last = between(first, last).orderBy(*arranged).limit(limit - sure)
    whole = picked_last if first is None else placed.filter(before(first)).unionByName(picked_last)
    return whole.drop("_place").orderBy(*arranged)


def newest_first(
    df: DataFrame, limit: int | None = None, ts: str = "ts", tie: Sequence[str] = ("seq",)
) -> DataFrame:
    """Rows from the newest whole second on, ``limit`` of them or all; ties by ``tie``, latest first.

    A limit above FIRST_ROWS counts the rows at once.
    """
    order = [F.date_trunc("second", F.col(ts)), *[F.col(c) for c in tie if c in df.columns]]
    if limit is None:
        return df.orderBy(*[c.desc() for c in order])
    return _first_rows(df, order, limit, descending=True)


def oldest_first(
    df: DataFrame, limit: int = 0, ts: str = "ts", tie: Sequence[str] = ("seq",)
) -> DataFrame:
    """Rows from the oldest on; ``limit`` 0 means all. One above FIRST_ROWS counts the rows at once."""
    order = [F.col(c) for c in (ts, *tie) if c in df.columns or c == ts]
    return _first_rows(df, order, limit, descending=False) if limit > 0 else df.orderBy(*order)


def project_api_row(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The eleven answer fields, time as RFC 3339 text."""
    return df.select(rfc3339(F.col(ts)).alias("timestamp"), *API_COLUMNS[1:])


def filter_readings(
    df: DataFrame, host: str | None = None, gpu: str | None = None,
    start: datetime | str | None = None, end: datetime | str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Readings by host, GPU and time, newest first if a limit is given."""
    if host:
        df = df.filter(F.col("hostname") == host)
    if gpu:
        df = match_gpu(df, gpu)
    df = time_range(df, start, end)
    return newest_first(df, limit) if limit else df


def gpu_metrics(
    df: DataFrame, cluster: str, host: str, gpu: str,
    start: datetime | str | None = None, end: datetime | str | None = None, limit: int = 0,
) -> DataFrame:
    """Points of one exact GPU, oldest first, with time bounds at full precision.

    Where the table has ``event_date`` partitions the bounds prune those too.
    """
    dated = "event_date" in df.columns
    df = df.filter(
        (F.col("cluster_id") == cluster) & (F.col("hostname") == host) & (F.col("gpu_id") == gpu)
    )
    if start is not None:
        df = df.filter(F.col("ts") >= instant_for(df, "ts", start))
        df = df.filter(F.col("event_date") >= F.lit(utc(start).date())) if dated else df
    if end is not None:
        df = df.filter(F.col("ts") <= instant_for(df, "ts", end))
        df = df.filter(F.col("event_date") <= F.lit(utc(end).date())) if dated else df
    return oldest_first(df, limit)


def _order_of(df: DataFrame, order: Sequence[str]) -> Column:
    return F.struct(*[c for c in order if c in df.columns])


_FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def one_number(df: DataFrame, order: Sequence[str]) -> Column | None:
    """(time, whole number) as one decimal of the same order, NULLs first; None for another order."""
    if len(order) != 2 or any(c not in df.columns for c in order):
        return None
    moment, place = (df.schema[c].dataType for c in order)
    if not isinstance(moment, (T.TimestampType, T.TimestampNTZType)) or not isinstance(place, T.IntegralType):
        return None
    # Times of any calendar year have 18 digits; a long, of either sign, spans less than the factor.
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    micros = F.coalesce(F.unix_micros(F.col(order[0]).cast("timestamp")), F.lit(-(10**17) * 9))
    number = F.coalesce(wide(F.col(order[1]), 20), wide(F.lit("-9223372036854775809"), 20))
    return wide(micros, 18) * wide(F.lit("20000000000000000000"), 20) + number


def latest_readings(
    df: DataFrame, keys: Sequence[str] = IDENTITY, order: Sequence[str] = ("ts", "seq"),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The newest row per key. Each task keeps one row per key before the shuffle.

    Ordered by a time and a unique whole number, columns of fixed width are
    picked by hashing, without a sort; other rows are compared as structs.
    """
    rest = [c for c in (columns or df.columns) if c not in keys]
    number = one_number(df, order)
    if number is not None and all(isinstance(df.schema[c].dataType, _FIXED_WIDTH) for c in rest):
        return df.groupBy(*keys).agg(*[F.max_by(c, number).alias(c) for c in rest])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), _order_of(df, order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def upsert_readings(
    df: DataFrame, order: Sequence[str] = ("seq",), within: Sequence[str] = ()
) -> DataFrame:
    """Last write wins per cluster, host, GPU and second.

    ``within`` names columns that follow from these, such as the day; as keys
    they let filters on them through to the table.

    Without the ``order`` columns, the order is event time, ingest time, source
    file and finally the content, so that the outcome never depends on chance.
    """
    keyed = df.withColumn("telemetry_id", telemetry_id())
    keys = ["cluster_id", "hostname", "gpu_id", "telemetry_id", *within]
    rest = [c for c in df.columns if c not in keys]
    known = [c for c in order if c in df.columns]
    if not known:
        comparable = [c for c in rest if not isinstance(df.schema[c].dataType, T.MapType)]
        known = [c for c in ("ts", "ingested_at", "source_file") if c in rest]
        known += [c for c in comparable if c not in known]
    # The rows are sorted by key; numbers that nearly always differ compare faster than the texts do.
    return (
        keyed.groupBy(F.xxhash64(*keys).alias("_hash"), *keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*known)).alias("_row"))
        .select(*keys, "_row.*")
    )


def stamp_lineage(df: DataFrame, collector_id: str, as_of: datetime | str | Column) -> DataFrame:
    """Collection time, collector and batch id; the custom metrics stay, and are an empty map where there are none."""
    now = instant(as_of)
    none = F.create_map().cast("map<string,float>")
    custom = F.coalesce(F.col("custom_metrics"), none) if "custom_metrics" in df.columns else none
    return df.withColumns(
        {
            "custom_metrics": custom,
            "collected_at": now,
            "processed_at": now,
            "collector_id": F.lit(collector_id),
            "batch_id": F.concat(F.lit("batch_"), F.unix_seconds(now).cast("string")),
        }
    )


def long_to_wide(
    df: DataFrame, metric_map: Mapping[str, str] = METRIC_MAP, seq: str = "seq", also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per cluster, host, GPU and second with a column per metric.

    Of several values of a metric in a second the last by ``seq`` counts, without
    such a column the last by time, ingest time, file and value; a metric that
    was not measured is 0. The same order picks the attributes. ``also`` names
    more aggregates of the same rows.
    """
    second = F.date_trunc("second", F.col("ts")).cast(df.schema["ts"].dataType)
    named = {m: [src for src, m2 in metric_map.items() if m2 == m] for m in METRICS}
    if seq in df.columns:
        order = F.col(seq)
    else:
        order = F.struct(
            "_moment", *[c for c in ("ingested_at", "source_file", "value") if c in df.columns]
        )

    def last(metric: str) -> Column:
        sources = named[metric]
        if not sources:
            return F.lit(0).cast("float").alias(metric)
        mine = F.col("metric_name").isin(sources)
        value = F.when(mine, F.col("value"))
        pick = F.max_by(value, F.when(mine, order))
        return F.coalesce(pick, F.lit(0.0)).cast("float").alias(metric)

    attributes = F.struct(*ATTRIBUTES)
    described = F.max_by(attributes, F.struct(order, attributes))
    more = also or {}
    return (
        df.withColumn("_moment", F.col("ts")).withColumn("ts", second)
        .groupBy(*IDENTITY, "ts")
        .agg(described.alias("_a"), *map(last, METRICS), *[c.alias(n) for n, c in more.items()])
        .select("ts", *IDENTITY, "_a.*", *METRICS, *more)
    )


def wide_to_long(df: DataFrame, metric_map: Mapping[str, str] | None = None) -> DataFrame:
    """One row per metric of each wide row, under its wide name or a mapped one."""
    names = {m: m for m in METRICS} | {m: s for s, m in (metric_map or {}).items()}
    keep = [c for c in ("seq", "ts", *IDENTITY, *ATTRIBUTES) if c in df.columns]
    values = F.array(
        *[
            F.struct(F.lit(names[m]).alias("metric_name"), F.col(m).cast("double").alias("value"))
            for m in METRICS
        ]
    )
    return df.select(*keep, F.inline(values))


def reading_span(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First and last time and the number of rows, per key."""
    return df.groupBy(*keys).agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("record_count"),
    )


@dataclass(frozen=True)
class Page:
    """One page of rows and, as a one-row frame, ``total_count`` and ``has_more``.

    The summary counts the whole selection; it costs a scan only if it is used.
    """

    rows: DataFrame
    summary: DataFrame


def page(df: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> Page:
    total = F.count(F.lit(1))
    return Page(
        rows=df.orderBy(*order).offset(offset).limit(limit),
        summary=df.agg(
            total.alias("total_count"), (total > limit + offset).alias("has_more")
        ),
    )


def page_after(
    df: DataFrame, last_ts: datetime | str, last_seq: int, limit: int
) -> DataFrame:
    """The next rows of :func:`newest_first` after a given row: no offset to skip over.

    Rows are listed by whole second and within it by ``seq``, so a row of the
    same second follows if its ``seq`` is lower, whatever its fraction of a second.
    """
    second = utc(last_ts).replace(microsecond=0)
    begin, end = (instant_for(df, "ts", t) for t in (second, second + timedelta(seconds=1)))
    left = df.filter(F.col("ts") < end).filter((F.col("ts") < begin) | (F.col("seq") < last_seq))
    return newest_first(left, limit)


def union_inputs(*dfs: DataFrame) -> DataFrame:
    """Rows of many inputs in one table; a column an input lacks is NULL there."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out

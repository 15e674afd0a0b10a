"""CSV input. Columns are always bound by header name, never by position.

Files of one folder may have different headers. A first distributed pass reads
no more of a file than its header line. Files whose headers put the wanted
columns in the same places are then read in one scan that names its columns by
position, so no row has to be joined to what is known of its file. Every file is
read whatever its size; only a caller who sets ``max_bytes`` refuses larger ones,
and the manifest then lists these as errors.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parsing as P
from ..schemas import DEFAULT_CLUSTER, METRICS, REQUIRED_COLUMNS
from ..session import instant
from .file_heads import describe_files

_CSV_GLOB = "*.[cC][sS][vV]"

# Where each field of a wide record may be found, in order.
WIDE_ALIASES = {
    "gpu_id": ("gpu_id", "gpu"),
    "uuid": ("uuid",),
    "device": ("device",),
    "model_name": ("modelname", "model_name"),
    "hostname": ("hostname", "host"),
}

# The long format's header names, which are case-sensitive.
LONG_FIELDS = {
    "metric_name": "metric_name",
    "gpu_id": "gpu_id",
    "device": "device",
    "uuid": "uuid",
    "model_name": "modelName",
    "hostname": "Hostname",
    "container": "container",
    "pod": "pod",
    "namespace": "namespace",
}


def select_input_files(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """The ``.csv`` files of at most ``max_bytes`` below a folder; contents are not read."""
    return (
        _binary(spark, path)
        .filter(F.col("length") <= max_bytes)
        .select(
            F.col("_metadata.file_path").alias("source_file"),
            F.col("_metadata.file_name").alias("filename"),
            F.col("length").alias("size"),
            F.col("modificationTime").alias("uploaded_at"),
        )
    )


def _binary(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _CSV_GLOB)
        .load(path)
    )


def _names(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The URIs of the CSV files at the paths, from Spark's listing; none is opened."""
    return _binary(spark, [path] if isinstance(path, str) else list(path)).inputFiles()


def file_headers(spark: SparkSession, path: str | Sequence[str], digest: bool = False) -> DataFrame:
    """Per file: name, size, time and header cells, from its first block; with ``digest`` also the MD5 of all of it."""
    return describe_files(spark, _names(spark, path), digest)


@dataclass(frozen=True)
class Layout:
    """The files that have one header."""

    headers: tuple[str, ...]
    files: tuple[tuple[str, int], ...]  # path and size

    def cells(self, fold_case: bool) -> list[str]:
        return [h.strip(P.WHITESPACE).lower() for h in self.headers] if fold_case else list(self.headers)

    def is_long(self) -> bool:
        return set(LONG_REQUIRED) <= set(self.headers)

    def is_wide(self) -> bool:
        """Whether files that are not long have all required columns and a metric."""
        held = set(self.cells(fold_case=True))
        return not self.is_long() and held >= set(REQUIRED_COLUMNS) and not held.isdisjoint(METRICS)


def layouts(spark: SparkSession, path: str | Sequence[str]) -> list[Layout]:
    """The headers of the files, each with its files.

    The driver holds the name of each file, as Spark's own listing does, and
    each different header once.
    """
    heads = file_headers(spark, path).select("path", "size", "headers").toArrow()
    found: dict[tuple[str, ...], list[tuple[str, int]]] = defaultdict(list)
    for file, size, headers in zip(*(heads.column(i).to_pylist() for i in range(3))):
        found[tuple(headers)].append((file, size))
    return [Layout(headers, tuple(sorted(files))) for headers, files in sorted(found.items())]


def normalise(names: Sequence[str]) -> list[str]:
    return [n.strip().lower() for n in names]


def missing_columns(names: Sequence[str], required: Sequence[str] = REQUIRED_COLUMNS) -> list[str]:
    have = set(normalise(names))
    return [r for r in required if r not in have]


def check_required_columns(
    df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS
) -> None:
    """Raise ValueError naming the required columns the frame lacks."""
    missing = missing_columns(df.columns, required)
    if missing:
        raise ValueError(f"missing required headers: [{' '.join(missing)}]")


#: Files of at least this size are cut into parts, if no field of theirs holds a line break.
SPLIT_BYTES = 128 * 1024 * 1024

#: The most scans that files with different headers are read in; those of still other headers are read in one more.
MAX_SCANS = 64

#: The file a row came from, under a name that no header can have: header cells are trimmed.
_FILE = " file"


def _literal(paths: Iterable[str]) -> list[str]:
    """The paths with their glob characters escaped."""
    return [re.sub(r"([{}\[\]*?\\])", r"\\\1", p) for p in paths]


def _scan(spark: SparkSession, files: Sequence[str], width: int, multi_line: bool) -> DataFrame:
    schema = T.StructType([T.StructField(f" {i}", T.StringType()) for i in range(width)])
    return (
        spark.read.schema(schema)
        .option("header", "true")
        .option("enforceSchema", "true")
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("multiLine", str(multi_line).lower())
        .csv(_literal(files))
        .select("*", F.col("_metadata.file_path").alias(_FILE))
    )


def _with_line_breaks(spark: SparkSession, files: Sequence[str]) -> set[str]:
    """Of large files, those in which a field may hold a line break; found line by line, in parts.

    Such a field begins in a line with an odd number of quotes. Lines that end
    with a carriage return only are not told apart either.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    inner = F.col("value").contains("\r") & ~F.col("value").rlike("\\A[^\r]*\r\\z")
    lines = spark.read.option("lineSep", "\n").text(_literal(files))
    found = lines.where((quotes % 2 == 1) | inner).select(F.col("_metadata.file_path").alias("f")).distinct()
    return {_spelt(unquote(row.f)) for row in found.collect()}


def _spelt(path: str) -> str:
    """One spelling of a decoded path: one slash before a local one."""
    return re.sub("^file:/+", "file:/", path)


def _cells(spark: SparkSession, files: Sequence[tuple[str, int]], width: int, multi_line: bool) -> DataFrame:
    """The fields of the files by position; large files are split where their lines are whole records."""
    small = [path for path, size in files if not multi_line or size < SPLIT_BYTES]
    large = [path for path, size in files if multi_line and size >= SPLIT_BYTES]
    broken = _with_line_breaks(spark, large) if large else set()
    whole = small + [path for path in large if _spelt(path) in broken]
    split = [path for path in large if _spelt(path) not in broken]
    parts = [(whole, multi_line), (split, False)]
    return reduce(DataFrame.unionAll, [_scan(spark, paths, width, how) for paths, how in parts if paths])


def read_cells_by_name(
    spark: SparkSession, path: str | Sequence[str], names: Sequence[str], *, fold_case: bool,
    required: Sequence[str] = (), any_of: Sequence[str] = (), multi_line: bool = True,
    files: Sequence[Layout] | None = None, others: bool = False,
) -> DataFrame:
    """The named fields as text, plus ``source_file``; a field the file does not have is NULL.

    With ``others`` the fields of all other header names are added as a map
    ``others``, if any file has such; blank names are left out.

    Every row is bound by the header of its own file, of which two equal names
    count as the last; other columns are not looked at, whatever their names.
    ``files`` is the result of an earlier header pass. A file that lacks a
    required column, or has none of ``any_of``, contributes no rows; if that is
    so of every file, ValueError is raised. With ``multi_line`` a quoted field may
    hold line breaks.
    """
    known = layouts(spark, path) if files is None else files
    places: dict[_Places, list[tuple[str, int]]] = defaultdict(list)
    for layout in known:
        cells = layout.cells(fold_case)
        if set(required) <= set(cells) and (not any_of or set(any_of) & set(cells)):
            last = {cell: i for i, cell in enumerate(cells)}
            more = sorted((n, i) for n, i in last.items() if n and n not in names) if others else ()
            places[_Places(tuple(last.get(n, -1) for n in names), tuple(more))] += layout.files
    if not places:
        first = min(known, key=lambda one: one.files[0], default=None)
        missing = missing_columns(first.headers if first else [], required) or list(any_of)
        raise ValueError(f"missing required headers: [{' '.join(missing)}]")
    by_size = sorted(places.items(), key=lambda one: (-len(one[1]), one[0]))
    scans = []
    for at, own in by_size[:MAX_SCANS]:
        cells = _cells(spark, own, at.width(), multi_line)
        fields = [F.col(f"` {i}`") if i >= 0 else F.lit(None).cast("string") for i in at.named]
        more = [F.create_map(*[c for n, i in at.others for c in (F.lit(n), F.col(f"` {i}`"))])] if at.others else []
        scans.append(cells.select(
            *[c.alias(n) for c, n in zip(fields, names)], F.col(f"`{_FILE}`").alias("source_file"),
            *[c.alias("others") for c in more],
        ))
    if rest := by_size[MAX_SCANS:]:
        scans.append(_bound_by_file(spark, rest, names, multi_line))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


@dataclass(frozen=True, order=True)
class _Places:
    """Where in a file's rows the wanted names stand, -1 for none, and where the others do."""

    named: tuple[int, ...]
    others: tuple[tuple[str, int], ...] = ()

    def width(self) -> int:
        return max([*self.named, *(i for _, i in self.others)]) + 1


def _bound_by_file(
    spark: SparkSession, rest: Sequence[tuple[_Places, Sequence[tuple[str, int]]]], names: Sequence[str],
    multi_line: bool,
) -> DataFrame:
    """The named fields of files of many layouts, each row bound by what its file's name is joined to."""
    width = max(at.width() for at, _ in rest)
    notes = spark.createDataFrame(
        [
            (_spelt(path), list(at.named), [n for n, _ in at.others], [i for _, i in at.others])
            for at, own in rest for path, _ in own
        ],
        "_path string, _at array<int>, _others array<string>, _others_at array<int>",
    )
    cells = _cells(spark, [file for _, own in rest for file in own], width, multi_line)
    own_name = F.regexp_replace(F.url_decode(F.replace(F.col(f"`{_FILE}`"), F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    bound = cells.withColumn("_path", own_name).join(notes, "_path")
    row = F.array(*[F.col(f"` {i}`") for i in range(width)])
    return bound.select(
        *[F.when(F.col("_at")[i] >= 0, F.get(row, F.col("_at")[i])).alias(n) for i, n in enumerate(names)],
        F.col(f"`{_FILE}`").alias("source_file"),
        *(
            [F.map_from_arrays("_others", F.transform("_others_at", lambda i: F.get(row, i))).alias("others")]
            if any(at.others for at, _ in rest) else []
        ),
    )


def _or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _or_blank(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit("")) if name in df.columns else F.lit("")


def parse_wide(
    df: DataFrame, as_of: datetime | str, timestamp_mode: str = "event",
    cluster_id: str = DEFAULT_CLUSTER,
) -> DataFrame:
    """Text rows of the wide format as readings, with ``reject_reason`` where invalid.

    ``timestamp_mode='processing'`` stamps every row with ``as_of`` instead of
    its own timestamp column.
    """
    now = instant(as_of)
    # Fields are cut out and trimmed once; parsing below refers to them by name.
    texts = df.select(
        P.trim_space(_or_null(df, "timestamp")).alias("timestamp"),
        *[
            P.first_non_empty(*[F.col(a) for a in aliases if a in df.columns]).alias(field)
            for field, aliases in WIDE_ALIASES.items()
        ],
        *[P.trim_space(_or_null(df, m)).alias(m) for m in METRICS],
        "source_file",
        *(["others"] if "others" in df.columns else []),
    )
    custom = [_numbers("others").alias("custom_metrics")] if "others" in df.columns else []
    ts = now if timestamp_mode == "processing" else P.parse_ts(F.col("timestamp"), now)
    return texts.select(
        ts.alias("ts"),
        F.lit(cluster_id).alias("cluster_id"),
        *WIDE_ALIASES,
        *[P.finite32_or_zero(F.col(m)).alias(m) for m in METRICS],
        now.alias("ingested_at"),
        "source_file",
        F.when((F.col("gpu_id") == "") | (F.col("hostname") == ""), "missing required fields")
        .when(P.any_not_finite(*map(F.col, METRICS)), "metric is not a finite number")
        .alias("reject_reason"),
        *custom,
    )


def _numbers(fields: str) -> Column:
    """Those of a map of texts that are finite 32-bit numbers."""
    largest = F.lit(3.4028234663852886e38)
    whole = F.transform_values(fields, lambda _, v: P.trim_space(v).try_cast("double"))
    kept = F.map_filter(whole, lambda _, v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= largest))
    return F.transform_values(kept, lambda _, v: v.cast("float"))


#: The columns of a wide file that count.
WIDE_COLUMNS = tuple(
    dict.fromkeys(["timestamp", *(a for aliases in WIDE_ALIASES.values() for a in aliases), *METRICS])
)


def read_wide_csv(
    spark: SparkSession, path: str | Sequence[str], as_of: datetime | str, *,
    timestamp_mode: str = "event", cluster_id: str = DEFAULT_CLUSTER,
    multi_line: bool = True, files: Sequence[Layout] | None = None, custom_metrics: bool = False,
) -> DataFrame:
    """One row per GPU and moment. Header names are trimmed and lower-cased; of two
    equal names the last wins; rows may be short or long. A file without any
    metric column holds no wide readings and contributes no rows. With
    ``custom_metrics`` the finite numbers under all other names are kept as a map, if
    any file has other names."""
    cells = read_cells_by_name(
        spark, path, WIDE_COLUMNS, fold_case=True, required=REQUIRED_COLUMNS, any_of=METRICS,
        multi_line=multi_line, files=files, others=custom_metrics,
    )
    return parse_wide(cells, as_of, timestamp_mode, cluster_id)


def parse_long(
    df: DataFrame, as_of: datetime | str, timestamp_mode: str = "event",
    cluster_id: str = DEFAULT_CLUSTER,
) -> DataFrame:
    now = instant(as_of)
    ts = now if timestamp_mode == "processing" else P.parse_ts(
        P.clean_field(_or_blank(df, "timestamp")), now
    )
    return df.select(
        ts.alias("ts"),
        F.lit(cluster_id).alias("cluster_id"),
        *[P.clean_field(_or_blank(df, src)).alias(name) for name, src in LONG_FIELDS.items()],
        P.to_float64_or_zero(P.trim_space(_or_blank(df, "value"))).alias("value"),
        P.trim_space(_or_blank(df, "labels_raw")).alias("labels_raw"),
        now.alias("ingested_at"),
        "source_file",
    )


#: The columns of a long file that count, and those by which it is known.
LONG_COLUMNS = ("timestamp", *LONG_FIELDS.values(), "value", "labels_raw")
LONG_REQUIRED = ("metric_name", "value")


def read_long_csv(
    spark: SparkSession, path: str | Sequence[str], as_of: datetime | str, *,
    timestamp_mode: str = "event", cluster_id: str = DEFAULT_CLUSTER,
    multi_line: bool = True, files: Sequence[Layout] | None = None, required: Sequence[str] = (),
) -> DataFrame:
    """One row per metric. Header names are case-sensitive; no row is rejected.

    ``labels_raw`` keeps its quotes, which belong to its own syntax.
    """
    cells = read_cells_by_name(
        spark, path, LONG_COLUMNS, fold_case=False, required=required, multi_line=multi_line, files=files
    )
    return parse_long(cells, as_of, timestamp_mode, cluster_id)


def read_readings_csv(
    spark: SparkSession, path: str | Sequence[str], as_of: datetime | str, *,
    timestamp_mode: str = "event", cluster_id: str = DEFAULT_CLUSTER, multi_line: bool = True,
    custom_metrics: bool = False,
) -> DataFrame:
    """Wide readings of a folder with wide and long files, each by its own header.

    A file with a metric name and a value column is long; its rows become one
    reading per GPU and second. Files of neither form are left out, and an empty
    folder gives no rows; ``ingest_manifest`` tells which files were.
    """
    files = layouts(spark, path)
    how = {"timestamp_mode": timestamp_mode, "cluster_id": cluster_id, "multi_line": multi_line}
    wide, long = [one for one in files if one.is_wide()], [one for one in files if one.is_long()]
    found = []
    if wide:
        found.append(read_wide_csv(spark, path, as_of, files=wide, custom_metrics=custom_metrics, **how))
    if long:
        metrics = read_long_csv(spark, path, as_of, files=long, required=LONG_REQUIRED, **how)
        found.append(_long_as_wide(metrics, as_of))
    if not found:
        nothing = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in (*WIDE_COLUMNS, "source_file")))
        found.append(parse_wide(nothing, as_of, timestamp_mode, cluster_id))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def _long_as_wide(metrics: DataFrame, as_of: datetime | str) -> DataFrame:
    """Long rows as rows of ``parse_wide``, with the greatest file name of the second.

    A value that is not finite counts as not measured; a second with such a value
    is told once as a reject, beside the reading of its other metrics.
    """
    from ..operators.readings import METRIC_MAP, long_to_wide

    names = {**METRIC_MAP, **{m: m for m in METRICS}}
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    values = metrics.withColumn("_bad", bad).withColumn("metric_name", F.when(bad, "").otherwise(F.col("metric_name")))
    wide = long_to_wide(
        values, names,
        also={
            "source_file": F.max("source_file"), "_bad": F.bool_or("_bad"), "_some": F.bool_or(~F.col("_bad")),
        },
    )
    outcomes = F.array_compact(F.array(F.when(F.col("_some"), F.lit(False)), F.when(F.col("_bad"), F.lit(True))))
    return wide.withColumn("_refused", F.explode(outcomes)).select(
        "ts", "cluster_id", *WIDE_ALIASES, *METRICS, instant(as_of).alias("ingested_at"), "source_file",
        F.when((F.col("gpu_id") == "") | (F.col("hostname") == ""), "missing required fields")
        .when(F.col("_refused"), "metric is not a finite number").alias("reject_reason"),
    )


def _no_larger(layout: Layout, max_bytes: int | None) -> Layout:
    return Layout(layout.headers, tuple(f for f in layout.files if max_bytes is None or f[1] <= max_bytes))


def _file_key() -> Column:
    return F.regexp_replace("source_file", "^file:/+", "file:/")


def ingest_manifest(
    spark: SparkSession, path: str, as_of: datetime | str, *, max_bytes: int | None = None,
) -> DataFrame:
    """Per file: id, name, size, MD5, headers, record counts, status and error.

    Files that lack columns, and with ``max_bytes`` those that are larger, are
    listed with status ``error``. The records of a long file are its rows.
    """
    fits = lambda one: one.is_long() or one.is_wide()
    counts = spark.createDataFrame([], "_key string, _processed long, _total long")
    known = [_no_larger(one, max_bytes) for one in layouts(spark, path) if fits(one)]
    for long, read in ((False, read_wide_csv), (True, read_long_csv)):
        chosen = [one for one in known if one.files and one.is_long() == long]
        if not chosen:
            continue
        rows = read(spark, path, as_of, files=chosen)
        good = F.lit(True) if long else F.col("reject_reason").isNull()
        counts = counts.unionByName(
            rows.groupBy(_file_key().alias("_key")).agg(
                F.count_if(good).alias("_processed"), F.count(F.lit(1)).alias("_total")
            )
        )
    names = F.transform("headers", lambda h: F.lower(P.trim_space(h)))
    lacking = F.filter(
        F.array(*map(F.lit, REQUIRED_COLUMNS)), lambda r: ~F.array_contains(names, r)
    )
    is_long = F.array_contains("headers", LONG_REQUIRED[0]) & F.array_contains("headers", LONG_REQUIRED[1])
    no_metric = ~F.arrays_overlap(names, F.array(*map(F.lit, METRICS)))
    missing = (
        F.when(is_long, F.array().cast("array<string>"))
        .when((F.size(lacking) == 0) & no_metric, F.array(F.lit("any metric")))
        .otherwise(lacking)
    )
    refused = F.lit(False) if max_bytes is None else F.col("size") > max_bytes
    checked = (
        file_headers(spark, path, digest=True).withColumn("_missing", missing).withColumn("_refused", refused)
        .withColumn("_key", _file_key())
    )
    bad = (F.size("_missing") > 0) | F.col("_refused")
    total = F.when(bad, 0).otherwise(F.coalesce("_total", F.lit(0)))
    processed = F.when(bad, 0).otherwise(F.coalesce("_processed", F.lit(0)))
    return (
        checked.join(counts, "_key", "left")
        .select(
            F.concat_ws(
                "_",
                (F.unix_micros("uploaded_at") * 1000).cast("string"),
                F.replace("filename", F.lit(" "), F.lit("_")),
            ).alias("file_id"),
            "filename", "source_file", "size", "md5_hash", "headers", "uploaded_at",
            instant(as_of).alias("processed_at"),
            processed.cast("long").alias("record_count"),
            total.cast("long").alias("total_records"),
            (total - processed).cast("long").alias("skipped_records"),
            F.when(bad, "error").otherwise("processed").alias("status"),
            F.when(
                F.col("_refused"), F.concat(F.lit("file is larger than "), F.lit(str(max_bytes)), F.lit(" bytes"))
            ).when(
                bad,
                F.concat(
                    F.lit("missing required headers: ["), F.concat_ws(" ", "_missing"), F.lit("]")
                ),
            ).otherwise("").alias("error"),
        )
    )


def stream_csv_files(
    spark: SparkSession, path: str, *, files_per_trigger: int = 1000, bytes_per_trigger: int | None = None
) -> DataFrame:
    """The paths of files arriving over time below a folder; contents are not read.

    A micro-batch reads its files by :func:`read_readings_csv`, so that each is
    bound by its own header. It admits ``files_per_trigger`` files or, if given,
    files of ``bytes_per_trigger`` together (a larger one alone).
    """
    most = ("maxFilesPerTrigger", files_per_trigger) if bytes_per_trigger is None else (
        "maxBytesPerTrigger", bytes_per_trigger
    )
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option(*most)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _CSV_GLOB)
        .load(path)
        .select("path")
    )

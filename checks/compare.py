"""Run registered queries against their SQL twins: ``python -m checks.compare [sf_dir] [names]``."""

from __future__ import annotations

import sys
import tempfile
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from fleetmetrics.session import CHECKPOINT_CONF, build_session

from .entries import QUERIES
from .oracles import ORACLES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _cell(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "NULL"
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    return repr(value.item()) if hasattr(value, "item") else repr(value)


def rows_of(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    ordered = frame[sorted(frame.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in ordered.itertuples(index=False, name=None))


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return db


def differences(spark: SparkSession, db, name: str, sf_dir: str) -> str | None:
    """What differs between the two results, or None."""
    ours = QUERIES[name](spark, sf_dir).toPandas()
    theirs = db.execute(ORACLES[name]).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} against {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    if not len(ours):
        return "no rows"
    kinds = [
        (c, ours[c].dtype, theirs[c].dtype) for c in sorted(ours.columns)
        if ours[c].dtype.kind != theirs[c].dtype.kind
    ]
    pairs = [(a, b) for a, b in zip(rows_of(ours), rows_of(theirs)) if a != b]
    if pairs:
        return f"{len(pairs)} of {len(ours)} rows differ, first {pairs[0]}"
    return f"types {kinds}" if kinds else None


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(
        "local[8]", **{
            "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            CHECKPOINT_CONF: tempfile.mkdtemp(prefix="compare-"),
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, failed = database(sf_dir), 0
    for name in names or QUERIES:
        began = time.time()
        try:
            found = differences(spark, db, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        failed += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - began:.1f}s {found or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(main(args[0] if args else "/root/testdata/sf0.01", args[1:]))

"""Fixed views over tables: windows of time, lists, aggregates, chunks and guards."""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMELINE = ("time_created", "host", "channel", "event_id", "level_name", "provider_name", "computer", "user_sid", "record_id", "event_data")


class ResultTooLargeError(MemoryError):
    """The result would not fit; read it in chunks."""


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*(F.col(k).asc_nulls_last() for k in keys))


def by_time(df: DataFrame, start=None, end=None, time: str = "time_created", **equal) -> DataFrame:
    """Rows within both bounds, inclusive; equal: columns and the value, or list of values, they must have."""
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(time) <= F.lit(end).cast("timestamp_ntz"))
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return df


def timeline(df: DataFrame, start=None, end=None, host=None, channel=None, event_id=None) -> DataFrame:
    return ordered(by_time(df, start, end, host=host, channel=channel, event_id=event_id).select(*TIMELINE), "time_created")


def full_text(df: DataFrame, text: str, columns: Iterable[str] = ("event_data", "provider_name", "computer")) -> DataFrame:
    """Rows with the text in one of the columns, regardless of case; % and _ in it are wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return df.where(hit)


def summary(df: DataFrame, keys: Iterable[str] = ("host", "channel", "event_id"), time: str = "time_created") -> DataFrame:
    out = df.groupBy(*keys).agg(F.count("*").alias("events"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))
    return out.orderBy(F.col("events").desc(), *(F.col(k).asc_nulls_last() for k in keys))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return ordered(df.select(column).distinct(), column)


def chunks(df: DataFrame, size: int = 100_000) -> Iterator[pd.DataFrame]:
    """Bounded parts of a result in order; an empty result has none. One partition at a time comes to the driver."""
    rows: list = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        rows.append(tuple(r))
        if len(rows) == size:
            yield pd.DataFrame(rows, columns=df.columns)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=df.columns)


def to_csv(df: DataFrame, path: str, size: int = 100_000) -> int:
    """Writes one header and all rows; an empty result gives an empty file. Returns the number of rows."""
    n = 0
    with open(path, "w", newline="", encoding="utf-8") as f:
        for part in chunks(df, size):
            if not n:
                csv.writer(f).writerow(part.columns)
            part.to_csv(f, header=False, index=False)
            n += len(part)
    return n


def estimate(df: DataFrame, sample_rows: int = 2000) -> tuple[int, int]:
    """Exact rows, and bytes guessed from a sample."""
    rows = df.count()
    some = df.limit(sample_rows).toPandas()
    return rows, int(some.memory_usage(deep=True).sum() / max(len(some), 1) * rows)


def to_pandas(df: DataFrame, share: float = 0.25, unknown: int = 200 << 20) -> pd.DataFrame:
    """The whole result, if it takes at most that share of available memory."""
    try:
        with open("/proc/meminfo", encoding="ascii") as f:
            most = share * next(int(x.split()[1]) << 10 for x in f if x.startswith("MemAvailable"))
    except (OSError, StopIteration):
        most = unknown
    if estimate(df)[1] > most:
        raise ResultTooLargeError("result too large; use chunks()")
    return df.toPandas()

"""Casts from text to the canonical types: what cannot be read becomes null, nothing raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schemas import columns

_LIMITS = {"u8": ("smallint", 255), "u32": ("bigint", 2**32 - 1)}


def timestamp(text: Column) -> Column:
    """Time without zone in UTC: an offset or Z is applied, a bad offset gives null, text without a date gives null."""
    t = F.trim(text)
    zoned = t.rlike(r"(?i)(z|[+-]\d{2}:?\d{2})$") & t.rlike(r"\d{2}:\d{2}")
    fixed = F.regexp_replace(F.regexp_replace(t, r"\s*[zZ]$", "Z"), r"([+-]\d{2}):?(\d{2})$", "$1:$2")
    utc = F.to_utc_timestamp(fixed.try_cast("timestamp"), "UTC").cast("timestamp_ntz")
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.when(zoned, utc).otherwise(t.try_cast("timestamp_ntz")))


def cast_to(text: Column, kind: str) -> Column:
    if kind == "ts":
        return timestamp(text)
    if kind in _LIMITS:
        name, most = _LIMITS[kind]
        value = text.try_cast("bigint")
        return F.when(value.between(0, most), value).cast(name)
    plain = {"i32": "int", "i64": "bigint", "f64": "double", "bool": "boolean"}.get(kind)
    return text.try_cast(plain) if plain else text


def cast_columns(df: DataFrame, table: str, batch: str = "", schema_version: int = 1) -> DataFrame:
    """df, all text, as the canonical table: columns in order, missing ones null, run columns set."""
    have = set(df.columns)
    run = {"ingest_batch_id": F.lit(batch), "ingested_at": F.current_timestamp().cast("timestamp_ntz"), "schema_version": F.lit(schema_version).cast("smallint")}
    typed = dict(df.dtypes)
    out = []
    for name, kind in columns(table):
        if name in run:
            c = run[name]
        elif name not in have:
            c = cast_to(F.lit(None).cast("string"), kind)
        else:
            c = cast_to(F.col(name), kind) if typed[name] == "string" else F.col(name)
        out.append(c.alias(name))
    return df.select(*out)

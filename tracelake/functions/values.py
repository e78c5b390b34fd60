"""Scalar expressions: JSON members, URI parts, entropy."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def json_member(column: Column, key: str) -> Column:
    """Text of a top-level member; null for absent, JSON null or malformed JSON. Any key is allowed, none is read as a path."""
    if _PLAIN.fullmatch(key):
        return F.get_json_object(column, f"$['{key}']")
    return F.from_json(column, "map<string,string>")[F.lit(key)]


def uri_parts(uri: Column) -> tuple[Column, Column]:
    """Stem and query: cut at the first question mark; an empty query is null."""
    at = F.instr(uri, "?")
    stem = F.when(at > 0, F.substring(uri, F.lit(1), at - 1)).otherwise(uri)
    return stem, F.when(at > 0, F.nullif(F.substring(uri, at + 1, F.length(uri)), F.lit("")))


def entropy(data: Column) -> Column:
    """Bits of Shannon entropy of the bytes of a text (its UTF-8) or binary; 0 for empty, null for null. The bytes are sorted once, and one pass adds up the runs; no shuffle."""
    raw = F.hex(data.cast("binary"))
    n = (F.length(raw) / 2).cast("int")
    each = F.array_sort(F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(raw, 2 * k - 1, F.lit(2))))
    bits = lambda run: -(run / n) * F.log2(run / n)
    start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        same = acc["last"] == x
        total = F.when(same | (acc["run"] == 0), acc["sum"]).otherwise(acc["sum"] + bits(acc["run"]))
        return F.struct(x.alias("last"), F.when(same, acc["run"] + 1).otherwise(F.lit(1.0)).alias("run"), total.alias("sum"))

    total = F.aggregate(each, start, step, lambda acc: acc["sum"] + bits(acc["run"]) + F.lit(0.0))
    return F.when(data.isNull(), F.lit(None)).when(n > 0, F.abs(total)).otherwise(F.lit(0.0))

"""Relational helpers that plain Spark SQL lacks: as-of join, range join by bins, qualify, top k of a group, files not yet in a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, on: str, by: str, carry: list[str]) -> DataFrame:
    """left with carry of the last right row of its key that is not later. One shuffle on the key and a running last value, no pairs; ties in right go to the
    greatest carried values."""
    r = right.groupBy(by, on).agg(F.max(F.struct(*carry)).alias("_r")).select(by, on, "_r", F.lit(0).alias("_side"))
    marked = left.withColumn("_l", F.struct(*left.columns)).select(by, on, "_l", F.lit(1).alias("_side"))
    both = r.unionByName(marked, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return out.select("_l.*", *(F.col(f"_m.{c}").alias(c) for c in carry))


def range_join(points: DataFrame, spans: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the spans that hold them (inclusive): equi-join on bins of the given width, then the exact test."""
    p = points.withColumn("_bin", F.floor(F.col(value) / width))
    s = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(s, "_bin").where(F.col(value).between(F.col(low), F.col(high))).drop("_bin")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def not_committed(files: DataFrame, ledger: DataFrame, identity: list[str]) -> DataFrame:
    """Files whose identity is not in the ledger."""
    return files.join(ledger.select(*identity), identity, "left_anti")


def positional_join(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Row k of one side with row k of the other, in a given order; the shorter side is filled with nulls. Places are counted in two steps: rows are sorted into ranges, and each
    range adds the number of rows before it, so no task sees a whole side."""
    return _placed(left, left_order).join(_placed(right, right_order), "_place", "full").drop("_place")


def _placed(df: DataFrame, order: str) -> DataFrame:
    ranged = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    own = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row a range: a sort of some hundred numbers.
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return own.join(F.broadcast(before), "_part").withColumn("_place", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")

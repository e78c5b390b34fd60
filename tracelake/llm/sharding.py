"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, in DataFrame operations only.

Rows lie in logical partitions by hash. How many rows each partition gives to each shard is drawn from the multivariate hypergeometric law with the
partitions' counts and the shards' exact sizes as margins, which is the law of a uniform permutation. Each partition permutes its rows and deals them by those
counts; after the exchange each shard permutes again, in blocks of the second random key, so no task sorts a whole shard.

Only the counts of at most MOST partitions come to the driver.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Rows of a logical partition, and partitions at most: beyond 268 million rows the partitions grow instead, so the matrix on the driver stays bounded.
ROWS_EACH, MOST = 8192, 1 << 15


def _ordered(df: DataFrame) -> list:
    """Columns that rows can be ordered by, so that ties of a random key fall the same way each time."""
    return [F.col(c) for c, t in df.dtypes if "map" not in t and "variant" not in t and c not in ("_p", "_k", "_h")]


def matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of partition p for shard s: margins are counts and sizes at most one apart."""
    rng = np.random.default_rng(seed)
    left = np.array([sum(counts) // shards + (s < sum(counts) % shards) for s in range(shards)], np.int64)
    out = []
    for n in counts:
        row, rest, need = [], int(left.sum()), n
        for s in range(shards):  # one margin after the other
            rest -= int(left[s])
            row.append(_draw(rng, int(left[s]), rest, need))
            need -= row[-1]
        left -= np.array(row)
        out.append(row)
    return out


def _log_ratio(a: int, b: int) -> float:
    """log(a! / b!), without the loss that two large logarithms of factorials would have."""
    if a == b:
        return 0.0
    if a < b:
        return -_log_ratio(b, a)
    if a - b <= 64:
        return math.fsum(math.log(k) for k in range(b + 1, a + 1))
    if b < 1000:
        return math.lgamma(a + 1) - math.lgamma(b + 1)
    series = lambda n: 1 / (12 * n) - 1 / (360 * n**3)
    # Stirling's formula for both; (a - b) log b is split off, so nothing large cancels.
    return (a - b) * math.log(b) + ((a + 0.5) * math.log1p((a - b) / b) - (a - b)) + series(a) - series(b)


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn from good + bad are good: the hypergeometric law at any size, by rejection from the hat that bounds every log-concave law around its
    mode (probability at most p * min(1, exp(1 - p * distance)), with p that of the mode)."""
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)

    def log_to_mode(k: int) -> float:
        return -(_log_ratio(k, mode) + _log_ratio(good - k, good - mode) + _log_ratio(n - k, n - mode) + _log_ratio(bad - n + k, bad - n + mode))

    # Any p under that of the mode keeps the bound; the deviation gives one that is near.
    deviation = math.sqrt(n * (good / (good + bad)) * (bad / (good + bad)) * ((good + bad - n) / (good + bad - 1))) if good + bad > 1 else 0.0
    p = 1 / (1 + 4 * deviation)
    wide = 1 + p / 2
    while True:
        if rng.random() <= wide / (1 + wide):
            y, hat = rng.random() * wide / p, 0.0
        else:
            beyond = rng.exponential()
            y, hat = (wide + beyond) / p, -beyond
        k = mode + (round(y) if rng.random() < 0.5 else -round(y))
        if low <= k <= high and math.log(rng.random()) + hat <= log_to_mode(k):
            return k


def shuffle_to_shards(df: DataFrame, key: list[str], shards: int = 24, seed: int = 17) -> DataFrame:
    """df with shard (0 to shards-1, sizes at most one apart, the first ones the larger) and slot (place in the shard, gapless from 0).

    key: columns that tell rows apart; their hash and the seed give the random keys, so reruns agree whatever the layout of the files. Null keys hash like
    any value. Repeated rows are rows of their own; which of two equal rows comes first makes no difference. An empty table gives an empty table. Columns
    named shard or slot are replaced.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    columns = df.columns
    n = df.count()
    parts = int(min(max(n // ROWS_EACH, 8), MOST))
    keyed = df.withColumn("_h", F.xxhash64(F.lit(seed), *key)).withColumn("_p", F.pmod(F.xxhash64(F.lit(seed + 1), *key), F.lit(parts)).cast("int"))
    counts = dict(keyed.groupBy("_p").count().collect())
    drawn = matrix([counts.get(p, 0) for p in range(parts)], shards, seed)
    ends = np.cumsum(np.array(drawn, np.int64).reshape(parts, shards), axis=1).tolist()
    plan = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>")).alias("_p", "_ends"))
    ties = _ordered(keyed)
    dealt = keyed.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy("_h", *ties)))
    # parts x shards numbers: at most MOST x shards x 8 bytes, so the plan is broadcast at any input size.
    dealt = dealt.join(F.broadcast(plan), "_p").withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_k"))).cast("int"))
    blocks = int(min(max(n // shards // ROWS_EACH, 1), MOST))
    dealt = dealt.withColumn("_h", F.xxhash64(F.lit(seed + 2), *key)).withColumn("_b", F.pmod(F.shiftright("_h", 20), F.lit(blocks)).cast("int")).drop("_p", "_k", "_ends")
    dealt = Scratch(spark).save(dealt)
    sizes = dealt.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    before = sizes.select("shard", "_b", (F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    placed = dealt.withColumn("_k", F.row_number().over(Window.partitionBy("shard", "_b").orderBy("_h", *ties))).join(F.broadcast(before), ["shard", "_b"])
    return placed.select(*columns, "shard", (F.col("_before") + F.col("_k") - 1).cast("long").alias("slot"))

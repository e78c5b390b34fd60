"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Targets: sources in order of code point (null last) weigh 3, 1, 2, repeating, and share 150% of all tokens; no source gets more than twice its own, and what is
cut off goes to the others by weight (water filling, in closed form by a running sum over the sources).

Quotas: the total is cut into blocks of equally many tokens; blocks go to the sources by the highest quotients target / (2k - 1). Every source is dealt
into shards of documents by hash, and its quota is apportioned to its shards in the same way, so each (source, shard) has an integer quota.

Selection: in a shard the documents stand in seeded order on one line of tokens. A quota takes the whole line as often as it can and then blocks of the line that
lie evenly from a seeded start. What a document gives is the taken part of its interval, a difference of two closed sums, so no row per block is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
SHARD_TOKENS = 1 << 20


def tokens(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size) with target. One row per source: the windows below sort sources, never documents."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("double")
    s = sizes.withColumn("place", place - 1).withColumn("w", weight).withColumn("cap", MOST * F.col("source_size").cast("double"))
    w = Window.orderBy(F.col("cap") / F.col("w"), "place")
    full = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("rest", F.sum("w").over(w.rowsBetween(0, Window.unboundedFollowing)))
    level = (SHARE * F.sum("source_size").over(full) - F.col("before")) / F.col("rest")
    # The first source, by cap for its weight, that stays under its cap at the level that the sources from it on would have.
    s = s.withColumn("level", F.min(F.when(F.col("cap") >= F.col("w") * level, F.struct(F.col("cap") / F.col("w"), "place", level.alias("level")))).over(full).level)
    return s.select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * F.col("level"), F.col("cap"))).alias("target"))


def apportion(shares: DataFrame, by: list[str], key: list[str], share: str, total: Column) -> DataFrame:
    """shares with seats: `total` seats of each group `by` by Sainte-Lague over `share`, ties to the smaller key.

    Every party's seats are share / d rounded, for one divisor d. As n parties round off by a half at most, d lies between sum / (total + n / 2) and
    sum / (total - n / 2), so a party with the part p of the sum has seats between p * (total - n / 2) - 1/2 and p * (total + n / 2) + 1/2. Only the quotients between
    are ranked: about six for each party on average, whatever the total and the number of parties.
    """
    every = [F.lit(0)] if not by else by
    w = Window.partitionBy(*every)
    s = shares.withColumn("_total", total).withColumn("_sum", F.sum(share).over(w)).withColumn("_n", F.count("*").over(w))
    s = s.withColumn("_part", F.when(F.col("_sum") > 0, F.col(share) / F.col("_sum")).otherwise(F.lit(0.0)))
    s = s.withColumn("_low", F.greatest(F.floor(F.col("_part") * (F.col("_total") - F.col("_n") / 2) - 0.5) - 1, F.lit(0)).cast("long"))
    s = s.withColumn("_high", (F.ceil(F.col("_part") * (F.col("_total") + F.col("_n") / 2) + 0.5) + 1).cast("long"))
    s = s.withColumn("_open", F.col("_total") - F.sum("_low").over(w))
    tried = s.select(*by, *key, "_open", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"), F.col(share).alias("_share"))
    rank = F.row_number().over(Window.partitionBy(*every).orderBy((F.col("_share") / (2 * F.col("_k") - 1)).desc(), *[F.col(c).asc_nulls_last() for c in key]))
    won = tried.where("_share > 0").withColumn("_r", rank).where("_r <= _open").groupBy(*by, *key).agg(F.count("*").alias("_won"))
    same = None
    for c in [*by, *key]:
        one = F.col(f"s.{c}").eqNullSafe(F.col(f"w.{c}"))
        same = one if same is None else same & one
    return s.alias("s").join(won.alias("w"), same, "left").select("s.*", (F.col("s._low") + F.coalesce("w._won", F.lit(0))).alias("seats")).drop("_total", "_sum", "_n", "_part", "_low", "_high", "_open")


def _upto(x: Column, block: int) -> Column:
    """Tokens of the first x on a line that the evenly spread blocks take: _take of _blocks, from _phase."""
    k = F.floor(x / block)
    picked = lambda j: F.floor((j * F.col("_take") + F.col("_phase")) / F.col("_blocks"))
    return picked(k) * block + F.when(picked(k + 1) > picked(k), x - k * block).otherwise(F.lit(0))


def mix(docs: DataFrame, block_tokens: int = 8, seed: int = 23) -> DataFrame:
    """docs' doc_id, source, with size, source_size, target (of its source), taken (tokens the mix takes, repeats counted; at most 2 sizes).

    Null or blank texts have size 0 and give 0. A null source is a source of its own, last in order. Repeated rows each have their own place. An empty table
    gives an empty table. Other columns are not read. The seed and doc_id, source and size order the documents, so reruns agree.
    """
    d = Scratch(docs.sparkSession).save(docs.select("doc_id", "source", tokens(F.col("text")).alias("size")))
    per = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")))
    per = apportion(per, [], ["source"], "target", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_tokens).cast("long"))
    per = per.withColumn("_shards", F.ceil((F.col("source_size") + 1) / SHARD_TOKENS)).withColumnRenamed("source", "_source")
    dealt = d.join(per, d.source.eqNullSafe(per._source)).drop("_source")
    dealt = dealt.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("_shards")).cast("long"))
    lines = dealt.groupBy("source", "_shard").agg(F.sum("size").alias("_line"), F.first("seats").alias("_quota"))
    lines = apportion(lines, ["source"], ["_shard"], "_line", F.col("_quota"))
    blocks = F.greatest(F.ceil(F.col("_line") / block_tokens), F.lit(1))
    lines = lines.select(F.col("source").alias("_source"), F.col("_shard").alias("_s"), blocks.alias("_blocks"), F.least("seats", MOST * blocks).alias("_seats"))
    lines = lines.select("_source", "_s", "_blocks", F.floor(F.col("_seats") / F.col("_blocks")).alias("_whole"), F.pmod("_seats", "_blocks").alias("_take"), F.pmod(F.xxhash64(F.lit(seed + 1), "_source", "_s"), "_blocks").alias("_phase"))
    end = F.sum("size").over(Window.partitionBy("source", "_shard").orderBy(F.xxhash64(F.lit(seed + 2), "doc_id", "size"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("_end", end).join(lines, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_shard") == F.col("_s")))
    taken = F.col("_whole") * F.col("size") + _upto(F.col("_end"), block_tokens) - _upto(F.col("_end") - F.col("size"), block_tokens)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))

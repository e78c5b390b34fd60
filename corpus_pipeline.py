"""A corpus pipeline of five stages. Each takes (spark, docs, sf_dir) and returns the documents that it keeps; the last adds shard and slot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.llm import decontam, jaccard, mixing, sharding, toxicity
from tracelake.llm.common import Scratch, bucket_of, table, temporary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score under 0.5. Labels teach the grammar as in the query of its own; null and empty texts stay."""
    learned = toxicity.learn(docs, table(spark, sf_dir, "labels"), bucket_of("doc_id", 5) != 0)
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return toxicity.score(docs, *learned, keep=tuple(docs.columns), name=name).where(F.col(name) < 0.5).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id."""
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, re-parameterised or not."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole documents: each source's quota takes its documents as often as it can, and then those at the front of a seeded
    line whose middle lies within the rest, so a line's words are off by half a document at most. Long sources have several lines. Documents without words count
    nothing in the mix and stay once."""
    taken = mixing.mix(docs)
    lines = F.ceil((F.col("source_size") + 1) / mixing.SHARD_TOKENS)
    taken = taken.withColumn("_line", F.pmod(F.xxhash64(F.lit(31), "doc_id", "size"), lines))
    line = Window.partitionBy("source", "_line")
    taken = taken.withColumn("_words", F.sum("size").over(line)).withColumn("_quota", F.sum("taken").over(line))
    end = F.sum("size").over(line.orderBy(F.xxhash64(F.lit(32), "doc_id", "size"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    middle = end - F.col("size") / 2
    whole = F.floor(F.col("_quota") / F.col("_words"))
    more = (middle < F.col("_quota") - whole * F.col("_words")).cast("int")
    times = F.when(F.col("size") > 0, whole + more).otherwise(F.lit(1)).cast("int")
    taken = taken.withColumn("_times", times).groupBy("doc_id").agg(F.max("_times").alias("_times"))
    times = taken.select(F.col("doc_id").alias("_id"), "_times")
    joined = docs.join(times, F.col("doc_id").eqNullSafe(F.col("_id")))
    return joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col("_times")))).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row in one of 24 shards whose counts differ by one at most, and its place there."""
    return sharding.shuffle_to_shards(docs, ["doc_id", "n_chars", "source"], 24)


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix_sources), ("sharding", shard)]

#: Learned weights, components and seeded choices are not expressible in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with temporary():
            out = scratch.save(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = out
    return STAGES[-1][1](spark, docs, sf_dir)

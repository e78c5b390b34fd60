from pyspark.sql import functions as F

import corpus_pipeline
from tracelake.llm import mixing

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "shard", "slot"]
    rows = out.select("doc_id", "shard", "slot").collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
    sizes = {s: sorted(r.slot for r in rows if r.shard == s) for s in {r.shard for r in rows}}
    assert all(x == list(range(len(x))) for x in sizes.values()) and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1


def test_small_sources_stay_in_the_mix(spark):
    """Each source's words come within a document of its target, whatever its size."""
    rows = [(100 * s + k, "w " * (20 + k), f"s{s:02}") for s in range(30) for k in range(4 if s else 90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = {r.source: r.n for r in corpus_pipeline.mix_sources(spark, docs, SF).groupBy("source").agg(F.sum(mixing.tokens(F.col("text"))).alias("n")).collect()}
    for r in mixing.mix(docs).select("source", "target").distinct().collect():
        assert abs(words.get(r.source, 0) - r.target) <= 60 + 24
    assert len(words) == 30

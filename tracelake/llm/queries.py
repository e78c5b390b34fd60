"""The thin opN queries over whole tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, jaccard, langid, licenses, mixing, passages, sharding, substrings, topk, toxicity
from .common import Scratch, bucket_of, table


def held_out(column: str, modulus: int, rest: int) -> Column:
    """Whether the row's fold is held out; rows without doc_id are of no fold: neither learned from nor held out."""
    return F.coalesce(bucket_of(column, modulus) == rest, F.lit(False)).alias("held_out")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP6_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents WHERE doc_id IS NOT NULL
), places AS (
  SELECT doc_id, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM words
), sets AS (
  SELECT DISTINCT doc_id, hash(w[i:i + 4]) AS s FROM places
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= 75 * (p.n + q.n - common)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(a, b) AS (
  SELECT DISTINCT doc_id, doc_id FROM words UNION SELECT a, y FROM reach JOIN edges ON b = x
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM least LEFT JOIN sizes USING (doc_id)
"""


def op1_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = toxicity.learn(docs, table(spark, sf_dir, "labels"), bucket_of("doc_id", 5) != 0)
    out = toxicity.score(docs, *learned)
    return out.select("doc_id", held_out("doc_id", 5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_rank_order_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.profiles(docs, bucket_of("doc_id", 3) != 1))
    return out.select("doc_id", held_out("doc_id", 3, 1), "lang_pred", "score")


def op5_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP5_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
), parts AS (
  SELECT rid, vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM rows
), whole AS (
  SELECT rid, vec_id, i, floor(256 * x)::BIGINT AS v FROM parts
  WHERE rid NOT IN (SELECT rid FROM parts WHERE x IS NULL OR isnan(x) OR isinf(x))
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, q.rid, c.rid, sum(q.v * c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL
), scored AS (
  SELECT query_id, vec_id, max(score) AS score FROM pairs GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    d = Scratch(spark).save(d.select("doc_id", size.alias("size"), crc.alias("text_crc32")))
    out = sharding.shuffle_to_shards(d, ["doc_id", "text_crc32", "size"], 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sainte_lague_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


OP10_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, hex(coalesce(text, '')) AS h FROM documents
), starts AS (
  SELECT rid, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM docs WHERE length(h) >= 400
), grams AS (
  SELECT rid, i, hash(substr(h, 2 * i + 1, 400)) AS g FROM starts
), twice AS (
  SELECT rid, i FROM grams JOIN (SELECT g FROM grams GROUP BY g HAVING count(*) > 1) USING (g)
), runs AS (
  SELECT rid, i, sum(CASE WHEN i <= last + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -1000) AS last FROM twice)
), spans AS (
  SELECT rid, run, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY ALL
), pieces AS (
  SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS low, a AS high FROM spans
  UNION ALL SELECT rid, coalesce(max(b), 0), NULL FROM docs LEFT JOIN spans USING (rid) GROUP BY rid
), kept AS (
  SELECT rid, string_agg(CASE WHEN high IS NULL THEN substr(h, 2 * low + 1) ELSE substr(h, 2 * low + 1, 2 * (high - low)) END, '' ORDER BY low) AS k FROM pieces JOIN docs USING (rid) GROUP BY rid
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, ((length(h) - length(k)) // 2)::BIGINT AS n_removed, (SELECT count(*) FROM spans s WHERE s.rid = docs.rid)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM docs JOIN kept USING (rid)
"""

QUERIES = {
    "op1_toxicity_grammar": op1_toxicity_grammar,
    "op2_license_scan": op2_license_scan,
    "op3_hypergeometric_sharding": op3_hypergeometric_sharding,
    "op4_rank_order_language_id": op4_rank_order_language_id,
    "op5_segment_top_k": op5_segment_top_k,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_sainte_lague_mixing": op7_sainte_lague_mixing,
    "op8_template_decontamination": op8_template_decontamination,
    "op9_compact_windows": op9_compact_windows,
    "op10_suffix_dedup": op10_suffix_dedup,
}
ORACLES: dict[str, str] = {"op5_segment_top_k": OP5_SQL, "op6_ngram_jaccard_join": OP6_SQL, "op10_suffix_dedup": OP10_SQL}

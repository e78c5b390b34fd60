"""Exact top-k inner products by multi-resolution segment statistics.

Vectors become integers floor(256 x). For a query q and a candidate c, |q - c|^2 = |q|^2 + |c|^2 - 2 q.c, so a lower bound of the distance is an upper bound of the
score. Vectors are turned into an orthogonal basis in which few components hold most of their energy, learned from a bounded sample (turning changes no inner product);
each is cut into segments, and a segment is summed up by its mean and deviation: q.c is at most the sum over segments of
length * (mean_q * mean_c + dev_q * dev_c). Bounds are computed coarse to fine; a candidate whose bound lies under the k-th best exact score found so far is dropped at
that level, and only survivors of all levels get exact integer scores.

Queries are taken in blocks of bounded size, and each block is sent to all partitions; only k rows a query and partition are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

BLOCK = 4096
#: Components of a segment, level by level.
LENGTHS = (16, 4, 2)
#: Candidates that are bounded together, and pairs whose exact scores are computed together.
GROUP, PAIRS = 512, 1 << 16
#: Vectors that the basis is learned from, at most: those with the smallest hash.
SAMPLE = 2000


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component; null unless all components are finite numbers."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long"))
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(math.inf))
    return F.when(vector.isNotNull() & ~F.exists(vector, odd), whole)


def _summary(x: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """sqrt(length) times mean and deviation of each segment; segments differ by one component at most."""
    cuts = np.linspace(0, x.shape[1], max(1, x.shape[1] // length) + 1).astype(int)
    mean, dev = np.empty((len(x), len(cuts) - 1)), np.empty((len(x), len(cuts) - 1))
    for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        mean[:, j], dev[:, j] = x[:, a:b].mean(1) * (b - a) ** 0.5, x[:, a:b].std(1) * (b - a) ** 0.5
    return mean, dev


def basis(x: np.ndarray) -> np.ndarray:
    """Orthogonal columns, those that hold most of the energy first."""
    return np.linalg.eigh(x.T @ x)[1][:, ::-1] if len(x) else np.eye(x.shape[1])


def survivors(q: np.ndarray, c: np.ndarray, told: list, turned: np.ndarray, least: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of the pairs (q, c) (places of queries and candidates) those left after each level. told: the queries' summaries; turned: the candidates in the basis; least: the score
    that each query's candidates have to reach."""
    out = []
    for (mean, dev), length in zip(told, LENGTHS, strict=True):
        if len(q):
            cm, cd = _summary(turned, length)
            bound = (mean @ cm.T + dev @ cd.T)[q, c]
            # Rounding of bounds must drop nothing.
            stay = bound >= least[q] - 1e-9 * (np.abs(bound) + np.abs(np.where(np.isfinite(least[q]), least[q], 0))) - 1
            q, c = q[stay], c[stay]
        out.append((q, c))
    return out


def _exact(q: np.ndarray, c: np.ndarray, qv: np.ndarray, cv: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs. Doubles hold them exactly below 2^53; beyond, integers are used."""
    out = np.empty(len(q))
    small = float(np.abs(qv).max(initial=0)) * float(np.abs(cv).max(initial=0)) * qv.shape[1] < 2**53
    if not small:
        qv, cv, out = qv.astype(np.int64), cv.astype(np.int64), np.empty(len(q), np.int64)
    for k in range(0, len(q), PAIRS):
        out[k : k + PAIRS] = np.einsum("ij,ij->i", qv[q[k : k + PAIRS]], cv[c[k : k + PAIRS]])
    return out


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each query, ties to the smaller id; an id counts once, with its best score."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    _, first = np.unique(np.stack([query, ids]), axis=1, return_index=True) if len(query) else (None, np.zeros(0, int))
    first = np.sort(first)
    query, ids, scores = query[first], ids[first], scores[first]
    begin = np.searchsorted(query, query, "left")
    keep = np.arange(len(query)) - begin < k
    return query[keep], ids[keep], scores[keep]


def _search(queries: Callable, bases: Callable, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        qs, turn = queries(), bases()
        told = {n: [_summary(v @ turn[n], length) for length in LENGTHS] if n else [] for n, (_, v) in qs.items()}
        held = {n: (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)) for n in qs}
        least = {n: np.full(len(q), -np.inf) for n, (q, _) in qs.items()}
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            lists = batch.column("v")
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            for n in set(sizes.tolist()) & set(qs):
                qid, qv = qs[n]
                rows = np.flatnonzero(sizes == n)
                for begin in range(0, len(rows), GROUP):
                    some = rows[begin : begin + GROUP]
                    cv = np.stack([values[at[r] : at[r] + n] for r in some])
                    cid = ids[some]
                    q, c = np.nonzero(qid[:, None] != cid[None, :])
                    if n:
                        q, c = survivors(q, c, told[n], cv @ turn[n], least[n])[-1]
                    if not len(q):
                        continue
                    score = _exact(q, c, qv, cv)
                    better = score >= least[n][q]
                    hq, hi, hs = held[n]
                    held[n] = hq, hi, hs = _best(np.concatenate([hq, q[better]]), np.concatenate([hi, cid[c[better]]]), np.concatenate([hs.astype(score.dtype), score[better]]), k)
                    end = np.searchsorted(hq, np.arange(len(qid)), "right")
                    full = end - np.searchsorted(hq, np.arange(len(qid)), "left") == k
                    least[n][full] = hs[end[full] - 1]
        for n, (q, i, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(qs[n][0][q]), pa.array(i), pa.array(s.astype(np.int64))], schema=schema)

    return run


def _by_length(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of each length."""
    lists = rows.column("v").combine_chunks()
    sizes, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at, ids = np.concatenate([[0], np.cumsum(sizes)]), rows.column("vec_id").to_numpy()
    return {int(n): (ids[sizes == n], np.stack([values[at[r] : at[r] + n] for r in np.flatnonzero(sizes == n)])) for n in np.unique(sizes)}


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k highest integer inner products of each query with all other rows; all, if there are fewer.

    Vectors null, or with null or non-finite components, and rows without vec_id take no part. Vectors meet those of their own length only. Ties go to the
    smaller vec_id. Rows that share a vec_id are one item, with the best score that any of its vectors gives; it never meets itself. An empty table gives an
    empty table. Scores are exact below 2^63.
    """
    spark = vectors.sparkSession
    v = Scratch(spark).save(vectors.select("vec_id", quantised(F.col("embedding")).alias("v"), is_query.alias("q")).where("vec_id is not null and v is not null"))
    # SAMPLE vectors: bounded by the parameter. Lengths that the sample lacks keep their own basis.
    sample = _by_length(v.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow())
    n = v.where("q").count()
    blocks = max(1, math.ceil(n / BLOCK))
    found = None
    for b in range(blocks):
        block = v.where("q").where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", "v")
        # About BLOCK queries: bounded by the parameter, whatever the table's size.
        some = _by_length(block.toArrow())
        held = spark.sparkContext.broadcast(some)
        turn = spark.sparkContext.broadcast({m: basis(sample[m][1]) if m in sample else np.eye(m) for m in some})
        part = v.select("vec_id", "v").mapInArrow(_search(lambda held=held: held.value, lambda turn=turn: turn.value, k), "query_id long, vec_id long, score long")
        found = part if found is None else found.unionByName(part)
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Which tokens of which documents occur more than once in the corpus: one shuffle of 8 bytes a token, with no row per token.

Tasks pack (token, place of the document in its batch) into 64 bits, sort them, and send each range of tokens as one binary value. The task that gets a
range counts its tokens and sends back to every batch those that occur at least twice. A token that is frequent inside one batch is counted there and sent
once, so a token that a third of all rows hold costs one entry a batch; its places wait in the batch's own rows.

A batch is known by its task and its place in it. Both follow from the input files, so a task that runs again after a lost executor gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions
from .textkit import TOKEN_BITS, TOKEN_MASK, mix, slices

#: Rows of one batch at most; the last place is kept for tokens that a batch counts itself.
PLACES = (1 << 14) - 1
SHIFT = np.uint64(14)
HOT = 48
#: Tokens of one exchange, and bytes of input files for each range: together they bound a task's memory.
BATCH_TOKENS, RANGE_BYTES = 1_500_000, 4 << 20
RANGE_BITS = 16

PARTS = "part int, uid long, kind int, a binary, b binary, c binary, d binary"
ROWS = "doc_id long, n int, s1 long, s2 long, toks array<long>, dfs array<int>"


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal values in a sorted array."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
    return first, np.diff(np.concatenate([first, [len(x)]]))


def _per_text(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums (modulo 2^64) of each text's values."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[at[1:]] - total[at[:-1]]


class _Batch:
    """Documents gathered until their tokens fill one exchange."""

    def __init__(self, uid: int, distinct: bool):
        self.uid, self.distinct = uid, distinct
        self.ids, self.counts, self.s1, self.s2, self.packed = [], [], [], [], []
        self.rows = self.size = 0
        self.seen: dict[tuple, int] = {}

    def add(self, ids: np.ndarray, tokens: np.ndarray, at: np.ndarray) -> None:
        owner = np.repeat(np.arange(len(ids), dtype=np.uint64), np.diff(at))
        if self.distinct:
            keys = np.unique((owner << np.uint64(TOKEN_BITS)) | tokens)
            owner, tokens = keys >> np.uint64(TOKEN_BITS), keys & TOKEN_MASK
            at = np.searchsorted(owner, np.arange(len(ids) + 1, dtype=np.uint64))
        spread = mix(tokens + np.uint64(1))
        count, s1, s2 = np.diff(at), _per_text(at, spread), _per_text(at, mix(spread ^ np.uint64(0x5DEECE66D)))
        if self.distinct:  # a set that this batch has already is not sent again
            new = np.zeros(len(ids), bool)
            for k, key in enumerate(zip(count.tolist(), s1.tolist(), s2.tolist(), strict=True)):
                new[k] = self.seen.setdefault(key, self.rows + k) == self.rows + k
            keep = new[owner.astype(np.int64)]
            owner, tokens = owner[keep], tokens[keep]
        self.packed.append((tokens << SHIFT) | (owner + np.uint64(self.rows)))
        for to, x in ((self.ids, ids), (self.counts, count), (self.s1, s1), (self.s2, s2)):
            to.append(x)
        self.rows += len(ids)
        self.size += len(tokens)

    def out(self, ranges: int) -> Iterator[dict]:
        packed = np.sort(np.concatenate(self.packed))
        token = packed >> SHIFT
        first, count = _runs(token)
        hot = np.repeat(count >= HOT, count)
        local, once = packed[hot], token[first[count >= HOT]]
        packed = np.sort(np.concatenate([packed[~hot], (once << SHIFT) | np.uint64(PLACES)]))
        cuts = np.searchsorted(packed, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(TOKEN_BITS + 14 - RANGE_BITS) if ranges == 1 << RANGE_BITS else _bounds(ranges))
        join = lambda xs, kind: np.concatenate(xs).astype(kind).tobytes()
        yield {"part": int(mix(np.array([self.uid], np.uint64))[0] % np.uint64(ranges)), "uid": self.uid, "kind": 1, "a": join(self.ids, np.int64) + local.tobytes(), "b": join(self.counts, np.int64), "c": join(self.s1, np.uint64), "d": join(self.s2, np.uint64)}
        for k in range(ranges):
            if cuts[k] < cuts[k + 1]:
                mine = packed[cuts[k] : cuts[k + 1]]
                often = count[count >= HOT][np.searchsorted(once, mine[(mine & np.uint64(PLACES)) == np.uint64(PLACES)] >> SHIFT)]
                yield {"part": k, "uid": self.uid, "kind": 0, "a": mine.tobytes(), "b": often.astype(np.int64).tobytes(), "c": None, "d": None}


def _bounds(ranges: int) -> np.ndarray:
    return np.array([min((k << 64) // ranges, (1 << 64) - 1) for k in range(ranges + 1)], np.uint64)


def _table(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("part", pa.int32()), ("uid", pa.int64()), ("kind", pa.int32()), *((x, pa.binary()) for x in "abcd")])
    return pa.RecordBatch.from_pylist(rows, schema)


def _send(tokenize: Callable, distinct: bool, ranges: int):
    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        held = _Batch(task << 24, distinct)
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                if held.rows + len(ids) > PLACES - 1 or held.size > BATCH_TOKENS:
                    n += 1
                    yield _table(list(held.out(ranges)))
                    held = _Batch((task << 24) + n, distinct)
                held.add(ids.astype(np.int64), *tokenize(part.column("text")))
        if held.rows:
            yield _table(list(held.out(ranges)))

    return run


def _count(batches):
    """Of each range: the tokens that occur at least twice, for each batch that sent them."""
    got: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"]:
                yield _table([r])
            else:
                got.setdefault(r["part"], []).append((r["uid"], r["a"], r["b"]))
    for part in sorted(got):
        rows = got.pop(part)
        blobs = [(uid, np.frombuffer(a, np.uint64)) for uid, a, _ in rows]
        often = np.concatenate([np.frombuffer(b, np.int64) for _, _, b in rows])
        names = np.concatenate([x[(x & np.uint64(PLACES)) == np.uint64(PLACES)] >> SHIFT for _, x in blobs])
        everything = np.sort(np.concatenate([x for _, x in blobs]))
        token = everything >> SHIFT
        first, count = _runs(token)
        df = count.copy()  # an entry stands for one occurrence, or for all of its batch
        np.add.at(df, np.searchsorted(token[first], names), often - 1)
        shared, df = token[first[df > 1]], df[df > 1]
        del everything, token
        for uid, x in blobs:
            t = x >> SHIFT
            k = np.minimum(np.searchsorted(shared, t), max(len(shared) - 1, 0))
            hit = shared[k] == t if len(shared) else np.zeros(len(t), bool)
            if hit.any():
                yield _table([{"part": part, "uid": uid, "kind": 2, "a": x[hit].tobytes(), "b": np.minimum(df[k[hit]], (1 << 31) - 1).astype(np.int32).tobytes(), "c": None, "d": None}])


def _gather(keep_share: float):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("toks", pa.list_(pa.int64())), ("dfs", pa.list_(pa.int32()))])

    def run(batches):
        got: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                got.setdefault(r["uid"], []).append(r)
        for uid in sorted(got):
            rows = got.pop(uid)
            head = next(r for r in rows if r["kind"] == 1)
            count = np.frombuffer(head["b"], np.int64)
            n = len(count)
            ids, local = np.frombuffer(head["a"][: 8 * n], np.int64), np.frombuffer(head["a"][8 * n :], np.uint64)
            packed = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["a"], np.uint64) for r in rows if r["kind"] == 2)])
            df = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r["b"], np.int32) for r in rows if r["kind"] == 2)])
            stands = (packed & np.uint64(PLACES)) == np.uint64(PLACES)
            if len(local):
                order = np.argsort(packed[stands])
                names, known = (packed[stands] >> SHIFT)[order], df[stands][order]
                packed, df = np.concatenate([packed[~stands], local]), np.concatenate([df[~stands], known[np.searchsorted(names, local >> SHIFT)]])
            owner, token = (packed & np.uint64(PLACES)).astype(np.int64), packed >> SHIFT
            order = np.lexsort((token, df, owner))
            owner, token, df = owner[order], token[order].astype(np.int64), df[order].astype(np.int32)
            at = np.searchsorted(owner, np.arange(n + 1))
            enough = (np.diff(at) > 0) & (np.diff(at) >= np.ceil(keep_share * count))
            at32 = np.concatenate([[0], np.cumsum(np.where(enough, np.diff(at), 0))]).astype(np.int32)
            keep = np.repeat(enough, np.diff(at))
            missing = pa.array(~enough)
            lists = [pa.ListArray.from_arrays(pa.array(at32), pa.array(x[keep]), mask=missing) for x in (token, df)]
            whole = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(count.astype(np.int32)), *(pa.array(np.frombuffer(head[x], np.int64)) for x in "cd"), *lists], schema=schema)
            yield from (whole.slice(k, 512) for k in range(0, n, 512))

    return run


def shared_tokens(docs: DataFrame, tokenize: Callable, distinct: bool, keep_share: float = 0.0) -> DataFrame:
    """Returns for each document (doc_id not null): doc_id; n, its number of tokens; s1 and s2, which equal sets of tokens have in common; toks and dfs, its
    tokens that occur at least twice in the corpus, rarest first, with how often (up to 2^31). toks is null where there are none, or
    fewer than keep_share of n, or where the set stands elsewhere in the same batch (distinct).

    tokenize: an Arrow column of texts to (tokens of 50 bits, where each text's begin). distinct: tokens of a document form a set, and frequencies count
    different sets of a batch once; else every occurrence counts.
    """
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    ranges = partitions(docs, RANGE_BYTES)
    sent = docs.mapInArrow(_send(tokenize, distinct, ranges), PARTS)
    counted = sent.repartition(ranges, "part").mapInArrow(_count, PARTS)
    return counted.repartition(ranges, "uid").mapInArrow(_gather(keep_share), ROWS)

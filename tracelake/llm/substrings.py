"""Exact substring dedup over sorted suffixes: common-prefix-aware distributed merge sort.

Every string of LENGTH bytes has one anchor: the place of its smallest GRAM-byte hash. Equal strings have their anchors at equal offsets, so only suffixes that start
at anchors whose gram occurs twice in the corpus can hold repeats; shared_tokens() finds those with 8 bytes an anchor. Tasks sort these suffixes (cut at LENGTH
bytes), front-code the sorted runs (length of the common prefix with the one before, and the rest) and send them by range of the gram. The receiver merges runs with a loser
tree that keeps, for each loser, how much it has in common with the winner it lost to, so no known prefix is compared again. In the merged order the common prefixes
delimit the groups of one gram, and tell which suffixes share how many bytes; the contexts to the left are sorted and compared in the same way. Together they
decide which windows of LENGTH bytes stand twice, and the covered bytes are removed. Hashes only choose anchors.

Contexts that one task holds twice are settled there, and one of them is sent, so a passage that a third of all documents share costs one suffix a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions
from .shared import shared_tokens
from .textkit import BYTE_CODE, MULT, TOKEN_BITS, flat, minimum_runs, mix, slices

LENGTH, GRAM = 200, 32
LEFT = LENGTH - GRAM
#: Suffixes of one run, suffixes checked at once, and bytes of text for each range of the exchange: together they bound a task's memory.
RUN, EVALUATE, RANGE_BYTES = 1 << 14, 2048, 4 << 20
#: Windows (members times offsets) that are looked at together: a gram that very many suffixes share takes more rounds, not more memory for each.
CELLS = 1 << 19

RUNS = "part int, kind int, a binary, b binary, c binary, d binary"
COVERS = "key long, begin long, end long"


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place (those near the end wrap into nothing and are never used)."""
    h, reach, m = BYTE_CODE[data], 1, MULT
    while reach < GRAM:
        h = h[:-reach] * m + h[reach:] if len(h) > reach else h[:0]
        m, reach = m * m, reach * 2
    return mix(h)


def _anchors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of anchors, their grams' tokens, all bytes, and where texts begin."""
    data, at = flat(column)
    with np.errstate(over="ignore"):
        h = _grams(data)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), data, at
    h = np.concatenate([h, np.zeros(GRAM - 1, np.uint64)])
    place, _, _ = minimum_runs_of_bytes(h, at)
    # Anchors have small hashes, so they are mixed again to spread over the ranges.
    return place, mix(h[place]) >> np.uint64(64 - TOKEN_BITS), data, at


def minimum_runs_of_bytes(h: np.ndarray, at: np.ndarray):
    """minimum_runs over the grams of each text: windows of LENGTH bytes hold LEFT + 1 grams."""
    size = np.diff(at)
    keep = np.maximum(size - GRAM + 1, 0)
    inner = np.concatenate([[0], np.cumsum(keep)])
    index = np.arange(int(inner[-1])) + np.repeat(at[:-1] - inner[:-1], keep)
    place, first, last = minimum_runs(h[index], inner, LEFT + 1)
    return index[place] if len(place) else place, first, last


def _tokenize(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    place, token, _, at = _anchors(column)
    return token, np.searchsorted(place, at)


def common(a: bytes, b: bytes, h: int) -> int:
    """Length of the common prefix of a and b, of which h bytes are known."""
    n = min(len(a), len(b))
    while h + 16 <= n and a[h : h + 16] == b[h : h + 16]:
        h += 16
    while h < n and a[h] == b[h]:
        h += 1
    return h


def front_code(strings: list[bytes]) -> tuple[bytes, bytes]:
    """Sorted strings as (prefix in common with the one before, length of the rest) and the rests."""
    heads, rests, before = [], [], b""
    for s in strings:
        h = common(before, s, 0)
        heads.append((h, len(s) - h))
        rests.append(s[h:])
        before = s
    return np.array(heads, np.uint16).tobytes(), b"".join(rests)


def decode(heads: bytes, rests: bytes) -> Iterator[tuple[int, bytes]]:
    """(prefix in common with the one before, string) of a front-coded run."""
    at, before = 0, b""
    for h, n in np.frombuffer(heads, np.uint16).reshape(-1, 2).tolist():
        before = before[:h] + rests[at : at + n]
        at += n
        yield h, before


class LoserTree:
    """Merges sorted runs of (common prefix with the one before, string). Yields (common prefix with the last yielded, string, run, place in run)."""

    def __init__(self, runs: list[Iterator[tuple[int, bytes]]]):
        self.runs, self.k = runs, max(1, len(runs))
        self.now: list[bytes | None] = [None] * self.k
        self.place = [-1] * self.k
        self.known = [0] * self.k
        for r in range(len(runs)):
            self._next(r)
            self.known[r] = 0
        self.tree = [-1] * self.k
        self.top = self._build(1) if self.k > 1 else 0

    def _next(self, r: int) -> None:
        got = next(self.runs[r], None)
        self.known[r], self.now[r] = got if got else (-1, None)
        self.place[r] += 1

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; both knew their prefix in common with the last winner, the loser then knows that with the new one."""
        if self.now[a] is None or self.now[b] is None:
            return (b, a) if self.now[a] is None else (a, b)
        ha, hb = self.known[a], self.known[b]
        if ha != hb:
            return (a, b) if ha > hb else (b, a)
        x, y = self.now[a], self.now[b]
        h = common(x, y, ha)
        if (x[h : h + 1], a) <= (y[h : h + 1], b):
            self.known[b] = h
            return a, b
        self.known[a] = h
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        win, lose = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.tree[node] = lose
        return win

    def __iter__(self):
        while self.runs and self.now[self.top] is not None:
            r = self.top
            yield self.known[r], self.now[r], r, self.place[r]
            self._next(r)
            node = (r + self.k) // 2
            while node >= 1:
                r, self.tree[node] = self._play(r, self.tree[node])
                node //= 2
            self.top = r


def _row(part, kind, *blobs) -> dict:
    return {"part": part, "kind": kind} | dict(zip("abcd", [*blobs, None, None, None, None][:4], strict=True))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int32()), ("kind", pa.int32()), *((x, pa.binary()) for x in "abcd")]))


def _runs(ranges: int):
    """Front-coded sorted runs of suffixes at shared anchors: kind 0. Covered bytes that are certain here: kind 1."""

    def flush(held: dict[tuple[bytes, bytes], list]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        sure = [(key, pos - len(left), pos + len(right)) for (right, left), (_, who) in held.items() if len(who) > 1 and len(left) + len(right) >= LENGTH for key, pos in who]
        if sure:
            yield _batch([_row(int(sure[0][0]) % ranges, 1, np.array(sure, np.int64).tobytes())])
        for (right, left), (token, who) in held.items():
            parts.setdefault(token * ranges >> TOKEN_BITS, []).append((right, left, *who[0], len(who)))
        for part, found in parts.items():
            found.sort()
            heads, rests = front_code([x[0] for x in found])
            lefts = np.array([len(x[1]) for x in found], np.uint8).tobytes() + b"".join(x[1] for x in found)
            yield _batch([_row(part, 0, heads, rests, lefts, np.array([x[2:] for x in found], np.int64).tobytes())])

    def run(batches):
        held: dict[tuple[bytes, bytes], list] = {}
        for batch in batches:
            for part in slices(batch):
                place, token, data, at = _anchors(part.column("text"))
                known = np.unique(pa.compute.list_flatten(part.column("toks")).to_numpy(zero_copy_only=False).astype(np.uint64))
                hit = known[np.minimum(np.searchsorted(known, token), len(known) - 1)] == token if len(known) else np.zeros(len(token), bool)
                place, token, raw = place[hit], token[hit], data.tobytes()
                owner = np.searchsorted(at, place, "right") - 1
                keys = part.column("key").to_numpy(zero_copy_only=False)[owner] if len(owner) else owner
                for p, t, key, a, b in zip(place.tolist(), token.tolist(), keys.tolist(), at[owner].tolist(), at[owner + 1].tolist(), strict=True):
                    held.setdefault((raw[p : min(p + LENGTH, b)], raw[max(p - LEFT, a) : p]), [t, []])[1].append((key, p - a))
                if len(held) > RUN:
                    yield from flush(held)
                    held = {}
        yield from flush(held)

    return run


def _classes(shared: np.ndarray, need: np.ndarray) -> np.ndarray:
    """For each length of `need` (a row) the class of each string of a sorted list, by what it shares with the one before: equal classes, equal prefixes of that length."""
    return np.cumsum(shared[None, :] < need[:, None], axis=1)


def _windows(members: list[tuple]) -> np.ndarray:
    """(key, begin, end) of covered bytes. members: (bytes shared with the member before, right, left, key, place, times), in merged order.

    A window of LENGTH bytes with its anchor at offset o is repeated where two members share LENGTH - o bytes of their suffixes and the o bytes before them.
    The merge knows the first; the second follows from the left contexts, sorted from the anchor outwards and compared byte by byte. No hash decides.
    """
    m = len(members)
    outwards = [x[2][::-1] for x in members]
    order = sorted(range(m), key=outwards.__getitem__)
    shared_left = np.array([0, *(common(outwards[a], outwards[b], 0) for a, b in zip(order, order[1:], strict=False))])
    shared_right = np.array([x[0] for x in members])
    n_left, n_right, times = np.array([len(x[2]) for x in members]), np.array([len(x[1]) for x in members]), np.array([x[5] for x in members])
    dup = np.zeros((m, LEFT + 3), bool)
    rows = max(1, CELLS // m)
    for low in range(0, LEFT + 1, rows):
        offset = np.arange(low, min(low + rows, LEFT + 1))
        left = np.empty((len(offset), m), np.int64)
        left[:, order] = _classes(shared_left, offset)
        key = (_classes(shared_right, LENGTH - offset) * (m + 1) + left) * len(offset) + np.arange(len(offset))[:, None]
        valid = (offset[:, None] <= n_left) & (LENGTH - offset[:, None] <= n_right)
        flat_keys = key[valid]
        place = np.argsort(flat_keys, kind="stable")
        same = np.diff(flat_keys[place]) == 0
        twice = np.zeros(len(place), bool)
        twice[place] = np.concatenate([[False], same])[: len(place)] | np.concatenate([same, [False]])[: len(place)]
        found = valid & (times > 1)
        found[valid] |= twice
        dup[:, 1 + low : 1 + low + len(offset)] = found.T
    begin, end = np.nonzero(dup[:, 1:] & ~dup[:, :-1]), np.nonzero(dup[:, :-1] & ~dup[:, 1:])
    who, low, high = begin[0], begin[1], end[1] - 1
    keys, places = np.array([x[3] for x in members], np.int64), np.array([x[4] for x in members], np.int64)
    return np.stack([keys[who], places[who] - high, places[who] - low + LENGTH], 1)


def _merge(batches):
    """Merged runs of each range; covers of each group of one gram."""
    names = ["key", "begin", "end"]
    emit = lambda x: pa.RecordBatch.from_arrays([pa.array(x[:, j]) for j in range(3)], names=names)
    got: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            if r["kind"]:
                yield emit(np.frombuffer(r["a"], np.int64).reshape(-1, 3))
            else:
                got.setdefault(r["part"], []).append(r)
    for part in sorted(got):
        runs = got.pop(part)
        lefts, metas = [], []
        for r in runs:
            meta = np.frombuffer(r["d"], np.int64).reshape(-1, 3)
            n = len(meta)
            lefts.append((r["c"], n + np.concatenate([[0], np.cumsum(np.frombuffer(r["c"][:n], np.uint8), dtype=np.int64)])))
            metas.append(meta)
        members: list[tuple] = []
        pending: list[tuple] = []

        def close(pending=pending, members=members):
            """A gram that stands once, or whose members all have the same place, repeats nothing here."""
            if len(pending) > 1:
                members.extend(pending)
            pending.clear()

        for h, s, r, k in LoserTree([decode(x["a"], x["b"]) for x in runs]):
            if h < GRAM:
                close()
                if len(members) >= EVALUATE:
                    yield emit(_windows(members))
                    members.clear()
            left, ends = lefts[r]
            pending.append((h, s, left[ends[k] : ends[k + 1]], *metas[r][k].tolist()))
        close()
        if members:
            yield emit(_windows(members))


def _remove(batches):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        for part in slices(batch):
            rows = []
            for doc, text, covers in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "covers")), strict=True):
                raw = (text or "").encode()
                spans: list[list[int]] = []
                for c in sorted((c["begin"], c["end"]) for c in covers or ()):
                    if spans and c[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], c[1])
                    else:
                        spans.append(list(c))
                kept, at = [], 0
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept = b"".join([*kept, raw[at:]])
                rows.append((doc, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the bytes that remain (which need not be whole characters).

    Every byte covered by a string of LENGTH bytes that also starts anywhere else in the input goes, overlaps and repeats in one text included; strings are judged on the
    input. Null texts are empty; shorter texts than LENGTH lose nothing. Rows are told apart by doc_id and text; repeated rows are repeats of each other. An empty
    table gives an empty table. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    d = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    shared = shared_tokens(d.select(F.col("key").alias("doc_id"), "text").where(F.octet_length("text") >= LENGTH), _tokenize, False)
    shared = scratch.save(shared.where("toks is not null").groupBy(F.col("doc_id").alias("key")).agg(F.first("toks").alias("toks")))
    ranges = partitions(docs, RANGE_BYTES)
    hold = d.select("key", "text").join(shared.hint("shuffle_hash"), "key")
    covers = hold.mapInArrow(_runs(ranges), RUNS).repartition(ranges, "part").mapInArrow(_merge, COVERS)
    covers = covers.groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("covers"))
    covers = scratch.save(covers)
    return d.join(covers.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "covers").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

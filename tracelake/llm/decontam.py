"""Benchmark decontamination by template canonicalisation.

Words become template words: numbers (with separators: 1,200 and 2.50), names (capitalised, not all capitals) and units (after a number) turn into typed placeholders,
others are lower-cased. Windows of WIDTH words of the benchmark are hashed and joined with those of every document in three readings: names inside sentences only, names at
sentence starts as well, and plain lower-cased words without placeholders. Matches of one item that lie along the same course in a document make a
candidate; it counts if it holds SHARE percent of the item's windows and its slots are consistent: equal values in the item have equal values in the document.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .textkit import LOWER, flat, shingle_hashes, slices, word_hashes, word_spans

WIDTH, SHARE = 5, 75
#: Benchmark text that one broadcast may hold; a larger benchmark is taken in blocks of items.
BLOCK_BYTES = 16 << 20
#: Matches of windows that are looked at together (one text's at least).
MATCHES = 1 << 20

#: Fixed list of units, as they stand after a number.
UNITS = "mm cm m km in ft yd mi mile miles inch inches foot feet meter meters metre metres kilometer kilometers mg g kg t ton tons lb lbs oz pound pounds gram grams kilogram kilograms ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degrees degree kmh mph".split()

#: `[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]`: letters, digits and all that is not ASCII.
IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
ENDS = np.zeros(256, bool)
ENDS[list(b".!?:;\n\r\"'([{")] = True
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
READINGS = 3
NUMBER, NAME, UNIT = np.uint64(0x1111111111111111), np.uint64(0x2222222222222222), np.uint64(0x3333333333333333)


def _hash_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


UNIT_HASHES = np.sort(np.array([_hash_of(u) for u in UNITS], np.uint64))


def _join_numbers(data: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with runs of digits that one comma or point parts made one word, each text's first word, and which words are numbers."""
    if not len(begin):
        return begin, end, np.searchsorted(begin, at), np.zeros(0, bool)
    digits = np.add.reduceat(DIGIT[data].astype(np.int64), np.stack([begin, end], 1).ravel()[:-1])[::2] == end - begin
    gap = data[np.minimum(end[:-1], len(data) - 1)]
    same = np.searchsorted(at, begin[1:], "right") == np.searchsorted(at, begin[:-1], "right")
    joined = digits[1:] & digits[:-1] & (begin[1:] - end[:-1] == 1) & ((gap == ord(",")) | (gap == ord("."))) & same
    begin, end, digits = begin[np.concatenate([[True], ~joined])], end[np.concatenate([~joined, [True]])], digits[np.concatenate([[True], ~joined])]
    return begin, end, np.searchsorted(begin, at), digits


def template(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Plain word hashes, whether a word is a slot (names inside sentences only; names at sentence starts as well), each text's first word, and windows' hashes by first
    word in each reading."""
    data, at = flat(column)
    low = LOWER[data]
    begin, end, _ = word_spans(data, at, IN_WORD)
    begin, end, first, number = _join_numbers(data, at, begin, end)
    plain = word_hashes(low, begin, end)
    if not len(begin):
        return plain, number, number, first, [plain] * READINGS
    second = data[np.minimum(begin + 1, end - 1)]
    capital = (data[begin] >= 0x41) & (data[begin] <= 0x5A) & ~((second >= 0x41) & (second <= 0x5A))
    stops = np.concatenate([[0], np.cumsum(ENDS[data])])
    opens = np.ones(len(begin), bool)
    opens[1:] = stops[begin[1:]] > stops[end[:-1]]
    opens[first[:-1][first[:-1] < len(begin)]] = True
    after = np.zeros(len(begin), bool)
    after[1:] = number[:-1]
    unit = after & (UNIT_HASHES[np.minimum(np.searchsorted(UNIT_HASHES, plain), len(UNIT_HASHES) - 1)] == plain)
    coded = lambda name: np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, plain)))
    names = capital & ~opens
    windows = [shingle_hashes(codes, first, WIDTH)[0] for codes in (coded(names), coded(capital), plain)]
    return plain, number | names | unit, number | capital | unit, first, windows


def _index(items: list[tuple[int, str]]):
    """For each reading the sorted windows of the benchmark with item and place; of each item its windows, words and slots."""
    plain, slot, loose, first, windows = template(pa.array([t for _, t in items], pa.string()))
    count = np.diff(first)
    made = np.where(count >= WIDTH, count - WIDTH + 1, (count > 0).astype(np.int64))
    item = np.repeat(np.arange(len(items)), made)
    place = np.arange(int(made.sum())) - np.repeat(np.cumsum(made) - made, made)
    orders = [np.argsort(w, kind="stable") for w in windows]
    info = [(i, int(made[k]), *(x[first[k] : first[k + 1]] for x in (plain, slot, loose))) for k, (i, _) in enumerate(items)]
    return [(w[o], item[o], place[o]) for w, o in zip(windows, orders, strict=True)], info


def _course(found: list[tuple[int, int]], need: int, length: int) -> list[tuple[int, int]]:
    """The matches (place in document, place in item) of the course with the most different windows of the item."""
    found.sort(key=lambda x: x[0] - x[1])
    slack, best, low = max(4, length // 4), [], 0
    distinct: dict[int, int] = defaultdict(int)
    for high, (d, i) in enumerate(found):
        distinct[i] += 1
        while found[low][0] - found[low][1] < d - i - slack:
            j = found[low][1]
            distinct[j] -= 1
            if not distinct[j]:
                del distinct[j]
            low += 1
        if len(distinct) > len(best) and len(distinct) >= need:
            best = list({j: x for x in found[low : high + 1] for j in [x[1]]}.values())
    return best


def _consistent(course: list[tuple[int, int]], words: np.ndarray, slots: np.ndarray, loose: np.ndarray, doc: np.ndarray) -> tuple[int, bool]:
    """Slots seen, and whether equal values of the item have equal values in the document (one in ten may differ). A capitalised word at a sentence start counts
    where its value differs."""
    pairs = {(i + k, d + k) for d, i in course for k in range(WIDTH) if i + k < len(words) and d + k < len(doc) and (slots[i + k] or (loose[i + k] and words[i + k] != doc[d + k]))}
    values: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for i, d in pairs:
        values[int(words[i])][int(doc[d])] += 1
    odd = sum(sum(x.values()) - max(x.values()) for x in values.values())
    return len(pairs), odd * 10 <= len(pairs)


def _found(index: list, info: list, column: pa.Array) -> Iterator[tuple[int, int, float, int]]:
    """(place of the text, item_id, share of the item's windows, slots compared) of each text and item that it holds, at most once for each reading."""
    plain, _, _, first, readings = template(column)
    count = np.diff(first)
    made = np.where(count >= WIDTH, count - WIDTH + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(made)])
    for reading, ((windows, item, place), own) in enumerate(zip(index, readings, strict=True)):
        if not len(own) or not len(windows):
            continue
        low, high = np.searchsorted(windows, own, "left"), np.searchsorted(windows, own, "right")
        hit = np.flatnonzero(high > low)
        # Some texts at a time, so that windows which many items share take bounded memory.
        total = np.cumsum(high[hit] - low[hit])
        cuts = np.searchsorted(at, hit, "right") - 1
        begin = 0
        while begin < len(hit):
            end = int(np.searchsorted(total, (total[begin - 1] if begin else 0) + MATCHES, "right"))
            end = int(np.searchsorted(cuts, cuts[max(begin, end - 1)], "right"))  # whole texts
            some = hit[begin:end]
            times = high[some] - low[some]
            entry = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low[some], times)
            owner, where = np.repeat(cuts[begin:end], times), np.repeat(some - at[cuts[begin:end]], times)
            order = np.lexsort((where, item[entry], owner))
            owner, where, entry = owner[order], where[order], entry[order]
            edge = np.flatnonzero((owner[1:] != owner[:-1]) | (item[entry[1:]] != item[entry[:-1]])) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(owner)], strict=True):
                o, (name, n, words, slots, loose) = int(owner[a]), info[item[entry[a]]]
                need = math.ceil(SHARE * n / 100)
                if b - a < need:
                    continue
                course = _course(list(zip(where[a:b].tolist(), place[entry[a:b]].tolist(), strict=True)), need, n)
                if course:
                    seen, fits = _consistent(course, words, slots, loose if reading == 1 else slots, plain[first[o] : first[o + 1]])
                    if fits:
                        yield o, name, len(course) / n, seen
            begin = end


def _match(held):
    names, types = ["doc_id", "item_id", "share", "n_slots"], (pa.int64(), pa.int64(), pa.float64(), pa.int64())

    def run(batches):
        index, info = _index(held())
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id")
                rows = [(ids[o].as_py(), *rest) for o, *rest in _found(index, info, part.column("text"))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def _without(held):
    def run(batches):
        index, info = _index(held())
        for batch in batches:
            for part in slices(batch):
                keep = np.ones(part.num_rows, bool)
                keep[[o for o, *_ in _found(index, info, part.column("text"))]] = False
                yield part.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame) -> Iterator:
    """The different items in blocks of about BLOCK_BYTES of text, bounded by the parameter whatever the benchmark's size; each as a broadcast value. Items of one item_id
    fall into different blocks, so none of them makes a block large."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(blocks):
        some = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toLocalIterator()]
        yield spark.sparkContext.broadcast(sorted(some))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, share (of the item's windows found along one course), n_slots (placeholders compared).

    Null, empty or wordless texts and items match nothing; an item of fewer than WIDTH words is one window and is found only in documents of the same few words. Repeated
    documents and items are taken one by one and give equal rows once; of several matches of a document and an item the largest share and number of slots are given, so ties
    make no difference. Items without item_id are left out, as are documents without doc_id. Empty tables give an empty table. Other columns are not read; texts are
    read whole.
    """
    out = None
    for held in _blocks(benchmark):
        found = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(_match(lambda held=held: held.value), "doc_id long, item_id long, share double, n_slots long")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"), F.max("n_slots").alias("n_slots"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item; all columns stay as they are. Each row is judged by its own text, so rows without doc_id are, too. No shuffle.
    What is left after a block is written to the shared folder before the next, so that a task holds one block's index at a time."""
    scratch, written = None, []
    for k, held in enumerate(_blocks(benchmark)):
        if k:
            scratch = scratch or Scratch(docs.sparkSession)
            docs = scratch.save(docs)
            scratch.drop(*written)
            written = [docs]
        docs = docs.mapInArrow(_without(lambda held=held: held.value), docs.schema)
    return docs

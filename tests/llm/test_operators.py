"""Each operator against a brute-force version on a small fixture with nulls, empty, blank, short and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracelake.llm import common, decontam, jaccard, langid, licenses, mixing, passages, queries, sharding, substrings, topk, toxicity
from tracelake.llm.common import bucket_of

BLANK = "[^\x20\x09-\x0d]+"


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


def texts(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(400)]
    base = [" ".join(r.choices(vocabulary, k=r.choice([3, 30, 120, 400]))) for _ in range(n)]
    passage = " ".join(r.choices(vocabulary, k=70))
    out = list(base)
    for k in range(0, n, 3):
        words = base[k].split(" ")
        for _ in range(r.choice([0, 1, 2])):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        out.append(" ".join(words))
    out += [base[5] + " " + passage + " tail", passage + " head", "x" * 5000, "y z " * 700, "", " \t\n", None, "one", "ONE", "under the MIT License. Under the mit license; x"]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 4}" if k % 9 else None, len(t or ""), 1) for k, t in enumerate(texts())]
    rows += [rows[3], (None, "nameless text", None, None, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def named(docs):
    return {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}


def test_jaccard(docs, none):
    sets = {}
    for d, t in named(docs).items():
        w = re.findall(BLANK, lower(t))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    to = {d: d for d in sets}

    def find(x):
        return x if to[x] == x else find(to[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                to[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {d: (len(s), find(d)) for d, s in sets.items()}
    assert jaccard.near_duplicates(none).count() == 0
    kept = {r.doc_id for r in jaccard.keep_one(docs).collect()}
    assert kept == {d for d in sets if find(d) == d} | {None}


def test_jaccard_last_round(spark):
    """Document 0 leads every list but is out of reach by size; the links of its two halves' near copies stay."""
    r = random.Random(2)
    words = lambda n: [f"j{r.randrange(10**9)}" for _ in range(n)]
    for _ in range(3):
        s, t = words(100), words(100)
        rows = [(0, s + t), (1, s + words(5)), (2, s + words(5)), (3, t + words(5)), (4, t + words(5))]
        d = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
        got = {x.doc_id: (x.component_id, x.n_links) for x in jaccard.near_duplicates(d).collect()}
        assert got == {0: (0, 0), 1: (1, 1), 2: (1, 1), 3: (3, 1), 4: (3, 1)}


def test_jaccard_sizes(spark):
    """Sets at the edge of the sizes that can be linked, one inside the other, near the ends of blocks: each component equals brute force."""
    r, rows = random.Random(8), []
    for n in (7, 8, 12, 15, 16, 20, 28, 40, 60, 100, 133, 134):
        words = [f"s{r.randrange(10**9)}" for _ in range(2 * n)]
        for m in {n, -(-3 * n // 4), 3 * n // 4, 3 * n // 4 - 1, n * 4 // 3, n * 4 // 3 + 1}:
            rows.append((len(rows), " ".join(words[: max(m, 1) + 4])))
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in rows}
    to = dict.fromkeys(sets)
    for d in sets:
        todo, seen = [d], {d}
        while todo:
            a = todo.pop()
            new = {b for b in sets if b not in seen and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
            todo, seen = todo + list(new), seen | new
        to[d] = min(seen)
    got = {x.doc_id: x.component_id for x in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == to


def test_substrings(docs, none):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    seen = collections.Counter(b[k : k + 200] for _, b in rows for k in range(len(b) - 199))
    want = collections.Counter()
    for d, b in rows:
        gone = set()
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone.update(range(k, k + 200))
        kept = bytes(x for k, x in enumerate(b) if k not in gone)
        want[(d, len(b), len(gone), sum(k - 1 not in gone for k in gone), hashlib.sha256(kept).hexdigest())] += 1
    got = substrings.remove_repeats(docs).drop("kept").collect()
    assert collections.Counter(tuple(r) for r in got) == want
    assert substrings.remove_repeats(none).count() == 0


def test_scratch(spark, monkeypatch):
    """Tables go when asked for; without a shared folder only local mode has a substitute."""
    import os

    path = lambda df: df._scratch_path.removeprefix("file://")
    outer = common.Scratch(spark)
    with common.temporary():
        inner = common.Scratch(spark).save(spark.range(3))
        kept = outer.save(inner)
        assert os.path.isdir(path(inner))
    assert not os.path.exists(path(inner)) and kept.count() == 3
    outer.drop(kept)
    assert not os.path.exists(path(kept))

    class Far:
        conf = {}  # noqa: RUF012
        sparkContext = type("Context", (), {"master": "yarn"})()  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Far())
    Far.conf["spark.checkpoint.dir"] = "hdfs://host/x/"
    assert common.shared_dir(Far()) == "hdfs://host/x"


def test_loser_tree():
    r = random.Random(4)
    strings = sorted(bytes(r.choices(b"ab", k=r.randrange(12))) for _ in range(300))
    runs = [sorted(strings[k::5]) for k in range(5)]
    got = [(h, s) for h, s, _, _ in substrings.LoserTree([substrings.decode(*substrings.front_code(x)) for x in runs])]
    assert [s for _, s in got] == strings
    assert all(h == substrings.common(a, b, 0) for (_, a), (h, b) in zip(got, got[1:], strict=False))


def test_passages(docs, none):
    where = collections.defaultdict(set)
    for d, t in named(docs).items():
        w = re.findall(BLANK, lower(t))
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(d)
    want = {d for s in where.values() if len(s) > 1 for d in s}
    got = {r.doc_id: r for r in passages.repeated_passages(docs).collect()}
    assert want <= set(got) and len(got) == passages.repeated_passages(docs).count()
    for r in got.values():
        assert r.n_spans == len(r.spans) and all(x.end_word - x.begin_word >= 49 and x.partner_id != r.doc_id for x in r.spans)
        assert all(a.end_word < b.begin_word for a, b in zip(r.spans, r.spans[1:], strict=False))
    assert passages.repeated_passages(none).count() == 0


def test_passage_recall(spark):
    """Of near copies of passages at similarities from 0.75 to 0.95, by brute force over their shingles, nine of ten documents are found; unrelated ones never."""
    r = random.Random(12)
    words = lambda n: [f"p{r.randrange(10**9)}" for _ in range(n)]
    rows, near = [], {}
    for k in range(400):
        passage = words(r.choice([60, 90, 200]))
        other = list(passage)
        for j in r.sample(range(len(other)), max(1, int(len(other) * r.uniform(0.005, 0.03)))):
            other[j : j + 1] = words(r.choice([0, 1, 2]))
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (passage, other)]
        similarity = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        for j, x in enumerate((passage, other)):
            rows.append((10 * k + j, " ".join(words(40) + x + words(30))))
        rows.append((10 * k + 2, " ".join(words(100))))
        near[k] = similarity
    got = {x.doc_id for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(d % 10 == 2 for d in got)
    for low, high in ((0.75, 0.8), (0.8, 0.9), (0.9, 1.0)):
        ks = [k for k, x in near.items() if low <= x < high]
        share = sum({10 * k, 10 * k + 1} <= got for k in ks) / len(ks)
        print(f"similarity {low} to {high}: {len(ks)} pairs, {share:.3f} found")
        assert share >= 0.9


def test_hot_passage(spark, monkeypatch):
    """A passage that many documents hold is found in all of them, through blocks of several levels, beside copies and near copies."""
    monkeypatch.setattr(passages, "BLOCK", 4)
    r = random.Random(13)
    words = lambda n: [f"h{r.randrange(10**9)}" for _ in range(n)]
    passage = words(80)
    rows = [(k, " ".join(words(20) + passage + words(20))) for k in range(150)] + [(k, " ".join(words(60))) for k in range(200, 240)] + [(300 + k, rows_text) for k, rows_text in enumerate([" ".join(words(55))] * 3)]
    got = {x.doc_id: x for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {*range(150), 300, 301, 302}
    assert all((x.begin_word, x.end_word) == (20, 99) for d in range(150) for x in got[d].spans)
    assert [(got[d].class_id, got[d].spans[0].partner_id, got[d].spans[0].end_word) for d in (300, 301, 302)] == [(300, 302, 54), (300, 300, 54), (300, 300, 54)]


def test_passages_with_quotes(spark):
    """Copies of a passage are found though a smaller document, or one between them, holds a part of it; near copies with three words changed as well."""
    r = random.Random(11)
    words = lambda n: [f"q{r.randrange(10**9)}" for _ in range(n)]
    rows, want = [], {}
    for k in range(60):
        passage, at = words(60), r.randrange(30)
        other = list(passage)
        if k % 3 == 2:
            for j in (2, 29, 57):
                other[j] = words(1)[0]
        a, b = words(20) + passage + words(20), words(25) + other + words(15)
        quote = words(30) + passage[at : at + 30] + words(30)
        for j, text in enumerate((quote, a, b) if k % 2 else (a, quote, b)):
            rows.append((10 * k + j, " ".join(text)))
        want[k] = {10 * k + 1, 10 * k + 2} if k % 2 else {10 * k, 10 * k + 2}
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {k: {x.doc_id for x in got if x.doc_id // 10 == k} for k in want}
    assert all(found[k] == want[k] for k in want if k % 3 != 2)
    assert sum(found[k] == want[k] for k in want if k % 3 == 2) >= 18
    repeated = " ".join(passage)
    rows = [(1, repeated + " " + " ".join(words(80)) + " " + repeated), (2, " ".join(words(9)) + " " + repeated)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id = 1").collect()
    assert [(x.begin_word, x.end_word) for x in got[0].spans] == [(0, 59), (140, 199)]


def test_passages_of_frequent_signatures(spark, monkeypatch):
    """Links of near copies are found though they share signatures with many documents that hold no copy: passages of 60 words around one line of 36 words, each
    held by two documents only, which further documents link with one another."""
    monkeypatch.setattr(passages, "BLOCK", 4)
    monkeypatch.setattr(passages, "SMALL", 4)
    r = random.Random(17)
    words = lambda n: [f"f{r.randrange(10**9)}" for _ in range(n)]
    line, rows = words(36), []
    passage = [words(12) + line + words(12) for _ in range(80)]
    names = r.sample(range(1000), 240)
    for k, x in enumerate(passage):
        rows += [(names[2 * k], " ".join(words(20) + x + words(20))), (names[2 * k + 1], " ".join(words(30) + x + words(10)))]
    # 20 documents hold another passage of the first of a pair, and one of the next pair.
    bridge = [words(60) for _ in range(20)]
    rows += [(1000 + k, " ".join(words(9) + x + words(9) + passage[k])) for k, x in enumerate(bridge)] + [(2000 + k, " ".join(x + words(5) + passage[k + 1])) for k, x in enumerate(bridge)]
    got = {x.doc_id: x for x in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {d: {tuple(w[k : k + 50]) for w in [t.split()] for k in range(len(w) - 49)} for d, t in rows}
    to = {d: d for d in sets}

    def find(x):
        return x if to[x] == x else find(to[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b]:
                x, y = sorted((find(a), find(b)))
                to[y] = x
    assert {d: x.component_id for d, x in got.items()} == {d: find(d) for d in sets}
    assert all({(x.begin_word, x.end_word) for x in got[names[2 * k]].spans} == {(20, 79)} for k in range(80))
    assert all({(x.begin_word, x.end_word) for x in got[names[2 * k + 1]].spans} == {(30, 89)} for k in range(80))


def asked(windows):
    """What windows (tokens) of one signature, each of a document and a component of its own, ask: rows."""
    n = len(windows)
    tokens = [[t << passages.MARKS | passages.SHARED | passages.RARE for t in w] for w in windows]
    spans = pa.array([None] * n, pa.list_(pa.struct([("l", pa.int32()), ("r", pa.int32())])))
    columns = [pa.array([7] * n), pa.array(range(n)), pa.array(range(n)), pa.array([0] * n, pa.int32()), pa.array([len(w) - 1 for w in windows], pa.int32()), pa.array(tokens, pa.list_(pa.int64())), spans]
    batch = pa.RecordBatch.from_arrays(columns, names=["tok", "rep", "c", "l", "r", "tokens", "spans"])
    return [r for x in passages._ask([batch]) for r in x.to_pylist()]


def test_asking_is_answered_by_answers():
    """Copies ask for one link each, not for all pairs, also where one token stands a hundred times; copies of a part are linked and their spans are whole."""
    for window in (list(range(60)), [1] * 150):
        got = asked([window] * 200)
        assert len(got) < 600
        assert {x for r in got for x in (r["rep"], r["lead"])} == set(range(200))


def test_passage_between_like_gaps():
    """A passage of 102 tokens, all gaps of which are alike, inside a window with further common tokens."""
    common = lambda a: "".join("." * 9 if x == "-" else "." * 6 if x == "_" else x for x in a)
    mask = common("#-" + "#" * 30 + "_" + "#" * 30 + "_" + "#" * 30 + "-#")
    windows = [[k if x == "#" else 1000 * (side + 1) + k for k, x in enumerate(mask)] for side in (0, 1)]
    assert not passages._similar(*(np.array(w) for w in windows))
    got = [r for r in asked(windows) if r["kind"] == 1]
    assert all((r["l"], r["r"]) == (r["ll"], r["lr"]) for r in got)
    assert sorted((r["l"], r["r"]) for r in got) == [(10, 75), (46, 111)]  # they overlap, so they become one span


def test_licenses(docs, none):
    for r in licenses.scan(docs.select("doc_id", F.col("text").alias("t"), "score"), "t").join(docs.select("doc_id", "text"), "doc_id").collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))
        hits = [k for k in range(len(w)) for p, _ in licenses.BASE if w[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min(hits, default=None), max(hits, default=None))
    spark = docs.sparkSession
    one = spark.createDataFrame([("Licensed under the GNU General Public License, version 3. All rights reserved",), ("apache license version 2 and CC BY-NC 4.0, under the MIT license",), ("SPDX-License-Identifier: GPL-3.0-only",)], "text string")
    found = [(r.base_labels, r.labels) for r in licenses.scan(one).collect()]
    assert found[0] == ("", "all-rights-reserved,gpl-3") and found[1][0] == "apache-2,cc-by-nc,mit" and found[2] == ("", "gpl-3")
    assert licenses.scan(none).count() == 0 and len(licenses.rules()) > 300


def test_license_wordings(spark):
    texts = ["Licensed under Creative Commons Zero", "released under CC-0", "licensed under CC0 1.0", "noncommercial use only", "non-commercial use", "for commercial use"]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    assert [r.labels for r in licenses.scan(d).orderBy("k").collect()] == ["cc0"] * 3 + ["noncommercial"] * 3


def test_sharding(docs, none):
    n = docs.count()
    out = sharding.shuffle_to_shards(docs.withColumn("shard", F.lit(9)), ["doc_id", "n_chars"], 7).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert len(out) == n and {len(x) for x in by.values()} <= {n // 7, n // 7 + 1} and all(sorted(x) == list(range(len(x))) for x in by.values())
    again = sharding.shuffle_to_shards(docs.repartition(5), ["doc_id", "n_chars"], 7).collect()
    assert sorted(map(str, ((r.doc_id, r.shard, r.slot) for r in out))) == sorted(map(str, ((r.doc_id, r.shard, r.slot) for r in again)))
    assert sharding.shuffle_to_shards(none, ["doc_id"], 7).count() == 0
    m = np.array(sharding.matrix([5, 0, 9, 4], 3, 1))
    assert m.sum(1).tolist() == [5, 0, 9, 4] and m.sum(0).tolist() == [6, 6, 6]


def test_mixing(docs, none):
    rows = [(r.source, len(re.findall(BLANK, r.text or ""))) for r in docs.collect()]
    size = collections.Counter()
    for s, n in rows:
        size[s] += n
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    taken = collections.Counter()
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 24 for s in order)
    assert mixing.mix(none).count() == 0


def test_apportionment(spark):
    share = {"a": 53000.0, "b": 24000.0, "c": 23000.0, "d": 10.0}
    seats = dict.fromkeys(share, 0)
    for _ in range(37):
        best = max(sorted(share), key=lambda s: share[s] / (2 * seats[s] + 1))
        seats[best] += 1
    got = mixing.apportion(spark.createDataFrame(list(share.items()), "k string, s double"), [], ["k"], "s", F.lit(37))
    assert {r.k: r.seats for r in got.collect()} == seats


def test_apportionment_of_many_parties(spark):
    """Ten thousand parties by brute force over a heap; the quotients ranked grow with the parties, not with their square."""
    import heapq

    r = random.Random(14)
    for n, total in ((10_000, 123_457), (10_000, 4_000), (300, 10_000_000)):
        share = {f"{k:05}": float(r.choice([1, 3, 50, r.randrange(1, 100_000)])) for k in range(n)}
        if total <= 200_000:
            heap = [(-x, k) for k, x in share.items()]
            heapq.heapify(heap)
            seats = dict.fromkeys(share, 0)
            for _ in range(total):
                _, k = heap[0]
                seats[k] += 1
                heapq.heapreplace(heap, (-share[k] / (2 * seats[k] + 1), k))
        d = spark.createDataFrame(list(share.items()), "k string, s double")
        out = mixing.apportion(d, [], ["k"], "s", F.lit(total))
        got = {x.k: x.seats for x in out.collect()}
        assert sum(got.values()) == total and (total > 200_000 or got == seats)
        parts = np.array(list(share.values())) / sum(share.values())
        high, low = np.ceil(parts * (total + n / 2) + 0.5) + 1, np.maximum(np.floor(parts * (total - n / 2) - 0.5) - 1, 0)
        assert (high - low).sum() <= 7 * n


def test_hypergeometric_law():
    """Draws against the exact probabilities, and against mean and deviation for ten trillion rows."""
    rng = np.random.default_rng(1)
    for good, bad, n in ((3, 5, 4), (50, 70, 30), (400, 20000, 1000)):
        x = np.array([sharding._draw(rng, good, bad, n) for _ in range(5000)])
        low = max(0, n - bad)
        p = np.array([math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(low, min(good, n) + 1)])
        seen, want = np.bincount(x - low, minlength=len(p)), 5000 * p
        often = want > 5
        assert ((seen - want) ** 2 / want)[often].sum() < often.sum() + 5 * (2 * often.sum()) ** 0.5
    total = 10**13
    good, n = total // 24, total // 4096
    x = np.array([sharding._draw(rng, good, total - good, n) for _ in range(3000)], float)
    deviation = math.sqrt(n * good / total * (total - good) / total * (total - n) / (total - 1))
    assert abs(x.mean() - n * good / total) < 5 * deviation / 3000**0.5 and abs(x.std() / deviation - 1) < 0.07
    m = np.array(sharding.matrix([4 * 10**9, 10**9, 7], 5, 3))
    assert m.sum(1).tolist() == [4 * 10**9, 10**9, 7] and m.sum(0).max() - m.sum(0).min() <= 1


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(k, [float(x) for x in r.normal(size=16)]) for k in range(300)]
    rows += [(300, None), (301, [float("nan")] * 16), (302, [None] * 16), (303, rows[7][1]), (304, []), (350, [1.0] * 3), (None, rows[1][1])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = {k: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for k, v in rows if k is not None and v and None not in v and np.isfinite(v).all()}
    want = [(q, n + 1, c, -s) for q in whole if q % 50 == 0 for n, (s, c) in enumerate(sorted((-int(whole[q] @ v), c) for c, v in whole.items() if c != q and len(v) == len(whole[q]))[:5])]
    got = topk.top_k(d, F.col("vec_id") % 50 == 0, 5)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(d.where("false"), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_segments_prune(spark):
    """Bounds drop no pair that reaches the threshold; where few directions hold the energy, as in learned embeddings, they drop nearly all others."""
    r = np.random.default_rng(5)
    for spread, left in ((np.ones(64), 0.6), (0.8 ** np.arange(64), 0.1)):
        v = np.floor(256 * (r.normal(size=(3000, 64)) * spread) @ np.linalg.qr(r.normal(size=(64, 64)))[0])
        turn = topk.basis(v[:500])
        scores = v[:50] @ v[50:].T
        least = np.sort(scores, 1)[:, -5]
        q, c = np.nonzero(np.ones_like(scores))
        told = [topk._summary(v[:50] @ turn, x) for x in topk.LENGTHS]
        levels = topk.survivors(q, c, told, v[50:] @ turn, least)
        kept = set(zip(*map(np.ndarray.tolist, levels[-1]), strict=True))
        assert all((a, b) in kept for a, b in zip(*map(np.ndarray.tolist, np.nonzero(scores >= least[:, None])), strict=True))
        print("left at each level:", [round(len(x) / scores.size, 3) for x, _ in levels])
        assert len(kept) <= left * scores.size
    big = np.array([[2.0**30, 1.0]])
    assert topk._exact(np.array([0]), np.array([0]), big, big)[0] == 2**60 + 1


def test_language(spark, none):
    r = random.Random(5)
    words = {"aa": ["ka", "lo", "mi"], "bb": ["ștr", "önd", "çik"]}
    rows = [(k, " ".join(r.choice(words[x]) + r.choice("aeiou") for _ in range(40)), x, x) for k in range(60) for x in [("aa", "bb")[k % 2]]]
    rows += [(90, None, "aa", "s"), (91, "123 !", "aa", "s"), (92, "", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {x.doc_id: x for x in langid.identify(d, langid.profiles(d, bucket_of("doc_id", 3) != 1)).collect()}
    assert all(out[k].lang_pred == x for k, _, x, _ in rows[:60]) and {out[k].lang_pred for k in (90, 91, 92)} == {"und"}
    assert all(0 <= x.score <= 1 for x in out.values()) and {x.lang_pred for x in langid.identify(d, {}).collect()} == {"und"} and langid.identify(none, {}).count() == 0


def test_toxicity(spark, none):
    r = random.Random(6)
    clean = lambda: " ".join(r.choices([f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"], k=60))
    rows = [(k, clean() + (" zzyx" + r.choice("abcd") + r.choice("efgh") + ", you zzyxe. " if k % 5 == 0 else "") + clean()) for k in range(300)] + [(900, None), (901, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(300)] + [(None, 1), (7, None), (5000, 1)], "doc_id long, toxic int")
    held = bucket_of("doc_id", 5) != 0
    out = {x.doc_id: x.score for x in toxicity.score(d, *toxicity.learn(d, labels, held)).collect()}
    assert all((out[k] >= 0.5) == (k % 5 == 0) for k in range(300)) and out[900] < 0.5 and out[901] < 0.5
    assert {k for k in range(300) if zlib.crc32(str(k).encode()) % 5} == {x.doc_id for x in d.where(held & (F.col("doc_id") < 300)).collect()}
    g, w = toxicity.learn(d.where("false"), labels, held)
    assert toxicity.score(none, g, w).count() == 0
    assert g.clause("you are an idiot")[0] > g.clause("you are not an idiot")[0] > 0 and g.clause("he said idiot")[0] < g.clause("idiot")[0]
    assert g.clause("i will kill you")[1] > g.clause("i will kill time")[1] and g.clause("we never hurt you")[1] == 0


def test_transducers():
    """The composed table marks what its parts mark, on all words of five symbols; brute force by distance."""
    import itertools

    for w in itertools.product(toxicity.SYMBOLS, repeat=5):
        near = lambda x, reach, k: any(w[j] == x for j in range(max(0, k - reach), k))  # noqa: B023, E731
        want = [
            toxicity.NEGATED * near(toxicity.NEGATION, toxicity.NEGATION_REACH, k)
            + toxicity.REPORTED_MARK * near(toxicity.REPORT, 5, k)
            + toxicity.TARGETED * near(toxicity.TARGET, toxicity.TARGET_REACH, k)
            for k in range(5)
        ]
        assert toxicity.FORWARD.marks(list(w)) == want


def test_toxicity_of_clashing_columns(spark):
    """Columns named like a result or an inner column, very long texts, and threats that the labels do not show."""
    g = toxicity.Grammar({}, {})
    rows = [(1, "you idiot, " + "plain words here " * 60000, 5.0, 1), (2, "we will kill you all", 6.0, 2), (3, None, 7.0, 3), (4, "", 8.0, 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, score double, _features int")
    out = {x.doc_id: x for x in toxicity.score(d, g, toxicity.PRIOR, tuple(d.columns), "toxicity").collect()}
    assert out[1].score == 5.0 and out[2]._features == 2 and out[2].toxicity > out[3].toxicity == out[4].toxicity and out[1].toxicity > out[4].toxicity
    assert toxicity.score(d, g, toxicity.PRIOR, ("doc_id", "score")).columns == ["doc_id", "score"]
    y = np.array([0, 1] * 20, float)
    x = np.zeros((40, toxicity.FEATURES))
    x[:, 0] = y
    w = toxicity._logistic(x, y)
    assert w[0] > 0 and w[toxicity.MARKS + toxicity.TARGETED] == toxicity.PRIOR[toxicity.MARKS + toxicity.TARGETED] == 2.0


def test_toxicity_of_held_out_documents(spark):
    """The query finds nine of ten held-out toxic documents, and flags at most one of a hundred clean ones."""
    sf = "/root/testdata/sf0.1"
    out = queries.op1_toxicity_grammar(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic in (0, 1)"), "doc_id").collect()
    toxic, clean = [r.predicted for r in out if r.toxic], [r.predicted for r in out if not r.toxic]
    print(f"toxic {sum(toxic)} of {len(toxic)}, clean flagged {sum(clean)} of {len(clean)}")
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_targets_on_both_sides(spark):
    g = toxicity.Grammar({}, {})
    assert g.clause("i will kill you")[1] > g.clause("i will kill time")[1] and g.clause("shoot them all")[1] == g.clause("you they shoot")[1]
    assert g.clause("idiot you")[0] == g.clause("you idiot")[0] and g.clause("kill a b c d e you")[1] == g.clause("kill")[1] and g.clause("never hurt you")[1] == 0


def test_decontamination(spark, none):
    item = "Maria has 12 apples and gives 5 kg of pears to Peter before Maria walks 3 miles home with the other children of the village"
    other = "nothing of this sentence stands in any of the documents that are looked at in this small test of ours"
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, ""), (None, item)], "item_id long, text string")
    again = item.replace("12", "77").replace("Peter", "Olaf").replace("kg", "lb").replace("5", "9")
    odd = item.replace("before Maria", "before Xaver").replace("gives 5", "gives 12").replace("walks 3", "walks 12").replace("has 12", "has 4")
    rows = [(1, "Some words first. " + item + " and last"), (2, "Intro text here. " + again), (3, " ".join(item.split()[:8])), (4, None), (5, ""), (6, other.upper()), (None, item), (7, odd)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("share", F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(d, bench).collect()}
    assert {(1, 1), (2, 1), (6, 2)} <= got and not any(x in got for x in ((3, 1), (4, 1), (5, 1)))
    kept = decontam.clean(d, bench)
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 7} - {x for x, _ in got} and kept.columns == d.columns and decontam.clean(none, bench).count() == 0
    assert decontam.leaks(none, bench).count() == 0 and decontam.leaks(d, bench.where("false")).count() == 0


def test_decontamination_of_changed_copies(spark):
    """Names at sentence starts, numbers with separators, lower case, capitals and other line breaks."""
    tom = "Tom has 12 apples. Tom gives 5 apples to Anna. Anna eats 2 apples. How many apples does Tom have now?"
    price = "A shop sells 900 boxes in one week and pays 3 dollars for each box while 10 percent of them come back to the shop later"
    bench = spark.createDataFrame([(1, tom), (2, price)], "item_id long, text string")
    again = tom.replace("Tom", "Leo").replace("Anna", "Mia").replace("12", "31")
    mixed = "Leo has 12 apples. Max gives 5 apples to Mia. Zoe eats 2 apples. How many apples does Kim have now?"
    rows = [(1, again), (2, price.replace("900", "1,200").replace("3 ", "2.50 ").replace("10 ", "12.5 ")), (3, tom.lower()), (4, tom.upper()), (5, again.replace(" ", "\n")), (6, mixed)]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1), (2, 2), (3, 1), (4, 1), (5, 1)}


def test_decontamination_in_blocks(spark, monkeypatch):
    """A benchmark of many blocks, with one item_id over and over, gives what one block gives."""
    words = [f"w{k}" for k in range(400)]
    r = random.Random(5)
    items = [(k % 3 and k, " ".join(r.choice(words) for _ in range(12))) for k in range(60)]
    docs = [(k, " ".join([*(r.choice(words) for _ in range(9)), items[k % 60][1] if k % 2 else "", "end"])) for k in range(120)] + [(None, items[1][1]), (500, None), (501, "")]
    d, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items * 2, "item_id long, text string")
    run = lambda: (sorted(map(tuple, decontam.leaks(d, bench).collect())), sorted(map(str, decontam.clean(d, bench).collect())))
    whole = run()
    assert len({x[0] for x in whole[0]}) == 60 and len(whole[1]) == 62
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 900)
    assert run() == whole

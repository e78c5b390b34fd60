"""Near-duplicate passages by compact windows.

1. Texts that are equal are one class; its smallest doc_id stands for it, and only that text goes on.
2. Tokens are 5-word shingles. For each hash function, all passages that share their smallest token are one compact window, a node of the Cartesian tree over
   the token hashes. The windows of two functions are joined as intervals inside the text; a signature is the pair of smallest tokens of such an
   intersection. Each of PAIRS pairs gives signatures of its own: at similarity 0.75 two passages share at least one of five with odds of 0.98, while a
   line that many documents quote rarely holds both smallest tokens.
3. shared_tokens() finds the signatures that stand twice, with 8 bytes a signature.
   Windows are cut to their first and last token that stands twice; one without a stretch of TOKENS tokens of which SHARE % stand twice holds no passage.
4. All windows of a signature of at most SMALL documents meet each other. Those of a more frequent one first meet in blocks of about BLOCK documents, each
   document the block's first one and the one before it, and each block's first document meets those of other blocks a level higher.
5. Windows of a pair of documents are joined as intervals, one stretch for each course that they follow; a stretch is cut to its first and last common token and verified by
   exact Jaccard similarity of its token sets. Where it fails it is cut at ever smaller gaps.
6. Of the pairs that frequent signatures have left, those that can still tell something meet as well: a passage outside the spans verified so far, or a link
   between two components. Such windows share a token outside the spans, or one of the rarest of a stretch (prefix filter), and have places in a row of which
   enough are common. All windows of a signature are looked at together, and each pair that is verified there closes further ones: pairs are skipped
   where both passages lie in verified spans, and both documents are in one component.
7. The passages of a class are merged into maximal spans before they go to the class's documents: one row a document, with its component of links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, partitions
from .jaccard import components
from .shared import shared_tokens
from .textkit import TOKEN_BITS, minimum_runs, mix, shingles, slices

WIDTH, SHARE = 5, 75
#: Shingles of the shortest passage: 50 words.
TOKENS = 46
PAIRS = 5
#: Signatures of at most so many documents, and windows, have all their pairs compared at once.
SMALL, FEW = 32, 512
#: Of two similar passages one has TOKENS tokens in a row of which at most this many are missing in the other. (A passage of 46 to 91 tokens has a quarter missing
#: at most, and a longer one has such a part; the better of its first and last 46 tokens misses 18 at most.)
MISSING = 18
#: Documents of one signature that meet in one block, and levels of blocks: enough for BLOCK ** LEVELS windows of one signature.
BLOCK, LEVELS = 512, 5
#: Windows whose offsets between two documents differ by more than this follow different courses.
DRIFT = 64
#: Where a stretch fails, it is cut at gaps of more tokens than these, one after the other; at last only exact runs are left.
GAPS = (10, 5, 1)
SEEDS = np.random.default_rng(7).integers(1, 1 << 63, 2 * PAIRS, dtype=np.uint64)

PIECES = "kind int, tok long, df long, key long, l int, r int, tokens array<long>"
PIECE_TYPES = pa.schema([("kind", pa.int32()), ("tok", pa.int64()), ("df", pa.int64()), ("key", pa.int64()), ("l", pa.int32()), ("r", pa.int32()), ("tokens", pa.list_(pa.int64()))])
#: Marks of a token in a piece: it stands twice in the corpus; it is one of the rarest around it.
SHARED, RARE, MARKS = 1, 2, 2
#: Places of a signature's windows that are looked at together.
AT_ONCE = 1 << 19
#: Less than any sum of places.
NEVER = -(1 << 29)
ASKED = "kind int, rep long, l int, r int, lead long, ll int, lr int"
ASKED_TYPES = pa.schema([("kind", pa.int32()), ("rep", pa.int64()), ("l", pa.int32()), ("r", pa.int32()), ("lead", pa.int64()), ("ll", pa.int32()), ("lr", pa.int32())])
STRETCHES = "lead long, rep long, l int, r int, ll int, lr int"
GOOD = "rep long, l int, r int, lead long, ll int, lr int"


def _windows(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Tokens, where texts begin, and of each window: its signature, first and last token (places in all tokens)."""
    tokens, at = shingles(column, WIDTH)
    names, firsts, lasts = [], [], []
    for pair in range(PAIRS):
        seed, other = SEEDS[2 * pair], SEEDS[2 * pair + 1]
        place, first, last = minimum_runs(mix(tokens ^ seed), at, TOKENS)
        place2, first2, last2 = minimum_runs(mix(tokens ^ other), at, TOKENS)
        # Both functions cut the same places into runs: their intersections begin where one of the runs begins.
        begin = np.union1d(first, first2)
        one, two = np.searchsorted(first, begin, "right") - 1, np.searchsorted(first2, begin, "right") - 1
        names.append(mix(mix(tokens[place[one]] + seed) ^ (tokens[place2[two]] + other)) >> np.uint64(64 - TOKEN_BITS))
        firsts.append(begin)
        lasts.append(np.minimum(last[one], last2[two]) + TOKENS - 1)
    return tokens, at, *(np.concatenate(x) for x in (names, firsts, lasts))


def _tokenize(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The different signatures of each text: what stands twice in one text only is not shared."""
    _, at, names, firsts, _ = _windows(column)
    owner = np.searchsorted(at, firsts, "right") - 1
    order = np.lexsort((names, owner))
    owner, names = owner[order], names[order]
    new = np.ones(len(names), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (names[1:] != names[:-1])
    return names[new], np.searchsorted(owner[new], np.arange(len(at)))


def _runs_of(mask: np.ndarray) -> np.ndarray:
    """First and last place of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.reshape(-1, 2) - [0, 1]


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return shingles(column, WIDTH)


def _dense_ends(shared: np.ndarray) -> np.ndarray:
    """For each place the smallest last place of a stretch that begins there or later, has TOKENS tokens at least and SHARE % of them shared. A stretch of twice the
    size or more has such a half."""
    n = len(shared)
    total, end = np.concatenate([[0], np.cumsum(np.where(shared, 100 - SHARE, -SHARE))]), np.full(n, n, np.int64)
    for size in range(min(2 * TOKENS - 1, n), TOKENS - 1, -1):
        at = np.flatnonzero(total[size:] >= total[:-size])
        end[at] = at + size - 1
    return np.minimum.accumulate(end[::-1])[::-1]


def _rarest(rank: np.ndarray) -> np.ndarray:
    """Which tokens of a piece have at most MISSING rarer ones in some TOKENS tokens in a row. Of a piece that repeats a token, all."""
    rare = np.ones(len(rank), bool)
    known = rank[rank >= 0]
    if len(rank) < TOKENS or len(np.unique(known)) < len(known):
        return rare
    rare[:] = False
    for base in range(0, len(rank) - TOKENS + 1, 1 << 14):
        rows = np.lib.stride_tricks.sliding_window_view(rank[base : base + (1 << 14) + TOKENS - 1], TOKENS)
        low = np.argpartition(rows, MISSING, axis=1)[:, : MISSING + 1]
        rare[(low + (base + np.arange(len(low)))[:, None]).ravel()] = True
    return rare


def _pieces(batches):
    """Kind 0: shared windows. Kind 1: the tokens, with their marks, of stretches that shared windows cover."""
    for batch in batches:
        for part in slices(batch):
            tokens, at, names, first, last = _windows(part.column("text"))
            known, where = np.unique(pc.list_flatten(part.column("toks")).to_numpy(zero_copy_only=False).astype(np.uint64), return_index=True)
            if not len(known) or not len(names):
                continue
            found = np.minimum(np.searchsorted(known, names), len(known) - 1)
            hit = known[found] == names
            if not hit.any():
                continue
            df = pc.list_flatten(part.column("dfs")).to_numpy(zero_copy_only=False)[where][found[hit]]
            names, first, last = names[hit], first[hit], last[hit]
            owner = np.searchsorted(at, first, "right") - 1
            # Windows of one signature that overlap, as in a line that is repeated over and over, become one.
            order = np.lexsort((first, names, owner))
            names, df, first, last, owner = (x[order] for x in (names, df, first, last, owner))
            group = np.cumsum(np.concatenate([[0], (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])]))
            reach = np.maximum.accumulate(last + group * (len(tokens) + 2))
            new = np.concatenate([[0], np.flatnonzero(first[1:] + group[1:] * (len(tokens) + 2) > reach[:-1] + 1) + 1])
            last = np.maximum.reduceat(last, new)
            names, df, first, owner = (x[new] for x in (names, df, first, owner))
            common, where = np.unique(pc.list_flatten(part.column("common")).to_numpy(zero_copy_only=False).astype(np.uint64), return_index=True)
            often = pc.list_flatten(part.column("often")).to_numpy(zero_copy_only=False)[where]
            if not len(common):
                continue
            place = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
            shared, ranks = common[place] == tokens, np.empty(len(common), np.int64)
            ranks[np.lexsort((common, often))] = np.arange(len(common))
            rank = np.where(shared, ranks[place], -1)
            keep = _dense_ends(shared)[first] <= last
            if not keep.any():
                continue
            names, df, first, last, owner = (x[keep] for x in (names, df, first, last, owner))
            here = np.arange(len(tokens))
            first = np.minimum.accumulate(np.where(shared, here, len(tokens))[::-1])[::-1][first]
            last = np.maximum.accumulate(np.where(shared, here, -1))[last]
            keys = part.column("key").to_numpy(zero_copy_only=False)
            n = len(names)
            columns = [np.zeros(n, np.int32), names.astype(np.int64), df.astype(np.int64), keys[owner], (first - at[owner]).astype(np.int32), (last - at[owner]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(n, pa.list_(pa.int64()))], schema=PIECE_TYPES)
            edge = np.zeros(len(tokens) + 1, np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, last + 1, -1)
            covered = np.cumsum(edge)[:-1] > 0
            spans = []
            for k in np.unique(owner).tolist():
                spans += [(k, a + int(at[k]), b + int(at[k])) for a, b in _runs_of(covered[at[k] : at[k + 1]]).tolist()]
            who, begin, end = (np.array(x, np.int64) for x in zip(*spans, strict=True))
            size = end - begin + 1
            offsets = np.concatenate([[0], np.cumsum(size)])
            hot = np.zeros(len(tokens) + 1, np.int64)
            np.add.at(hot, first[df > SMALL], 1)
            hot = np.cumsum(hot)
            rare = np.ones(len(tokens), np.int64)
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                if hot[b] > (hot[a - 1] if a else 0):
                    rare[a : b + 1] = _rarest(rank[a : b + 1])
            marked = (tokens << np.uint64(MARKS)).astype(np.int64) + SHARED * shared + RARE * (rare * shared)
            flat = marked[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], size)]
            m = len(spans)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
            columns = [np.ones(m, np.int32), np.zeros(m, np.int64), np.zeros(m, np.int64), keys[who], (begin - at[who]).astype(np.int32), (end - at[who]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], schema=PIECE_TYPES)


def _meet(windows: DataFrame, block: Column, n: int) -> DataFrame:
    """windows (tok, rep, l, r) with a window of another document (lead, ll, lr) of their block: of each document, its windows with the first one of the block's first
    document and of the document before it. The first document's further windows go with the next document. Rows: two a window at most."""
    held = windows.withColumn("b", block).repartition(n, "tok", "b").groupBy("tok", "b", "rep").agg(F.array_sort(F.collect_list(F.struct("l", "r"))).alias("ws"))
    by, own = Window.partitionBy("tok", "b").orderBy("rep"), F.struct("rep", F.col("ws")[0].alias("w"))
    held = held.select("rep", "ws", F.first(own).over(by).alias("least"), F.lag(own).over(by).alias("before"), F.lead(own).over(by).alias("next"))
    smallest = F.col("before").isNull()
    others = F.when(smallest, F.array("next")).otherwise(F.array_distinct(F.array("least", "before")))
    ws = F.when(smallest, F.slice("ws", F.lit(2), F.size("ws"))).otherwise(F.col("ws"))
    each = held.where(~smallest | (F.col("next").isNotNull() & (F.size("ws") > 1))).select("rep", others.alias("others"), F.explode(ws).alias("w"))
    each = each.select("rep", "w", F.explode("others").alias("o"))
    return each.select("rep", F.col("w.l").alias("l"), F.col("w.r").alias("r"), F.col("o.rep").alias("lead"), F.col("o.w.l").alias("ll"), F.col("o.w.r").alias("lr"))


def _block(level: int) -> Column:
    """The block of a document among those of one signature: about BLOCK ** level windows are below each block."""
    blocks = F.ceil(F.col("df") / F.lit(float(BLOCK**level)))
    return F.when(F.col("df") > BLOCK**level, F.pmod(F.xxhash64(F.lit(level), "rep"), blocks)).otherwise(F.lit(0))


def _all_pairs(windows: DataFrame) -> DataFrame:
    """All pairs of windows of a signature that are of different documents."""
    each = windows.groupBy("tok").agg(F.collect_list(F.struct("rep", "l", "r")).alias("ws")).where(F.size("ws") > 1)
    each = each.select("ws", F.explode("ws").alias("w")).select("w", F.explode("ws").alias("o")).where("w.rep > o.rep")
    return each.select(F.col("w.rep").alias("rep"), F.col("w.l").alias("l"), F.col("w.r").alias("r"), F.col("o.rep").alias("lead"), F.col("o.l").alias("ll"), F.col("o.r").alias("lr"))


def _partners(windows: DataFrame, n: int) -> DataFrame:
    """Pairs of windows of all levels. df is the number of documents of the signature, so only frequent ones have higher levels."""
    out = _meet(windows, _block(1), n)
    for level in range(1, LEVELS):
        # At most one window goes up from each block: partial aggregates make one of what a task holds of it.
        up = windows.where(F.col("df") > BLOCK**level).groupBy("tok", "df", _block(level).alias("b")).agg(F.min(F.struct("rep", "l", "r")).alias("w"))
        windows = up.select("tok", "df", "w.*")
        out = out.unionByName(_meet(windows, _block(level + 1), n))
    return out


def _fewest(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each window (values from at[k] to at[k + 1]) the fewest different tokens that TOKENS of its tokens in a row have."""
    w, here = np.repeat(np.arange(len(at) - 1), np.diff(at)), np.arange(len(values))
    order = np.lexsort((here, values, w))
    again = np.flatnonzero((values[order][1:] == values[order][:-1]) & (w[order][1:] == w[order][:-1]))
    before = np.full(len(values), -1)
    before[order[again + 1]] = order[again]
    # A token counts for the rows that begin after the place where it stood before.
    count = np.zeros(len(values) + 1, np.int64)
    np.add.at(count, np.maximum(np.maximum(before + 1, here - TOKENS + 1), at[w]), 1)
    np.add.at(count, here + 1, -1)
    count = np.where(here <= np.maximum(at[w + 1] - TOKENS, at[w]), np.cumsum(count)[:-1], TOKENS)
    return np.minimum.reduceat(count, at[:-1])


def _reach(inside: np.ndarray) -> np.ndarray:
    """From the first to the last true place of each row."""
    return np.where(inside.any(axis=1), inside.shape[1] - np.argmax(inside[:, ::-1], axis=1) - np.argmax(inside, axis=1), 0)


def _best(inside: np.ndarray, gain: int, cost: int, spans: list) -> np.ndarray:
    """The largest sum that TOKENS or more places in a row have, not all of them in one span, the first and the last one inside: cost off for each place, gain for each
    that is inside. A row for each pair; NEVER where there are none."""
    n = inside.shape[1]
    # The last place where such a row may begin, by its end.
    begin = np.arange(max(n - TOKENS + 1, 0))
    for a, b in spans:
        part = slice(max(a - TOKENS + 1, 0), max(b - TOKENS + 2, 0))
        begin[part] = np.minimum(begin[part], a - 1)
    end = np.flatnonzero(begin >= 0)
    begin = begin[end]
    if not len(end):
        return np.full(len(inside), NEVER)
    total = np.cumsum(np.where(inside, gain - cost, -cost), axis=1, dtype=np.int32)
    first = np.minimum.accumulate(np.where(inside, total, -NEVER)[:, : n - TOKENS + 1], axis=1)[:, begin]
    return np.maximum((np.where(inside, total, NEVER)[:, TOKENS - 1 + end] - first).max(axis=1) + gain - cost, NEVER)


class _Signature:
    """Windows of one signature. Those that can still add a span or join two components ask others; what is verified on the way answers further questions.

    A window asks by its tokens outside the one verified span that it meets, or by its rarest ones if it meets none or several spans; where its component is not
    the largest one, by its rarest tokens too. Pairs whose common tokens can't make a passage are passed over."""

    def __init__(self, rows: dict[str, np.ndarray], at: np.ndarray, values: np.ndarray, spans: list):
        self.rep, self.label, self.l, self.at = rows["rep"], rows["c"].copy(), rows["l"], at.astype(np.int64)
        self.names, shared = values >> MARKS, values & SHARED > 0
        self.shared, self.rare = shared, shared & (values & RARE > 0)
        self.fewest, self.size, n = _fewest(self.names, self.at), np.diff(self.at), len(self.rep)
        w = np.repeat(np.arange(n), self.size)
        known, self.code = np.unique(self.names, return_inverse=True)
        self.k = len(known)
        # Each token once a window, though it may stand there a hundred times.
        pairs = np.unique(w[shared] * self.k + self.code[shared])
        self.tokens = pairs % self.k
        self.held = np.searchsorted(pairs, np.arange(n + 1) * self.k)
        self.plain = np.diff(self.held) == np.bincount(w[shared], minlength=n)
        order = np.argsort(self.tokens, kind="stable")
        self.lists, self.start = pairs[order] // self.k, np.searchsorted(self.tokens[order], np.arange(self.k + 1))
        self.spans = [[(max(x["l"] - int(l), 0), min(x["r"], int(r)) - int(l)) for x in own or () if x["l"] <= r and x["r"] >= l] for own, l, r in zip(spans, rows["l"], rows["r"], strict=True)]
        labels, size = np.unique(self.label, return_counts=True)
        self.largest = labels[np.argmax(size)]
        self.place, self.where, self.met = np.full(self.k, -1), np.full(self.k, -1), [set() for _ in range(n)]

    def _holders(self, x: int, mask: np.ndarray) -> np.ndarray:
        """Windows that hold one of the tokens of x that mask marks."""
        codes = np.unique(self.code[self.at[x] : self.at[x + 1]][mask])
        return np.unique(np.concatenate([self.lists[self.start[t] : self.start[t + 1]] for t in codes])) if len(codes) else np.zeros(0, np.int64)

    def _asked(self, x: int) -> np.ndarray:
        """Windows that can hold a partner of a passage of x outside its spans."""
        own, part = self.spans[x], slice(self.at[x], self.at[x + 1])
        if len(own) != 1:
            return self._holders(x, self.rare[part])
        outside = self.shared[part].copy()
        outside[own[0][0] : own[0][1] + 1] = False
        return self._holders(x, outside)

    def _likely(self, x: int, others: np.ndarray) -> np.ndarray:
        """Those of others that can hold a passage similar to one of x, outside its spans or of another component, most common tokens first.

        If SHARE % of the union of two token sets are common, (100 + SHARE) * common >= SHARE * (size + size of the other). Where windows repeat no token, sizes are
        numbers of places."""
        mine = self.tokens[self.held[x] : self.held[x + 1]]
        self.place[mine] = np.arange(len(mine))
        part = slice(self.at[x], self.at[x + 1])
        places = np.where(self.shared[part], self.place[self.code[part]], len(mine))
        found, counts = [], []
        step = max(1, AT_ONCE // max(len(places), int(self.size[others].max(initial=1))))
        for base in range(0, len(others), step):
            y = others[base : base + step]
            size = self.held[y + 1] - self.held[y]
            row = np.repeat(np.arange(len(y)), size)
            at = self.place[self.tokens[np.arange(len(row)) + np.repeat(self.held[y] - (np.cumsum(size) - size), size)]]
            row, at = row[at >= 0], at[at >= 0]
            common = np.bincount(row, minlength=len(y))
            one = np.zeros((len(y), len(mine) + 1), bool)
            one[row, at] = True
            good = (100 + SHARE) * common >= SHARE * (self.fewest[x] + self.fewest[y])
            if not good.any():
                continue
            y, common, one = y[good], common[good], one[good][:, places]
            column = np.arange(int(self.size[y].max(initial=0)))
            held = column < self.size[y][:, None]
            there = np.where(held, self.at[y][:, None] + column, 0)
            two = held & self.shared[there] & (self.place[self.code[there]] >= 0)
            good = (_reach(one) >= TOKENS) & (_reach(two) >= TOKENS)
            apart = self.label[y] != self.label[x]
            for cost, some in ((2 * SHARE, good & self.plain[y]), (SHARE, good & ~self.plain[y])):
                # Without the spans of x where a link is new whatever it covers.
                for own, some in (([], some & apart), (self.spans[x], some & ~apart)):
                    if self.plain[x] and some.any():
                        least = -_best(two[some], 100 + SHARE, cost, []) if cost > SHARE else SHARE * self.fewest[y[some]]
                        good[some] = _best(one[some], 100 + SHARE, cost, own) >= least
            if not self.plain[x] and (some := good & self.plain[y]).any():
                good[some] = _best(two[some], 100 + SHARE, SHARE, []) >= SHARE * self.fewest[x]
            found.append(y[good])
            counts.append(common[good])
        self.place[mine] = -1
        found, counts = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (found, counts))
        return found[np.argsort(-counts, kind="stable")]

    def _add(self, x: int, l: int, r: int) -> bool:
        """Adds a verified span to those of x. Whether it tells something."""
        own = self.spans[x]
        if any(a <= l and r <= b for a, b in own):
            return False
        apart = [(a, b) for a, b in own if b < l or a > r]
        over = [(a, b) for a, b in own if b >= l and a <= r]
        self.spans[x] = [*apart, (min([l, *(a for a, _ in over)]), max([r, *(b for _, b in over)]))]
        return True

    def _passage(self, x: int, y: int) -> tuple[int, int, int, int] | None:
        """Of two windows that repeat no token, the places of two similar passages, not in a span of x: of all that begin and end with common tokens those with most
        common tokens for their sizes. If common tokens stand in the same order on both sides, none is missed."""
        one, two = self.code[self.at[x] : self.at[x + 1]], self.code[self.at[y] : self.at[y + 1]]
        self.where[two] = np.arange(len(two))
        place = self.where[one]
        self.where[two] = -1
        p = np.flatnonzero(place >= 0)
        q, limit = place[p], p - TOKENS + 1
        for a, b in self.spans[x]:
            limit = np.where((p >= a) & (p <= b), np.minimum(limit, a - 1), limit)
        begin = np.searchsorted(p, limit, "right") - 1
        if (np.diff(q) > 0).all():
            begin = np.minimum(begin, np.searchsorted(q, q - TOKENS + 1, "right") - 1)
        if not len(p) or begin.max() < 0:
            return None
        score = (100 + SHARE) * np.arange(len(p)) - SHARE * (p + q)
        e = int(np.argmax(np.where(begin >= 0, score - np.minimum.accumulate(score)[begin], NEVER)))
        a = int(np.argmin(score[: begin[e] + 1]))
        a, b, c, d, common = int(p[a]), int(p[e]), int(q[a : e + 1].min()), int(q[a : e + 1].max()), e - a + 1
        good = min(b - a, d - c) + 1 >= TOKENS and (100 + SHARE) * common >= SHARE * (b - a + d - c + 2)
        return (a, b, c, d) if good else None

    def _found(self, x: int, y: int) -> list[tuple[int, int, int, int]]:
        """Similar passages of x and y that tell something new of x or y, which get them as spans."""
        out = []
        # Cuts at gaps miss passages whose gaps are all alike; the best places in a row are grown until nothing is new.
        while self.plain[x] and self.plain[y] and (found := self._passage(x, y)):
            self._add(x, *found[:2])
            self._add(y, *found[2:])
            out.append(found)
        for found in _similar(*(self.names[self.at[z] : self.at[z + 1]] for z in (x, y))):
            new = [self._add(x, *found[:2]), self._add(y, *found[2:])]
            if any(new) or self.label[x] != self.label[y]:
                out.append(found)
        return out

    def ask(self) -> Iterator[tuple]:
        """(0, both windows): a pair to verify along its whole stretch. (1, both passages): what is verified already. Rows: rep, l, r, lead, ll, lr."""
        size = self.size
        for x in np.flatnonzero(size >= TOKENS).tolist():
            others = self._asked(x)
            if self.label[x] != self.largest:
                rare = self._holders(x, self.rare[self.at[x] : self.at[x + 1]])
                others = np.union1d(others, rare[self.label[rare] != self.label[x]])
            others = self._likely(x, others[(self.rep[others] != self.rep[x]) & (size[others] >= TOKENS)])
            others = others[[y not in self.met[x] for y in others.tolist()]] if self.met[x] else others
            while len(others):
                y, others = int(others[0]), others[1:]
                self.met[y].add(x)
                before, found = list(self.spans[x]), self._found(x, y)
                for k, (a, b, c, d) in enumerate([(0, size[x] - 1, 0, size[y] - 1), *found] if found else []):
                    sides = (self.rep[x], self.l[x] + a, self.l[x] + b), (self.rep[y], self.l[y] + c, self.l[y] + d)
                    yield min(k, 1), *map(int, (*max(sides), *min(sides)))
                if found and self.label[x] != self.label[y]:
                    old, kept = (self.label[x], self.label[y]) if self.label[x] != self.largest else (self.label[y], self.label[x])
                    self.label[self.label == old] = kept
                elif before == self.spans[x]:
                    continue
                if len(others):
                    others = self._likely(x, others[np.isin(others, self._asked(x)) | (self.label[others] != self.label[x])])


def _ask(batches):
    """Rows come in order of their signature; its windows are held until the next one begins."""
    held: list[pa.RecordBatch] = []

    def answer():
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        at, values = _lists(rows, "tokens")
        signature = {x: rows.column(x).to_numpy(zero_copy_only=False) for x in ("rep", "c", "l", "r")}
        if signature["rep"].min() == signature["rep"].max():
            return
        asked = _Signature(signature, at - at[0], values[at[0] : at[-1]], rows.column("spans").to_pylist()).ask()
        while some := list(itertools.islice(asked, 1 << 13)):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*some, strict=True), ASKED_TYPES.types, strict=True)], schema=ASKED_TYPES)

    for batch in batches:
        tok = batch.column("tok").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(tok[1:] != tok[:-1]) + 1).tolist(), len(tok)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and b > a and held[-1].column("tok")[0].as_py() != int(tok[a]):
                yield from answer()
                held.clear()
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield from answer()


def _open_pairs(windows: DataFrame, own: DataFrame, good: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """Pairs of windows of frequent signatures that can add a span or join two components (labels), given what is verified: good. Kind 0: pairs to verify along
    their whole stretch; kind 1: passages that are verified already."""
    sides = good.select("rep", "l", "r").union(good.select("lead", "ll", "lr"))
    spans = _runs_of_spans(sides.select(F.col("rep").alias("key"), "l", "r", F.lit(0).alias("partner"))).groupBy("key").agg(F.collect_list(F.struct("l", "r")).alias("spans"))
    known = spans.join(labels.withColumnRenamed("v", "key"), "key").withColumnRenamed("key", "rep")
    inside = (F.col("l") >= F.col("pl")) & (F.col("r") <= F.col("pr"))
    tokens = F.slice("tokens", F.col("l") - F.col("pl") + 1, F.col("r") - F.col("l") + 1)
    whole = windows.join(own, "rep").where(inside).select("tok", "rep", "l", "r", tokens.alias("tokens")).join(known, "rep", "left")
    whole = whole.select("tok", "rep", F.coalesce("c", "rep").alias("c"), "l", "r", "tokens", "spans")
    return whole.repartition(n, "tok").sortWithinPartitions("tok").mapInArrow(_ask, ASKED)


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(name)
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


def _stretches(lead: np.ndarray, rep: np.ndarray, l: np.ndarray, r: np.ndarray, ll: np.ndarray, lr: np.ndarray, course: np.ndarray) -> pa.RecordBatch:
    """The windows of each course in order of their place, cut where no window reaches on."""
    order = np.lexsort((l, course))
    lead, rep, l, r, ll, lr, course = (x[order] for x in (lead, rep, l, r, ll, lr, course))
    far = int(r.max()) + 2
    reach = np.maximum.accumulate(r + course * far)
    first = np.ones(len(l), bool)
    first[1:] = l[1:] + course[1:] * far > reach[:-1] + 1
    first = np.flatnonzero(first)
    columns = [lead[first], rep[first], *(x.astype(np.int32) for x in (l[first], np.maximum.reduceat(r, first), np.minimum.reduceat(ll, first), np.maximum.reduceat(lr, first)))]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["lead", "rep", "l", "r", "ll", "lr"])


def _candidates(batches):
    """Stretches of a pair of documents that shared windows cover along one course, and the stretch of the other document that they span. Rows come in order of pair
    and offset; a course is held until the next one begins."""
    held = None
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lead", "rep", "l", "r", "ll", "lr")])
        rows = rows if held is None else np.concatenate([held, rows], 1)
        if not rows.shape[1]:
            continue
        offset = rows[2] - rows[4]
        new = np.zeros(rows.shape[1], bool)
        new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]) | (np.diff(offset) > DRIFT)
        course, last = np.cumsum(new), int(np.flatnonzero(new)[-1]) if new.any() else 0
        if last:
            yield _stretches(*rows[:, :last], course[:last])
        held = rows[:, last:]
    if held is not None and held.shape[1]:
        yield _stretches(*held, np.zeros(held.shape[1], np.int64))


def _similar(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int]]:
    """First and last places of the parts of x and y, between their first and last common token, whose token sets have the similarity asked for; both parts
    have TOKENS tokens at least."""
    names, codes = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = codes[: len(x)], codes[len(x) :]

    def holds(part: np.ndarray) -> np.ndarray:
        table = np.zeros(len(names), bool)
        table[part] = True
        return table

    out, todo = [], [(np.flatnonzero(holds(y)[x]), 0, len(y), 0)]
    while todo:
        p, low, high, level = todo.pop()
        if level:
            p = p[holds(y[low:high])[x[p]]]
        if not len(p) or int(p[-1]) - int(p[0]) + 1 < TOKENS:
            continue
        a, b = int(p[0]), int(p[-1])
        one = holds(x[a : b + 1])
        there = low + np.flatnonzero(one[y[low:high]])
        if int(there[-1]) - int(there[0]) + 1 < TOKENS:
            continue
        two = holds(y[there[0] : there[-1] + 1])
        if 100 * np.count_nonzero(one & two) >= SHARE * np.count_nonzero(one | two):
            out.append((a, b, int(there[0]), int(there[-1])))
        elif level < len(GAPS):
            # Each side is cut on its own: a token that stands again far off on the other side must not fail the passage.
            todo += [(q, low, high, level + 1) for q in np.split(p, np.flatnonzero(np.diff(p) > GAPS[level]) + 1)]
            parts = np.split(there, np.flatnonzero(np.diff(there) > GAPS[level]) + 1)
            if len(parts) > 1:
                todo += [(p, int(u[0]), int(u[-1]) + 1, level + 1) for u in parts if int(u[-1]) - int(u[0]) + 1 >= SHARE * TOKENS // 100]
    return out


def _verify(batches):
    for batch in batches:
        rows = []
        (at1, one), (at2, two) = _lists(batch, "one"), _lists(batch, "two")
        for k, (lead, rep, l, ll) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("lead", "rep", "l", "ll")), strict=True)):
            for a, b, c, d in _similar(one[at1[k] : at1[k + 1]] >> MARKS, two[at2[k] : at2[k + 1]] >> MARKS):
                rows.append((rep, l + a, l + b, lead, ll + c, ll + d))
        if rows:
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["rep", "l", "r", "lead", "ll", "lr"])


def _verified(scratch: Scratch, pairs: DataFrame, own: DataFrame, n: int) -> DataFrame:
    """Similar passages of pairs of windows."""
    pairs = pairs.repartition(n, "lead", "rep").sortWithinPartitions("lead", "rep", F.col("l") - F.col("ll"))
    found = scratch.save(pairs.mapInArrow(_candidates, STRETCHES))
    part = lambda a, b: F.slice("tokens", F.col(a) - F.col("pl") + 1, F.col(b) - F.col(a) + 1)
    # All windows of a stretch lie in one piece, so each side of a stretch has one row.
    inside = lambda a, b: (F.col(a) >= F.col("pl")) & (F.col(b) <= F.col("pr"))
    one = found.join(own, "rep").where(inside("l", "r")).select("lead", "rep", "l", "ll", "lr", part("l", "r").alias("one"))
    begin, end = F.greatest("ll", "pl"), F.least("lr", "pr")
    other = F.slice("tokens", begin - F.col("pl") + 1, end - begin + 1)
    two = one.join(own.withColumnRenamed("rep", "lead"), "lead").where((F.col("ll") <= F.col("pr")) & (F.col("lr") >= F.col("pl")))
    return scratch.save(two.select("lead", "rep", "l", begin.alias("ll"), "one", other.alias("two")).mapInArrow(_verify, GOOD))


def _runs_of_spans(spans: DataFrame) -> DataFrame:
    """spans (key, l, r, partner) as maximal disjoint ones."""
    line = Window.partitionBy("key").orderBy("l", "r")
    spans = spans.groupBy("key", "l", "r").agg(F.min("partner").alias("partner"))
    spans = spans.withColumn("reach", F.max("r").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("l") <= F.col("reach"), 0).otherwise(1)).over(line))
    return spans.groupBy("key", "run").agg(F.min("l").alias("l"), F.max("r").alias("r"), F.min("partner").alias("partner"))


def _merged(spans: DataFrame) -> DataFrame:
    """spans (key, l, r, partner) of a class as maximal disjoint ones in one row: key, spans."""
    spans = _runs_of_spans(spans)
    span = F.struct(F.col("l").alias("begin_word"), (F.col("r") + WIDTH - 1).alias("end_word"), F.col("partner").alias("partner_id"))
    return spans.groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Documents with near-duplicate passages of at least 50 words in documents of different text, or whole in another document of the same text. One row a
    document: doc_id, class_id (smallest doc_id of the same text), n_spans, spans (begin_word, end_word, from 0, end inclusive; partner_id, the smallest
    document it was verified against), component_id (smallest doc_id reachable by such passages and by equal texts). Spans of a document are maximal and do
    not overlap.

    Null, empty and shorter texts have no passages. Documents without doc_id are left out; rows that share doc_id and text are one document, rows that share
    a doc_id only are one each. Copies of a text get the passages of their class, and from 50 words the whole text as one span, with the class's smallest
    doc_id as partner (which itself has the largest one). A passage that stands twice in one document only is none. An empty table gives an empty table. Other
    columns are not read; texts are read whole.
    """
    scratch = Scratch(docs.sparkSession)
    d = docs.select("doc_id", "text").where("doc_id is not null and text is not null").withColumn("key", F.xxhash64("text"))
    n = partitions(docs)
    words = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+"))
    classes = d.groupBy("key", "doc_id").agg(F.count("*").alias("times")).groupBy("key").agg(F.min(F.struct("doc_id", "times")).alias("one"), F.max("doc_id").alias("other"))
    classes = classes.select("key", F.col("one.doc_id").alias("doc_id"), "one.times", "other")
    long = d.where(F.octet_length("text") >= 2 * (TOKENS + WIDTH - 1) - 1)
    classes = long.join(classes.hint("shuffle_hash"), ["key", "doc_id"]).withColumnRenamed("doc_id", "rep")
    classes = scratch.save(classes.withColumn("words", F.when(F.col("other") != F.col("rep"), words)))
    # Rows that stand there several times are few; only they are looked at for repeats.
    classes = classes.where("times = 1").unionByName(classes.where("times > 1").dropDuplicates(["key"]))
    named = shared_tokens(classes.select(F.col("key").alias("doc_id"), "text"), _tokenize, False)
    named = scratch.save(named.where("toks is not null").select(F.col("doc_id").alias("key"), "toks", "dfs"))
    hold = scratch.save(classes.select("key", "text").join(named.hint("shuffle_hash"), "key"))
    scratch.drop(named)
    common = shared_tokens(hold.select(F.col("key").alias("doc_id"), "text"), _tokens, False).where("toks is not null")
    common = scratch.save(common.select(F.col("doc_id").alias("key"), F.col("toks").alias("common"), F.col("dfs").alias("often")))
    pieces = scratch.save(hold.join(common.hint("shuffle_hash"), "key").mapInArrow(_pieces, PIECES))
    scratch.drop(hold, common)
    windows = pieces.where("kind = 0").select("tok", "df", F.col("key").alias("rep"), "l", "r")
    own = pieces.where("kind = 1").select(F.col("key").alias("rep"), F.col("l").alias("pl"), F.col("r").alias("pr"), "tokens")
    few = windows.where(F.col("df") <= SMALL).withColumn("n", F.count("*").over(Window.partitionBy("tok")))
    many = windows.where(F.col("df") > SMALL).unionByName(few.where(F.col("n") > FEW).drop("n"))
    good = _verified(scratch, _all_pairs(few.where(F.col("n") <= FEW)).unionByName(_partners(many, n)), own, n)
    labels = components(scratch, good.select(F.col("rep").alias("x"), F.col("lead").alias("y")).distinct())
    asked = scratch.save(_open_pairs(many, own, good, labels, n))
    pairs, found = (asked.where(F.col("kind") == kind).drop("kind") for kind in (0, 1))
    more = _verified(scratch, pairs, own, n).unionByName(found)
    good = good.unionByName(more)
    # What the second round joins are components of the first, or documents that had none.
    ends = more.select("rep", "lead").distinct()
    for end in ("rep", "lead"):
        ends = ends.join(labels.select(F.col("v").alias(end), F.col("c").alias(f"{end}_c")), end, "left").withColumn(end, F.coalesce(f"{end}_c", end)).drop(f"{end}_c")
    ends = scratch.save(ends.where("rep <> lead").select(F.col("rep").alias("x"), F.col("lead").alias("y")).distinct())
    labels = labels.unionByName(ends.select(F.explode(F.array("x", "y")).alias("v")).distinct().join(labels, "v", "left_anti").select("v", F.col("v").alias("c")))
    joined = components(scratch, ends).select(F.col("v").alias("c"), F.col("c").alias("further"))
    linked = labels.join(joined, "c", "left").select(F.col("v").alias("key"), F.coalesce("further", "c").alias("c"))
    linked = linked.join(classes.select("key", "rep"), "key").withColumn("component_id", F.min("rep").over(Window.partitionBy("c"))).select("key", "component_id")
    sides = good.select(F.col("rep").alias("key"), "l", "r", F.col("lead").alias("to")).union(good.select("lead", "ll", "lr", "rep")).distinct()
    names = classes.select(F.col("key").alias("to"), F.col("rep").alias("partner"))
    sides = sides.join(names, "to").select("key", "l", "r", "partner")
    spans = _merged(sides)
    copies = classes.where(F.col("words") >= TOKENS + WIDTH - 1).select("key", F.col("words").alias("whole"))
    known = classes.select("key", "rep", "other").join(spans.join(linked, "key"), "key", "left").join(copies, "key", "left").where("spans is not null or whole is not null")
    out = d.select("doc_id", "key").distinct().join(known, "key")
    partner = F.when(F.col("doc_id") == F.col("rep"), F.col("other")).otherwise(F.col("rep"))
    whole = F.array(F.struct(F.lit(0).alias("begin_word"), (F.col("whole") - 1).alias("end_word"), partner.alias("partner_id")))
    spans = F.when(F.col("whole").isNotNull(), whole).otherwise(F.col("spans"))
    return out.select("doc_id", F.col("rep").alias("class_id"), F.size(spans).alias("n_spans"), spans.alias("spans"), F.coalesce("component_id", "rep").alias("component_id"))

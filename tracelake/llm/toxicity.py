"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexer maps words to symbols: insult (with a weight), threat verb, target, negation, reported speech. Small transducers read the symbols of a clause and mark insults and
threats: negated (a negation stands within a few words before), reported (speech is reported in the clause), targeted (a target stands within a few words before or after).
They are composed into one transition table read from left to right, and one for targets that follow, read from right to left. Each pair of kind
and marks is an arc with a weight; what a matched clause gives is the sum of its arcs. Arc weights start from fixed ones and are fitted to labels, drawn to the start
where labels say little, so a kind that the sample lacks keeps its weight.

Insults are words and stems. Besides a seed list, stems are learned from a bounded sample of labelled rows (SAMPLE): those that stand in at least LEAST toxic and few
clean documents of the sample, after near copies in it are left out. A stem's weight grows with its odds.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .textkit import shingles, slices

#: Labelled rows that stems and weights are learned from, at most: those with the smallest hash.
SAMPLE = 5000
LEAST, PRECISION = 5, 0.75
STEM = (3, 10)

#: Fixed word lists of the grammar.
INSULTS = "idiot idiots moron morons stupid pathetic worthless disgusting trash scum loser losers clown clowns imbecile dumb dumbass garbage vermin filthy ugly freak coward cowards liar retard bastard bitch fool fools jerk creep pig pigs".split()
THREATS = "kill hurt destroy beat burn crush punish stab shoot hang strangle choke murder slaughter attack hunt".split()
TARGETS = "you your yours yourself he him his she her they them their these those all everyone people".split()
NEGATIONS = "not no never isn't aren't wasn't weren't don't doesn't didn't nobody neither nor without".split()
REPORTED = "said says say told tells claimed claims reported reports wrote writes quoted quotes called calls alleged according".split()

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:,\n|]+")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = SYMBOLS = range(6)
NEGATED, REPORTED_MARK, TARGETED = 1, 2, 4
MARKS = 8
#: Words that a negation and a target reach.
NEGATION_REACH, TARGET_REACH = 3, 4


class Transducer:
    """A sequential letter-to-letter transducer: arcs[state][symbol] is the next state and the marks that the symbol gets. State 0 is the first."""

    def __init__(self, arcs: list[list[tuple[int, int]]]):
        self.arcs = arcs

    @classmethod
    def near(cls, trigger: int, reach: int, mark: int) -> Transducer:
        """Marks the `reach` symbols after a trigger: the state counts down."""
        return cls([[(reach if x == trigger else max(0, s - 1), mark if s else 0) for x in SYMBOLS] for s in range(reach + 1)])

    @classmethod
    def after(cls, trigger: int, mark: int) -> Transducer:
        """Marks all symbols after a trigger."""
        return cls([[(int(s or x == trigger), mark if s else 0) for x in SYMBOLS] for s in range(2)])

    def compose(self, then: Transducer) -> Transducer:
        """Both one after the other: `then` reads what this one has marked and adds its own marks. States are pairs."""
        n = len(then.arcs)
        return Transducer([[(a * n + b, m | k) for (a, m), (b, k) in zip(one, two, strict=True)] for one in self.arcs for two in then.arcs])

    def marks(self, symbols: list[int]) -> list[int]:
        state, out = 0, []
        for x in symbols:
            state, mark = self.arcs[state][x]
            out.append(mark)
        return out


FORWARD = Transducer.near(NEGATION, NEGATION_REACH, NEGATED).compose(Transducer.after(REPORT, REPORTED_MARK)).compose(Transducer.near(TARGET, TARGET_REACH, TARGETED))
BACKWARD = Transducer.near(TARGET, TARGET_REACH, TARGETED)


def _start(kind: int, mark: int) -> float:
    """Fixed weight of an arc."""
    speech = 0.5 if mark & REPORTED_MARK else 1.0
    if kind == INSULT:
        return speech * (0.6 if mark & NEGATED else 1.0) * (1.25 if mark & TARGETED else 1.0)
    return speech * (0.0 if mark & NEGATED else 1.0) * (1.0 if mark & TARGETED else 0.1)


#: Arcs: insults by marks, then threats by marks.
START = np.array([_start(kind, mark) for kind in (INSULT, THREAT) for mark in range(MARKS)])
#: Arcs, the strongest clause, matched clauses for each hundred words.
FEATURES = len(START) + 2
#: Weights before fitting, the constant last.
PRIOR = np.array([*(2.0 * START), 1.0, 0.1, -2.5])


class Grammar:
    def __init__(self, stems: dict[str, float], whole: dict[str, float]):
        self.stems, self.whole = stems, whole | {w: 1.0 for w in INSULTS}
        self.plain = {w: s for s, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTED)) for w in ws}
        lead = "|".join(sorted(map(re.escape, {*self.whole, *THREATS}))) + "".join(f"|{re.escape(s)}" for s in sorted(stems))
        #: Every clause that can score holds one of these: the others are never lexed.
        self.gate = re.compile(rf"(?<![^\W\d_])(?:{lead})")

    def insult(self, word: str) -> float:
        if word in self.whole:
            return self.whole[word]
        return max((self.stems[word[:n]] for n in range(STEM[0], min(len(word), STEM[1]) + 1) if word[:n] in self.stems), default=0.0)

    def arcs(self, text: str) -> list[tuple[int, float]]:
        """Arcs that insults and threats of one clause take, with the words' weights."""
        words = WORD.findall(text)
        symbols = [self.plain.get(w, OTHER) for w in words]
        weights = [self.insult(w) if x == OTHER else 1.0 for w, x in zip(words, symbols, strict=True)]
        symbols = [INSULT if x == OTHER and w else x for x, w in zip(symbols, weights, strict=True)]
        marks = zip(FORWARD.marks(symbols), BACKWARD.marks(symbols[::-1])[::-1], strict=True)
        return [((x == THREAT) * MARKS + (m | k), w) for x, w, (m, k) in zip(symbols, weights, marks, strict=True) if x in (INSULT, THREAT)]

    def clause(self, text: str) -> tuple[float, float]:
        """Insult and threat scores of one clause by the fixed weights."""
        found = self.arcs(text)
        return tuple(sum(w * START[a] for a, w in found if (a >= MARKS) == threat) for threat in (False, True))

    def features(self, text: str | None) -> list[float]:
        """Sums of each arc over matched clauses, the strongest clause, and matched clauses for each hundred words."""
        sums, most, clauses, done = [0.0] * len(START), 0.0, 0, -1
        low = (text or "").lower()
        for m in self.gate.finditer(low):
            if m.start() < done:
                continue
            begin = max((low.rfind(x, max(0, done), m.start()) for x in ".!?;:,\n|"), default=-1) + 1
            stop = CLAUSE.search(low, m.start())
            done = stop.start() if stop else len(low)
            value = 0.0
            for arc, weight in self.arcs(low[begin:done]):
                sums[arc] += weight
                value += weight * START[arc]
            most, clauses = max(most, value), clauses + (value > 0)
        return [*map(math.log1p, sums), most, 100 * clauses / (1 + len(low) / 6)]


def _sample_rows(batches):
    """Of each labelled document: its distinct words and four min-hashes of its shingles, to tell near copies."""
    for batch in batches:
        for part in slices(batch):
            tokens, at = shingles(part.column("text"))
            rows = []
            for k, (d, y, t) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("toxic").to_pylist(), part.column("text").to_pylist(), strict=True)):
                own = tokens[at[k] : at[k + 1]]
                low = [int(((own * np.uint64(2 * j + 1)) & np.uint64((1 << 50) - 1)).min()) for j in range(1, 5)] if len(own) else []
                rows.append({"doc_id": d, "toxic": y, "words": sorted(set(WORD.findall((t or "").lower()))), "low": low, "text": t or ""})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("words", pa.list_(pa.string())), ("low", pa.list_(pa.int64())), ("text", pa.string())]))


def _stems(rows: list[tuple[int, list[str]]]) -> tuple[dict[str, float], dict[str, float]]:
    """Stems and whole words with their weights: the logarithm of their odds, as a share of the best ones'."""
    count, of = {0: Counter(), 1: Counter()}, Counter(y for y, _ in rows)
    for y, words in rows:
        count[y].update({*words, *(w[:n] + "*" for w in words for n in range(STEM[0], min(len(w), STEM[1]) + 1))})
    toxic, clean = count[1], count[0]
    good = {x: n for x, n in toxic.items() if n >= LEAST and n >= PRECISION * (n + clean[x])}
    odds = {x: math.log((n + 0.5) / (clean[x] + 0.5) * (of[0] + 1) / (of[1] + 1)) for x, n in good.items()}
    best = max(odds.values(), default=1.0)
    weight = {x: max(0.0, min(1.0, o / best)) for x, o in odds.items()}
    # Of stems that stand in the same documents the longest is taken: a shorter one would reach words that the sample lacks.
    same = {(x[:n] + "*", good[x], clean[x]) for x in good if x.endswith("*") for n in range(STEM[0], len(x) - 1)}
    stems = {x[:-1]: weight[x] for x in good if x.endswith("*") and (x, good[x], clean[x]) not in same}
    whole = {x: weight[x] for x in good if not x.endswith("*") and not any(x.startswith(y) and v >= weight[x] for y, v in stems.items())}
    return stems, whole


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, ridge: float = 0.5) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method, drawn to the prior; the constant is free."""
    x = np.column_stack([x, np.ones(len(x))])
    pull = np.full(len(prior), ridge)
    pull[-1] = 1e-3
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, x.T @ (y - p) - pull * (w - prior))
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, use: Column) -> tuple[Grammar, np.ndarray]:
    """Grammar and weights from at most SAMPLE labelled rows for which `use` holds (an expression over doc_id). Rows without a label of 0 or 1 teach nothing. With
    fewer than LEAST rows of a kind the seed lists and fixed weights hold."""
    some = labels.where(use & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # SAMPLE rows of two numbers
    seen: set[tuple[int, int]] = set()
    rows, held = [], Scratch(docs.sparkSession).save(texts.mapInArrow(_sample_rows, "doc_id long, toxic int, words array<string>, low array<long>, text string"))
    for r in sorted(held.select("doc_id", "toxic", "words", "low").toLocalIterator(), key=lambda r: r.doc_id):
        marks = set(enumerate(r.low))
        if len(marks & seen) < 2:
            rows.append((r.toxic, r.words))
        seen |= marks
    grammar = Grammar(*_stems(rows))
    fitted = held.select("toxic", "text").mapInArrow(_features(grammar, ["toxic"]), "toxic int, f array<double>").collect()
    y = np.array([r.toxic for r in fitted], float)
    if min(y.sum(), len(y) - y.sum()) < LEAST:
        return grammar, PRIOR.copy()
    return grammar, _logistic(np.array([r.f for r in fitted]), y)


def _features(grammar: Grammar, keep: list[str], name: str = "f"):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                f = [grammar.features(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(f, pa.list_(pa.float64()))], names=[*keep, name])

    return run


def score(docs: DataFrame, grammar: Grammar, weights: np.ndarray, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """keep's columns with the score (0 to 1) in column `name`; a column of that name among them gives way to it.

    Null and empty texts match no clause and get the constant's score. Each row stands alone, so repeated rows and ties change nothing; an empty table gives an
    empty table; texts are read whole.
    """
    kept = [c for c in keep if c != name]
    types, held = dict(docs.dtypes), "_features"
    while held in docs.columns:
        held += "_"
    made = docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(_features(grammar, kept, held), ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"`{held}` array<double>"]))
    z = sum((F.col(held)[k] * float(w) for k, w in enumerate(weights[:-1])), F.lit(float(weights[-1])))
    return made.select(*kept, (1 / (1 + F.exp(-z))).alias(name))

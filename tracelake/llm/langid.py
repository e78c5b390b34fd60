"""Language identification by rank-order profiles: out-of-place distance between a text's most frequent n-grams and those of each language.

N-grams are runs of one to three characters of lower-cased words with a blank on either side. Profiles are learned from labelled documents: of each language the
SAMPLE documents with the smallest hash, a bounded sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .textkit import slices

#: Documents of each language that a profile is learned from.
SAMPLE = 1000
#: Times SAMPLE that are expected below the hash that the sample is taken from.
SLACK = 4
#: N-grams of a profile.
RANKS = 300
NOT_LETTERS = r"[^\p{L}]+"


def _ngrams(text: str, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of a normalised text (words with blanks around) and their counts."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = c == 32
    pair = (c[:-1] << np.uint64(21)) | c[1:]
    triple = (pair[:-1] << np.uint64(21)) | c[2:]
    codes = np.concatenate([c[~blank], pair[~(blank[:-1] & blank[1:])], triple[~blank[1:-1]]])
    codes.sort()
    first = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1]) if len(codes) else np.zeros(0, int)
    return codes[first], np.diff(np.concatenate([first, [len(codes)]]))


def _top(codes: np.ndarray, counts: np.ndarray, most: int = RANKS) -> np.ndarray:
    """The most frequent codes, ties to the smaller code."""
    if len(codes) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:most]


def _normal(column: pa.Array) -> list[str | None]:
    low = pc.utf8_lower(column)
    return pc.binary_join_element_wise("", pc.replace_substring_regex(low, NOT_LETTERS, " "), "", " ").to_pylist()


def _count(batches):
    for batch in batches:
        total: dict[str, list] = {}
        for part in slices(batch):
            for lang, text in zip(part.column("lang").to_pylist(), _normal(part.column("text")), strict=True):
                if text and text.strip():
                    total.setdefault(lang, []).append(_ngrams(text))
        for lang, found in total.items():
            codes, where = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([n for _, n in found]))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])


def profiles(docs: DataFrame, learn: Column) -> dict[str, list[int]]:
    """The most frequent n-grams of each language, first the most frequent: at most RANKS numbers a language come to the driver."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    hashed = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    # So that one task never gets all rows of a language, only those with a small hash go on: about SLACK times SAMPLE documents, once each.
    share = hashed.groupBy(F.col("lang").alias("_lang")).agg((F.lit(SLACK * SAMPLE) / F.approx_count_distinct("h")).alias("_share"))
    small = hashed.join(F.broadcast(share), F.col("lang") == F.col("_lang")).where(F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("_share"))  # a row a language
    chosen = small.select("doc_id", "lang", "h").distinct().withColumn("r", rank).where(F.col("r") <= SAMPLE).select("doc_id").distinct()
    # SAMPLE ids a language: bounded, so they are broadcast.
    texts = docs.where(learn & F.col("lang").isNotNull()).join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")
    grams = texts.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    rows = grams.withColumn("r", F.row_number().over(order)).where(F.col("r") <= RANKS).select("lang", "gram", "r").collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.r)):
        out.setdefault(r.lang, []).append(r.gram)
    return out


def _predict(known: dict[str, list[int]], keep: list[str]):
    langs = sorted(known)
    vocabulary = np.unique(np.array([g for x in known.values() for g in x], np.uint64))
    place = np.full((len(langs), len(vocabulary) + 1), -1)
    for k, lang in enumerate(langs):
        place[k, np.searchsorted(vocabulary, np.array(known[lang], np.uint64))] = np.arange(len(known[lang]))

    def one(text: str | None) -> tuple[str, float]:
        if not text or not text.strip() or not langs:
            return "und", 0.0
        top = _top(*_ngrams(text))
        at = np.searchsorted(vocabulary, top)
        at[(at == len(vocabulary)) | (vocabulary[np.minimum(at, len(vocabulary) - 1)] != top)] = len(vocabulary)
        ranks = place[:, at]
        off = np.where(ranks < 0, RANKS, np.abs(ranks - np.arange(len(top)))).sum(1) / (RANKS * len(top))
        order = np.argsort(off, kind="stable")
        return langs[order[0]], float(1 - off[order[0]])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = [one(t) for t in _normal(part.column("text"))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, known: dict[str, list[int]], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns (any named lang_pred or score give way) with lang_pred and score (1 less the distance as a share of the largest possible one).

    Text null or without a letter, or no language learned: `und`, 0. Equal distances go to the first language by name. Each row stands alone: repeated rows and
    other columns change nothing. Texts are read whole.
    """
    types, keep = dict(docs.dtypes), tuple(c for c in keep if c not in ("lang_pred", "score"))
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "lang_pred string", "score double"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(_predict(known, list(keep)), schema)

"""Language identification by rank-order profiles of character n-grams (operator 7).

A profile is the `top` most frequent n-grams (n = 1 to 3, letters only, words padded by a boundary) in
order. A text gets the language whose profile is nearest by out-of-place distance: for each of the
text's own most frequent n-grams, how far its rank is from the rank in the profile; `top` if not there.

Learning counts n-grams over a bounded, documented sample: at most `per_lang` labelled rows a language,
chosen by hash of doc_id. Every letter of every script is a symbol of its own, so n-grams have 64-bit codes and are
counted sparsely. Profiles are `top` n-grams a language; scoring is one pass without a shuffle.

Nulls: a null text, and one without a letter, is `und` with score 0. Rows without lang, or with a null
doc_id, aren't learnt from. Without any labelled row every text is `und`. Ties go to the first
language in order. Repeated rows and ids are predicted each by their own text; of a repeated doc_id all rows may be
learnt from. A very long text takes memory in proportion to its length, several times its bytes. Extra columns are left
out (kept by with_language).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .tokens import LETTER, _classes

BASE = 1 << 18  # a boundary (0) and all letters of Unicode, fewer than 2**18


def letter_symbols() -> np.ndarray:
    """Symbol of each code point: letters are numbered in order, all else is a boundary."""
    letter = _classes() == LETTER
    return np.where(letter, np.cumsum(letter), 0).astype(np.int32)


class Ranks:
    """Ranks of n-gram codes in the profiles: ranks[language, code], -1 where the profile lacks the code."""

    def __init__(self, profiles: list[np.ndarray]):
        self.codes = np.unique(np.concatenate([np.zeros(1, np.int64), *profiles]))
        self.table = np.full((len(profiles), len(self.codes) + 1), -1, np.int32)
        for own, codes in zip(self.table, profiles, strict=True):
            own[np.searchsorted(self.codes, codes)] = np.arange(len(codes))

    def __getitem__(self, at: tuple) -> np.ndarray:
        langs, codes = at
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return self.table[langs, np.where(self.codes[place] == codes, place, len(self.codes))]


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each followed by a line end, and each text's offset."""
    low = [(t or "").lower() for t in texts]
    return np.frombuffer("".join(x + "\n" for x in low).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum([0, *(len(x) + 1 for x in low)])


def symbols(cps: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols with runs of non-letters as one boundary, and which code points were kept."""
    s = table[cps]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep].astype(np.int64), keep


def gram_codes(s: np.ndarray) -> np.ndarray:
    """Codes of the uni-, bi- and trigrams of one text's symbols; those of boundaries alone left out."""
    s = np.concatenate([[0], s]) if len(s) and s[0] else s
    one, two = s[s > 0], s[:-1] * BASE + s[1:]
    three = two[:-1] * BASE + s[2:]
    return np.concatenate([BASE**3 + BASE**2 + one, BASE**3 + two, three[s[1:-1] > 0]])


def ranked(codes: np.ndarray, top: int) -> np.ndarray:
    """The `top` most frequent of the codes, most frequent first, ties by code."""
    found, counts = np.unique(codes, return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:top]]


def learn_profiles(labelled: DataFrame, per_lang: int = 3000, top: int = 300) -> tuple[np.ndarray, list[str], Ranks]:
    """(symbol of each code point, languages, profile ranks[language, code]) from rows (doc_id, text, lang).

    Nothing larger than per_lang ids and `top` codes a language reaches the driver.
    """
    known = labelled.where("lang is not null and doc_id is not null").select("doc_id", "lang")
    # A share of each language by hash, somewhat above per_lang rows, goes into the exact pick. Counts are
    # a row a language, like the profiles, so they are broadcast and the rest is left out before the shuffle.
    counts = known.groupBy(F.col("lang").alias("own")).agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = known.join(F.broadcast(counts), F.col("lang") == F.col("own")).where(place * F.col("n") < 1.2 * per_lang + 100)
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = some.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_lang).select(F.col("doc_id").alias("chosen_id"))
    rows = labelled.where("lang is not null and text is not null").join(F.broadcast(chosen.distinct()), F.col("doc_id") == F.col("chosen_id"), "left_semi").select("text", "lang")

    table = letter_symbols()

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text"):
            cps, at = code_points(part.column("text").to_pylist())
            s, keep = symbols(cps, table)
            at = np.concatenate([[0], np.cumsum(keep)])[at]
            held: dict[str, list[np.ndarray]] = {}
            for i, lang in enumerate(part.column("lang").to_pylist()):
                held.setdefault(lang, []).append(gram_codes(s[at[i] : at[i + 1]]))
            for lang, own in held.items():
                codes, counts = np.unique(np.concatenate(own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["lang", "code", "n"])

    totals = rows.mapInArrow(grams, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    profile = totals.withColumn("rank", F.row_number().over(best) - 1).where(F.col("rank") < top).select("lang", "code", "rank").collect()
    own: dict[str, list[tuple[int, int]]] = {}
    for r in profile:
        own.setdefault(r.lang, []).append((r.rank, r.code))
    langs = sorted(own)
    return table, langs, Ranks([np.array([c for _, c in sorted(own[x])], np.int64) for x in langs])


def distances(codes: np.ndarray, ranks: Ranks, top: int) -> np.ndarray:
    """Out-of-place distance of a text's ranked codes to each profile."""
    there = ranks[:, codes]
    return np.where(there < 0, top, np.abs(there - np.arange(len(codes)))).sum(axis=1)


def predicted(column: pa.Array, model: tuple[np.ndarray, list[str], Ranks], top: int) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    table, langs, ranks = model
    cps, at = code_points(column.to_pylist())
    s, keep = symbols(cps, table)
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    pred, score = [], []
    for i in range(len(column)):
        codes = gram_codes(s[at[i] : at[i + 1]])
        if not len(codes) or not langs:
            pred.append("und")
            score.append(0.0)
            continue
        own = ranked(codes, top)
        d = distances(own, ranks, top)
        best = int(np.argmin(d))
        pred.append(langs[best])
        score.append(1.0 - float(d[best]) / (top * len(own)))
    return pred, score


def identify(docs: DataFrame, model: tuple[np.ndarray, list[str], Ranks], top: int = 300) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of `docs` (doc_id, text).

    score: 1 less the distance as a share of the largest possible one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text"):
            pred, score = predicted(part.column("text"), shared.value, top)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def with_language(docs: DataFrame, model: tuple[np.ndarray, list[str], Ranks], top: int = 300) -> DataFrame:
    """The rows of `docs` in which a language is found; each is judged by its own text, whatever its doc_id."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text"):
            pred, _ = predicted(part.column("text"), shared.value, top)
            yield part.filter(pa.array([p != "und" for p in pred], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)

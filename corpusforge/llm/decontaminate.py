"""Benchmark decontamination with an FM-index of each training shard (operator 3).

Phrases are all windows of `window` words of the benchmark items (an item of fewer words is one phrase).
A shard is a slice of about 1 MB of texts. Its words become symbols: words that no phrase holds, and runs
of words shorter than the shortest phrase, can't lie in an occurrence and collapse to one separator. The
FM-index of the rest is a suffix array by prefix doubling, its Burrows-Wheeler transform in a wavelet
tree, and suffix positions sampled every `SAMPLE` symbols. All phrases are searched backward at once by
wavelet ranks; occurrences are located by walking to a sampled suffix; spans that touch or overlap merge.

How it runs on Spark: one pass over the documents without a shuffle. Phrases are the only thing
broadcast; items are taken in parts of at most `max_phrases` phrases, each a pass of its own over the original
texts, so that the broadcast stays bounded however large the benchmark is (items come to the driver one part at a time).
With several parts, rows are saved with a number of their own, each part's spans are saved and its phrases released, and a
row's spans of all parts are merged by its number before anything is cut.

Nulls: a null text or item has no words. Repeated items count under each of their ids; an item without an id has hits but
is not listed. Rows with a null or repeated doc_id are each scanned by their own text and keep their ids. An empty
benchmark hits nothing; an empty table gives no rows. Ties can't occur: spans that touch are one. Extra columns are left
out of spans and kept by remove_spans. A very long text is a shard of its own and takes memory in proportion to its
length, several times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .durable import saved

SAMPLE = 8


class WaveletTree:
    """Ranks of symbols below 2**levels, level by level from the high bit (a wavelet matrix)."""

    def __init__(self, x: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        for k in range(self.levels - 1, -1, -1):
            bit = (x >> k & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(x) - int(bit.sum()))
            x = np.concatenate([x[~bit], x[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before place i; both arrays."""
        low = np.zeros(len(i), np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (c >> (self.levels - 1 - k) & 1).astype(bool)
            i = np.where(bit, zeros + ones[i], i - ones[i])
            low = np.where(bit, zeros + ones[low], low - ones[low])
        return i - low


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Order of the suffixes of x, whose last symbol is its unique least; by prefix doubling."""
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(len(x), np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (len(x) + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank[order] = fresh
        if fresh[-1] == len(x) - 1 or step >= len(x):
            return order
        step *= 2


class FMIndex:
    """Backward search and location over an array of symbols 1 .. sigma - 1."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        x = np.append(symbols, 0)
        sa = suffix_array(x)
        self.bwt = x[sa - 1]
        self.before = np.searchsorted(x[sa], np.arange(sigma + 1))
        self.tree = WaveletTree(self.bwt, sigma)
        self.sampled = sa % SAMPLE == 0
        self.samples = sa[self.sampled]
        self.sample_at = np.cumsum(self.sampled) - 1

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of the phrases, one a row, right-aligned and filled with 0 on the left."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            go = np.flatnonzero((phrases[:, k] > 0) & (low < high))
            c = phrases[go, k]
            low[go], high[go] = self.before[c] + self.tree.rank(c, low[go]), self.before[c] + self.tree.rank(c, high[go])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks, by LF steps to a sampled one."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walk = np.flatnonzero(~self.sampled[at])
        while len(walk):
            c = self.bwt[at[walk]]
            at[walk] = self.before[c] + self.tree.rank(c, at[walk])
            steps[walk] += 1
            walk = walk[~self.sampled[at[walk]]]
        return self.samples[self.sample_at[at]] + steps


class Phrases:
    """Distinct phrases of some items as symbols, and the items of each."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        data, offsets = T.buffers(pa.array([t for _, t in items], pa.string()))
        data = T.LOWER[data]
        starts, ends, first = T.word_spans(data, offsets, T.ALNUM)
        self.vocabulary, code = np.unique(T.word_hashes(data, starts, ends), return_inverse=True)
        code = code + 2  # 0 ends the text, 1 separates
        found: dict[tuple, list[int]] = {}
        for i in range(len(items)):
            own = code[first[i] : first[i + 1]].tolist()
            for k in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[k : k + window]), []).append(i)
        self.ids = [x for x, _ in items]
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.symbols = np.zeros((len(found), window), np.int64)
        for k, p in enumerate(found):
            self.symbols[k, window - len(p) :] = p
        self.items = list(found.values())
        self.least = int(self.lengths.min()) if len(found) else 0
        self.sigma = len(self.vocabulary) + 2

    def occurrences(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, index of its first word) of all occurrences in rows of words, given as hashes."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.items) or not len(words):
            return none
        place = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        symbol = np.where(self.vocabulary[place] == words, place + 2, 1)
        edge = np.zeros(len(words) + 1, bool)
        edge[first] = True
        inside = symbol > 1
        begins = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], ~inside[:-1]])))
        stops = np.flatnonzero(inside & (edge[1:] | np.concatenate([~inside[1:], [True]]))) + 1
        long = stops - begins >= self.least
        begins, stops = begins[long], stops[long]
        if not len(begins):
            return none
        sizes = stops - begins + 1  # with a separator after each run
        ends = np.cumsum(sizes)
        origin = np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1])
        origin[ends - 1] = -1
        reduced = np.where(origin < 0, 1, symbol[origin])
        present = np.zeros(self.sigma, bool)
        present[reduced] = True
        here = np.flatnonzero((present[self.symbols] | (self.symbols == 0)).all(axis=1))
        if not len(here):
            return none
        index = FMIndex(reduced, self.sigma)
        low, high = index.search(self.symbols[here])
        count = np.maximum(0, high - low)
        phrase = np.repeat(here, count)
        if not len(phrase):
            return none
        rows = np.arange(len(phrase)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return phrase, origin[index.locate(rows)]


def merged(begins: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Spans that touch or overlap as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(begins.tolist(), stops.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def item_parts(benchmark: DataFrame, window: int, max_phrases: int) -> Iterator[Phrases]:
    """The items in parts of bounded size; an item larger than a part is one."""
    held, size = [], 0
    for row in benchmark.select("item_id", F.col("text").cast("string").alias("text")).orderBy("item_id", "text").toLocalIterator():
        n = len((row.text or "").split()) + 1
        if held and size + n > max_phrases:
            yield Phrases(held, window)
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += n
    if held:
        yield Phrases(held, window)


SPANS = "doc_id long, n_words long, word_spans array<struct<start:long,end:long>>, byte_spans array<struct<start:long,end:long>>, items array<string>"


ROW = "_decontaminate_row"


def _scan(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """SPANS of every row by the broadcast Phrases, after its number where `docs` has one."""
    numbered = [ROW] if ROW in docs.columns else []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for part in T.slices(batches, "text"):
            by_words, by_bytes, items, n = spans_of(part.column("text"), p)
            as_structs = lambda rows: pa.array([[{"start": a, "end": b} for a, b in r] for r in rows], span)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in numbered), part.column("doc_id"), pa.array(n, pa.int64()), as_structs(by_words), as_structs(by_bytes), pa.array(items, pa.list_(pa.string()))], [*numbered, "doc_id", "n_words", "word_spans", "byte_spans", "items"])

    source = docs.select(*numbered, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(work, ", ".join([*(f"{c} long" for c in numbered), SPANS]))


def spans_of(column: pa.Array, p: Phrases) -> tuple[list, list, list, np.ndarray]:
    """For each row: merged hit spans in words and in UTF-8 bytes, ids of items found, number of words."""
    data, offsets = T.buffers(column)
    data = T.LOWER[data]
    starts, ends, first = T.word_spans(data, offsets, T.ALNUM)
    phrase, at = p.occurrences(T.word_hashes(data, starts, ends), first)
    row = np.searchsorted(first, at, "right") - 1
    by_words, by_bytes, items = ([[] for _ in range(len(column))] for _ in range(3))
    for r in np.unique(row).tolist():
        mine = row == r
        spans = merged(at[mine], at[mine] + p.lengths[phrase[mine]])
        by_words[r] = [(a - first[r], b - first[r]) for a, b in spans]
        by_bytes[r] = [(starts[a] - offsets[r], ends[b - 1] - offsets[r]) for a, b in spans]
        items[r] = sorted({str(p.ids[i]) for k in np.unique(phrase[mine]).tolist() for i in p.items[k] if p.ids[i] is not None})
    return by_words, by_bytes, items, np.diff(first)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_phrases: int = 500_000) -> DataFrame:
    """One row a document of `docs` (doc_id, text): n_words, word_spans and byte_spans to remove, items found.

    benchmark: (item_id, text). Spans are half-open and sorted; items are ids as strings, sorted.
    """
    parts = item_parts(benchmark, window, max_phrases)
    first, second = next(parts, None) or Phrases([], window), next(parts, None)
    if second is None:
        return _scan(docs, docs.sparkSession.sparkContext.broadcast(first))
    return _merged_scans(_numbered(docs), chain([first, second], parts)).drop(ROW)


def _numbered(docs: DataFrame) -> DataFrame:
    """`docs` with a number of each row's own; saved, as numbers hold for one run only."""
    return saved(docs.withColumn(ROW, F.monotonically_increasing_id()))


def _merged_scans(numbered: DataFrame, parts: Iterator[Phrases]) -> DataFrame:
    """(ROW, SPANS) of every row over all parts: spans that touch or overlap in words are one, as within a part."""
    both = None
    for p in parts:
        shared = numbered.sparkSession.sparkContext.broadcast(p)
        found = _scan(numbered, shared).withColumn("both", F.arrays_zip("word_spans", "byte_spans"))
        found = saved(found if both is None else found.where("size(both) > 0"))
        shared.destroy()  # one part's phrases at a time
        both = found if both is None else both.unionByName(found)
    spans = both.groupBy(ROW).agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("both"))).alias("both"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    last = lambda acc: F.element_at(acc, -1)
    longer = lambda a, b, c: F.struct(a[c]["start"].alias("start"), F.greatest(a[c]["end"], b[c]["end"]).alias("end")).alias(c)
    grown = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(longer(last(acc), x, "word_spans"), longer(last(acc), x, "byte_spans"))))
    meets = lambda acc, x: (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["word_spans"]["end"] >= x["word_spans"]["start"])
    joined = F.aggregate("both", F.slice("both", 1, 0), lambda acc, x: F.when(meets(acc, x), grown(acc, x)).otherwise(F.concat(acc, F.array(x))))
    spans = spans.withColumn("both", joined)
    return spans.select(ROW, "doc_id", "n_words", F.col("both.word_spans").alias("word_spans"), F.col("both.byte_spans").alias("byte_spans"), "items")


def removed(text: str | None, spans: list) -> str | None:
    """`text` without the byte spans; what stood before and after is joined by one space."""
    if text is None or not spans:
        return text
    raw = text.encode()
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return " ".join(k.decode().strip(" ") for k in kept).strip(" ")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_phrases: int = 500_000) -> DataFrame:
    """`docs` with every occurrence cut out of `text` (n_chars, if there, follows); all else stays as it is."""
    parts = item_parts(benchmark, window, max_phrases)
    first, second = next(parts, None), next(parts, None)
    if first is None:
        return docs
    names = docs.columns
    if second is None:
        shared, source = docs.sparkSession.sparkContext.broadcast(first), docs
    else:
        numbered = _numbered(docs)
        hit = _merged_scans(numbered.select(ROW, F.lit(None).alias("doc_id"), "text"), chain([first, second], parts)).where("size(byte_spans) > 0")
        hit = hit.select(F.col(ROW).alias("_hit"), F.col("byte_spans").alias("_spans"))
        shared, source = None, numbered.join(hit, F.col(ROW) == F.col("_hit"), "left").select(*names, "_spans")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text"):
            if shared is None:
                spans = [[(s["start"], s["end"]) for s in row or []] for row in part.column("_spans").to_pylist()]
                part = part.select(names)
            else:
                spans = spans_of(part.column("text"), shared.value)[1]
            if any(spans):
                texts = [removed(t, s) if s else t for t, s in zip(part.column("text").to_pylist(), spans, strict=True)]
                part = part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, part.schema.field("text").type))
                if "n_chars" in part.schema.names:
                    chars = [len(t) if s else n for t, s, n in zip(texts, spans, part.column("n_chars").to_pylist(), strict=True)]
                    part = part.set_column(part.schema.get_field_index("n_chars"), "n_chars", pa.array(chars, part.schema.field("n_chars").type))
            yield part

    return source.mapInArrow(work, docs.schema)

"""Periodic run detection: Lyndon roots extended by LCE on suffix trees of text and reversal (operator 11).

A run is a stretch of consecutive words with smallest period q, at least max(least, exponent * q) words long,
that no neighbouring word extends keeping the period. The longest Lyndon words that start at each place, under
an order of words and under the reverse order, hold a root of every run. Each such root (place, length) is
extended to both sides by the longest common extension: the depth of the lowest common ancestor of two
leaves, in Ukkonen's suffix tree of the words forwards and in that of the words reversed. Ancestors come in
constant time from a table of range minima over the tree's Euler tour; the tour's leaves in order give the suffixes' ranks, and
next smaller ranks give the Lyndon words.

Trees are built of the zones of a text that can hold a run. For each power of two g, a run of period q with g <= q < 2g
holds more than 2g consecutive places whose g words come again at most q words later. Stretches of so many
such places, grown by 3g words, hold every such run whole; natural text has hardly any. The zones of a slice of
rows, apart by separators of their own, are one tree. Words of zones are told apart by their bytes,
so hashes (which only choose zones) can't lead to wrong runs.

One pass without a shuffle. Slices hold 256 KB of text; a longer text is one slice and takes memory in proportion to
its length (some 900 bytes a word of its zones, measured at 100,000 words). Nulls and texts without words have no runs; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

RUNS = "array<struct<start:long,length:long,period:long>>"


# -- suffix trees -----------------------------------------------------------------------------------------------------


def ukkonen(s: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The suffix tree of s, whose last symbol occurs once: of each node its parent, the symbol and length of the edge
    to it, and its suffix (-1 for inner nodes). Node 0 is the root; nodes are in order of creation."""
    n, sigma = len(s), max(s) + 1
    start, end, link, leaf = [0], [0], [0], [-1]
    children: dict[int, int] = {}
    node = edge = length = pending = 0
    for i, c in enumerate(s):
        last = 0
        pending += 1
        while pending:
            if not length:
                edge = i
            key = node * sigma + s[edge]
            child = children.get(key)
            if child is None:
                children[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                leaf.append(i - pending + 1)
                if last:
                    link[last] = node
                    last = 0
            else:
                at = start[child]
                size = (end[child] if end[child] <= i else i + 1) - at
                if length >= size:
                    node, edge, length = child, edge + size, length - size
                    continue
                if s[at + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                inner = len(start)
                children[key] = inner
                start += (at, i)
                end += (at + length, n)
                link += (0, 0)
                leaf += (-1, i - pending + 1)
                children[inner * sigma + s[at + length]] = child
                children[inner * sigma + c] = inner + 1
                start[child] = at + length
                if last:
                    link[last] = inner
                last = inner
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - pending + 1
    parent, symbol = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    keys = np.fromiter(children.keys(), np.int64, len(children))
    nodes = np.fromiter(children.values(), np.int64, len(children))
    parent[nodes], symbol[nodes] = keys // sigma, keys % sigma
    return parent, symbol, np.array(end, np.int64) - np.array(start, np.int64), np.array(leaf, np.int64)


class Extensions:
    """Longest common extensions of the suffixes of a list of symbols, and the suffixes' ranks."""

    def __init__(self, s: list[int]):
        parent, symbol, width, leaf = ukkonen(s)
        m = len(parent)
        order = np.lexsort((-symbol[1:], parent[1:])) + 1  # children of one parent together, largest symbol first
        low = np.searchsorted(parent[order], np.arange(m + 1)).tolist()
        kids, wide, above = order.tolist(), width.tolist(), parent.tolist()
        depth, tour, stack = [0] * m, [], [0]
        while stack:
            v = stack.pop()
            tour.append(v)
            if v:
                depth[v] = depth[above[v]] + wide[v]
            if low[v] < low[v + 1]:
                stack += kids[low[v] : low[v + 1]]
        tour, depth = np.array(tour, np.int64), np.array(depth, np.int64)
        # Between the first visits of two leaves the tour goes up to their lowest common ancestor and down again by one of
        # its children: the least depth of a parent there is the ancestor's. So one entry a first visit is enough.
        leaves = leaf[tour] >= 0
        self.place = np.zeros(len(s), np.int64)
        self.place[leaf[tour[leaves]]] = np.flatnonzero(leaves)
        self.rank = np.zeros(len(s), np.int64)
        self.rank[leaf[tour[leaves]]] = np.arange(len(s))
        table = [depth[parent[tour]].astype(np.int32)]
        while 2 << len(table) - 1 <= m:
            half = 1 << len(table) - 1
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self.table = table

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The longest common extensions of suffixes a and b (which differ)."""
        a, b = self.place[a], self.place[b]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        return out


def next_smaller(rank: list[int]) -> np.ndarray:
    """For each place the next one of smaller rank, or the end."""
    out, held = [len(rank)] * len(rank), []
    for i in range(len(rank) - 1, -1, -1):
        r = rank[i]
        while held and rank[held[-1]] > r:
            held.pop()
        if held:
            out[i] = held[-1]
        held.append(i)
    return np.array(out, np.int64)


def runs_in(s: list[int], least: int, exponent: int) -> np.ndarray:
    """(start, length, period) of the runs of s in order of start, then period; its first and last symbols occur once and
    are smaller than those between."""
    n = len(s)
    forwards = Extensions(s)
    rank = forwards.rank
    ends = [next_smaller(r.tolist()) for r in (rank, n - 1 - rank)]
    start = np.tile(np.arange(n), 2)
    period = np.concatenate(ends) - start
    some = (start > 0) & (start + period < n) & (period * exponent <= n)
    start, period = start[some], period[some]
    right = forwards.common(start, start + period)
    del forwards
    # Words before a place p are, in the reversed list, the suffix at n - p.
    left = Extensions(s[::-1]).common(n - start, n - start - period)
    length = left + period + right
    good = length >= np.maximum(least, exponent * period)
    found = np.stack([start - left, length, period], axis=1)[good]
    found = np.unique(found, axis=0) if len(found) else found
    return found[np.lexsort((found[:, 2], found[:, 0]))]


# -- zones ------------------------------------------------------------------------------------------------------------


def zones(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and stops of disjoint stretches of words (hashes; each row's begin at `first`) that hold every run."""
    n = len(words)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stop = first[1:][row]
    salted = T.mix(words + row.astype(np.uint64) * T.RADIX)
    grams, active = salted, np.arange(n)
    edge = np.zeros(n + 1, np.int64)
    g = 1
    while len(active):
        order = np.argsort(grams[active], kind="stable")
        at = active[order]
        same = grams[at[1:]] == grams[at[:-1]]
        soon = np.zeros(n + 1, bool)
        soon[at[:-1][same & (np.diff(at) < 2 * g)]] = True
        change = np.flatnonzero(np.diff(soon.astype(np.int8), prepend=0))
        begins, ends = change[::2], change[1::2]
        long = ends - begins > 2 * g
        begins, ends = begins[long], ends[long]
        # A stretch may reach over the end of a row, where nothing tells rows apart: cut it there when zones are made.
        np.add.at(edge, begins, 1)
        np.add.at(edge, np.minimum(ends - 1 + 3 * g, n), -1)
        again = np.zeros(n + g, bool)  # places whose g words come elsewhere in the row too
        again[at[:-1][same]] = True
        again[at[1:][same]] = True
        active = active[again[active] & again[np.minimum(active + g, n + g - 1)] & (active + 2 * g <= stop[active])]
        longer = np.zeros(n, np.uint64)
        longer[active] = T.mix(grams[active] * T.RADIX + grams[active + g])
        grams = longer
        g *= 2
    inside = np.cumsum(edge[:-1]) > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    heads = first[:-1][np.diff(first) > 0]
    opens[heads] = inside[heads]
    begins = np.flatnonzero(opens)
    closed = np.ones(n, bool)
    closed[:-1] = ~inside[1:] | opens[1:]
    return begins, np.flatnonzero(inside & closed) + 1


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """(word, length, period) of the runs of all rows, words counted through all rows."""
    if not len(starts):
        return np.zeros((0, 3), np.int64)
    begins, stops = zones(T.word_hashes(data, starts, ends), first)
    wide = stops - begins >= least
    begins, stops = begins[wide], stops[wide]
    if not len(begins):
        return np.zeros((0, 3), np.int64)
    raw, known, symbols, origin = data.tobytes(), {}, [], []
    for k, (a, b) in enumerate(zip(begins.tolist(), stops.tolist(), strict=True)):
        symbols.append(k)
        origin.append(-1)
        span = zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)
        symbols += [known.setdefault(raw[x:y], len(known)) + len(begins) + 1 for x, y in span]
        origin += range(a, b)
    symbols.append(len(begins))
    found = runs_in(symbols, least, exponent)
    if len(found):
        found[:, 0] = np.array(origin, np.int64)[found[:, 0]]
    return found


# -- the operator -----------------------------------------------------------------------------------------------------


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, runs: np.ndarray) -> pa.Array:
    """Each row's words outside of repetitions (what follows a run's first period), joined by one space."""
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    count = np.searchsorted(kept, first)  # kept words before each row
    follows = np.ones(len(kept), np.int64)
    follows[count[1:][np.diff(count) > 0] - 1] = 0  # a row's last one has no space
    out = np.append(data, np.uint8(0x20))
    out[ends[kept[follows > 0]]] = 0x20
    mask = np.zeros(len(out) + 1, np.int8)
    np.add.at(mask, starts[kept], 1)
    np.add.at(mask, ends[kept] + follows, -1)
    size = np.concatenate([[0], np.cumsum(ends[kept] - starts[kept] + follows)])
    return pa.StringArray.from_buffers(len(count) - 1, pa.py_buffer(size[count].astype(np.int32)), pa.py_buffer(out[np.cumsum(mask[:-1], dtype=np.int8) > 0]))


def find_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of `docs` (doc_id, text): its runs of words in order of start, then
    period (starts count from 0), and its words without repetitions, joined by one space. Words are what white space parts."""
    if exponent < 4 or least < 1:
        raise ValueError("zones hold runs of four periods or more")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text"):
            data, offsets = T.buffers(part.column("text"))
            starts, ends, first = T.word_spans(data, offsets, T.NOT_SPACE)
            runs = runs_of(data, starts, ends, first, least, exponent)
            texts = _collapsed(data, starts, ends, first, runs)
            row = np.searchsorted(first, runs[:, 0], "right") - 1
            at = np.searchsorted(row, np.arange(len(first))).astype(np.int32)
            fields = [pa.array(runs[:, 0] - first[row]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
            lists = pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), lists, texts], ["doc_id", "n_words", "runs", "collapsed"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return source.mapInArrow(work, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")

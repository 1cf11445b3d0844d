"""Quality classifier: hashed word n-gram logistic regression trained by FTRL-proximal (operator 4).

Features are uni- and bigrams of the words of a text and of the words' shapes (upper-case runs `A`,
lower-case `a`, digits `0`, other bytes as they are), and whether a bigram is one word twice, hashed into
2**BITS weights; a feature's value is its share of the text's features times `SCALE`. Shapes and repeats
carry over to words never seen.

Training uses a bounded, documented sample: the first `max_train` labelled rows by hash of doc_id. It
is one task over those rows' sparse features. Scoring is one pass without a shuffle: the sparse dot
product of a text's features and the weights (a broadcast of fixed size, 4 x 2**BITS bytes).

Nulls: a null or wordless text has no features and gets the bias's score. Labels that are null or of
unknown documents aren't learnt from; of several labels of one doc_id the least counts. Without any
label every score is 0.5. Rows with a null or repeated doc_id are scored each; equal texts have equal scores. A very
long text takes memory in proportion to its length, several times its bytes; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

BITS = 18
SCALE = 24.0
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[0x41:0x5B] = 0x41
SHAPE[0x61:0x7B] = 0x61
SHAPE[0x80:] = 0x61
SHAPE[0x30:0x3A] = 0x30


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all rows, repeats included, and each row's offset in them."""
    data, offsets = T.buffers(column)
    starts, ends, first = T.word_spans(data, offsets, T.NOT_SPACE)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    words = T.word_hashes(T.LOWER[data], starts, ends)
    shape = SHAPE[data]
    kept = np.ones(len(shape), bool)
    kept[1:] = shape[1:] != shape[:-1]
    kept[starts] = True
    at = np.concatenate([[0], np.cumsum(kept)])
    shapes = T.word_hashes(shape[kept], at[starts], at[ends])
    last = np.zeros(len(words), bool)
    last[first[1:][first[1:] > first[:-1]] - 1] = True
    streams = []
    for salt, x in ((1, words), (2, shapes)):
        after = np.where(last, np.uint64(0), np.roll(x, -1))
        streams += [T.mix(x + np.uint64(salt)), T.mix(x * T.RADIX + after + np.uint64(salt + 8))]
    again = words == np.where(last, np.uint64(0), np.roll(words, -1))
    streams.append(T.mix(np.where(again, np.uint64(21), np.uint64(20))))
    flat = np.stack(streams, axis=1).ravel()
    return (flat >> np.uint64(64 - BITS)).astype(np.int64), first * len(streams)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 3, alpha: float = 0.1, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by follow-the-regularised-leader over (features, values, label) rows."""
    size = (1 << BITS) + 1  # the last weight is the bias
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray | slice) -> np.ndarray:
        over = np.abs(z[i]) - l1
        return np.where(over <= 0, 0.0, -np.sign(z[i]) * over / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i, v, y = rows[k]
            i, v = np.append(i, size - 1), np.append(v, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ v, -35, 35)))
            g = (p - y) * v
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    w = weights(slice(None))
    return w[:-1].astype(np.float32), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, max_train: int = 8000) -> tuple[np.ndarray, float]:
    """Weights and bias from `docs` (doc_id, text) and `labels` (doc_id, label 0 or 1)."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in T.slices(batches, "text"):
            flat, at = features(part.column("text"))
            rows = [np.unique(flat[at[i] : at[i + 1]], return_counts=True) for i in range(part.num_rows)]
            values = [(c * (SCALE / max(1, c.sum()))).astype(np.float32) for _, c in rows]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([i.astype(np.int32) for i, _ in rows], pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["doc_id", "label", "i", "v"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            i, v = batch.column("i"), batch.column("v")
            rows += [(d, i[k].values.to_numpy(), v[k].values.to_numpy(), y) for k, (d, y) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("label").to_pylist(), strict=True))]
        rows.sort(key=lambda r: r[0])  # the same weights however rows arrive
        if rows:
            w, bias = ftrl([(i.astype(np.int64), v.astype(float), y) for _, i, v, y in rows])
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias])], ["w", "bias"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "label")), "doc_id").select("doc_id", "label", "text")
    got = rows.mapInArrow(sparse, "doc_id long, label int, i array<int>, v array<float>").repartition(1).mapInArrow(fit, "w binary, bias double").collect()
    return (np.frombuffer(got[0].w, np.float32), got[0].bias) if got else (np.zeros(1 << BITS, np.float32), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score) for every row of `docs` (doc_id, text): how likely label 1 is."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for part in T.slices(batches, "text"):
            flat, at = features(part.column("text"))
            sums = np.concatenate([[0.0], np.cumsum(w[flat], dtype=np.float64)])
            x = (sums[at[1:]] - sums[at[:-1]]) * SCALE / np.maximum(1, np.diff(at)) + bias
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(x, -35, 35))))], ["doc_id", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(work, "doc_id long, score double")

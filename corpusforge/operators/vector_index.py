"""Approximate nearest neighbours by L2 over inverted lists of product-quantised codes, with exact reranking.

Lists grow with the rows: about the square root of their number, found in two levels of k-means on a bounded sample (groups
of lists, then the lists of each group), so that a vector is compared with some 2 * n**(1/4) centres. A vector is
stored as its list and a code of one byte for every few components of what its list's centre leaves over; searches
shuffle codes, not vectors.

A query visits its nearest lists. How many is calibrated on the sample: so many that the given share of true neighbours
of trial rows lies in them; the sample is thinner than the whole, so its neighbours are farther and the number errs upwards.
The best codes of all visited lists, `rerank` times k, are then measured exactly.

Lists with more rows, or more visiting queries, than a task holds are dealt into parts by their own sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed, fresh_path

ENTRIES = 256
TRIALS = 200


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances, up to a row's own square."""
    return (y * y).sum(1) - 2 * x @ y.T


def _nearest(x: np.ndarray, y: np.ndarray, block: int = 4096) -> np.ndarray:
    return np.concatenate([np.argmin(_distances(x[i : i + block], y), axis=1) for i in range(0, len(x), block)] or [np.zeros(0, np.int64)])


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """At most k centres of x, started from rows at equal steps; a centre without rows stays."""
    centres = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


@dataclass
class Model:
    """Centres of lists by group, and the codebooks of what they leave over."""

    groups: np.ndarray
    first: np.ndarray  # of each group its first list (with one more at the end)
    centres: np.ndarray
    cuts: np.ndarray  # where the parts of a vector begin (with one more at the end)
    books: list[np.ndarray]
    probes: int = 1

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The list of each row: the nearest of its nearest group."""
        group, out = _nearest(x, self.groups), np.zeros(len(x), np.int64)
        for g in np.unique(group).tolist():
            mine = group == g
            a, b = self.first[g], self.first[g + 1]
            out[mine] = a + _nearest(x[mine], self.centres[a:b])
        return out

    def visits(self, x: np.ndarray, most: int) -> np.ndarray:
        """The `most` nearest lists of each row, nearest first."""
        return np.argsort(_distances(x, self.centres), axis=1, kind="stable")[:, :most]

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.centres[lists]
        return np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)], axis=1).astype(np.uint8)

    def table(self, q: np.ndarray, which: int) -> np.ndarray:
        """Squared distances of one query's parts from all entries, as seen from a list's centre."""
        rest = q - self.centres[which]
        out = np.full((len(self.books), ENTRIES), np.inf)
        for p, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)):
            out[p, : len(book)] = ((book - rest[a:b]) ** 2).sum(1)
        return out


def fit(sample: np.ndarray, n: int, k: int, share: float, width: int = 4) -> Model:
    """A model for n rows from a sample of them, with the number of lists to visit for that share of the k nearest."""
    lists = int(min(max(1, round(n**0.5)), max(1, len(sample) // 8)))
    groups = k_means(sample, max(1, round(lists**0.5)))
    own = _nearest(sample, groups)
    kept = [g for g in range(len(groups)) if (own == g).any()]
    parts = [k_means(sample[own == g], max(1, round(lists * (own == g).mean()))) for g in kept]
    first = np.cumsum([0, *(len(p) for p in parts)])
    dims = sample.shape[1]
    cuts = np.linspace(0, dims, max(1, -(-dims // width)) + 1).astype(int)
    model = Model(groups[kept], first, np.concatenate(parts), cuts, [])
    held = model.lists(sample)
    rest = sample - model.centres[held]
    some = rest[: 64 * ENTRIES]
    model.books = [k_means(some[:, a:b], ENTRIES) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    trial = sample[:: max(1, len(sample) // TRIALS)][:TRIALS]
    d = _distances(trial, sample)
    near = np.argsort(d, axis=1, kind="stable")[:, : k + 1]  # itself too
    rank = np.argsort(model.visits(trial, len(model.centres)), axis=1)
    at = np.take_along_axis(rank, held[near], axis=1)
    model.probes = int(np.quantile(at, share, method="higher")) + 1
    return model


@dataclass
class VectorIndex:
    """Saved codes (key, list, code) of all vectors, with the model and the vectors for exact distances."""

    vectors: DataFrame
    codes: DataFrame
    key: str
    shared: Broadcast
    block: int

    def visits(self, queries: DataFrame) -> DataFrame:
        """(query_id, embedding, list, nth) of the lists that each query (query_id, embedding) visits."""
        shared = self.shared

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                if batch.num_rows and model is not None:
                    found = model.visits(_matrix(batch.column("embedding")), model.probes)
                    row = pa.array(np.repeat(np.arange(batch.num_rows), found.shape[1]))
                    yield pa.RecordBatch.from_arrays([*(c.take(row) for c in batch.columns), pa.array(found.ravel().astype(np.int32))], [*batch.schema.names, "list"])

        asked = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return asked.mapInArrow(work, "query_id long, embedding array<double>, list int")

    def sizes(self) -> DataFrame:
        return self.codes.groupBy("list").agg(F.count("*").alias("rows"))

    def candidate_share(self, queries: DataFrame) -> float:
        """The mean share of all vectors whose codes a query reads."""
        asked = queries.where("embedding is not null").count()
        read = self.visits(queries).join(self.sizes(), "list").agg(F.sum("rows")).first()[0] or 0
        return read / max(1, asked * self.codes.count())

    def search(self, queries: DataFrame, k: int, rerank: int = 20) -> DataFrame:
        """(query_id, key, distance, rank): the k nearest vectors found, by exact distance; fewer if lists hold fewer."""
        key, shared, kind = self.key, self.shared, self.vectors.schema[self.key].dataType.simpleString()
        asked = checkpointed(self.visits(queries))
        n_parts = F.ceil(F.col("rows") / self.block).cast("int")
        parts = self.sizes().join(asked.groupBy("list").agg(F.count("*").alias("asked")), "list").select("list", n_parts.alias("vp"), F.ceil(F.col("asked") / self.block).cast("int").alias("qp"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        held = self.codes.join(parts, "list").select(key, "list", "code", own(key, "vp").alias("_v"), each("qp").alias("_q"))
        probing = asked.join(parts, "list").select("query_id", "embedding", "list", own("query_id", "qp").alias("_q"), each("vp").alias("_v"))
        most = rerank * k

        def scan(a: pa.Table, h: pa.Table) -> pa.Table:
            model, ids, found, near = shared.value, a.column("query_id").to_numpy(), [], []
            if a.num_rows and h.num_rows:
                which = h.column("list")[0].as_py()
                codes = np.frombuffer(b"".join(h.column("code").to_pylist()), np.uint8).reshape(h.num_rows, -1)
                for q in _matrix(a.column("embedding")):
                    d = np.take_along_axis(model.table(q, which), codes.T.astype(np.int64), axis=1).sum(0)
                    best = np.argpartition(d, most - 1)[:most] if len(d) > most else np.arange(len(d))
                    found.append(best)
                    near.append(d[best])
            at = np.concatenate(found or [np.zeros(0, np.int64)])
            out = h.select([key]).take(pa.array(at))
            return out.add_column(0, "query_id", pa.array(np.repeat(ids, [len(x) for x in found] or 0), pa.int64())).append_column("near", pa.array(np.concatenate(near or [np.zeros(0)])))

        by = ["list", "_v", "_q"]
        seen = probing.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(scan, f"query_id long, `{key}` {kind}, near double")
        order = Window.partitionBy("query_id").orderBy("near", key)
        few = seen.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("query_id", key)
        exact = few.join(self.vectors, key).join(asked.select("query_id", F.col("embedding").alias("_asked")).dropDuplicates(["query_id"]), "query_id")

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    d = np.sqrt(((_matrix(batch.column("embedding")) - _matrix(batch.column("_asked"))) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column(key), pa.array(d)], ["query_id", key, "distance"])

        measured = exact.select("query_id", key, F.col("embedding").cast("array<double>").alias("embedding"), "_asked").mapInArrow(measure, f"query_id long, `{key}` {kind}, distance double")
        w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), key)
        return measured.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def build_index(vectors: DataFrame, key: str = "vec_id", k: int = 10, share: float = 0.97, sample: int = 20_000, block: int = 20_000) -> VectorIndex:
    """Index all vectors (key, embedding) that aren't null; keys are distinct. The model is fit on `sample` rows at most, by hash."""
    pool = vectors.where("embedding is not null").select(key, "embedding")
    n = pool.count()
    spread = F.pmod(F.xxhash64("embedding"), F.lit(1 << 30))
    # Twice the share that is needed of the hashes' range first, so that a task sorts few rows.
    some = pool.where(spread < int(min(1.0, (2 * sample + 1000) / max(1, n)) * (1 << 30))).orderBy(spread, key).limit(sample).select(F.col("embedding").cast("array<double>").alias("e")).collect()
    x = np.array([r.e for r in some], np.float64)
    model = fit(x, n, k, share) if len(x) else None
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding"))
                lists = model.lists(x)
                codes = model.codes(x, lists)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], [key, "list", "code"])

    coded = pool.mapInArrow(work, f"`{key}` {pool.schema[key].dataType.simpleString()}, list int, code binary")
    path = fresh_path(vectors.sparkSession, "vector-index")
    coded.repartitionByRange("list").sortWithinPartitions("list").write.parquet(path)
    return VectorIndex(pool, vectors.sparkSession.read.parquet(path), key, shared, block)


def knn_approx(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", share: float = 0.97, sample: int = 20_000, block: int = 20_000) -> DataFrame:
    """(query_id, key, distance, rank) for queries (query_id, embedding): an index is built, searched once and left saved."""
    return build_index(vectors, key, k, share, sample, block).search(queries, k)

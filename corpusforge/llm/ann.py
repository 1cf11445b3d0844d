"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 6).

Nearness is the largest inner product. Vectors are scaled by the largest norm and get one more coordinate
that makes them unit vectors, so the largest inner product is the smallest L2 distance. Each of `tables`
tables hashes a vector by `functions` p-stable functions floor((a x + b) / width). A query visits, in each
table, its own bucket and the `probes` perturbed ones (up to four functions moved by one) with the least
sum of squared distances to the boundaries crossed: the order of estimated success. Candidates of all
tables are merged and ranked by the exact inner product in double precision. A query for which they are k or fewer is answered
by all vectors.

How it runs on Spark: equal vectors are one class; of a class at most k + 1 ids can matter. Buckets larger
than `bucket_rows` (more where MOST_LARGE buckets would not do) are dealt into parts and their probes repeated for
each. A table's buckets are dealt to groups of about `group_rows` vectors; a group is one task's cogroup of vectors
and of the queries that visit it, each with its list of buckets, from which at most k candidates a query go on. Every
vector is indexed and every query answered; only the largest norm, the number of rows and the sizes of at most
MOST_LARGE large buckets reach the driver. The functions come from a seed.

Nulls: vectors that are null, all zero, or hold a null or a number that isn't finite take no part, neither
as query nor as candidate. All vectors have one length. Ties go to the smaller vec_id; a repeated vec_id
with equal vectors counts once. An empty table gives no rows; extra columns are left out, so their names can't clash.
Vectors that are uniform on a sphere of 64 dimensions are the hard case: at a recall of 0.9 hashing of any width and
number of functions has a fifth or more of 50,000 vectors as candidates (README.md has figures).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import saved
from .text import mix


#: Buckets that may be larger than a part, over all tables: what is broadcast of them stays below 3 MB.
MOST_LARGE = 100_000


def hash_functions(dims: int, tables: int, functions: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions [dims, tables x functions] and offsets, from the seed."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(dims, tables * functions)), rng.uniform(0, width, tables * functions)


def perturbations(functions: int, most: int = 4) -> np.ndarray:
    """All ways to move up to `most` of the functions by -1 or +1, the way that moves none first."""
    out = [np.zeros(functions, np.int64)]
    for size in range(1, most + 1):
        for some in combinations(range(functions), size):
            for signs in range(1 << size):
                move = np.zeros(functions, np.int64)
                move[list(some)] = [1 if signs >> i & 1 else -1 for i in range(size)]
                out.append(move)
    return np.array(out)


def bucket_keys(cells: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row of cell numbers."""
    key = np.zeros(cells.shape[:-1], np.uint64)
    for k in range(cells.shape[-1]):
        key = mix(key ^ cells[..., k].astype(np.int64).view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


class Salts:
    """How many parts each bucket is dealt into: 1, but for the given (table, bucket, parts); and the group of a part."""

    def __init__(self, large: list[tuple[int, int, int]], tables: int, groups: int):
        self.groups = np.uint64(groups)
        by_table = [sorted((b, k) for t, b, k in large if t == own) for own in range(tables)]
        self.buckets = [np.array([b for b, _ in x], np.int64) for x in by_table]
        self.parts = [np.array([k for _, k in x] + [1], np.int64) for x in by_table]

    def of(self, t: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        out = np.ones(len(bucket), np.int64)
        for own, (known, parts) in enumerate(zip(self.buckets, self.parts, strict=True)):
            if len(known):
                mine = np.flatnonzero(t == own)
                place = np.minimum(np.searchsorted(known, bucket[mine]), len(known) - 1)
                out[mine] = np.where(known[place] == bucket[mine], parts[place], 1)
        return out

    def group(self, bucket: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return (mix(bucket.view(np.uint64) ^ mix(salt.astype(np.uint64) + np.uint64(1))) % self.groups).astype(np.int32)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = 10, functions: int = 8, width: float = 2.0, probes: int = 100, seed: int = 5, group_rows: int = 50_000, bucket_rows: int = 5_000, query_rows: int = 2_000) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` its k nearest rows of `vectors`, itself left out.

    Both have (vec_id, embedding); an id in both is the same row. query_rows: about how many queries a task holds; a group that
    more of them visit is searched once a block of queries.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    sound = F.coalesce(F.col("embedding").isNotNull() & whole & F.exists("embedding", lambda v: v != 0), F.lit(False))

    def clean(df: DataFrame) -> DataFrame:
        return df.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")).dropDuplicates(["vec_id", "v"])

    rows, asked = saved(clean(vectors)), saved(clean(queries))
    first = rows.select(F.size("v").alias("dims")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if first is None:
        return vectors.sparkSession.createDataFrame([], schema)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, y: acc + y * y))
    largest, n = rows.agg(F.max(norm), F.count("*")).first()
    directions, offsets = hash_functions(first.dims + 1, tables, functions, width, seed)
    moves = perturbations(functions)
    groups = max(2, -(-n // group_rows))

    def projected(v: pd.Series, scale: float | None) -> np.ndarray:
        m = np.stack(v.to_numpy())
        if scale is None:
            m = np.column_stack([m / np.linalg.norm(m, axis=1, keepdims=True), np.zeros(len(m))])
        else:
            m = m / scale
            m = np.column_stack([m, np.sqrt(np.maximum(0, 1 - (m * m).sum(axis=1)))])
        return ((m @ directions + offsets) / width).reshape(len(m), tables, functions)

    @F.pandas_udf("array<long>")
    def buckets_of(v: pd.Series) -> pd.Series:
        return pd.Series(list(bucket_keys(np.floor(projected(v, largest)).astype(np.int64))))

    def probes_of(v: pd.Series) -> np.ndarray:
        """[query, table, probe]: the buckets to visit, in order of estimated success."""
        place = projected(v, None)
        cell = np.floor(place).astype(np.int64)
        up, down = (1 - (place - cell)) ** 2, (place - cell) ** 2
        cost = up @ (moves > 0).T + down @ (moves < 0).T
        best = np.argsort(cost, axis=2, kind="stable")[:, :, : probes + 1]
        return bucket_keys(cell[:, :, None, :] + moves[best])

    classes = rows.groupBy("v").agg(F.min("vec_id").alias("class"))
    asked_classes = asked.groupBy("v").agg(F.min("vec_id").alias("class"))
    indexed = saved(classes.withColumn("keys", buckets_of("v")))
    most = max(bucket_rows, tables * n // MOST_LARGE)
    counts = indexed.select(F.posexplode("keys").alias("t", "bucket")).groupBy("t", "bucket").count().where(F.col("count") > most)
    salts = Salts([(r.t, r.bucket, -(-r["count"] // most)) for r in counts.collect()], tables, groups)
    shared = vectors.sparkSession.sparkContext.broadcast(salts)

    def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bucket = batch.column("keys").flatten().to_numpy().reshape(batch.num_rows, tables).T.ravel()
                row, t = np.tile(np.arange(batch.num_rows), tables), np.repeat(np.arange(tables), batch.num_rows)
                salt = (mix(batch.column("class").to_numpy().view(np.uint64))[row] % shared.value.of(t, bucket).astype(np.uint64)).astype(np.int32)
                own = batch.select(["class", "v"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(shared.value.group(bucket, salt)), pa.array(bucket), pa.array(salt), *own.columns], ["t", "g", "bucket", "salt", "class", "v"])

    def visit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                bucket = probes_of(batch.column("v").to_pandas())
                row, t = (np.repeat(x, bucket.shape[2]) for x in (np.repeat(np.arange(batch.num_rows), tables), np.tile(np.arange(tables), batch.num_rows)))
                times = shared.value.of(t, bucket.ravel())
                salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row, t, bucket = (np.repeat(x, times) for x in (row, t, bucket.ravel()))
                g = shared.value.group(bucket, salt)
                order = np.lexsort((g, t, row))
                row, t, bucket, salt, g = (x[order] for x in (row, t, bucket, salt, g))
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (t[1:] != t[:-1]) | (g[1:] != g[:-1])]))
                ends = pa.array(np.append(first, len(row)), pa.int32())
                own = batch.select(["class", "v"]).take(pa.array(row[first]))
                lists = [pa.ListArray.from_arrays(ends, pa.array(bucket)), pa.ListArray.from_arrays(ends, pa.array(salt, pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(t[first], pa.int32()), pa.array(g[first]), *own.columns, *lists], ["t", "g", "class", "v", "buckets", "salts"])

    def visit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in visit_rows(batches):
            cell, n = np.unique(np.stack([batch.column("t").to_numpy(), batch.column("g").to_numpy()]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell[0], pa.int32()), pa.array(cell[1], pa.int32()), pa.array(n)], ["t", "g", "n"])

    def blocked(ask: DataFrame, index: DataFrame, by: list[str], crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both sides with the block of queries `qb`, of which crowded groups (by, blocks; at most one row a table and group) have several."""
        parts = F.coalesce("blocks", F.lit(1)).cast("int")
        ask = ask.join(F.broadcast(crowded), by, "left").withColumn("qb", F.pmod(F.xxhash64("class"), parts).cast("int")).drop("blocks")
        return ask, index.join(F.broadcast(crowded), by, "left").withColumn("qb", F.explode(F.sequence(F.lit(0), parts - 1))).drop("blocks")

    placed = indexed.mapInArrow(index_rows, "t int, g int, bucket long, salt int, class long, v array<double>")
    visited = asked_classes.select("class", "v").mapInArrow(visit_rows, "t int, g int, class long, v array<double>, buckets array<long>, salts array<int>")

    def nearest(index: pa.Table, ask: pa.Table) -> pa.Table:
        names = ["query", "class", "score"]
        if not index.num_rows or not ask.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "class": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        data = _matrix(index)
        owner = index.column("class").to_numpy()
        where: dict[tuple[int, int], list[int]] = {}
        for i, cell in enumerate(zip(index.column("bucket").to_pylist(), index.column("salt").to_pylist(), strict=True)):
            where.setdefault(cell, []).append(i)
        visits: dict[tuple[int, int], list[int]] = {}
        for q, cells in enumerate(zip(ask.column("buckets").to_pylist(), ask.column("salts").to_pylist(), strict=True)):
            for cell in zip(*cells, strict=True):
                if cell in where:
                    visits.setdefault(cell, []).append(q)
        question = _matrix(ask)
        best = np.full((len(question), k + 1), -np.inf)
        found = np.full((len(question), k + 1), -1, np.int64)
        for cell, qs in visits.items():
            rows_here = np.array(where[cell])
            qs = np.array(qs)
            step = max(1, (1 << 20) // len(rows_here))
            for s in range(0, len(qs), step):
                some = qs[s : s + step]
                score = np.concatenate([best[some], question[some] @ data[rows_here].T], axis=1)
                who = np.concatenate([found[some], np.broadcast_to(owner[rows_here], (len(some), len(rows_here)))], axis=1)
                if score.shape[1] > 4 * k:  # fewer to sort; all ties at the edge stay
                    edge = np.partition(score, -(k + 1), axis=1)[:, -(k + 1), None]
                    score, who = np.where(score < edge, -np.inf, score), np.where(score < edge, -1, who)
                top = np.lexsort((who, -score), axis=1)[:, : k + 1]
                best[some], found[some] = np.take_along_axis(score, top, 1), np.take_along_axis(who, top, 1)
        keep = np.isfinite(best)
        who = np.broadcast_to(ask.column("class").to_numpy()[:, None], found.shape)
        return pa.table([pa.array(who[keep]), pa.array(found[keep]), pa.array(best[keep])], names)

    visits = asked_classes.select("class", "v").mapInArrow(visit_counts, "t int, g int, n long").groupBy("t", "g").agg(F.ceil(F.sum("n") / query_rows).alias("blocks"))
    visited, placed = blocked(visited, placed, ["t", "g"], saved(visits.where("blocks > 1")))
    near = visited.groupBy("t", "g", "qb").cogroup(placed.groupBy("t", "g", "qb"))
    merged = near.applyInArrow(lambda ask, index: nearest(index, ask), "query long, class long, score double")
    merged = saved(merged.groupBy("query", "class").agg(F.max("score").alias("score")))
    # Queries with too few candidates see all vectors, dealt to groups by hash.
    found = merged.groupBy("query").agg(F.count("*").alias("found"))
    few = asked_classes.join(found, F.col("class") == F.col("query"), "left").where(F.coalesce("found", F.lit(0)) <= k)
    own_group = F.pmod(F.xxhash64("class"), F.lit(groups)).cast("int")
    few = saved(few.select("class", "v"))
    blocks = max(1, -(-few.count() // query_rows))
    few = few.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int").alias("qb"), "class", "v")

    def scan(ask: pa.Table, index: pa.Table) -> pa.Table:
        out = []
        if index.num_rows and ask.num_rows:
            data, owner = _matrix(index), index.column("class").to_numpy()
            for q, x in zip(ask.column("class").to_pylist(), _matrix(ask), strict=True):
                score = data @ x
                top = np.lexsort((owner, -score))[: k + 1]
                out += [(q, int(owner[i]), float(score[i])) for i in top]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query", "class", "score"])

    every = indexed.select(own_group.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("qb"), "class", "v")
    scanned = few.groupBy("g", "qb").cogroup(every.groupBy("g", "qb")).applyInArrow(scan, "query long, class long, score double")
    merged = merged.unionByName(scanned).groupBy("query", "class").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    merged = merged.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    # Classes back to ids: of equal vectors the k + 1 smallest ids are enough.
    own = Window.partitionBy("class").orderBy("vec_id")
    members = rows.join(classes, "v").select("class", "vec_id").withColumn("r", F.row_number().over(own)).where(F.col("r") <= k + 1).drop("r")
    ids = asked.join(asked_classes, "v").select(F.col("class").alias("query"), F.col("vec_id").alias("query_id"))
    listed = merged.join(members, "class")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    pairs = ids.join(listed, "query").where("query_id <> vec_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("v").combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy().reshape(len(flat), -1)

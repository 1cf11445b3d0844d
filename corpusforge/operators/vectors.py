"""Vector retrieval K4 to K6, K12 to K16: exact and multi-vector neighbours, ambiguity, expansion, probes.

The exact search is a blocked matrix product: queries and vectors are dealt into blocks by hash, a pair of blocks is one
task's cogroup, of which the k nearest of each query go on and are ranked after one small shuffle. Nothing
but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from .picks import top_n


PAIRS = 1 << 19  # distances that a task holds at once


def _nearest(asked: pa.Table, held: pa.Table, k: int, keys: Sequence[str]) -> pa.Table:
    """(query_id, *keys, distance) of the k nearest rows of `held` for each row of `asked`, ties at nine decimals by keys.

    The product finds who may be among them; their distances are then taken from the vectors, so equal vectors are at 0.
    """
    matrix = lambda t: t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
    held = held.take(pc.sort_indices(held, sort_keys=[(c, "ascending") for c in keys], null_placement="at_start"))
    ids, found, at, distance = asked.column("query_id").to_numpy(), [], [], []
    if asked.num_rows and held.num_rows:
        q, x = matrix(asked), matrix(held)
        square, n, step = (x * x).sum(1), min(k, len(x)), max(1, PAIRS // len(x))
        for i in range(0, len(q), step):
            some = q[i : i + step]
            own = (some * some).sum(1)[:, None]
            d = some @ x.T
            d *= -2
            d += square
            d += own
            edge = np.sqrt(np.maximum(0, np.partition(d, n - 1, axis=1)[:, n - 1, None]))
            row, col = np.nonzero(d <= (edge + 2e-9) ** 2 + 1e-12 * (own + square.max()))
            exact = np.concatenate([np.sqrt(((some[row[j : j + (1 << 16)]] - x[col[j : j + (1 << 16)]]) ** 2).sum(1)) for j in range(0, len(row), 1 << 16)] or [np.zeros(0)])
            order = np.lexsort((col, np.round(exact, 9), row))
            order = order[np.arange(len(row)) - np.searchsorted(row, row) < n]  # rows come in order
            found.append(ids[i + row[order]])
            at.append(col[order])
            distance.append(exact[order])
    none = [np.zeros(0, np.int64)]
    table = held.select(list(keys)).take(pa.array(np.concatenate(at or none)))
    return table.add_column(0, "query_id", pa.array(np.concatenate(found or none), pa.int64())).append_column("distance", pa.array(np.concatenate(distance or [np.zeros(0)])))


def _search_groups(asked: DataFrame, held: DataFrame, by: Sequence[str], k: int, keys: Sequence[str]) -> DataFrame:
    """_nearest in each group of equal `by`: (query_id, *keys, distance)."""
    # A column of its own: those that both sides have from one source reach only one side of a cogroup.
    asked = asked.withColumn("embedding", F.transform("embedding", lambda v: v.cast("double")))
    schema = "query_id long, " + ", ".join(f"{c} {held.schema[c].dataType.simpleString()}" for c in keys) + ", distance double"
    return asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(lambda a, h: _nearest(a, h, k, keys), schema)


def _ranked(found: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), *keys)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(queries: DataFrame, vectors: DataFrame, k: int, keys: Sequence[str] = ("vec_id",), where: Column | None = None, block: int = 20_000) -> DataFrame:
    """K4: (query_id, *keys, distance, rank): the k nearest rows by L2 for queries (query_id, embedding).

    `where` filters vectors before the search; null embeddings take no part. block: queries, and vectors, a task holds.
    """
    pool = (vectors.where(where) if where is not None else vectors).where("embedding is not null")
    asked = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    many = lambda df: max(1, -(-df.count() // block))
    n_asked, n_pool = many(asked), many(pool)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    asked = asked.select("query_id", "embedding", own(n_asked, "query_id").alias("qb"), each(n_pool).alias("vb"))
    pool = pool.select(*keys, "embedding", own(n_pool, *keys).alias("vb"), each(n_asked).alias("qb"))
    return _ranked(_search_groups(asked, pool, ["qb", "vb"], k, keys), k, keys)


def knn_multi(queries: DataFrame, slots: DataFrame, k: int, source: Column | None = None) -> DataFrame:
    """K5: (query_id, owner_id, distance, rank): the 3 k nearest slots, the best one of each owner, then k owners.

    slots: (owner_id, slot, embedding, ...). `source` filters owners after the limit on slots.
    """
    extra = [c for c in slots.columns if c != "embedding"]
    hits = knn(queries, slots, 3 * k, extra).drop("rank")
    if source is not None:
        hits = hits.where(source)
    best = hits.groupBy("query_id", "owner_id").agg(F.min("distance").alias("distance"))
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "owner_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_within(requests: DataFrame, vectors: DataFrame, group: str, key: str, k: int, block: int = 20_000) -> DataFrame:
    """K6: (request_id, key, score, rank): the k best members of the request's group by cosine (six decimals; ties by key).

    requests: (request_id, group, embedding). Groups, and their requests, are dealt into blocks of about `block` rows by their
    own sizes; a pair of blocks is one matrix product, of which k rows a request go on. Null embeddings take no part.
    """
    pool, asked = (df.where(F.col("embedding").isNotNull() & F.col(group).isNotNull()) for df in (vectors, requests))
    counted = lambda df, n: df.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    parts = counted(pool, "_nv").join(counted(asked, "_nq"), group)
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    doubles = F.transform("embedding", lambda v: v.cast("double")).alias("embedding")
    held = pool.join(parts, group).select(F.col(group).alias("_g"), key, doubles, own(key, "_nv").alias("_v"), each("_nq").alias("_q"))
    probing = asked.join(parts, group).select(F.col(group).alias("_g"), "request_id", doubles, own("request_id", "_nq").alias("_q"), each("_nv").alias("_v"))
    names = [("request_id", requests.schema["request_id"].dataType.simpleString()), (key, vectors.schema[key].dataType.simpleString())]

    def best(a: pa.Table, h: pa.Table) -> pa.Table:
        rows, at, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if a.num_rows and h.num_rows:
            h = h.sort_by(key)
            q, x = (t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) for t in (a, h))
            norm, step = np.sqrt((x * x).sum(1)), max(1, (1 << 22) // len(x))
            for i in range(0, len(q), step):
                some = q[i : i + step]
                score = np.round(some @ x.T / (np.sqrt((some * some).sum(1))[:, None] * norm + 1e-9), 6)
                order = np.argsort(-score, axis=1, kind="stable")[:, :k]
                rows.append(np.repeat(np.arange(i, i + len(some)), order.shape[1]))
                at.append(order.ravel())
                scores.append(np.take_along_axis(score, order, axis=1).ravel())
        found = [a.column("request_id").combine_chunks().take(pa.array(np.concatenate(rows))), h.column(key).combine_chunks().take(pa.array(np.concatenate(at)))]
        return pa.table([*found, pa.array(np.concatenate(scores))], names=["request_id", key, "score"])

    by = ["_g", "_v", "_q"]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in names), "score double"])
    scored = probing.groupBy(*by).cogroup(held.groupBy(*by)).applyInArrow(best, schema)
    w = Window.partitionBy("request_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cached_vectors(texts: DataFrame, cache: DataFrame, model: str, embed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """K6: `texts` (text, ...) with text_hash and embedding, and the rows that the cache (text_hash, model, embedding) lacks.

    `embed` (a user's vectorised function) runs once a distinct text that the cache has no vector of this model for;
    null and blank texts have none. The second frame is saved: append it to the cache.
    """
    hashed = texts.withColumn("text_hash", F.when(F.trim("text") != "", F.sha2("text", 256)))
    known = cache.where(F.col("model") == model).select("text_hash", "embedding")
    missing = hashed.where("text_hash is not null").groupBy("text_hash").agg(F.min("text").alias("text")).join(known, "text_hash", "left_anti")
    fresh = checkpointed(missing.select("text_hash", F.lit(model).alias("model"), embed(F.col("text")).alias("embedding")))
    every = known.unionByName(fresh.select("text_hash", "embedding"))
    return hashed.join(every, "text_hash", "left").select(*texts.columns, "text_hash", "embedding"), fresh


def ambiguity(hits: DataFrame, limit: int, margin: float = 0.1) -> DataFrame:
    """(query_id, stage, top, tied): whether the two best domains of a query's hits lie within the margin.

    hits: (query_id, rank, score, top, sub). The first max(limit + 3, 8) hits count. Stage 1 compares top
    levels, stage 2 the sub levels inside the winner (hits without a sub don't count there).
    """
    window = hits.where(F.col("rank") <= max(limit + 3, 8))

    def stage(df: DataFrame, level: str, number: int) -> DataFrame:
        best = df.groupBy("query_id", level).agg(F.max("score").alias("score"), F.count("*").alias("n"))
        two = top_n(best, ["query_id"], [F.desc("score"), F.desc("n"), F.col(level)], 2)
        return two.groupBy("query_id").agg(F.lit(number).alias("stage"), F.min_by(level, F.struct(-F.col("score"), -F.col("n"), level)).alias("winner"), (F.count("*") > 1).alias("_two"), F.round(F.max("score") - F.min("score"), 6).alias("gap")).select("query_id", "stage", "winner", (F.col("_two") & (F.col("gap") <= margin)).alias("tied"))

    first = stage(window, "top", 1)
    inside = window.where("sub is not null").join(first.select("query_id", F.col("winner").alias("top")), ["query_id", "top"])
    return first.unionByName(stage(inside, "sub", 2))


def retrieve(queries: DataFrame, slots: DataFrame, domains: DataFrame, texts: DataFrame, limit: int, inline: int = 6_000, domain: str | None = None) -> DataFrame:
    """Owners near each query with their domain and text: K5, domain filter, then the text if it is short.

    domains: (owner_id, top, sub); texts: (owner_id, text). `domain` keeps one top or sub domain.
    """
    hits = knn_multi(queries, slots, max(6 * limit, 24))
    scored = hits.join(domains, "owner_id", "left").withColumn("score", F.round(1 - F.col("distance") ** 2 / 2, 3))
    if domain is not None:
        scored = scored.where((F.col("top") == domain) | (F.col("sub") == domain))
    w = Window.partitionBy("query_id").orderBy("rank")
    few = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    size = F.length("text")
    return few.join(texts, "owner_id", "left").select("query_id", "rank", "owner_id", "score", "top", "sub", F.when(size <= inline, F.col("text")).alias("text"), (size > inline).alias("pointer_only"))


def search_expand(queries: DataFrame, vectors: DataFrame, entities: DataFrame, k: int, places: int = 6, over: int = 4) -> DataFrame:
    """Hits by text hash expand to the places that share the text, at most `places` a hit, k hits a query.

    vectors: (text_hash, embedding); entities: (text_hash, place).
    """
    hits = knn(queries, vectors, over * k, ["text_hash"])
    near = hits.where(F.col("rank") <= k)
    own = Window.partitionBy("query_id", "text_hash").orderBy("place")
    out = near.join(entities, "text_hash").withColumns({"place_no": F.row_number().over(own)})
    return out.where(F.col("place_no") <= places).select("query_id", "rank", "text_hash", "place", "place_no")


def retrieve_patterns(queries: DataFrame, slots: DataFrame, kinds: DataFrame, k: int, apart: str, apart_n: int = 2) -> DataFrame:
    """K5 with one kind kept apart: k owners of other kinds and apart_n of that kind, each ranked on its own."""
    hits = knn_multi(queries, slots, 6 * k).drop("rank").join(kinds, "owner_id")
    group = F.when(F.col("kind") == apart, apart).otherwise("pattern")
    w = Window.partitionBy("query_id", "part").orderBy(F.round("distance", 9), "owner_id")
    ranked = hits.withColumn("part", group).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= F.when(F.col("part") == apart, apart_n).otherwise(k)).select("query_id", "part", "rank", "owner_id", "kind")


def topk_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(query_id, overlap, same_first) of two ranked results (query_id, key, rank)."""
    lists = lambda df, n: df.groupBy("query_id").agg(F.collect_set(key).alias(n), F.min_by(key, "rank").alias(f"{n}_first"))
    both = lists(a, "a").join(lists(b, "b"), "query_id", "full")
    size = F.coalesce(F.size(F.array_intersect("a", "b")), F.lit(0))
    return both.select("query_id", size.alias("overlap"), F.coalesce(F.col("a_first") == F.col("b_first"), F.lit(False)).alias("same_first"))

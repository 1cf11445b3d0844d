"""Sharding by vector bin packing (operator 8): bytes, tokens and rows are balanced jointly.

Equal texts are a group and stay together, unless the group fits whole in no shard's share of bytes and rows: then it
is dealt in pieces of about half a shard's share of a lane (below). Each group goes to the shard where the dot product of its vector
(bytes, tokens, rows) with the shard's residual capacity is highest: largest groups first up to half of the bytes, then
most others in order of their hash, so that groups of all shapes level every dimension, and the smallest last. In this second
half bytes weigh more in the dot product (`law_weight`), as shards must be near equal in bytes before all.

How it runs on Spark: texts are read once, for sizes and hashes. Groups are summed before anything is
placed, so copies cost one row a group and piece. Groups above half a shard's share of a lane (at most
4 x shards x (lanes + 1) of them, of at most `max_lanes` lanes) are placed whole in a first pass over all shards. The others are dealt by hash to lanes of about `lane_groups`; each lane fills its own share of what the first pass left of every shard, so the sums are
balanced as well. Slots are counts of (shard, bucket) before a bucket plus the place in the bucket.

Nulls: a null text has no bytes and the crc of the empty text; null and empty texts are two groups. Rows
with a null or repeated doc_id are placed like others. Ties go to the lower shard. An empty table gives no rows. Texts of any
length are read in the JVM, row by row; extra columns are left out, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import saved


def place_whole(vectors: np.ndarray, totals: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each row of `vectors` (bytes, tokens, rows) with room for its bytes and rows, -1 where there is none."""
    scaled = vectors / np.maximum(1, totals)
    left = np.full((shards, scaled.shape[1]), 1 / shards)
    out = np.full(len(vectors), -1, np.int32)
    for i in np.argsort(-vectors[:, 0], kind="stable").tolist():
        fits = np.flatnonzero((left[:, [0, 2]] >= scaled[i, [0, 2]] - 1e-12).all(axis=1))
        if len(fits):
            out[i] = fits[np.argmax(left[fits] @ scaled[i])]
            left[out[i]] -= scaled[i]
    return out


def place(vectors: np.ndarray, shards: int, law_weight: float = 16.0, room: np.ndarray | None = None) -> np.ndarray:
    """Shard of each row of `vectors` (bytes, tokens, rows): where its dot product with the residual capacity is highest.

    Rows of the largest bytes come first, up to half of all bytes, then others as they are, and from nine tenths of the bytes
    on the smallest, by size. In the second part the first dimension weighs `law_weight` times, in the last one the square
    of it. Ties go to the lower shard.
    room: each shard's share of each dimension, equal if not given.
    """
    scaled = vectors / np.maximum(1, vectors.sum(axis=0))
    left = (np.full((shards, scaled.shape[1]), 1 / shards) if room is None else room).tolist()
    out = np.zeros(len(vectors), np.int32)
    by_size = np.argsort(-vectors[:, 0], kind="stable")
    half, most = np.searchsorted(np.cumsum(scaled[by_size, 0]), [0.5, 0.9], "right").tolist()
    for k, i in enumerate([*by_size[:half].tolist(), *np.sort(by_size[half:most]).tolist(), *by_size[most:].tolist()]):
        x, y, z = scaled[i].tolist()
        weight = 1.0 if k < half else law_weight if k < most else law_weight**2
        best = max(range(shards), key=lambda s, w=weight * x: (w * left[s][0] + y * left[s][1] + z * left[s][2], -s))  # noqa: B023
        own = left[best]
        own[0] -= x
        own[1] -= y
        own[2] -= z
        out[i] = best
    return out


def shard_documents(docs: DataFrame, shards: int = 8, lane_groups: int = 20_000, bucket_rows: int = 20_000, max_lanes: int = 4096) -> DataFrame:
    """(doc_id, size, text_crc32, tokens, group_hash, piece, shard, slot) for every row of `docs` (doc_id, text).

    size: UTF-8 bytes plus 1; slot: 0 .. rows of the shard - 1. max_lanes bounds the first pass and what is broadcast of
    it; with more rows, lanes are larger.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long").alias("tokens"),
        F.xxhash64(text, text.isNull()).alias("group_hash"),
    )
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()))  # spreads rows of one id, or none
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    group = ["group_hash", "text_crc32", "size"]
    lanes = min(max_lanes, max(1, -(-total[1] // lane_groups)))
    limit = max(1, total[0] // (shards * 2 * (lanes + 1)))
    row_limit = max(1, total[1] // (shards * 2 * (lanes + 1)))
    counts = rows.groupBy(group).agg(F.count("*").alias("n"), F.max("tokens").alias("tokens"))
    pieces = F.greatest(F.ceil(F.col("n") * F.col("size") / limit), F.ceil(F.col("n") / row_limit))
    split = F.least(pieces, F.col("n")).cast("long")
    large = counts.where((split > 1) & ((F.col("n") * F.col("size") > limit) | (F.col("n") > row_limit))).select(*group, "n", "tokens", split.alias("pieces"))

    def vectors(table: pa.Table) -> np.ndarray:
        n, size, tokens = (table.column(c).to_numpy().astype(float) for c in ("n", "size", "tokens"))
        return np.stack([n * size, n * tokens, n], axis=1)

    def fill_whole(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in group])
        shard = place_whole(vectors(table), np.array([total[0], total[2], total[1]], float), shards)
        return table.append_column("whole", pa.array(shard))

    large = saved(large.groupBy().applyInArrow(fill_whole, "group_hash long, text_crc32 long, size long, n long, tokens long, pieces long, whole int"))
    full = np.zeros((shards, 3))
    for r in large.where("whole >= 0").groupBy("whole").agg(F.sum(F.expr("n * size")), F.sum(F.expr("n * tokens")), F.sum("n")).collect():
        full[r[0]] = r[1:]
    left = np.array([total[0], total[2], total[1]], float) / shards - full
    room = left / np.maximum(1, left.sum(axis=0))
    hot = large.select(*group, F.when(F.col("whole") < 0, F.col("pieces")).alias("pieces"), F.when(F.col("whole") >= 0, F.col("whole")).alias("whole"))
    rows = rows.join(F.broadcast(hot), group, "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("doc_id", "row", F.lit(3)), "pieces"), F.lit(0))).drop("pieces")
    key = [*group, "piece"]
    sums = rows.where("whole is null").groupBy(key).agg(F.count("*").alias("n"), F.max("tokens").alias("tokens"))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in key])
        shard = place(vectors(table), shards, room=room)
        return table.select(key).append_column("shard", pa.array(shard))

    placed = sums.withColumn("lane", F.pmod(F.xxhash64(*key), F.lit(lanes))).groupBy("lane").applyInArrow(fill, "group_hash long, text_crc32 long, size long, piece long, shard int")
    placed = rows.where("whole is null").drop("whole").join(placed, key)
    placed = saved(placed.unionByName(rows.where("whole is not null").withColumnRenamed("whole", "shard")))
    buckets = max(1, -(-total[1] // bucket_rows))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "row", F.lit(5)), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("shard", "bucket").count().select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32", "group_hash", "row")
    return placed.join(bases, ["shard", "bucket"]).withColumn("slot", F.col("base") + F.row_number().over(own) - 1).select("doc_id", "size", "text_crc32", "tokens", "group_hash", "piece", "shard", "slot")

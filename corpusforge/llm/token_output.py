"""Training-order materialisation of token ids (operator 5).

Every document's token sequence gets a global slot from a keyed Feistel permutation of its row number
(cycle-walking keeps the slots within 0 .. rows - 1). A range of slots is a shard: one task tokenises
the shard's texts in slot order and writes the ids as records of a fixed stride, so a reader seeks to
any record and goes on from there.

How it runs on Spark: row numbers are partition offsets plus the place in the partition, so only the
row counts of partitions reach the driver; the permutation is computed per row; texts are shuffled once,
to the partition of their range of shards (at most spark.sql.shuffle.partitions ranges), sorted there by slot, and
tokenised once; a task writes the shards of its range one after the other. A shard's file
is written under a name of its attempt and renamed, so a task that is run again leaves one whole file.
`docs` must be read from files or saved: its partitions may not change between two readings.

Nulls: a null text counts as empty and gives the end id alone. A repeated row, and one with a null doc_id, has a slot of
its own. An empty table gives no rows and no files. Of a very long text one task holds text and ids. Extra columns
are left out, so their names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .tokens import default_path, tokenizer, with_end


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The keyed permutation of 0 .. n - 1 at x: a balanced Feistel network on the next even number of
    bits, applied again to what falls outside (cycle-walking)."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = T.mix(np.arange(1, rounds + 1, dtype=np.uint64) * T.RADIX + np.uint64(key % 2**64))
    out = x.astype(np.uint64)
    walk = np.ones(len(out), bool)
    while walk.any():
        left, right = out[walk] >> np.uint64(half), out[walk] & mask
        for k in keys:
            left, right = right, left ^ (T.mix(right + k) & mask)
        out[walk] = (left << np.uint64(half)) | right
        walk = out >= np.uint64(n)
    return out.astype(np.int64)


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """`docs` with a column row_no, 0 .. rows - 1 in order of partitions, and the number of rows."""
    spark = docs.sparkSession
    counts = sorted((r.part, r["count"]) for r in docs.select(F.spark_partition_id().alias("part")).groupBy("part").count().collect())
    offsets = np.cumsum([0, *(c for _, c in counts)]).tolist()
    rows = [(p, o, c) for (p, c), o in zip(counts, offsets, strict=False)]
    table = F.broadcast(spark.createDataFrame(rows, "part int, base long, part_rows long"))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    made = docs.withColumns({"part": F.spark_partition_id(), "place": place}).join(table, "part")
    changed = F.raise_error(F.lit("numbered: the partitions of docs changed between two readings"))
    return made.withColumn("row_no", F.when(F.col("place") < F.col("part_rows"), F.col("base") + F.col("place")).otherwise(changed)).drop("part", "place", "base", "part_rows"), offsets[-1]


class ShardWriter:
    """Appends ids to one shard file in records of `stride` ids; the last record is padded."""

    def __init__(self, folder: str, shard: int, stride: int, pad_id: int):
        from pyarrow import fs

        self.fs, root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.part = f"{root}/shard-{shard:08d}.bin", f"{root}/.{uuid4().hex}.part"
        self.stride, self.pad_id, self.n = stride, pad_id, 0
        self.out = self.fs.open_output_stream(self.part)

    def append(self, ids: np.ndarray) -> None:
        self.out.write(ids.astype("<u4").tobytes() if ids.dtype.itemsize > 2 else ids.astype("<u2").tobytes())
        self.n += len(ids)
        self.dtype = ids.dtype

    def close(self) -> None:
        if self.n % self.stride:
            self.append(np.full(self.stride - self.n % self.stride, self.pad_id, self.dtype))
        self.out.close()
        self.fs.move(self.part, self.path)


def write_training_order(docs: DataFrame, folder: str, key: int = 17, stride: int = 2048, end_id: int = 1, pad_id: int = 0, shard_docs: int = 8192, path: str | None = None) -> DataFrame:
    """Writes the shards of `docs` (doc_id, text) under `folder`, a URI that all executors reach, as the result is computed.

    Returns one row a document: slot (a permutation of 0 .. rows - 1), shard, record and offset of its
    first id, n_tokens with the end id, ids_crc32 (little-endian uint32 ids), id_bytes (2 or 4 in the file).
    """
    path = path or default_path()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, n = numbered(source)
    shards = max(1, -(-n // shard_docs))

    @F.pandas_udf("long")
    def slot(x: pd.Series) -> pd.Series:
        return pd.Series(feistel(x.to_numpy(), n, key))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        shard, out = -1, None
        for part in T.slices(batches, "text"):
            ids, at = with_end(*words.encode([t or "" for t in part.column("text").to_pylist()]), end_id)
            own = part.column("shard").to_numpy()
            place, crc = [], []
            for i in range(part.num_rows):
                if own[i] != shard:
                    if out:
                        out.close()
                    shard, out = int(own[i]), ShardWriter(folder, int(own[i]), stride, pad_id)
                piece = ids[at[i] : at[i + 1]]
                place.append(out.n)
                crc.append(zlib.crc32(piece.astype("<u4").tobytes()))
                out.append(piece)
            at_id = np.array(place, np.int64)
            extra = [pa.array(at_id // stride), pa.array(at_id % stride), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(np.full(len(own), ids.dtype.itemsize, np.int32))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("slot"), part.column("shard"), *extra], ["doc_id", "slot", "shard", "record", "offset", "n_tokens", "ids_crc32", "id_bytes"])
        if out:
            out.close()

    dealt = rows.withColumn("slot", slot("row_no")).withColumn("shard", F.floor(F.col("slot") / shard_docs).cast("int")).drop("row_no")
    ranges = min(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = dealt.repartitionById(ranges, F.floor(F.col("shard") * ranges / shards).cast("int")).sortWithinPartitions("shard", "slot")
    return dealt.mapInArrow(work, "doc_id long, slot long, shard int, record long, offset long, n_tokens long, ids_crc32 long, id_bytes int")


def read_records(spark: SparkSession, folder: str, stride: int = 2048, id_bytes: int = 2):
    """All records of the shards under `folder`, as an RDD of `stride` ids each, read sequentially by Spark."""
    kind = f"<u{id_bytes}"
    return spark.sparkContext.binaryRecords(folder, stride * id_bytes).map(lambda b: np.frombuffer(b, kind).tolist())


def read_from(folder: str, shard: int, record: int, count: int, stride: int = 2048, id_bytes: int = 2) -> np.ndarray:
    """`count` records from `record` on of one shard: how a reader resumes."""
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(folder)
    with where.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
        f.seek(record * stride * id_bytes)
        return np.frombuffer(f.read(count * stride * id_bytes), f"<u{id_bytes}").reshape(-1, stride)

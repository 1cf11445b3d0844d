"""Releases stored with a tree of content digests: two of them are compared by reading only what differs.

    <path>/data/_leaf=17/part-*.parquet     rows, dealt by the hash of their key
    <path>/tree/level=0..depth              (node, n, d1, d2): level 0 is the root, the last one the leaves
    <path>/_release.json                    columns, key and shape; written last, so a broken run is no release

A node's digest is the sum of its rows' hashes, twice with other seeds: order doesn't count, copies do, and 128 bits keep
unequal contents apart. A comparison goes down the tree from the root and reads the rows of differing leaves only:
one row where two releases are equal. The driver holds leaf numbers, at most `leaves` of them.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.picks import diff_two_way
from ..operators.quality import side_counts

LEAF = "_leaf"
_META = "_release.json"


def _digest(columns: Sequence[str], seed: int) -> Column:
    """A row's hash as a decimal, whose sums can't overflow. Spark's hash passes over nulls, so they are hashed as flags too."""
    flags = [F.isnull(F.col(c)) for c in columns]
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns], *flags).cast("decimal(28,0)")


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def save_release(df: DataFrame, path: str, key: Sequence[str], leaves: int = 1024, fanout: int = 32) -> None:
    """Writes df and its tree to a new path. Rows of one key share a leaf; nulls are a key like others; no maps.

    Rebalancing cuts a leaf of many rows into several files. Digests are of what is read back, in one pass.
    """
    if leaves < 1 or fanout < 2:
        raise ValueError("save_release: at least one leaf, and two children a node")
    spark, columns, data = df.sparkSession, df.columns, f"{path}/data"
    keyed = df.withColumn(LEAF, F.pmod(F.xxhash64(*[F.col(k) for k in key]), F.lit(leaves)).cast("int"))
    keyed.hint("rebalance", LEAF).write.partitionBy(LEAF).parquet(data)
    depth, width = 0, 1
    while width < leaves:
        depth, width = depth + 1, width * fanout
    stored = spark.read.schema(StructType([*df.schema.fields, *StructType.fromDDL(f"{LEAF} int").fields])).parquet(data)
    rows = stored.select(F.col(LEAF).alias("node"), F.lit(1).cast("long").alias("n"), _digest(columns, 1).alias("d1"), _digest(columns, 2).alias("d2"))
    for level in range(depth, -1, -1):
        node = F.col("node") if level == depth else F.floor(F.col("node") / fanout).cast("int")
        sums = [F.sum("n").alias("n"), *[F.sum(d).cast("decimal(38,0)").alias(d) for d in ("d1", "d2")]]
        rows.groupBy(node.alias("node")).agg(*sums).write.parquet(f"{path}/tree/level={level}")
        rows = _level(spark, path, level)
    meta = {"schema": df.schema.jsonValue(), "key": list(key), "leaves": leaves, "fanout": fanout, "depth": depth}
    fs, at = _file(spark, f"{path}/{_META}")
    out = fs.create(at, False)
    out.write(bytearray(json.dumps(meta), "utf-8"))
    out.close()


def _meta(spark: SparkSession, path: str) -> dict:
    fs, at = _file(spark, f"{path}/{_META}")
    if not fs.exists(at):
        raise ValueError(f"no whole release at {path}")
    whole = fs.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(whole, "UTF-8"))
    finally:
        whole.close()


def _level(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.schema("node int, n long, d1 decimal(38,0), d2 decimal(38,0)").parquet(f"{path}/tree/level={level}")


def release_count(spark: SparkSession, path: str) -> int:
    """Q1: the number of rows, from the root."""
    _meta(spark, path)
    return sum(r["n"] for r in _level(spark, path, 0).collect())


def changed_leaves(spark: SparkSession, a: str, b: str) -> list[tuple[int, bool, bool]]:
    """(leaf, a has it, b has it) of leaves with other contents in two releases of one shape. Each level reads children
    of nodes that differ."""
    shape = _meta(spark, a)
    if shape != _meta(spark, b):
        raise ValueError(f"{a} and {b} differ in columns, key or shape of the tree; compare their rows")
    found: list[tuple[int, bool, bool]] = []
    for level in range(shape["depth"] + 1):
        sides = [_level(spark, p, level) for p in (a, b)]
        if level:
            parents = [n for n, _, _ in found]
            sides = [s.where(F.floor(F.col("node") / shape["fanout"]).isin(parents)) for s in sides]
        x, y = (s.select("node", F.struct("n", "d1", "d2").alias(name)) for s, name in zip(sides, ("x", "y"), strict=True))
        odd = x.join(y, "node", "full").where(~F.col("x").eqNullSafe(F.col("y")))
        found = sorted((r["node"], r["has_a"], r["has_b"]) for r in odd.select("node", F.col("x").isNotNull().alias("has_a"), F.col("y").isNotNull().alias("has_b")).collect())
        if not found:
            break
    return found


def read_leaves(spark: SparkSession, path: str, leaves: Sequence[int]) -> DataFrame:
    """Rows of the given leaves; no other folder is listed or read."""
    schema = StructType.fromJson(_meta(spark, path)["schema"])
    if not leaves:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{LEAF}={n}" for n in leaves])


def diff_releases(spark: SparkSession, a: str, b: str) -> DataFrame:
    """U3 on stored releases: the rows of `diff_two_way`, from differing leaves alone."""
    odd = changed_leaves(spark, a, b)
    old, new = (read_leaves(spark, p, [leaf[0] for leaf in odd if leaf[i]]) for p, i in ((a, 1), (b, 2)))
    return diff_two_way(old, new, old.columns)


def compare_releases(spark: SparkSession, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Q2 on stored releases: (name, only_built, only_previous) for name -> (built path, previous path)."""
    return reduce(DataFrame.unionByName, [side_counts(name, diff_releases(spark, *paths)) for name, paths in pairs.items()])

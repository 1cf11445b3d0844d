"""Winners, caps and set operations: W1 to W11, U1 to U11, T-style upserts.

Orders are lists of columns with explicit null placement; callers end them with a unique key, so that
results don't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

Order = Sequence[Column | str]


def ascending(*names: str) -> list[Column]:
    """Ascending, nulls last: the order of every pick unless said otherwise."""
    return [F.col(n).asc_nulls_last() for n in names]


def top_n(df: DataFrame, by: Sequence[str], order: Order, n: int) -> DataFrame:
    """The first n rows of each key. Spark limits each partition's groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def pick_first(df: DataFrame, by: Sequence[str], order: Order) -> DataFrame:
    """One winner a key by an ordered list of criteria."""
    return top_n(df, by, order, 1)


def distinct_on(df: DataFrame, by: Sequence[str], order: Order) -> DataFrame:
    """The first row of each key."""
    return top_n(df, by, order, 1)


def top_ties(df: DataFrame, by: Sequence[str], score: Column) -> DataFrame:
    """All rows that share the highest score of their key."""
    w = Window.partitionBy(*by).orderBy(score.desc_nulls_last())
    return df.withColumn("_rank", F.rank().over(w)).where("_rank = 1").drop("_rank")


def surrogate_id(df: DataFrame, order: str, name: str = "id") -> DataFrame:
    """Dense numbers from 1 in order of a unique column.

    Rows are range-partitioned and sorted; numbers are counts of the ranges before plus the place in the
    range, so no task sees all rows.
    """
    spread = df.repartitionByRange(F.col(order).asc_nulls_last()).sortWithinPartitions(F.col(order).asc_nulls_last())
    spread = checkpointed(spread.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = spread.groupBy("_part").agg(F.count("*").alias("_n")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return spread.join(F.broadcast(bases), F.col("_part") == F.col("_p")).withColumn(name, F.col("_base") + F.col("_place") + 1).drop("_part", "_place", "_p", "_base")


def ordinal_in(df: DataFrame, by: Sequence[str], order: Order, name: str = "ordinal") -> DataFrame:
    """The place in the group, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def share_of_total(df: DataFrame, by: Sequence[str], digits: int = 4) -> DataFrame:
    """Count and share of all rows by key. The total is one row, so no window over all rows."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("_total"), digits)).drop("_total")


def top_k(df: DataFrame, order: Order, k: int) -> DataFrame:
    """The first k rows of all."""
    return df.orderBy(*order).limit(k)


def cap_with_more(df: DataFrame, by: Sequence[str], order: Order, n: int) -> DataFrame:
    """The first n rows of each key, and whether there were more."""
    key = Window.partitionBy(*by)
    ranked = df.withColumn("_rank", F.row_number().over(key.orderBy(*order))).where(F.col("_rank") <= n + 1)
    return ranked.withColumn("more", F.max("_rank").over(key) > n).where(F.col("_rank") <= n).drop("_rank")


def primary_flag(df: DataFrame, by: Sequence[str], priority: str, priorities: Mapping[str, int], order: Order, name: str = "is_primary") -> DataFrame:
    """True for exactly one row a key: the least configured priority (unlisted last), then `order`."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in priorities.items() for x in kv])[F.col(priority)], F.lit(len(priorities) + 1_000))
    w = Window.partitionBy(*by).orderBy(rank, *order)
    return df.withColumn(name, F.row_number().over(w) == 1)


def union_labelled(branches: Mapping[str, DataFrame], name: str = "branch") -> DataFrame:
    """Union of branches with the same columns, each row with its branch's label."""
    parts = [df.withColumn(name, F.lit(k)) for k, df in branches.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def universe(sources: Mapping[str, DataFrame], key: Sequence[str]) -> DataFrame:
    """The distinct keys of all sources, with a flag in_<source> each. One shuffle, no joins."""
    marked = union_labelled({k: df.select(*key) for k, df in sources.items()}, "_in")
    return marked.groupBy(*key).agg(*[F.bool_or(F.col("_in") == k).alias(f"in_{k}") for k in sources])


def diff_two_way(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, as a multiset, that are in one of two frames only, with the side they are on."""
    both = union_labelled({"a": a.select(*columns), "b": b.select(*columns)}, "side")
    counts = both.groupBy(*columns).agg(F.count_if(F.col("side") == "a").alias("_a"), F.count_if(F.col("side") == "b").alias("_b"))
    odd = counts.where("_a <> _b").withColumn("side", F.when(F.col("_a") > F.col("_b"), "a").otherwise("b"))
    return odd.select(*columns, "side", F.abs(F.col("_a") - F.col("_b")).alias("n"))


def upsert(base: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """U4: rows of `new`, and those of `base` whose key isn't in it. `new` has one row a key."""
    return base.join(new.select(*key), list(key), "left_anti").unionByName(new)


def upsert_counts(base: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """U4: how many rows of `new` replace one and how many are inserted."""
    flagged = new.join(base.select(*key).distinct().withColumn("_there", F.lit(True)), list(key), "left")
    return flagged.agg(F.count_if("_there").alias("replaced"), F.count_if(F.col("_there").isNull()).alias("inserted"))


def upsert_if(base: DataFrame, new: DataFrame, key: Sequence[str], rank: Order) -> DataFrame:
    """The higher-ranked of base's and new's row a key; ties keep base."""
    both = union_labelled({"0": base, "1": new}, "_side")
    return pick_first(both, key, [*rank, F.col("_side").asc()]).drop("_side")


def replace_snapshot(base: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """All rows of `new` in place of base's rows of the same sources."""
    return base.join(new.select(source).distinct(), source, "left_anti").unionByName(new)


def carry_forward(built: Mapping[str, DataFrame], previous: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The built tables, and those of the previous release that weren't built, unchanged."""
    return {**previous, **built}


def prune_sources(base: DataFrame, keep: DataFrame, sources: Sequence[str], key: str, dependents: Mapping[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Base without rows of the imported sources that the import (key) lacks, and dependents of rows that are left."""
    imported = F.col("source").isin(list(sources))
    kept = keep.select(key).distinct().withColumn("_kept", F.lit(True))
    rest = base.join(kept, key, "left").where(~imported | F.col("_kept")).select(*base.columns)
    return rest, {n: df.join(rest.select(key), key, "left_semi") for n, df in dependents.items()}


def members_of_all(df: DataFrame, group: str, member: str, wanted: Sequence) -> DataFrame:
    """Groups that hold every wanted member (relational division)."""
    some = df.where(F.col(member).isin(list(wanted)))
    return some.groupBy(group).agg(F.countDistinct(member).alias("_n")).where(F.col("_n") == len(set(wanted))).select(group)


def upsert_rules(base: DataFrame, changes: DataFrame, key: str, kept: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """Changes by id over base; columns in `kept` stay where the change has null, inserts take defaults."""
    b, c = base.alias("b"), changes.withColumn("_new", F.lit(True)).alias("c")
    joined = b.join(c, F.col(f"b.{key}") == F.col(f"c.{key}"), "full")
    out = []
    for name in base.columns:
        old, new = F.col(f"b.{name}"), F.col(f"c.{name}")
        value = F.when(F.col("c._new"), F.coalesce(new, old) if name in kept or name == key else new).otherwise(old)
        out.append((F.coalesce(value, F.lit(defaults[name])) if name in defaults else value).alias(name))
    return joined.select(*out)


def delete_by_id(base: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Base without the rows of these ids."""
    return base.join(ids.select(key), key, "left_anti")

"""Gates and release checks Q1 to Q13, and P21: violations are DataFrames; a gate raises with the joined list."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .picks import diff_two_way


class GateError(Exception):
    """A gate found violations; the message lists the first of them."""


def gate(violations: DataFrame, column: str = "message", shown: int = 20) -> None:
    """Raises if there is any violation, with up to `shown` messages."""
    found = [r[0] for r in violations.select(F.col(column).cast("string")).orderBy(column).limit(shown).collect()]
    if found:
        raise GateError("; ".join(found))


def violations(checks: Mapping[str, DataFrame]) -> DataFrame:
    """(check, message): one frame of several checks' violating rows, each as JSON."""
    parts = [df.select(F.lit(k).alias("check"), F.concat(F.lit(k + ": "), F.to_json(F.struct(*df.columns))).alias("message")) for k, df in checks.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Q12: (name, n) of all tables in one job."""
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.lit(k).alias("name"), F.count("*").alias("n")) for k, df in tables.items()])


def compare_counts(built: Mapping[str, DataFrame], previous: Mapping[str, DataFrame], expected: Mapping[str, int]) -> DataFrame:
    """Q1: (name, built, previous, expected, state): same, changed or wrong."""
    b, p = counts(built).withColumnRenamed("n", "built"), counts(previous).withColumnRenamed("n", "previous")
    j = b.join(p, "name", "left")
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])[F.col("name")] if expected else F.lit(None).cast("long")
    j = j.withColumn("expected", want.cast("long"))
    return j.withColumn("state", F.when(F.col("expected").isNotNull() & (F.col("expected") != F.col("built")), "wrong").when(F.col("previous") == F.col("built"), "same").otherwise("changed"))


def side_counts(name: str, diff: DataFrame) -> DataFrame:
    """(name, only_built, only_previous): how many rows of a two-way diff are on either side."""
    rows_on = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0))
    return diff.agg(F.lit(name).alias("name"), rows_on("a").alias("only_built"), rows_on("b").alias("only_previous"))


def compare_content(built: Mapping[str, DataFrame], previous: Mapping[str, DataFrame]) -> DataFrame:
    """Q2: (name, only_built, only_previous): rows, as multisets, on one side only."""
    return reduce(lambda a, b: a.unionByName(b), [side_counts(k, diff_two_way(df, previous[k], df.columns)) for k, df in built.items()])


def dangling_report(tables: Mapping[str, DataFrame], refs: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Q3: (child, key, parent, n): child rows without a parent, for each (child, key, parent, key)."""
    parts = []
    for child, ck, parent, pk in refs:
        c = tables[child].where(F.col(ck).isNotNull()).select(F.col(ck).alias("_k"))
        p = tables[parent].select(F.col(pk).alias("_k")).distinct()
        parts.append(c.join(p, "_k", "left_anti").agg(F.lit(child).alias("child"), F.lit(ck).alias("key"), F.lit(parent).alias("parent"), F.count("*").alias("n")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def vector_completeness(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Q4: (n_slots, n): how many rows have how many vectors, none included."""
    slots = vectors.groupBy(key).agg(F.count("*").alias("n_slots"))
    return rows.select(key).join(slots, key, "left").groupBy(F.coalesce("n_slots", F.lit(0)).alias("n_slots")).agg(F.count("*").alias("n"))


def check_exploded(df: DataFrame, column: str, index: DataFrame) -> DataFrame:
    """Q5: (distinct elements of an array column, rows of the index, equal)."""
    n = df.select(F.explode(column).alias("_x")).agg(F.countDistinct("_x").alias("elements"))
    return n.crossJoin(index.agg(F.count("*").alias("index_rows"))).withColumn("equal", F.col("elements") == F.col("index_rows"))


def compare_field_coverage(a: DataFrame, b: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Q7: (field, n_a, n_b): filled values of each field in two releases."""
    def filled(df: DataFrame, name: str) -> DataFrame:
        sums = df.agg(*[F.count_if(F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != "")).alias(f) for f in fields])
        return sums.select(F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])).alias("field", name))

    return filled(a, "n_a").join(filled(b, "n_b"), "field")


def compare_ids(old: DataFrame, new: DataFrame, mapping: DataFrame, text: str) -> DataFrame:
    """Q8: (total, mapped, reachable, same_text): old ids that a map (id, new_id) leads to a new row, and equal texts."""
    j = old.select("id", F.col(text).alias("_o")).join(mapping, "id", "left").join(new.select(F.col("id").alias("new_id"), F.col(text).alias("_n"), F.lit(True).alias("_there")), "new_id", "left")
    return j.agg(F.count("*").alias("total"), F.count("new_id").alias("mapped"), F.count("_there").alias("reachable"), F.count_if(F.coalesce(F.col("_o") == F.col("_n"), F.lit(False))).alias("same_text"))


def check_stamps(stamps: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Q9: (key, value, expected) of stamps that aren't as expected or missing."""
    spark = stamps.sparkSession
    want = spark.createDataFrame(list(expected.items()), "key string, expected string")
    return want.join(stamps, "key", "left").where(F.col("value").isNull() | (F.col("value") != F.col("expected"))).select("key", "value", "expected")


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], root: str, version: str, checks: Sequence[DataFrame] = ()) -> bool:
    """Q10: writes a version beside the others, verifies its counts and gates, then switches the pointer last.

    A version that the pointer already names is left alone (False). Leftovers of a broken run are refused.
    """
    jvm = spark.sparkContext._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(f"{root}/{p}")
    fs = at("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at("active")) and spark.read.json(f"{root}/active").where(F.col("version") == version).count():
        return False
    if fs.exists(at(version)):
        raise GateError(f"publish: {version} exists but isn't active; remove it first")
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    for name, df in tables.items():
        n, m = df.count(), spark.read.parquet(f"{root}/{version}/{name}").count()
        if n != m:
            raise GateError(f"publish: {name} has {m} of {n} rows")
    for c in checks:
        gate(c)
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{root}/active")
    return True


def check_layer(pages: Mapping[str, DataFrame], key: str, member: str, whole: str, part: str) -> DataFrame:
    """Q11: keys of page set `part` that `whole` lacks, or whose members differ from it: (key, problem)."""
    sig = lambda df, n: df.groupBy(key).agg(F.sha2(F.array_join(F.sort_array(F.collect_set(F.col(member).cast("string"))), ","), 256).alias(n))
    j = sig(pages[part], "_p").join(sig(pages[whole], "_w"), key, "left")
    return j.select(key, F.when(F.col("_w").isNull(), "missing").when(F.col("_p") != F.col("_w"), "members differ").alias("problem")).where("problem is not null")


def check_vectors(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Q13: (n, missing, changed): vectors of a that b lacks or holds with other values."""
    j = a.select(key, F.col("embedding").alias("_a")).join(b.select(key, F.col("embedding").alias("_b")), key, "left")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.coalesce(F.col("_a") != F.col("_b"), F.lit(False))).alias("changed"))

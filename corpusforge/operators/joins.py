"""Join forms J1 to J17. Spark picks broadcast or sort-merge by size; keys are what it shuffles on."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_facts(facts: DataFrame, corpus: DataFrame, on: Sequence[str]) -> DataFrame:
    """Facts with their statement's columns."""
    return facts.join(corpus, list(on))


def assemble_left(base: DataFrame, parts: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Base with several keyed parts; one key, so base is shuffled once."""
    return reduce(lambda df, p: df.join(p, list(on), "left"), parts, base)


def full_union_join(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join on one key, coalesced."""
    return a.join(b, list(on), "full")


def keep_existing(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Child rows whose parent exists. on: child column -> parent column."""
    return child.join(parent, [child[c] == parent[p] for c, p in on.items()], "left_semi")


def dangling(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Child rows whose parent doesn't exist; a null key dangles."""
    return child.join(parent, [child[c] == parent[p] for c, p in on.items()], "left_anti")


def flag_exists(df: DataFrame, other: DataFrame, on: Mapping[str, str], name: str) -> DataFrame:
    """Existence as a column."""
    keys = other.select(*[F.col(p).alias(f"_k{i}") for i, p in enumerate(on.values())]).distinct().withColumn(name, F.lit(True))
    joined = df.join(keys, [df[c] == keys[f"_k{i}"] for i, c in enumerate(on)], "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(False))).drop(*[f"_k{i}" for i in range(len(on))])


def match_pairs(edges: DataFrame, declared: DataFrame, name: str = "matches_declared") -> DataFrame:
    """Whether an edge (t1, c1, t2, c2) has a declared one (t1, t2, c) of the same unordered tables on either column."""
    pair = declared.select(F.least("t1", "t2").alias("_a"), F.greatest("t1", "t2").alias("_b"), F.col("c").alias("_c")).groupBy("_a", "_b").agg(F.collect_set("_c").alias("_cs"))
    joined = edges.join(pair, (F.least("t1", "t2") == F.col("_a")) & (F.greatest("t1", "t2") == F.col("_b")), "left")
    hit = F.array_contains("_cs", F.col("c1")) | F.array_contains("_cs", F.col("c2"))
    return joined.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_a", "_b", "_cs")


def top1_join(df: DataFrame, ranked: DataFrame, on: str, order: Sequence[str]) -> DataFrame:
    """Df with the least row of `ranked` by `order` for its key: one aggregate, then an equi join."""
    rest = [c for c in ranked.columns if c != on and c not in order]
    best = ranked.groupBy(on).agg(F.min(F.struct(*order, *rest)).alias("_best")).select(on, "_best.*")
    return df.join(best, on, "left")


def explode_ordered(df: DataFrame, column: str, keep_empty: bool = False) -> DataFrame:
    """One row an element of an array, with its place from 0."""
    f = F.posexplode_outer if keep_empty else F.posexplode
    return df.select(*[c for c in df.columns if c != column], f(column).alias("pos", column))


def mention_flags(claims: DataFrame, texts: DataFrame, on: str, name: str, text: str) -> DataFrame:
    """Per claim whether its name occurs in its text as a whole word, and right after FROM, JOIN, UPDATE or INTO."""
    joined = claims.join(texts, on, "left")
    word = F.concat(F.lit(r"(?i)(^|[^A-Za-z0-9_$#])"), F.regexp_replace(F.col(name), r"([^A-Za-z0-9_])", r"\\$1"), F.lit(r"($|[^A-Za-z0-9_$#])"))
    after = F.concat(F.lit(r"(?i)\b(from|join|update|into)\s+([A-Za-z0-9_]+\.)?"), F.regexp_replace(F.col(name), r"([^A-Za-z0-9_])", r"\\$1"), F.lit(r"($|[^A-Za-z0-9_$#])"))
    return joined.withColumns({"in_text": F.coalesce(F.rlike(F.col(text), word), F.lit(False)), "after_from": F.coalesce(F.rlike(F.col(text), after), F.lit(False))}).drop(text)


def match_rules(columns: DataFrame, rules: Sequence[Mapping[str, str]], column: str = "column_name", table: str = "table_name") -> DataFrame:
    """(row, rule) for each rule (id, column regex, optional table regex) that fits. Rules are literals: no join."""
    fits = F.array(*[F.when(F.col(column).rlike(r["column"]) & F.col(table).rlike(r.get("table", "")), F.lit(r["id"])) for r in rules])
    return columns.withColumn("rule", F.explode(F.filter(fits, lambda x: x.isNotNull())))


def join_labels(a: DataFrame, b: DataFrame, key: Column, aliases: DataFrame) -> DataFrame:
    """A (label) to b (key) by normalised label, else by its alias (label, alias); equal keys win."""
    labelled = a.withColumn("_key", key)
    alias = aliases.select(F.col("label").alias("_label"), F.col("alias").alias("_alias"))
    direct = labelled.join(b, F.col("_key") == b["key"])
    rest = labelled.join(b, F.col("_key") == b["key"], "left_anti").join(alias, F.col("_key") == F.col("_label"))
    return direct.drop("_key").unionByName(rest.join(b, F.col("_alias") == b["key"]).drop("_key", "_label", "_alias"))


def both_directions(edges: DataFrame) -> DataFrame:
    """Each edge (from_t, from_c, to_t, to_c, ...) and its reverse, in one pass."""
    rest = [c for c in edges.columns if c not in ("from_t", "from_c", "to_t", "to_c")]
    ways = F.array(F.struct("from_t", "from_c", "to_t", "to_c"), F.struct(F.col("to_t").alias("from_t"), F.col("to_c").alias("from_c"), F.col("from_t").alias("to_t"), F.col("from_c").alias("to_c")))
    return edges.select(*rest, F.inline(ways))


def with_config(df: DataFrame, config: DataFrame) -> DataFrame:
    """Df with the columns of a table of one row."""
    return df.crossJoin(F.broadcast(config.limit(1)))


def share_join(num: DataFrame, den: DataFrame, on: Sequence[str], digits: int = 4) -> DataFrame:
    """N of `num` as a share of total of `den`."""
    return num.join(den, list(on)).withColumn("share", F.round(F.col("n") / F.col("total"), digits))


def related(requests: DataFrame, declared: DataFrame, mined: DataFrame) -> DataFrame:
    """For requested tables (name) their neighbours: declared out and in, then mined, by confidence and occurrences.

    Edges are (from_t, from_c, to_t, to_c); mined ones also have confidence and occurrences.
    """
    d = declared.select("from_t", "to_t", F.lit("DECLARED").alias("confidence"), F.lit(None).cast("long").alias("occurrences"), F.lit(0).alias("tier"))
    m = mined.select("from_t", "to_t", "confidence", F.col("occurrences").cast("long").alias("occurrences"), F.when(F.col("confidence") == "HIGH", 1).when(F.col("confidence") == "MEDIUM", 2).otherwise(3).alias("tier"))
    edges = d.unionByName(m)
    ways = F.array(F.struct(F.col("from_t").alias("name"), F.col("to_t").alias("other"), F.lit("out").alias("way")), F.struct(F.col("to_t").alias("name"), F.col("from_t").alias("other"), F.lit("in").alias("way")))
    sides = edges.select("confidence", "occurrences", "tier", F.inline(ways))
    return sides.join(requests.select("name").distinct(), "name").select("name", "other", "way", "confidence", "occurrences", "tier")


def join_array_member(df: DataFrame, array: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose array holds a key, once a distinct key."""
    return df.withColumn(key, F.explode(F.array_distinct(array))).join(keys.select(key).distinct(), key)

"""Aggregations A1 to A25: counts, pivots, ordered collections, shares, coverage and agreement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_counts(df: DataFrame, by: Sequence[str], specs: Mapping[str, tuple[str, Column | None]]) -> DataFrame:
    """A1: name -> (column, condition): distinct values of the column in rows that meet the condition; n counts rows."""
    aggs = [F.countDistinct(F.when(cond, F.col(c)) if cond is not None else F.col(c)).alias(name) for name, (c, cond) in specs.items()]
    return df.groupBy(*by).agg(F.count("*").alias("n"), *aggs)


def pivot_counts(df: DataFrame, by: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """A2: rows that meet each condition, by key."""
    return df.groupBy(*by).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def basic_aggs(df: DataFrame, by: Sequence[str], value: str, flag: Column, digits: int = 4) -> DataFrame:
    """A3: any, all, min, max, avg and sum by key."""
    return df.groupBy(*by).agg(F.bool_or(flag).alias("any_flag"), F.bool_and(flag).alias("all_flag"), F.min(value).alias("min_v"), F.max(value).alias("max_v"), F.round(F.avg(value), digits).alias("avg_v"), F.round(F.sum(value), digits).alias("sum_v"))


def collect_sorted(df: DataFrame, by: Sequence[str], column: str, sep: str | None = None, name: str = "items") -> DataFrame:
    """A4: distinct values in order, as an array or joined by `sep`. Nulls are left out."""
    items = F.sort_array(F.collect_set(column))
    return df.groupBy(*by).agg((F.array_join(items, sep) if sep is not None else items).alias(name))


def collect_structs(df: DataFrame, by: Sequence[str], fields: Sequence[str], order: Sequence[Column], cap: int = 50, name: str = "items") -> DataFrame:
    """A5: the first `cap` rows of each key in order, as a JSON array of objects. Cut before it is collected."""
    w = Window.partitionBy(*by).orderBy(*order)
    some = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= cap)
    rows = F.sort_array(F.collect_list(F.struct("_rank", F.struct(*fields).alias("row"))))
    return some.groupBy(*by).agg(F.to_json(F.transform(rows, lambda x: x["row"])).alias(name))


def first_where(df: DataFrame, by: Sequence[str], column: str, order: str, condition: Column, name: str = "first") -> DataFrame:
    """The column's value at the least `order` among rows that meet the condition."""
    return df.groupBy(*by).agg(F.min_by(F.when(condition, F.col(column)), F.when(condition, F.col(order))).alias(name))


def mode_of(df: DataFrame, by: Sequence[str], column: str, min_n: int = 1, name: str = "mode") -> DataFrame:
    """The most frequent value of keys with at least min_n rows; ties take the lowest value."""
    return df.groupBy(*by).agg(F.count(column).alias("n"), F.mode(column, True).alias(name)).where(F.col("n") >= min_n)


def count_map(df: DataFrame, by: Sequence[str], key: str, name: str = "counts") -> DataFrame:
    """A map from values to counts, sorted by value. Counts come first, so an array has distinct values only."""
    counts = df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.count("*").alias("_n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "_n")))).alias(name))


def having(df: DataFrame, by: Sequence[str], condition: str, **aggs: Column) -> DataFrame:
    """A10: keys whose aggregates meet a condition (violations of a gate)."""
    return df.groupBy(*by).agg(*[c.alias(k) for k, c in aggs.items()]).where(condition)


def cooccurrence(entities: DataFrame, tables: DataFrame, entity: str, table: str, on: str, digits: int = 4) -> DataFrame:
    """(entity, table, n, share): statements that hold both, as a share of those that hold the entity."""
    e = entities.select(on, entity).distinct()
    totals = e.groupBy(entity).agg(F.count("*").alias("_total"))
    pairs = e.join(tables.select(on, table).distinct(), on).groupBy(entity, table).agg(F.count("*").alias("n"))
    return pairs.join(totals, entity).select(entity, table, "n", F.round(F.col("n") / F.col("_total"), digits).alias("share"))


def participation_share(edges: DataFrame, totals: DataFrame, floor: float = 0.2, digits: int = 3) -> DataFrame:
    """(table_name, column_name, n, share) of columns that take part in at least `floor` of a table's statements.

    edges: (sql_hash, from_t, from_c, to_t, to_c); totals: (sql_hash, table_name).
    """
    ends = edges.select("sql_hash", F.inline(F.array(F.struct(F.col("from_t").alias("table_name"), F.col("from_c").alias("column_name")), F.struct(F.col("to_t").alias("table_name"), F.col("to_c").alias("column_name")))))
    n = ends.where("column_name is not null").groupBy("table_name", "column_name").agg(F.countDistinct("sql_hash").alias("n"))
    all_n = totals.groupBy("table_name").agg(F.countDistinct("sql_hash").alias("_total"))
    share = F.round(F.col("n") / F.col("_total"), digits)
    return n.join(all_n, "table_name").where(F.col("n") / F.col("_total") >= floor).select("table_name", "column_name", "n", share.alias("share"))


def literal_roles(preds: DataFrame, threshold: int = 8, chars: int = 80) -> DataFrame:
    """Occurrences of (table, column, op, clipped literal), with the column's role by its distinct literals."""
    cut = preds.withColumn("literal", F.left("literal", F.lit(chars)))
    key = ["table_name", "column_name"]
    counts = cut.groupBy(*key, "op", "literal").agg(F.countDistinct("sql_hash").alias("occurrences"))
    roles = counts.groupBy(*key).agg(F.countDistinct("literal").alias("n_literals"))
    role = F.when(F.col("n_literals") >= threshold, "discriminator").otherwise("structural")
    return counts.join(roles, key).select(*key, "op", "literal", "occurrences", role.alias("role"))


def column_signals(columns: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """For each table and rule (name -> regex) the first column, by ordinal, whose name matches, else null."""
    aggs = [F.min_by(F.when(F.col("column_name").rlike(r), F.col("column_name")), F.when(F.col("column_name").rlike(r), F.col("ordinal"))).alias(k) for k, r in rules.items()]
    return columns.groupBy("table_name").agg(*aggs)


def pattern_evidence(texts: DataFrame, facts: DataFrame, patterns: Mapping[str, str], on: str, text: str, table: str) -> DataFrame:
    """For each table, statements on it whose text matches each pattern."""
    flags = texts.select(on, *[F.col(text).rlike(r).alias(k) for k, r in patterns.items()])
    joined = facts.select(on, table).distinct().join(flags, on)
    return joined.groupBy(table).agg(*[F.count_if(k).alias(k) for k in patterns])


def coverage(df: DataFrame, by: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """Rows, and rows with each flag, by key."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()])


def set_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """How rows' two arrays agree as sets: both there, equal, one within the other, or different."""
    both = (F.size(a) > 0) & (F.size(b) > 0)
    a_left, b_left = F.size(F.array_except(a, b)), F.size(F.array_except(b, a))
    return df.agg(
        F.count_if(both).alias("both"),
        F.count_if(both & (a_left == 0) & (b_left == 0)).alias("agree"),
        F.count_if(both & ((a_left == 0) != (b_left == 0))).alias("subset"),
        F.count_if(both & (a_left > 0) & (b_left > 0)).alias("disagree"),
    )


def usage_cost(usage: DataFrame, prices: DataFrame, queue_rows: int, digits: int = 6) -> DataFrame:
    """Per model rows, tokens, cost, and the cost projected to a queue. prices: (model, price) a million tokens."""
    per = usage.groupBy("model").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    cost = F.col("tokens") * F.col("price") / 1_000_000
    return per.join(prices, "model", "left").select("model", "n", "tokens", F.round(cost, digits).alias("cost"), F.round(cost / F.col("n") * queue_rows, digits).alias("projected"))


def text_stats(df: DataFrame, by: Sequence[str], column: str, digits: int = 4) -> DataFrame:
    """Mean, median, least and largest length of a text, and the share of texts that aren't blank."""
    n = F.length(column)
    filled = F.count_if(F.trim(F.col(column)) != "")
    return df.groupBy(*by).agg(F.round(F.avg(n), digits).alias("mean_len"), F.median(n).alias("median_len"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.round(filled / F.count("*"), digits).alias("filled"))


def precision_recall(got: DataFrame, truth: DataFrame, by: str, item: str, digits: int = 4) -> DataFrame:
    """Per key true positives, false positives, misses, precision and recall of distinct (by, item) pairs."""
    a = got.select(by, item).distinct().withColumn("_got", F.lit(1))
    b = truth.select(by, item).distinct().withColumn("_true", F.lit(1))
    got_it, is_true = F.col("_got").isNotNull(), F.col("_true").isNotNull()
    sums = a.join(b, [by, item], "full").groupBy(by).agg(F.count_if(got_it & is_true).alias("tp"), F.count_if(~is_true).alias("fp"), F.count_if(~got_it).alias("fn"))
    return sums.withColumns({"precision": F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), digits), "recall": F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), digits)})


def cross_tab(df: DataFrame, before: str, after: str, rank: Mapping[str, int]) -> DataFrame:
    """(before, after, n, change): improved, same or regressed by a rank of the labels, larger is better."""
    ranks = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    a, b = ranks[F.col(before)], ranks[F.col(after)]
    change = F.when(b > a, "improved").when(b < a, "regressed").otherwise("same")
    return df.groupBy(before, after).agg(F.count("*").alias("n")).withColumn("change", change)


def template_histogram(df: DataFrame, template: Column, example: str, n: int) -> DataFrame:
    """The n most frequent templates of a text with a total and the least example."""
    return df.groupBy(template.alias("template")).agg(F.count("*").alias("n"), F.min(example).alias("example")).orderBy(F.desc("n"), "template").limit(n)


def set_signature(df: DataFrame, by: Sequence[str], members: Sequence[str], name: str = "signature") -> DataFrame:
    """A digest of each key's set of members, whatever their order: equal digests mean equal sets."""
    return df.groupBy(*by).agg(F.sha2(F.to_json(F.sort_array(F.collect_set(F.struct(*members)))), 256).alias(name))


def group_all(df: DataFrame, by: Sequence[str], condition: Column, kind: str, only: str) -> DataFrame:
    """Whether all members meet a condition, and whether their kinds are exactly {only}."""
    return df.groupBy(*by).agg(F.bool_and(condition).alias("all_meet"), (F.bool_and(F.col(kind) == only) & (F.count(kind) == F.count("*"))).alias("only_kind"))

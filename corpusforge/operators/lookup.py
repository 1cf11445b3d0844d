"""Filters, predicates and lookups P1 to P27: the reference's tool calls as batch operators over requests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import norm_name
from .picks import pick_first, top_n
from .search import suggest


def validate_names(requests: DataFrame, names: DataFrame, k: int = 5) -> DataFrame:
    """(request, name, exists, suggestions): requested names against a dictionary (name); misses get K7's names."""
    r = requests.select("request").distinct().withColumn("name", norm_name(F.col("request")))
    known = names.select("name").distinct().withColumn("_e", F.lit(True))
    checked = r.join(known, "name", "left").withColumn("exists", F.coalesce("_e", F.lit(False))).drop("_e")
    near = suggest(checked.where("not exists").select("request"), names, k)
    lists = near.groupBy("request").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("suggestions"))
    return checked.join(lists, "request", "left").select("request", "name", "exists", "suggestions")


def validate_columns(requests: DataFrame, columns: DataFrame) -> DataFrame:
    """(table_name, column_name, state): ok, unknown_column or unknown_table for requested pairs; an unknown
    table ends the check. columns: (table_name, column_name)."""
    r = requests.select(F.upper(F.trim("table_name")).alias("table_name"), F.upper(F.trim("column_name")).alias("column_name")).distinct()
    pairs = columns.select(F.upper("table_name").alias("table_name"), F.upper("column_name").alias("column_name")).distinct()
    tables = pairs.select("table_name").distinct().withColumn("_t", F.lit(True))
    j = r.join(tables, "table_name", "left").join(pairs.withColumn("_c", F.lit(True)), ["table_name", "column_name"], "left")
    return j.select("table_name", "column_name", F.when(F.col("_t").isNull(), "unknown_table").when(F.col("_c").isNull(), "unknown_column").otherwise("ok").alias("state"))


def object_cards(tables: DataFrame, pkeys: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables with their ordered key and number of columns. pkeys: (table_name, column_name, seq)."""
    keys = pkeys.groupBy("table_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "column_name"))), lambda x: x["column_name"]).alias("pkey"))
    n = columns.groupBy("table_name").agg(F.count("*").alias("n_columns"))
    return tables.join(keys, "table_name", "left").join(n, "table_name", "left").withColumn("n_columns", F.coalesce("n_columns", F.lit(0)))


def list_columns(columns: DataFrame, like: str | None = None, cap: int = 120, chars: int = 140) -> DataFrame:
    """Columns whose name contains a text, by ordinal, at most `cap` (400 at most) a table, with the total."""
    rows = columns.where(F.contains(F.upper("column_name"), F.upper(F.lit(like)))) if like else columns
    w = Window.partitionBy("table_name")
    rows = rows.withColumns({"total": F.count("*").over(w), "_r": F.row_number().over(w.orderBy("ordinal", "column_name"))}).where(F.col("_r") <= min(cap, 400)).drop("_r")
    return rows.withColumn("remark", F.left("remark", F.lit(chars))) if "remark" in columns.columns else rows


def list_indexes(indexes: DataFrame) -> DataFrame:
    """P5: (table_name, index_name, is_unique, columns in order) from (table_name, index_name, is_unique, ordinal, column_name)."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column_name"))), lambda x: x["column_name"])
    return indexes.groupBy("table_name", "index_name", "is_unique").agg(ordered.alias("columns"))


def overlay_rules(derived: DataFrame, rules: DataFrame, key: str, value: str) -> DataFrame:
    """Derived values, overridden by the newest enabled rule of the key. rules: (key, value, enabled, version)."""
    best = pick_first(rules.where("enabled"), [key], [F.desc_nulls_last("version"), F.col(value)]).select(key, F.col(value).alias("_v"))
    return derived.join(best, key, "left").withColumns({value: F.coalesce("_v", value), "curated": F.col("_v").isNotNull()}).drop("_v")


def lookup_text(requests: DataFrame, corpus: DataFrame, aliases: DataFrame) -> DataFrame:
    """(request, id, chars): the text of an id, or the longest one of a title or alias. corpus: (id, title, chars); aliases: (title, id)."""
    by_id = corpus.select(F.col("id").alias("request"), "id", "chars")
    titles = corpus.select(F.col("title").alias("request"), "id", "chars").unionByName(aliases.select(F.col("title").alias("request"), "id").join(corpus.select("id", "chars"), "id").select("request", "id", "chars"))
    both = by_id.withColumn("t", F.lit(0)).unionByName(titles.withColumn("t", F.lit(1)))
    hits = requests.select("request").distinct().join(both, "request")
    return pick_first(hits, ["request"], [F.col("t"), F.desc("chars"), F.col("id")]).drop("t")


def siblings(requests: DataFrame, corpus: DataFrame) -> DataFrame:
    """(request, id, chars, rank): all texts of a title, longest first."""
    j = requests.select(F.col("request"), F.col("request").alias("title")).distinct().join(corpus, "title")
    return j.withColumn("rank", F.row_number().over(Window.partitionBy("request").orderBy(F.desc("chars"), "id"))).select("request", "id", "chars", "rank")


def list_by_prefix(requests: DataFrame, corpus: DataFrame, sep: str = ".") -> DataFrame:
    """(request, title): titles below `request` and the separator; without any, titles that begin with it.

    Titles and requests meet on the part before the separator first; only requests without a hit are
    matched by prefix, as a range of strings.
    """
    r = requests.select("request").distinct()
    t = corpus.select("title").distinct()
    below = r.join(t.withColumn("_p", F.substring_index("title", sep, 1)), (F.col("request") == F.col("_p")) & F.contains("title", F.lit(sep))).select("request", "title")
    rest = r.join(below.select("request").distinct(), "request", "left_anti")
    near = rest.join(t, (F.left("title", F.lit(1)) == F.left("request", F.lit(1))) & F.startswith("title", "request")).select("request", "title")
    return below.unionByName(near)


def near_titles(requests: DataFrame, titles: DataFrame, n: int = 8) -> DataFrame:
    """P10: (request, title): the first n titles that contain the request. Candidates share its first three letters, or all of
    a shorter request's."""
    t = titles.select("title").distinct()
    of = lambda size: F.transform(F.sequence(F.lit(1), F.greatest(F.length("title") - (size - 1), F.lit(1))), lambda i: F.lower(F.substr("title", i, F.lit(size))))
    grams = t.withColumn("g", F.explode(F.array_distinct(F.concat(of(1), of(2), of(3)))))
    r = requests.select("request").distinct().where("request <> ''").withColumn("g", F.lower(F.left("request", F.lit(3))))
    hits = r.join(grams, "g").where(F.contains(F.lower("title"), F.lower("request"))).select("request", "title").distinct()
    return top_n(hits, ["request"], [F.col("title")], n)


def search_like(df: DataFrame, column: str, tokens: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows whose text holds all tokens, as they are (no wildcards)."""
    return df.where(reduce(lambda a, b: a & b, [F.contains(F.upper(column), F.lit(t.upper())) for t in tokens])).orderBy(*order).limit(k)


def search_snapshot(df: DataFrame, equal: Mapping[str, object], text: Sequence[str] = (), free: str | None = None, hints: Sequence[str] = (), by: str | None = None, limit: int | None = 1000) -> DataFrame:
    """Rows that meet all equalities and hold the free text, or all hint words, in one of the text columns;
    grouped by a column as an array of rows if `by` is given. limit: the first so many rows in order of the columns; None: all."""
    out = df
    for c, v in equal.items():
        if v is not None:
            out = out.where(F.col(c) == v)
    if text and (free or hints):
        whole = F.lower(F.concat_ws(" ", *text))
        every = reduce(lambda a, b: a & b, [F.contains(whole, F.lit(h.lower())) for h in hints]) if hints else F.lit(False)
        out = out.where((F.contains(whole, F.lit(free.lower())) if free else F.lit(False)) | every)
    if limit is not None:
        out = out.orderBy(*df.columns).limit(limit)
    return out if by is None else out.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != by]))).alias("rows"))


def longest_prefixes(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """F28 over a dictionary of any size: `df` with `entry`, the longest name of the dictionary (name) that begins the column.

    Distinct values are cut at the lengths that names have (no more than the longest name is long) and joined by equality.
    """
    names = dictionary.where("name <> ''").select("name").distinct()
    sizes = sorted(r[0] for r in names.select(F.length("name")).distinct().collect())
    values = df.select(F.col(column).alias("_v")).where("_v is not null").distinct()
    cuts = F.filter(F.array(*[F.lit(n) for n in sizes]), lambda n: n <= F.length("_v")) if sizes else F.array().cast("array<int>")
    begun = values.select("_v", F.explode(F.transform(cuts, lambda n: F.substr("_v", F.lit(1), n))).alias("name")).join(names, "name")
    best = begun.groupBy("_v").agg(F.max_by("name", F.length("name")).alias("entry"))
    return df.join(best, F.col(column) == F.col("_v"), "left").drop("_v")


def drop_artifacts(df: DataFrame, column: str, pattern: str = r"(?i)^(XMLTABLE|DUAL|SAWITH\d+|TABLE\d+)$") -> DataFrame:
    """Rows whose object isn't a pseudo-object; null objects stay."""
    return df.where(F.coalesce(~F.col(column).rlike(pattern), F.lit(True)))


def classify_first(rules: Sequence[tuple[str, Column]], default: str) -> Column:
    """The label of the first rule that holds, else the default."""
    return reduce(lambda acc, r: acc.when(r[1], F.lit(r[0])), rules, F.when(F.lit(False), F.lit(default))).otherwise(default)


def classify_names(names: DataFrame, rules: Sequence[tuple[str, str]], dictionary: DataFrame, known: str = "known") -> DataFrame:
    """(name, class, in_dictionary): the first regex rule, else `known` by dictionary evidence, else unknown."""
    d = dictionary.select("name").distinct().withColumn("in_dictionary", F.lit(True))
    j = names.select("name").distinct().join(d, "name", "left").withColumn("in_dictionary", F.coalesce("in_dictionary", F.lit(False)))
    label = classify_first([(k, F.col("name").rlike(r)) for k, r in rules] + [(known, F.col("in_dictionary"))], "unknown")
    return j.withColumn("class", label)


def ship_scope(in_lineage: Column, in_crawl: Column, name: Column, hidden: str) -> Column:
    """In some source, not by an internal name, and named."""
    return (in_lineage | in_crawl) & ~F.coalesce(name.rlike(hidden), F.lit(False)) & name.isNotNull()


def family_match(arrays: DataFrame, families: Sequence[Mapping[str, object]]) -> DataFrame:
    """(table_name, family): the first family whose name pattern and all-of / any-of columns a table meets.

    arrays: (table_name, columns); families in order: dicts with family, name, all, any (the last three optional).
    """
    def fits(f: Mapping[str, object]) -> Column:
        some = [F.col("table_name").rlike(str(f.get("name", "")))]
        if f.get("all"):
            some.append(F.size(F.array_except(F.array(*map(F.lit, f["all"])), F.col("columns"))) == 0)
        if f.get("any"):
            some.append(F.arrays_overlap(F.array(*map(F.lit, f["any"])), F.col("columns")))
        return reduce(lambda a, b: a & b, some)

    return arrays.select("table_name", reduce(lambda acc, f: acc.when(fits(f), F.lit(f["family"])), families, F.when(F.lit(False), F.lit(None).cast("string"))).alias("family")).where("family is not null")


def family_translation(arrays: DataFrame, suffixes: Sequence[str] = ("_TL", "_VL"), base: Sequence[str] = ("", "_B")) -> DataFrame:
    """P20: (table_name, base_table, shared): translation twins with the base table of their stem that shares columns."""
    pattern = "(" + "|".join(suffixes) + ")$"
    twins = arrays.where(F.col("table_name").rlike(pattern)).select("table_name", "columns", F.regexp_replace("table_name", pattern, "").alias("stem"))
    named = twins.select("table_name", "columns", F.explode(F.array(*[F.concat("stem", F.lit(b)) for b in base])).alias("base_table"))
    other = arrays.select(F.col("table_name").alias("base_table"), F.col("columns").alias("_c"))
    j = named.join(other, "base_table").withColumn("shared", F.size(F.array_intersect("columns", "_c"))).where("shared > 0")
    return pick_first(j, ["table_name"], [F.desc("shared"), F.col("base_table")]).select("table_name", "base_table", "shared")


def list_usages(requests: DataFrame, usages: DataFrame, texts: DataFrame, n: int = 5, inline: int = 2_500) -> DataFrame:
    """(name, sql_hash, rank, total, text): top usages of requested tables, with texts of at most `inline` characters.

    usages: (table_name, sql_hash, score); texts: (sql_hash, text).
    """
    u = usages.join(requests.select(F.col("name").alias("table_name")).distinct(), "table_name", "left_semi")
    w = Window.partitionBy("table_name")
    ranked = u.withColumns({"total": F.count("*").over(w), "rank": F.row_number().over(w.orderBy(F.desc("score"), "sql_hash"))}).where(F.col("rank") <= n)
    return ranked.join(texts, "sql_hash", "left").select(F.col("table_name").alias("name"), "sql_hash", "rank", "total", F.when(F.length("text") <= inline, F.col("text")).alias("text"))


def list_predicates(requests: DataFrame, preds: DataFrame, n: int = 5) -> DataFrame:
    """(name, column_name, op, literal, occurrences, role, rank): top filters of requested tables."""
    p = preds.join(requests.select(F.col("name").alias("table_name")).distinct(), "table_name", "left_semi")
    w = Window.partitionBy("table_name").orderBy(F.desc("occurrences"), "column_name", "op", "literal")
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumnRenamed("table_name", "name")


def list_apis(requests: DataFrame, pairs: DataFrame, least: int = 2, n: int = 5) -> DataFrame:
    """(name, entity, n): APIs used with requested tables in at least `least` statements. pairs: (entity, table_name, n)."""
    p = pairs.where(F.col("n") >= least).join(requests.select(F.col("name").alias("table_name")).distinct(), "table_name", "left_semi")
    return top_n(p, ["table_name"], [F.desc("n"), F.col("entity")], n).select(F.col("table_name").alias("name"), "entity", "n")


def describe_hierarchy(requests: DataFrame, folders: DataFrame, cap: int = 60) -> DataFrame:
    """P25: (area, facts, dimensions, n_folders) of requested areas; lists sorted, at most `cap` names each."""
    f = folders.join(requests.select("area").distinct(), "area", "left_semi")
    names = lambda kind: F.slice(F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("folder")))), 1, cap)
    return f.groupBy("area").agg(names("fact").alias("facts"), names("dimension").alias("dimensions"), F.count("*").alias("n_folders"))


def package_cards(requests: DataFrame, packages: DataFrame, apis: DataFrame, n: int = 5) -> DataFrame:
    """(request, exists, class, functions, near, note): packages with the functions seen; on a miss, packages of
    the same first two name parts. packages: (name, class); apis: (package_name, function_name)."""
    two = lambda c: F.substring_index(c, "_", 2)
    r = requests.select(F.upper(F.trim("request")).alias("request")).distinct()
    seen = apis.groupBy(F.col("package_name").alias("request")).agg(F.sort_array(F.collect_set("function_name")).alias("functions"))
    known = packages.select(F.col("name").alias("request"), "class", F.lit(True).alias("_e"))
    near = packages.select(F.col("name").alias("_n"), two(F.col("name")).alias("_k"))
    miss = r.join(known, "request", "left_anti").withColumn("_k", two(F.col("request"))).join(near, "_k")
    lists = top_n(miss, ["request"], [F.col("_n")], n).groupBy("request").agg(F.sort_array(F.collect_list("_n")).alias("near"))
    j = r.join(known, "request", "left").join(seen, "request", "left").join(lists, "request", "left")
    return j.select("request", F.coalesce("_e", F.lit(False)).alias("exists"), "class", "functions", "near", F.when(F.col("_e") & F.col("functions").isNull(), "never called").alias("note"))

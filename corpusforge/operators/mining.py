"""Corpus-mining composites M1 to M45 over statement facts.

Facts are DataFrames keyed by sql_hash. Distinct keys come before joins and counts, so that a hub object
costs partial sums and not pairs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from .aggregates import cooccurrence, literal_roles, participation_share
from .picks import pick_first, surrogate_id, top_n, universe

Rank = Mapping[str, int]
ARTIFACTS = r"(?i)^(XMLTABLE|DUAL|SAWITH\d+|TABLE\d+)$"


def _rank(source: Column, ranks: Rank) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[source], F.lit(9)) if ranks else F.lit(9)


def dedup_units(units: DataFrame, refs: DataFrame, source_rank: Rank) -> DataFrame:
    """M1: one row a content hash: primary unit, n_units, distinct sources and titles, path refs.

    units: (unit_id, source, title, original_sql); refs: (unit_id, path, idx). The primary unit is the first
    by source rank, title (nulls last) and id. Texts are hashed before the shuffle and only the hash, the
    ids and the titles go through it.
    """
    hashed = units.select("unit_id", "source", "title", C.content_hash(F.col("original_sql")).alias("sql_hash"))
    no_title = F.col("title").isNull()
    first = F.min(F.struct(_rank(F.col("source"), source_rank).alias("r"), no_title.alias("n"), "title", "unit_id", "source"))
    groups = hashed.groupBy("sql_hash").agg(first.alias("p"), F.count("*").alias("n_units"), F.sort_array(F.collect_set("source")).alias("sources"), F.sort_array(F.collect_set("title")).alias("titles"))
    paths = hashed.select("unit_id", "sql_hash").join(refs, "unit_id").groupBy("sql_hash").agg(F.sort_array(F.collect_set(F.struct("path", "idx"))).alias("reports"))
    return groups.join(paths, "sql_hash", "left").select("sql_hash", F.col("p.unit_id").alias("primary_unit_id"), F.col("p.source").alias("source"), F.col("p.title").alias("title"), "n_units", "sources", "titles", "reports")


def dedup_exact(units: DataFrame, text: str, key: str) -> DataFrame:
    """M2: (key, canonical): each unit's least id among byte-identical texts."""
    hashed = units.select(key, F.md5(text).alias("_h"), F.length(text).alias("_n"))
    best = hashed.groupBy("_h", "_n").agg(F.min(key).alias("canonical"))
    return hashed.join(best, ["_h", "_n"]).select(key, "canonical")


def drop_copies(facts: DataFrame, canonical: DataFrame, key: str) -> DataFrame:
    """M2: facts without the rows of copies."""
    return facts.join(canonical.where(F.col(key) != F.col("canonical")).select(key), key, "left_anti")


def tag_mentions(texts: DataFrame, dictionary: DataFrame, key: str, text: str) -> DataFrame:
    """M3: (key, name, after_from): dictionary names that a text holds as whole words, and whether one follows
    FROM, JOIN, UPDATE or INTO. Words are exploded and joined, so the cost is linear in the words."""
    words = texts.select(key, F.explode(F.array_distinct(C.tokens(F.col(text)))).alias("name"))
    froms = texts.select(key, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(r"(?i)\b(?:from|join|update|into)\s+(?:[A-Za-z0-9_]+\.)?([A-Za-z0-9_]+)"), F.lit(1)), F.upper))).alias("name"), F.lit(True).alias("_f"))
    names = dictionary.select(F.upper("name").alias("name")).distinct()
    return words.join(names, "name").join(froms, [key, "name"], "left").select(key, "name", F.coalesce("_f", F.lit(False)).alias("after_from"))


def package_rollup(inventory: DataFrame, packages: DataFrame) -> DataFrame:
    """M6: (name, in_dictionary, functions, statements): dictionary and called packages in one full join."""
    called = inventory.groupBy(F.col("package_name").alias("name")).agg(F.count("*").alias("functions"), F.sum("statements").alias("statements"))
    known = packages.select("name").distinct().withColumn("_in", F.lit(True))
    return known.join(called, "name", "full").select("name", F.coalesce("_in", F.lit(False)).alias("in_dictionary"), F.coalesce("functions", F.lit(0)).alias("functions"), F.coalesce("statements", F.lit(0)).alias("statements"))


def mine_relationships(joins: DataFrame, corpus: DataFrame, dictionary: DataFrame, declared: DataFrame) -> DataFrame:
    """M7: undirected column pairs of real tables with occurrences (distinct statements), statements by source,
    share of outer joins, confidence, and whether a declared key (child, parent, col) matches.

    joins: (sql_hash, from_t, from_c, to_t, to_c, join_type); corpus: (sql_hash, source) of statements that count.
    """
    real = dictionary.select(F.upper("name").alias("t")).distinct()
    up = {c: F.upper(c) for c in ("from_t", "from_c", "to_t", "to_c")}
    j = joins.withColumns(up).where("from_t is not null and to_t is not null").where(~F.col("from_t").rlike(ARTIFACTS) & ~F.col("to_t").rlike(ARTIFACTS))
    j = j.join(real.withColumnRenamed("t", "from_t"), "from_t", "left_semi").join(real.withColumnRenamed("t", "to_t"), "to_t", "left_semi")
    a = F.struct(F.col("from_t").alias("t"), F.coalesce("from_c", F.lit("")).alias("k"), F.col("from_c").alias("c"))
    b = F.struct(F.col("to_t").alias("t"), F.coalesce("to_c", F.lit("")).alias("k"), F.col("to_c").alias("c"))
    j = j.select("sql_hash", F.least(a, b).alias("x"), F.greatest(a, b).alias("y"), F.col("join_type").rlike("(?i)(LEFT|RIGHT|FULL|OUTER)").alias("outer"))
    # One row a statement and pair first: a pair that one statement repeats is counted once.
    per = j.groupBy("sql_hash", F.col("x.t").alias("t1"), F.col("x.c").alias("c1"), F.col("y.t").alias("t2"), F.col("y.c").alias("c2")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("outer", F.lit(False))).alias("n_outer"))
    per = per.join(corpus.select("sql_hash", "source"), "sql_hash")
    key = ["t1", "c1", "t2", "c2"]
    by_source = per.groupBy(*key, "source").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("n_outer").alias("n_outer"))
    mined = by_source.groupBy(*key).agg(F.sum("k").alias("occurrences"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "k")))).alias("by_source"), F.round(F.sum("n_outer") / F.sum("n"), 4).alias("outer_share"))
    pair = declared.select(F.least(F.upper("child"), F.upper("parent")).alias("t1"), F.greatest(F.upper("child"), F.upper("parent")).alias("t2"), F.upper("col").alias("_c")).groupBy("t1", "t2").agg(F.collect_set("_c").alias("_cs"))
    hit = F.array_contains("_cs", F.col("c1")) | F.array_contains("_cs", F.col("c2"))
    return mined.join(pair, ["t1", "t2"], "left").select(*key, "occurrences", C.confidence(F.col("occurrences")).alias("confidence"), "by_source", "outer_share", F.coalesce(hit, F.lit(False)).alias("matches_declared"))


def usage_graph(facts: DataFrame, corpus: DataFrame, weights: Rank, n: int = 60) -> DataFrame:
    """M8: (table_name, sql_hash, score, rank): each table's n best statements by source weight, then length."""
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source")], F.lit(1))
    scored = corpus.select("sql_hash", C.usage_score(w, F.col("chars")).alias("score"))
    ranked = facts.select("sql_hash", "table_name").distinct().join(scored, "sql_hash")
    order = Window.partitionBy("table_name").orderBy(F.desc("score"), "sql_hash")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def not_id_literal(column: Column, literal: Column) -> Column:
    """Not a number of six digits or more compared with a column that ends in _ID."""
    return ~(F.endswith(F.upper(column), F.lit("_ID")) & literal.rlike(r"^'?\d{6,}'?$"))


def predicate_registry(preds: DataFrame, threshold: int = 8) -> DataFrame:
    """M9: literal roles without id literals."""
    return literal_roles(preds.where(not_id_literal(F.col("column_name"), F.col("literal"))), threshold)


def join_column_stats(joins: DataFrame, tables: DataFrame, floor: float = 0.2) -> DataFrame:
    """Columns that take part in joins of at least `floor` of their table's statements."""
    return participation_share(joins, tables, floor)


def grain_registry(columns: DataFrame, rules: Mapping[str, str], evidence: DataFrame) -> DataFrame:
    """(table_name, grain, signal, statements): the first rule (name -> column regex) in order that a table's
    columns meet, the least such column, and its evidence. evidence: (table_name, statements)."""
    hits = [F.min(F.when(F.col("column_name").rlike(r), F.col("column_name"))).alias(k) for k, r in rules.items()]
    flat = columns.groupBy("table_name").agg(*hits)
    grain = reduce(lambda acc, k: acc.when(F.col(k).isNotNull(), k), rules, F.when(F.lit(False), ""))
    out = flat.select("table_name", grain.alias("grain"), F.coalesce(*rules).alias("signal")).where("grain is not null")
    return out.join(evidence, "table_name", "left").select("table_name", "grain", "signal", F.coalesce("statements", F.lit(0)).alias("statements"))


def lookup_values(preds: DataFrame, column: str) -> DataFrame:
    """(sql_hash, values): distinct values of a column's EQ and IN predicates, split and without quotes, sorted."""
    some = preds.where((F.col("column_name") == column) & F.col("op").isin("EQ", "IN"))
    each = some.select("sql_hash", F.explode(F.split("literal", ",")).alias("v")).select("sql_hash", C.clean_literal(F.col("v")).alias("v")).where("v <> ''")
    return each.groupBy("sql_hash").agg(F.sort_array(F.collect_set("v")).alias("values"))


def assemble_rows(corpus: DataFrame, tables: DataFrame, joins: DataFrame, preds: DataFrame) -> DataFrame:
    """Serving rows with a dense id: statement, tables, rendered joins and filters, all sorted."""
    lists = lambda df, c, name: df.groupBy("sql_hash").agg(F.sort_array(F.collect_set(c)).alias(name))
    t = lists(tables, F.col("table_name"), "tables")
    j = lists(joins, C.render_edge(*[F.col(c) for c in ("from_t", "from_c", "to_t", "to_c", "join_type")]), "joins")
    p = lists(preds, C.render_predicate(*[F.col(c) for c in ("table_name", "column_name", "op", "literal")]), "filters")
    out = corpus.select("sql_hash", "source")
    for part in (t, j, p):
        out = out.join(part, "sql_hash", "left")
    return surrogate_id(out, "sql_hash")


def merge_sources(sources: Mapping[str, DataFrame], key: Sequence[str], ref: str) -> DataFrame:
    """One row a key with flags in_<source> and, for each reference, the sources that hold it in order of precedence."""
    flags = universe(sources, key)
    order = {s: i for i, s in enumerate(sources)}
    refs = reduce(lambda a, b: a.unionByName(b), [df.where(F.col(ref).isNotNull()).select(*key, ref, F.lit(i).alias("_i"), F.lit(s).alias("_s")) for (s, df), i in zip(sources.items(), order.values(), strict=True)])
    per = refs.groupBy(*key, ref).agg(F.sort_array(F.collect_set(F.struct("_i", "_s"))).alias("_l"))
    rows = per.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col("_l")[0]["_i"].alias("i"), F.col(ref).alias("ref"), F.transform("_l", lambda x: x["_s"]).alias("src")))).alias("_r"))
    return flags.join(rows, list(key), "left").withColumn("refs", F.transform("_r", lambda x: F.struct(x["ref"].alias("ref"), x["src"].alias("src")))).drop("_r")


def inherit_descriptions(entities: DataFrame, remarks: DataFrame, cap: int = 4) -> DataFrame:
    """(id, description, source): the first reference's remark that isn't junk, else for a derived entity up to
    `cap` references' remarks. entities: (id, derived, refs in order); remarks: (ref, name, remark)."""
    good = remarks.where(~C.is_junk_remark(F.col("remark"), F.col("name"))).select("ref", "remark")
    each = entities.select("id", "derived", F.posexplode("refs").alias("pos", "ref")).join(good, "ref")
    first = each.groupBy("id").agg(F.min_by("remark", "pos").alias("first"), F.sort_array(F.collect_list(F.struct("pos", "remark"))).alias("all"))
    joined = entities.select("id", "derived").join(first, "id", "left")
    derived = F.array_join(F.transform(F.slice("all", 1, cap), lambda x: x["remark"]), "; ")
    text = F.when(F.col("derived"), derived).otherwise(F.col("first"))
    return joined.select("id", text.alias("description"), F.when(text.isNull(), "none").when(F.col("derived"), "expression").otherwise("reference").alias("source"))


def rollup_hierarchy(columns: DataFrame, fact_name: str = "(?i)fact") -> tuple[DataFrame, DataFrame]:
    """Folders (area, folder, n_columns, n_measures, kind) and areas (area, n_folders, n_facts, n_columns).

    columns: (area, folder, column, is_measure). A folder is a fact by measures, else by name, else a dimension.
    """
    folders = columns.groupBy("area", "folder").agg(F.count("*").alias("n_columns"), F.count_if("is_measure").alias("n_measures"))
    folders = folders.withColumn("kind", F.when((F.col("n_measures") > 0) | F.col("folder").rlike(fact_name), "fact").otherwise("dimension"))
    areas = folders.groupBy("area").agg(F.count("*").alias("n_folders"), F.count_if(F.col("kind") == "fact").alias("n_facts"), F.sum("n_columns").alias("n_columns"))
    return folders, areas


def dedup_texts(entities: DataFrame, text: str, key: str) -> DataFrame:
    """(text_hash, least key, n): one row a distinct text, so that each is embedded once."""
    return entities.groupBy(F.md5(text).alias("text_hash")).agg(F.min(key).alias(key), F.count("*").alias("n"))


def reconcile(claims: DataFrame, facts: DataFrame, dictionary: DataFrame, texts: DataFrame) -> DataFrame:
    """Claims (sql_hash, kind missing or extra, table_name) with evidence and a verdict.

    A missing table is added if the dictionary has it and the text names it, `likely` if only one holds, else
    rejected; an extra one is disputed unless the text lacks it. Facts are never removed.
    """
    parsed = facts.select("sql_hash", "table_name").distinct().withColumn("in_facts", F.lit(True))
    known = dictionary.select(F.upper("name").alias("table_name")).distinct().withColumn("in_dict", F.lit(True))
    words = texts.select("sql_hash", F.explode(F.array_distinct(C.tokens(F.col("text")))).alias("table_name")).withColumn("in_text", F.lit(True))
    c = claims.withColumn("table_name", F.upper("table_name")).distinct()
    for part, on in ((parsed, ["sql_hash", "table_name"]), (known, ["table_name"]), (words, ["sql_hash", "table_name"])):
        c = c.join(part, on, "left")
    c = c.fillna(False, ["in_facts", "in_dict", "in_text"])
    missing = F.when(F.col("in_facts"), "already_there").when(F.col("in_dict") & F.col("in_text"), "added").when(F.col("in_dict") | F.col("in_text"), "likely").otherwise("rejected")
    extra = F.when(~F.col("in_facts"), "not_there").when(F.col("in_text"), "kept").otherwise("disputed")
    return c.withColumn("verdict", F.when(F.col("kind") == "missing", missing).otherwise(extra))


def reconciled_tables(facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(sql_hash, table_name, provenance): all facts, labelled, and the added ones."""
    disputed = verdicts.where("verdict = 'disputed'").select("sql_hash", "table_name").distinct().withColumn("_d", F.lit("disputed"))
    kept = facts.select("sql_hash", "table_name").distinct().join(disputed, ["sql_hash", "table_name"], "left").select("sql_hash", "table_name", F.coalesce("_d", F.lit("parser")).alias("provenance"))
    return kept.unionByName(verdicts.where("verdict = 'added'").select("sql_hash", "table_name", F.lit("model").alias("provenance")).distinct())


def compact_journal(lines: DataFrame) -> DataFrame:
    """Each id's last ok line, or its last line if none is ok, with the number of lines and failures.

    lines: (id, line_no, ok, ...).
    """
    rest = [c for c in lines.columns if c not in ("id", "line_no", "ok")]
    last = F.max_by(F.struct("line_no", "ok", *rest), F.struct("ok", "line_no"))
    return lines.groupBy("id").agg(last.alias("_l"), F.count("*").alias("n_lines"), F.count_if(~F.col("ok")).alias("n_failed")).select("id", "_l.*", "n_lines", "n_failed")


def claims_union(lines: DataFrame, claims: str) -> DataFrame:
    """Every claim of every line of every generation, once. `claims` is an array column."""
    return lines.select("id", F.explode(claims).alias("claim")).distinct()


def pick_record(rows: DataFrame) -> DataFrame:
    """Of records that share a statement: ok first, then the primary unit's, then the least id."""
    return pick_first(rows, ["sql_hash"], [F.desc_nulls_last("ok"), F.desc_nulls_last("is_primary"), F.col("id")])


def promote_fields(records: DataFrame, payload: str, spec: Mapping[str, str]) -> DataFrame:
    """Typed columns out of a JSON payload (name -> type), emptiness as null, and how many are filled."""
    parsed = F.from_json(payload, ", ".join(f"`{k}` {t}" for k, t in spec.items()))
    out = records.withColumn("_p", parsed)
    cols = [(C.text_nonempty(F.col(f"_p.{k}")) if t == "string" else F.col(f"_p.{k}")).alias(k) for k, t in spec.items()]
    rest = [c for c in records.columns if c != payload]
    out = out.select(*rest, *cols)
    return out.withColumn("n_filled", reduce(lambda a, b: a + b, [F.when(F.col(k).isNotNull(), 1).otherwise(0) for k in spec]))


def build_grounding(keys: DataFrame, notes: DataFrame, key: str, max_columns: int = 24, max_notes: int = 120) -> DataFrame:
    """(key, payload, ghash): a JSON document of grouped notes with sorted lists, and its md5.

    notes: (key, column_name, note). At most max_columns columns, and max_notes notes, by name.
    """
    distinct = notes.select(key, "column_name", "note").distinct()
    w = Window.partitionBy(key).orderBy("column_name", "note")
    ranked = distinct.withColumns({"_c": F.dense_rank().over(Window.partitionBy(key).orderBy("column_name")), "_n": F.row_number().over(w)})
    some = ranked.where((F.col("_c") <= max_columns) & (F.col("_n") <= max_notes))
    per = some.groupBy(key, "column_name").agg(F.sort_array(F.collect_list("note")).alias("notes"))
    doc = per.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("column_name", "notes"))).alias("columns"))
    payload = F.to_json(F.struct(F.col(key), F.coalesce("columns", F.array().cast("array<struct<column_name:string,notes:array<string>>>")).alias("columns")))
    return keys.select(key).distinct().join(doc, key, "left").select(key, payload.alias("payload"), F.md5(payload).alias("ghash"))


def resolve_labels(columns: DataFrame, contexts: DataFrame, labels: DataFrame) -> DataFrame:
    """(sql_hash, column_name, label, how): by a context that the statement names, else by the column's owner,
    else the single label of all, else unresolved.

    columns: (sql_hash, column_name, owner); contexts: (sql_hash, context); labels: (column_name, context, label).
    """
    ctx = columns.join(contexts, "sql_hash").join(labels, ["column_name", "context"]).groupBy("sql_hash", "column_name").agg(F.min("label").alias("_ctx"))
    own = labels.select("column_name", F.col("context").alias("owner"), F.col("label").alias("_own"))
    only = labels.groupBy("column_name").agg(F.countDistinct("label").alias("_n"), F.min("label").alias("_only")).where("_n = 1")
    j = columns.join(ctx, ["sql_hash", "column_name"], "left").join(own, ["column_name", "owner"], "left").join(only, "column_name", "left")
    how = F.when(F.col("_ctx").isNotNull(), "context").when(F.col("_own").isNotNull(), "owner").when(F.col("_only").isNotNull(), "single").otherwise("unresolved")
    return j.select("sql_hash", "column_name", F.coalesce("_ctx", "_own", "_only").alias("label"), how.alias("how"))


def exposure_index(columns: DataFrame) -> DataFrame:
    """(area, folder, column, table_name, column_name, sources, via_expression) from columns with refs
    array<struct<t, c, src>> and a flag is_expression."""
    each = columns.select("area", "folder", "column", "is_expression", F.inline("refs"))
    return each.groupBy("area", "folder", "column", F.col("t").alias("table_name"), F.col("c").alias("column_name")).agg(F.sort_array(F.collect_set("src")).alias("sources"), F.max("is_expression").alias("via_expression"))


def exposure_stats(index: DataFrame) -> DataFrame:
    """(table_name, column_name, n_areas, n_columns)."""
    return index.groupBy("table_name", "column_name").agg(F.countDistinct("area").alias("n_areas"), F.count("*").alias("n_columns"))


def map_areas(areas: DataFrame, roles: DataFrame, aliases: DataFrame, admin: str) -> DataFrame:
    """(area, role, how): roles by normalised name, else by alias; admin roles left out; the rest unmapped."""
    r = roles.where(~F.col("role").rlike(admin)).select("role", C.match_key(F.col("role")).alias("_k"))
    a = areas.select("area").distinct().withColumn("_k", C.match_key(F.col("area")))
    by_name = a.join(r, "_k").select("area", "role", F.lit("name").alias("how"))
    rest = a.join(by_name.select("area").distinct(), "area", "left_anti")
    by_alias = rest.join(aliases, "area").join(r.select("role", F.col("_k").alias("_r")), C.match_key(F.col("alias")) == F.col("_r")).select("area", "role", F.lit("alias").alias("how"))
    none = rest.join(by_alias.select("area").distinct(), "area", "left_anti").select("area", F.lit(None).cast("string").alias("role"), F.lit("unmapped").alias("how"))
    return by_name.unionByName(by_alias).unionByName(none)


def derive_families(policies: DataFrame) -> DataFrame:
    """(module, family): the single family of a module's code evidence, else of its object evidence; mixed gives
    null. policies: (module, family, evidence: code or object)."""
    kinds = policies.groupBy("module").agg(F.collect_set(F.when(F.col("evidence") == "code", F.col("family"))).alias("c"), F.collect_set(F.when(F.col("evidence") == "object", F.col("family"))).alias("o"))
    return kinds.select("module", F.when(F.size("c") == 1, F.col("c")[0]).when((F.size("c") == 0) & (F.size("o") == 1), F.col("o")[0]).alias("family"))


def candidates(columns: DataFrame, rules: Sequence[Mapping[str, str]], excluded: DataFrame) -> DataFrame:
    """(table_name, column_name, context, how, excluded): rules (context, name, optional suffix) by exact name,
    else by suffix; exclusions (table_name) stay as marked rows."""
    exact = F.array(*[F.when(F.col("column_name") == r["name"], F.struct(F.lit(r["context"]).alias("context"), F.lit("name").alias("how"))) for r in rules])
    ends = F.array(*[F.when(F.endswith("column_name", F.lit(r.get("suffix", r["name"]))) & (F.col("column_name") != r["name"]), F.struct(F.lit(r["context"]).alias("context"), F.lit("suffix").alias("how"))) for r in rules])
    hits = F.filter(F.concat(exact, ends), lambda x: x.isNotNull())
    out = columns.select("table_name", "column_name", F.inline(hits))
    return out.join(excluded.select("table_name").distinct().withColumn("_x", F.lit(True)), "table_name", "left").withColumn("excluded", F.coalesce("_x", F.lit(False))).drop("_x")


def usage_evidence(branches: Mapping[str, DataFrame], name: str) -> DataFrame:
    """(name, evidence, n, n_sources): rows of an object in all branches and how many branches hold it."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.select(name, F.lit(k).alias("_b")) for k, df in branches.items()])
    return rows.groupBy(name).agg(F.sort_array(F.collect_set("_b")).alias("evidence"), F.count("*").alias("n"), F.countDistinct("_b").alias("n_sources"))


def compare_extractions(a: DataFrame, b: DataFrame, key: str, item: str) -> DataFrame:
    """(key, n_a, n_b, gained, lost, verdict) of two versions' item sets."""
    both = universe({"a": a, "b": b}, [key, item])
    per = both.groupBy(key).agg(F.count_if("in_a").alias("n_a"), F.count_if("in_b").alias("n_b"), F.count_if(F.col("in_b") & ~F.col("in_a")).alias("gained"), F.count_if(F.col("in_a") & ~F.col("in_b")).alias("lost"))
    return per.withColumn("verdict", F.when((F.col("gained") == 0) & (F.col("lost") == 0), "equal").when(F.col("lost") == 0, "gain").when(F.col("gained") == 0, "loss").otherwise("mixed"))


def suspect_text(df: DataFrame, text: str) -> DataFrame:
    """Flags of a text that looks cut: ends in a comma, an elision comment, no FROM, an ellipsis."""
    c = F.col(text)
    return df.withColumns({"trailing_comma": c.rlike(r",\s*$"), "elided": c.rlike(r"(?i)(--|/\*)[^\n]*(rest|remaining|omitted|etc)"), "no_from": ~c.rlike(r"(?i)\bfrom\b"), "ellipsis": F.contains(c, F.lit("...")) | F.contains(c, F.lit("…"))})


def coverage_gate(refs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(name, n, state): referenced objects by impact: described, existing or missing. dictionary: (name, remark)."""
    d = dictionary.groupBy("name").agg(F.max(F.when(~C.is_junk_remark(F.col("remark"), F.col("name")), True)).alias("_d"), F.lit(True).alias("_e"))
    n = refs.groupBy("name").agg(F.countDistinct("sql_hash").alias("n"))
    return n.join(d, "name", "left").select("name", "n", F.when(F.col("_d"), "described").when(F.col("_e"), "exists").otherwise("missing").alias("state"))


def ab_compare(old: DataFrame, new: DataFrame, canonical: DataFrame, metric: str) -> DataFrame:
    """(canonical, old_avg, new_avg, change) of a unit metric aggregated to canonical ids."""
    side = lambda df, n: df.join(canonical, "id").groupBy("canonical").agg(F.round(F.avg(metric), 4).alias(n))
    j = side(old, "old_avg").join(side(new, "new_avg"), "canonical", "full")
    return j.withColumn("change", F.round(F.col("new_avg") - F.col("old_avg"), 4))


def validate_records(records: DataFrame, facts: DataFrame, least: int = 20) -> DataFrame:
    """Records (sql_hash, description, names array, seqs array) with unknown names, unknown sequence numbers,
    and problems; facts: (sql_hash, table_name, seq)."""
    known = facts.groupBy("sql_hash").agg(F.collect_set("table_name").alias("_t"), F.collect_set("seq").alias("_s"))
    j = records.join(known, "sql_hash", "left")
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t))
    bad_names = F.array_except("names", empty("_t", "array<string>"))
    bad_seqs = F.array_except("seqs", empty("_s", "array<int>"))
    problems = F.filter(F.array(F.when(F.coalesce(F.length(F.trim("description")), F.lit(0)) < least, "short"), F.when(F.size(bad_names) > 0, "names"), F.when(F.size(bad_seqs) > 0, "seqs")), lambda x: x.isNotNull())
    return j.select("sql_hash", F.sort_array(bad_names).alias("unknown_names"), F.sort_array(bad_seqs).alias("unknown_seqs"), problems.alias("problems"), (F.size(problems) > 0).alias("review"))


def merge_config(base: DataFrame, fields: DataFrame, key: Sequence[str], anchor: str) -> DataFrame:
    """Base rows with labels updated by key, and unmatched fields inserted if they have an anchor."""
    f = fields.withColumnRenamed("label", "_label")
    updated = base.join(f.drop(anchor), list(key), "left").withColumn("label", F.coalesce("_label", "label")).drop("_label").select(*base.columns)
    new = fields.join(base.select(*key), list(key), "left_anti").where(F.col(anchor).isNotNull())
    return updated.unionByName(new.select(*[F.col(c) if c in new.columns else F.lit(None).alias(c) for c in base.columns]))


def table_dossier(requests: DataFrame, dictionary: DataFrame, preds: DataFrame, join_stats: DataFrame, n: int = 5) -> DataFrame:
    """(name, exists, filters, join_columns) of requested tables: their top filters and join columns."""
    top = top_n(preds.groupBy("table_name", "column_name").agg(F.sum("occurrences").alias("n")), ["table_name"], [F.desc("n"), F.col("column_name")], n)
    filters = top.groupBy("table_name").agg(F.sort_array(F.collect_list("column_name")).alias("filters"))
    cols = top_n(join_stats, ["table_name"], [F.desc("share"), F.col("column_name")], n).groupBy("table_name").agg(F.sort_array(F.collect_list("column_name")).alias("join_columns"))
    known = dictionary.select("name").distinct().withColumn("exists", F.lit(True))
    out = requests.select("name").distinct().join(known, "name", "left")
    out = out.join(filters.withColumnRenamed("table_name", "name"), "name", "left").join(cols.withColumnRenamed("table_name", "name"), "name", "left")
    return out.select("name", F.coalesce("exists", F.lit(False)).alias("exists"), "filters", "join_columns")


def evidence_pack(requests: DataFrame, facts: DataFrame, joins: DataFrame, n: int = 5) -> DataFrame:
    """(name, co_used, joined): the n tables most used together with each requested one, and most joined to it."""
    wanted = requests.select(F.col("name").alias("entity")).distinct()
    mine = facts.select("sql_hash", F.col("table_name").alias("entity")).join(wanted, "entity", "left_semi")
    co = cooccurrence(mine, facts, "entity", "table_name", "sql_hash").where("entity <> table_name")
    best = top_n(co, ["entity"], [F.desc("n"), F.col("table_name")], n).groupBy("entity").agg(F.sort_array(F.collect_list("table_name")).alias("co_used"))
    ends = joins.select("sql_hash", F.col("from_t").alias("entity"), F.col("to_t").alias("other")).unionByName(joins.select("sql_hash", F.col("to_t").alias("entity"), F.col("from_t").alias("other")))
    pairs = ends.join(wanted, "entity", "left_semi").where("entity <> other").groupBy("entity", "other").agg(F.countDistinct("sql_hash").alias("n"))
    linked = top_n(pairs, ["entity"], [F.desc("n"), F.col("other")], n).groupBy("entity").agg(F.sort_array(F.collect_list("other")).alias("joined"))
    return wanted.join(best, "entity", "left").join(linked, "entity", "left").withColumnRenamed("entity", "name")


def ship_inventory(inventory: DataFrame, pairs: DataFrame, real: DataFrame, kept: Sequence[str], least: int = 2, share: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Inventory rows of kept classes, and their (entity, table_name) pairs with enough statements or share and a real table."""
    rows = inventory.where(F.col("class").isin(list(kept)))
    some = pairs.where((F.col("n") >= least) | (F.col("share") >= share)).join(real.select("table_name").distinct(), "table_name", "left_semi")
    return rows, some.join(rows.select("entity").distinct(), "entity", "left_semi")


def title_aliases(units: DataFrame, corpus: DataFrame) -> DataFrame:
    """(title, sql_hash): every unit's title leads to its statement."""
    return units.where("title is not null").select("title", "sql_hash").join(corpus.select("sql_hash"), "sql_hash", "left_semi").distinct()


def carry_over(new: DataFrame, old: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """New rows with fields of the old row of the same key; state says carried or new."""
    o = old.select(key, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_old"))
    j = new.join(o, key, "left")
    return j.select(*[c for c in new.columns if c not in fields], *[(F.coalesce(f, f"_{f}") if f in new.columns else F.col(f"_{f}")).alias(f) for f in fields], F.when(F.col("_old"), "carried").otherwise("new").alias("state"))


def precedents(texts: DataFrame, facts: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """(table_name, column_name, n): statements on a table whose text names a listed column."""
    words = texts.select("sql_hash", F.explode(F.array_distinct(C.tokens(F.col(text)))).alias("column_name")).where(F.col("column_name").isin([c.upper() for c in columns]))
    return facts.select("sql_hash", "table_name").distinct().join(words, "sql_hash").groupBy("table_name", "column_name").agg(F.count("*").alias("n"))


def join_evidence(joins: DataFrame, contexts: DataFrame) -> DataFrame:
    """(table_name, column_name, context, n): statements that join a table to an evidence object of a context.

    contexts: (context, evidence object name).
    """
    ends = joins.select("sql_hash", F.inline(F.array(*[F.struct(F.col(f"{a}_t").alias("table_name"), F.col(f"{a}_c").alias("column_name"), F.col(f"{b}_t").alias("evidence")) for a, b in (("from", "to"), ("to", "from"))])))
    return ends.join(contexts, "evidence").groupBy("table_name", "column_name", "context").agg(F.countDistinct("sql_hash").alias("n"))


def error_families(df: DataFrame, error: str) -> DataFrame:
    """(family, n): the bracketed code of an error, else its text, else `none`."""
    code = F.regexp_extract(error, r"\[([A-Z0-9_.-]+)\]", 1)
    return df.groupBy(F.when(F.col(error).isNull(), "none").when(code != "", code).otherwise(F.col(error)).alias("family")).agg(F.count("*").alias("n"))


def gap_estimate(df: DataFrame, name: str, expression: str, ref: str) -> DataFrame:
    """Rows, distinct names, (name, expression) and (name, ref) among gaps."""
    return df.agg(F.count("*").alias("gaps"), F.countDistinct(name).alias("names"), F.countDistinct(F.struct(name, F.coalesce(expression, F.lit("")))).alias("by_expression"), F.countDistinct(F.struct(name, F.coalesce(ref, F.lit("")))).alias("by_ref"))

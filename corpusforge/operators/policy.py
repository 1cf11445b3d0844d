"""Access-policy operators X1 to X25, in batch over tables and areas.

Facts, candidates and grants are DataFrames; a missing fact never means "allowed": verdicts fail closed
with a reason, and an absent input raises.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import name_stem
from .picks import pick_first, primary_flag, top_n, top_ties


def policy_columns(rows: DataFrame, standard: str) -> DataFrame:
    """(table_name, column_name, context, state): the single context of a column's policies, else the standard
    set's single one, else a conflict. rows: (table_name, column_name, context, set_code)."""
    g = rows.groupBy("table_name", "column_name").agg(F.collect_set("context").alias("a"), F.collect_set(F.when(F.col("set_code") == standard, F.col("context"))).alias("s"))
    one = lambda c: F.size(c) == 1
    value = F.when(one("a"), F.col("a")[0]).when(one("s"), F.col("s")[0])
    return g.select("table_name", "column_name", value.alias("context"), F.when(one("a"), "single").when(one("s"), "standard").otherwise("conflict").alias("state"))


def final_facts(candidates: DataFrame, precedents: DataFrame, evidence: DataFrame, used: DataFrame, priorities: Mapping[str, int]) -> DataFrame:
    """One row a (table, column, context) by confidence, raised by precedent or evidence, with a primary column a
    table; tables left with LOW candidates only are ambiguous if used, else disallowed.

    candidates: (table_name, column_name, context, confidence HIGH, MEDIUM or LOW); precedents and evidence:
    (table_name, column_name, context, n); used: (table_name).
    """
    key = ["table_name", "column_name", "context"]
    level = F.when(F.col("confidence") == "HIGH", 0).when(F.col("confidence") == "MEDIUM", 1).otherwise(2)
    best = pick_first(candidates.withColumn("_l", level), key, [F.col("_l")])
    j = best.join(precedents.select(*key, F.col("n").alias("_p")), key, "left").join(evidence.select(*key, F.col("n").alias("_e")), key, "left")
    raised = F.when((F.coalesce("_p", F.lit(0)) > 0) | (F.coalesce("_e", F.lit(0)) >= 2), F.greatest(F.col("_l") - 1, F.lit(0))).otherwise(F.col("_l"))
    j = j.withColumn("_l", raised)
    j = primary_flag(j, ["table_name"], "context", priorities, [F.col("_l"), F.col("column_name"), F.col("context")])
    least = j.groupBy("table_name").agg(F.min("_l").alias("_best"))
    u = used.select("table_name").distinct().withColumn("_u", F.lit(True))
    j = j.join(least, "table_name").join(u, "table_name", "left")
    state = F.when(F.col("_best") < 2, "secured").when(F.col("_u"), "ambiguous").otherwise("disallowed")
    return j.select(*key, F.element_at(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")), F.col("_l") + 1).alias("confidence"), "is_primary", state.alias("state"))


def signature_classes(candidates: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n_classes, first): how many signatures a key's candidates (name, signature) have, and the least name if one."""
    g = candidates.groupBy(*by).agg(F.countDistinct("signature").alias("n_classes"), F.min("name").alias("_n"))
    return g.select(*by, "n_classes", F.when(F.col("n_classes") == 1, F.col("_n")).alias("first"))


def curated_choice(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """(area, entity, product, choice, state): curated rows by tier: (area, entity), area, product; an exact area
    before a prefix; several choices in the first tier that has any are a conflict.

    requests: (area, entity, product); rows: (area_or_product, entity, choice, kind: area, prefix or product).
    """
    q = requests.select("area", "entity", "product").distinct()
    exact = q.join(rows.where("kind = 'area'").select(F.col("area_or_product").alias("area"), F.col("entity").alias("_e"), "choice"), "area")
    exact = exact.where("_e is null or _e = entity").withColumn("tier", F.when(F.col("_e").isNotNull(), 0).otherwise(1))
    pre = rows.where("kind = 'prefix'").select(F.col("area_or_product").alias("_p"), F.col("entity").alias("_e"), "choice")
    near = q.join(pre, (F.left("area", F.lit(1)) == F.left("_p", F.lit(1))) & F.startswith("area", "_p") & (F.col("_e").isNull() | (F.col("_e") == F.col("entity")))).withColumn("tier", F.when(F.col("_e").isNotNull(), 2).otherwise(3)).drop("_p")
    prod = q.join(rows.where("kind = 'product'").select(F.col("area_or_product").alias("product"), F.lit(None).cast("string").alias("_e"), "choice"), "product").withColumn("tier", F.lit(4))
    cols = ["area", "entity", "product", "choice", "tier"]
    first = top_ties(exact.select(*cols).unionByName(near.select(*cols)).unionByName(prod.select(*cols)), ["area", "entity", "product"], -F.col("tier"))
    g = first.groupBy("area", "entity", "product").agg(F.countDistinct("choice").alias("_n"), F.min("choice").alias("_c"))
    return q.join(g, ["area", "entity", "product"], "left").select("area", "entity", "product", F.when(F.col("_n") == 1, F.col("_c")).alias("choice"), F.when(F.col("_n").isNull(), "none").when(F.col("_n") > 1, "conflict").otherwise("curated").alias("state"))


def rule_choice(candidates: DataFrame, prefixes: Mapping[str, Sequence[str]], generic: str) -> DataFrame:
    """X3 over named candidates (area, product, name, signature) that aren't generic and begin with one of their product's prefixes."""
    fits = reduce(lambda a, b: a | b, [(F.col("product") == p) & F.startswith("name", F.lit(x)) for p, xs in prefixes.items() for x in xs], F.lit(False))
    return signature_classes(candidates.where(F.col("name").isNotNull() & ~F.col("name").rlike(generic) & fits), ["area"])


def consensus(grants: DataFrame, voters: DataFrame) -> DataFrame:
    """(entity, signature, how): unanimous if one class is held by all voters, else the unique majority, else undecided.

    grants: (entity, role_name, signature); voters: (entity, role_name).
    """
    held = grants.join(voters, ["entity", "role_name"], "left_semi")
    n = voters.groupBy("entity").agg(F.countDistinct("role_name").alias("_v"))
    per = held.groupBy("entity", "signature").agg(F.countDistinct("role_name").alias("_h"))
    top = top_ties(per, ["entity"], F.col("_h")).groupBy("entity").agg(F.count("*").alias("_k"), F.min("signature").alias("_s"), F.max("_h").alias("_h"))
    classes = per.groupBy("entity").agg(F.count("*").alias("_c"))
    j = n.join(top, "entity", "left").join(classes, "entity", "left")
    unanimous = (F.col("_c") == 1) & (F.col("_h") == F.col("_v"))
    return j.select("entity", F.when(F.col("_k") == 1, F.col("_s")).alias("signature"), F.when(unanimous, "unanimous").when(F.col("_k") == 1, "majority").otherwise("undecided").alias("how"))


def pool_choice(candidates: DataFrame) -> DataFrame:
    """(entity, first) where all granted candidates (entity, name, signature) are of one class."""
    return signature_classes(candidates, ["entity"]).where("n_classes = 1").select("entity", "first")


def role_map_choice(pairs: DataFrame, area_roles: DataFrame) -> DataFrame:
    """(area, privilege, roles, in_area): privileges with their roles; of the area's own roles if it has any.

    pairs: (area, privilege, role_name); area_roles: (area, role_name).
    """
    own = area_roles.distinct().withColumn("_o", F.lit(True))
    j = pairs.join(own, ["area", "role_name"], "left").withColumn("_o", F.coalesce("_o", F.lit(False)))
    g = j.groupBy("area", "privilege").agg(F.sort_array(F.collect_set(F.when(F.col("_o"), F.col("role_name")))).alias("_in"), F.sort_array(F.collect_set("role_name")).alias("_all"))
    own_roles = F.size("_in") > 0
    return g.select("area", "privilege", F.when(own_roles, F.col("_in")).otherwise(F.col("_all")).alias("roles"), own_roles.alias("in_area"))


def choose_context(facts: DataFrame, traced: DataFrame) -> DataFrame:
    """(table_name, context, why): a traced context, the only one, the one with most evidence, or the audited
    primary one; else blocked. facts: (table_name, context, evidence, is_primary, audited); traced: (table_name, context)."""
    f = facts.groupBy("table_name").agg(
        F.countDistinct("context").alias("n"), F.min("context").alias("only"), F.max("evidence").alias("most"),
        F.collect_set(F.when(F.col("is_primary") & F.col("audited"), F.col("context"))).alias("prim"),
    )
    best = top_ties(facts.where("evidence > 0"), ["table_name"], F.col("evidence")).groupBy("table_name").agg(F.countDistinct("context").alias("_k"), F.min("context").alias("by_evidence"))
    t = traced.groupBy("table_name").agg(F.min("context").alias("traced"))
    j = f.join(t, "table_name", "left").join(best, "table_name", "left")
    evid = F.when(F.col("_k") == 1, F.col("by_evidence"))
    prim = F.when(F.size("prim") == 1, F.col("prim")[0])
    only = F.when(F.col("n") == 1, F.col("only"))
    why = F.when(F.col("traced").isNotNull(), "traced").when(only.isNotNull(), "only").when(evid.isNotNull(), "evidence").when(prim.isNotNull(), "primary").otherwise("blocked")
    return j.select("table_name", F.coalesce("traced", only, evid, prim).alias("context"), why.alias("why"))


def resolve_access(tables: DataFrame, flags: Sequence[str] = ("sensitive", "direct", "reference", "pool")) -> DataFrame:
    """(table_name, area, verdict, route, reason): secured by the first route that holds, none if the table is
    known to hold nothing secured, else blocked with a reason.

    tables: (table_name, area, known, has_context, and one nullable boolean a route). A sensitive table is
    secured only by its own route. A fact that is null is missing and blocks.
    """
    missing = [c for c in ("known", "has_context", *flags) if c not in tables.columns]
    if missing:
        raise ValueError(f"resolve_access: missing facts {missing}")
    route = reduce(lambda acc, r: acc.when(F.col(r), F.lit(r)), flags, F.when(F.lit(False), F.lit(None).cast("string")))
    unknown = F.col("known").isNull() | ~F.coalesce("known", F.lit(False)) | F.col("has_context").isNull()
    verdict = F.when(unknown, "blocked").when(~F.col("has_context"), "none").when(route.isNotNull(), "secured").otherwise("blocked")
    reason = F.when(unknown, "no facts").when(F.col("has_context") & route.isNull(), "no condition")
    return tables.select("table_name", "area", verdict.alias("verdict"), F.when(verdict == "secured", route).alias("route"), reason.alias("reason"))


def combine_conditions(df: DataFrame, key_sets: Sequence[DataFrame], on: str, how: str) -> DataFrame:
    """X11: rows whose key is in all key sets (`all`, strictest) or in any of them (`any`)."""
    if how == "all":
        return reduce(lambda d, k: d.join(k.select(on), on, "left_semi"), key_sets, df)
    if how == "any":
        keys = reduce(lambda a, b: a.union(b), [k.select(on) for k in key_sets]).distinct()
        return df.join(keys, on, "left_semi")
    raise ValueError(f"combine_conditions: all or any, not {how}")


def apply_row_policy(df: DataFrame, keys: DataFrame, on: Sequence[str], null_passes: bool = False) -> DataFrame:
    """Rows whose key is in the secured key set; with null_passes also rows with a null in the key. One pass."""
    k = keys.select(*[F.col(c).alias(f"_{c}") for c in on]).distinct().withColumn("_ok", F.lit(True))
    j = df.join(k, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in on]), "left")
    free = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on]) if null_passes else F.lit(False)
    return j.where(F.col("_ok") | free).select(*df.columns)


def column_scope(columns: DataFrame, exposed: DataFrame, keys: DataFrame, filters: DataFrame, masked: DataFrame, cap: int = 60) -> DataFrame:
    """(table_name, column_name, scope): allowed, joinOnly, filterOnly or hidden (at most `cap` hidden a table).

    All inputs are (table_name, column_name). A masked column is hidden whatever else it is.
    """
    key = ["table_name", "column_name"]
    flag = lambda df, n: df.select(*key).distinct().withColumn(n, F.lit(True))
    j = columns.select(*key).distinct()
    for df, n in ((masked, "_m"), (exposed, "_e"), (keys, "_k"), (filters, "_f")):
        j = j.join(flag(df, n), key, "left")
    scope = F.when(F.col("_m"), "hidden").when(F.col("_e"), "allowed").when(F.col("_k"), "joinOnly").when(F.col("_f"), "filterOnly").otherwise("hidden")
    out = j.select(*key, scope.alias("scope"))
    return out.where("scope <> 'hidden'").unionByName(top_n(out.where("scope = 'hidden'"), ["table_name"], [F.col("column_name")], cap))


def apply_column_policy(df: DataFrame, scope: Mapping[str, str], twins: Mapping[str, str]) -> DataFrame:
    """Df with allowed and join columns only; a hidden column with a masked twin is replaced by it, under its name."""
    out = []
    for c in df.columns:
        if scope.get(c) in ("allowed", "joinOnly"):
            out.append(F.col(c))
        elif twins.get(c) in df.columns:
            out.append(F.col(twins[c]).alias(c))
    return df.select(*out)


def structural_readable(tables: DataFrame, links: DataFrame, secured: DataFrame, families: DataFrame) -> DataFrame:
    """(table_name, readable, why): tables of a reference family, or without a link to secured data.

    links: (table_name, other) both declared and mined.
    """
    fam = families.select("table_name").distinct().withColumn("_f", F.lit(True))
    near = links.join(secured.select(F.col("table_name").alias("other")).distinct(), "other", "left_semi").select("table_name").distinct().withColumn("_l", F.lit(True))
    sec = secured.select("table_name").distinct().withColumn("_s", F.lit(True))
    j = tables.select("table_name").distinct()
    for p in (fam, near, sec):
        j = j.join(p, "table_name", "left")
    why = F.when(F.col("_s"), "secured").when(F.col("_f"), "family").when(F.col("_l"), "linked").otherwise("free")
    return j.select("table_name", why.isin("family", "free").alias("readable"), why.alias("why"))


def read_instead(requests: DataFrame, readable: DataFrame, n: int = 5) -> DataFrame:
    """(request, candidate): readable tables of the same stem, first n. Both have (table_name)."""
    r = requests.select(F.col("table_name").alias("request"), name_stem(F.col("table_name")).alias("_s")).distinct()
    t = readable.select(F.col("table_name").alias("candidate"), name_stem(F.col("table_name")).alias("_s")).distinct()
    return top_n(r.join(t, "_s").where("request <> candidate"), ["request"], [F.col("candidate")], n).select("request", "candidate")


def candidate_areas(exposure: DataFrame, wanted: Sequence[str], n: int = 10) -> DataFrame:
    """(area, n_facts): areas that expose all wanted tables, by number of fact folders, first n.

    exposure: (area, folder, kind, table_name).
    """
    some = exposure.where(F.col("table_name").isin(list(wanted)))
    full = some.groupBy("area").agg(F.countDistinct("table_name").alias("_t")).where(F.col("_t") == len(set(wanted))).select("area")
    facts = exposure.where("kind = 'fact'").groupBy("area").agg(F.countDistinct("folder").alias("n_facts"))
    return full.join(facts, "area", "left").select("area", F.coalesce("n_facts", F.lit(0)).alias("n_facts")).orderBy(F.desc("n_facts"), "area").limit(n)


def classify_objects(objects: DataFrame, registered: DataFrame, granted: DataFrame, facts: DataFrame, joins: DataFrame, parents: DataFrame, disallowed: DataFrame) -> DataFrame:
    """(name, class): DIRECT, REGISTERED_NO_GRANT, DISALLOWED, VIA_JOIN, VIA_PARENT or UNSECURABLE. All (name)."""
    j = objects.select("name").distinct()
    for k, df in (("_g", granted), ("_r", registered), ("_d", disallowed), ("_f", facts), ("_j", joins), ("_p", parents)):
        j = j.join(df.select("name").distinct().withColumn(k, F.lit(True)), "name", "left")
    cls = F.when(F.col("_g") & (F.col("_r") | F.col("_f")), "DIRECT").when(F.col("_r"), "REGISTERED_NO_GRANT").when(F.col("_d"), "DISALLOWED").when(F.col("_j"), "VIA_JOIN").when(F.col("_p"), "VIA_PARENT").otherwise("UNSECURABLE")
    return j.select("name", cls.alias("class"))


def class_report(classes: DataFrame, by: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """(by, class, n, percent) of classified objects."""
    n = classes.groupBy(*by, "class").agg(F.count("*").alias("n"))
    total = classes.groupBy(*by).agg(F.count("*").alias("_t"))
    j = n.join(total, list(by)) if by else n.crossJoin(F.broadcast(total))
    return j.select(*by, "class", "n", F.round(100 * F.col("n") / F.col("_t"), digits).alias("percent"))


def masked_twins(columns: DataFrame, prefix: str = "MASKED_") -> DataFrame:
    """(table_name, column_name, twin): columns with a sibling of the prefixed name."""
    twins = columns.where(F.startswith("column_name", F.lit(prefix))).select("table_name", F.col("column_name").alias("twin"), F.substr("column_name", F.lit(len(prefix) + 1)).alias("column_name"))
    return columns.select("table_name", "column_name").join(twins, ["table_name", "column_name"])


def upsert_curated(base: DataFrame, pairs: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(merged, conflicts): traced pairs into curated rules; a key with two new values, or whose curated value
    differs, is a conflict and changes nothing."""
    p = pairs.groupBy(key).agg(F.countDistinct(value).alias("_n"), F.min(value).alias("_v"))
    j = base.select(key, value).join(p, key, "full")
    clash = (F.col("_n") > 1) | (F.col(value).isNotNull() & F.col("_v").isNotNull() & (F.col(value) != F.col("_v")))
    clash = F.coalesce(clash, F.lit(False))
    merged = j.where(~clash | F.col(value).isNotNull()).select(key, F.coalesce(value, "_v").alias(value))
    return merged, j.where(clash).select(key, F.col(value).alias("curated"), F.col("_v").alias("traced"))


def map_roles(areas: DataFrame, carried: DataFrame, template: Column) -> DataFrame:
    """(area, role_name, how): the area's code as it is, else by the template, if the instance carries it; else unmapped.

    areas: (area, code); carried: (role_name).
    """
    c = carried.select(F.col("role_name").alias("_r")).distinct()
    a = areas.withColumn("_t", template)
    j = a.join(c, F.col("code") == F.col("_r"), "left").withColumnRenamed("_r", "_direct").join(c, F.col("_t") == F.col("_r"), "left")
    how = F.when(F.col("_direct").isNotNull(), "code").when(F.col("_r").isNotNull(), "template").otherwise("unmapped")
    return j.select("area", F.coalesce("_direct", "_r").alias("role_name"), how.alias("how"))


def decide_access(requests: DataFrame, verdicts: DataFrame, readable: DataFrame) -> DataFrame:
    """(request_id, table_name, area, decision): the first listed area that reads the table; picks of the
    fallback pool are refused; tables that no area reads only as reference data.

    requests: (request_id, table_name, areas array); verdicts: resolve_access; readable: (table_name, readable).
    """
    listed = requests.select("request_id", "table_name", F.posexplode("areas").alias("_o", "area"))
    ok = listed.join(verdicts, ["table_name", "area"]).where("verdict = 'secured' and route <> 'pool'")
    first = pick_first(ok, ["request_id", "table_name"], [F.col("_o")]).select("request_id", "table_name", "area")
    free = readable.where("readable").select("table_name").distinct().withColumn("_free", F.lit(True))
    j = requests.select("request_id", "table_name").distinct().join(first, ["request_id", "table_name"], "left").join(free, "table_name", "left")
    return j.select("request_id", "table_name", "area", F.when(F.col("area").isNotNull(), "secured").when(F.col("_free"), "reference").otherwise("refused").alias("decision"))


def secured_objects(facts: DataFrame, registered: DataFrame, grants: DataFrame) -> DataFrame:
    """(name): objects with a context column, or registered with any grant. All (name)."""
    return facts.select("name").union(registered.select("name").join(grants.select("name"), "name", "left_semi")).distinct()


def access_coverage(verdicts: DataFrame, digits: int = 2) -> DataFrame:
    """(verdict, route, reason, n, percent) over all (table, area) pairs."""
    n = verdicts.groupBy("verdict", "route", "reason").agg(F.count("*").alias("n"))
    total = verdicts.agg(F.count("*").alias("_t"))
    return n.crossJoin(F.broadcast(total)).select("verdict", "route", "reason", "n", F.round(100 * F.col("n") / F.col("_t"), digits).alias("percent"))

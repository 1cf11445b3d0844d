"""Queries of access policies, increments and sources (X, T, S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import picks as W
from ..operators import policy as X
from ..operators import quality as Q
from ..sources import files as S
from ..sources import paged as SP
from ..sources.shared import fresh_path
from ..streaming import incremental as T
from .registry import query, table
from .scalar import _ENT, _TRIM, NORM_SQL
from .standins import duck, view


@query("x01_policy_columns", "WITH g AS (SELECT p_brand AS table_name, 'T' || p_size % 4 AS column_name, list(DISTINCT p_type) a, list(DISTINCT p_type) FILTER (p_name LIKE 'old%') s FROM part GROUP BY 1, 2) SELECT table_name, column_name, CASE WHEN len(a) = 1 THEN a[1] WHEN len(s) = 1 THEN s[1] END AS context, CASE WHEN len(a) = 1 THEN 'single' WHEN len(s) = 1 THEN 'standard' ELSE 'conflict' END AS state FROM g")
def x01(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("table_name"), F.concat(F.lit("T"), F.col("p_size") % 4).alias("column_name"), F.col("p_type").alias("context"), F.when(F.col("p_name").startswith("old"), "STD").otherwise("X").alias("set_code"))
    return X.policy_columns(p, "STD")


@query("x02_final_facts", "SELECT p_partkey AS table_name, p_type AS context, CASE WHEN p_partkey % 3 = 0 THEN 'HIGH' WHEN p_partkey % 5 = 0 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, true AS is_primary, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN 'secured' WHEN p_partkey % 2 = 0 THEN 'ambiguous' ELSE 'disallowed' END AS state FROM part")
def x02(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    c = p.select(k.alias("table_name"), F.lit("C").alias("column_name"), F.col("p_type").alias("context"), F.when(k % 3 == 0, "HIGH").otherwise("LOW").alias("confidence"))
    n = c.select("table_name", "column_name", "context", F.lit(1).alias("n"))
    return X.final_facts(c.unionByName(c.withColumn("confidence", F.lit("LOW"))), n.where("table_name % 5 = 0"), n, c.where("table_name % 2 = 0"), {"SMALL": 1}).drop("column_name")


@query("x03_signature_classes", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n_classes, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderkey) END AS first FROM orders GROUP BY 1")
def x03(spark, d):
    return X.signature_classes(table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("name"), F.col("o_orderpriority").alias("signature")), ["o_custkey"])


@query("x04_curated_choice", "SELECT DISTINCT p_type AS area, p_brand AS entity, p_name AS product, CASE WHEN p_type = 'SMALL' AND p_brand = 'Brand#1' THEN 'c1' WHEN p_type = 'SMALL' THEN 'c2' WHEN p_type LIKE 'ME%' THEN 'c3' WHEN p_name LIKE '%e' THEN NULL END AS choice, CASE WHEN p_type = 'SMALL' OR p_type LIKE 'ME%' THEN 'curated' WHEN p_name LIKE '%e' THEN 'conflict' ELSE 'none' END AS state FROM part")
def x04(spark, d):
    q = table(spark, d, "part").select(F.col("p_type").alias("area"), F.col("p_brand").alias("entity"), F.col("p_name").alias("product"))
    rows = spark.createDataFrame([("SMALL", "Brand#1", "c1", "area"), ("SMALL", None, "c2", "area"), ("ME", None, "c3", "prefix")], "area_or_product string, entity string, choice string, kind string")
    prod = q.where("product like '%e'").select(F.col("product").alias("area_or_product"), F.lit(None).cast("string").alias("entity"), F.explode(F.array(F.lit("c4"), F.lit("c5"))).alias("choice"), F.lit("product").alias("kind")).distinct()
    return X.curated_choice(q, rows.unionByName(prod))


@query("x05_rule_choice", "SELECT p_brand AS area, count(DISTINCT p_size) AS n_classes, CASE WHEN count(DISTINCT p_size) = 1 THEN min(p_name) END AS first FROM part WHERE (p_type = 'SMALL' AND p_name LIKE 'old%') OR (p_type = 'LARGE' AND p_name LIKE 'b%') GROUP BY 1")
def x05(spark, d):
    c = table(spark, d, "part").select(F.col("p_brand").alias("area"), F.col("p_type").alias("product"), F.col("p_name").alias("name"), F.col("p_size").alias("signature"))
    return X.rule_choice(c, {"SMALL": ["old"], "LARGE": ["b"]}, "^generic")


@query("x06_consensus", duck("WITH g AS (SELECT obj_name AS entity, role_name, privilege AS s FROM {grants}), v AS (SELECT DISTINCT entity, role_name FROM g), h AS (SELECT entity, s, count(DISTINCT role_name) h FROM g GROUP BY 1, 2), t AS (SELECT entity, count(*) k, min(s) s FROM h WHERE h = (SELECT max(h) FROM h b WHERE b.entity = h.entity) GROUP BY 1) SELECT entity, CASE WHEN k = 1 THEN s END AS signature, CASE WHEN k = 1 THEN 'majority' ELSE 'undecided' END AS how FROM t"))
def x06(spark, d):
    g = view(spark, d, "grants").select(F.col("obj_name").alias("entity"), "role_name", F.col("privilege").alias("signature"))
    return X.consensus(g, g.select("entity", "role_name").distinct())


@query("x07_pool_choice", "SELECT o_custkey AS entity, min(o_orderkey) AS first FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) = 1")
def x07(spark, d):
    return X.pool_choice(table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("name"), F.col("o_orderstatus").alias("signature")))


@query("x08_role_map_choice", duck("SELECT obj_name AS area, privilege, CASE WHEN bool_or(role_name < 'R13') THEN string_agg(role_name, ',' ORDER BY role_name) FILTER (role_name < 'R13') ELSE string_agg(role_name, ',' ORDER BY role_name) END AS roles, bool_or(role_name < 'R13') AS in_area FROM {grants} GROUP BY 1, 2"))
def x08(spark, d):
    g = view(spark, d, "grants").withColumnRenamed("obj_name", "area")
    out = X.role_map_choice(g, g.where("role_name < 'R13'").select("area", "role_name"))
    return out.withColumn("roles", F.array_join("roles", ","))


@query("x09_choose_context", "SELECT p_partkey AS table_name, CASE p_partkey % 5 WHEN 0 THEN 'traced' WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'A' END AS context, CASE p_partkey % 5 WHEN 0 THEN 'traced' WHEN 1 THEN 'only' WHEN 2 THEN 'evidence' WHEN 3 THEN 'primary' ELSE 'blocked' END AS why FROM part")
def x09(spark, d):
    k = F.col("table_name")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("table_name"))
    row = lambda c, e, prim: F.struct(F.lit(c).alias("context"), e.cast("int").alias("evidence"), F.lit(prim).alias("is_primary"), (k % 5 == 3).alias("audited"))
    facts = p.select("table_name", F.inline(F.array(row("A", F.lit(0), True), row("B", F.when(k % 5 == 2, 3).otherwise(0), False)))).where("table_name % 5 <> 1 or context = 'A'")
    return X.choose_context(facts, p.where("table_name % 5 = 0").select("table_name", F.lit("traced").alias("context")))


def _access(spark, d):
    k = F.col("o_orderkey")
    o = table(spark, d, "orders")
    return o.select(k.alias("table_name"), F.col("o_orderstatus").alias("area"), F.when(k % 11 > 0, True).alias("known"), (k % 7 > 0).alias("has_context"), (k % 5 == 0).alias("sensitive"), (k % 3 == 0).alias("direct"), (k % 2 == 0).alias("reference"), (k % 13 == 0).alias("pool"))


_ACCESS = "SELECT o_orderkey AS table_name, o_orderstatus AS area, CASE WHEN o_orderkey % 11 = 0 THEN 'blocked' WHEN o_orderkey % 7 = 0 THEN 'none' WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 OR o_orderkey % 13 = 0 THEN 'secured' ELSE 'blocked' END AS verdict, CASE WHEN o_orderkey % 11 > 0 AND o_orderkey % 7 > 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'sensitive' WHEN o_orderkey % 3 = 0 THEN 'direct' WHEN o_orderkey % 2 = 0 THEN 'reference' WHEN o_orderkey % 13 = 0 THEN 'pool' END END AS route, CASE WHEN o_orderkey % 11 = 0 THEN 'no facts' WHEN o_orderkey % 7 > 0 AND NOT (o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 OR o_orderkey % 2 = 0 OR o_orderkey % 13 = 0) THEN 'no condition' END AS reason FROM orders"


@query("x10_resolve_access", _ACCESS)
def x10(spark, d):
    return X.resolve_access(_access(spark, d))


@query("x11_combine_all", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def x11(spark, d):
    o, c = table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), table(spark, d, "customer").withColumnRenamed("c_custkey", "k")
    return X.combine_conditions(o, [c.where("c_acctbal > 0"), c.where("c_mktsegment = 'BUILDING'")], "k", "all").select("o_orderkey")


@query("x11_combine_any", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 OR c_mktsegment = 'BUILDING')")
def x11b(spark, d):
    o, c = table(spark, d, "orders").withColumnRenamed("o_custkey", "k"), table(spark, d, "customer").withColumnRenamed("c_custkey", "k")
    return X.combine_conditions(o, [c.where("c_acctbal > 0"), c.where("c_mktsegment = 'BUILDING'")], "k", "any").select("o_orderkey")


@query("x12_apply_row_policy", "SELECT o_orderkey FROM orders WHERE o_custkey % 9 = 0 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def x12(spark, d):
    o = table(spark, d, "orders").withColumn("k", F.when(F.col("o_custkey") % 9 > 0, F.col("o_custkey")))
    keys = table(spark, d, "customer").where("c_nationkey < 5").withColumnRenamed("c_custkey", "k")
    return X.apply_row_policy(o, keys, ["k"], null_passes=True).select("o_orderkey")


@query("x13_column_scope", "SELECT 'T' || l_suppkey AS table_name, 'C' || l_linenumber AS column_name, CASE WHEN l_linenumber = 7 THEN 'hidden' WHEN bool_or(l_returnflag = 'R') THEN 'allowed' WHEN l_linenumber = 1 THEN 'joinOnly' WHEN bool_or(l_discount > 0.08) THEN 'filterOnly' ELSE 'hidden' END AS scope FROM lineitem GROUP BY l_suppkey, l_linenumber")
def x13(spark, d):
    li = table(spark, d, "lineitem").withColumns({"table_name": F.concat(F.lit("T"), "l_suppkey"), "column_name": F.concat(F.lit("C"), "l_linenumber")})
    return X.column_scope(li, li.where("l_returnflag = 'R'"), li.where("l_linenumber = 1"), li.where("l_discount > 0.08"), li.where("l_linenumber = 7"))


@query("x14_apply_column_policy", "SELECT c_custkey, c_mktsegment AS c_name, c_nationkey FROM customer")
def x14(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_mktsegment", "MASKED_c_name")
    return X.apply_column_policy(c, {"c_custkey": "joinOnly", "c_nationkey": "allowed", "c_acctbal": "filterOnly"}, {"c_name": "MASKED_c_name"})


@query("x15_structural_readable", duck("WITH l AS (SELECT DISTINCT from_t AS t FROM {f_joins} WHERE to_t = 'S1') SELECT 'S' || s_suppkey AS table_name, CASE WHEN s_suppkey = 1 THEN false WHEN s_suppkey % 4 = 0 THEN true ELSE t IS NULL END AS readable, CASE WHEN s_suppkey = 1 THEN 'secured' WHEN s_suppkey % 4 = 0 THEN 'family' WHEN t IS NOT NULL THEN 'linked' ELSE 'free' END AS why FROM supplier LEFT JOIN l ON t = 'S' || s_suppkey"))
def x15(spark, d):
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("table_name"), "s_suppkey")
    links = view(spark, d, "f_joins").select(F.col("from_t").alias("table_name"), F.col("to_t").alias("other"))
    return X.structural_readable(s, links, s.where("s_suppkey = 1"), s.where("s_suppkey % 4 = 0"))


@query("x16_read_instead", "SELECT 'AP_' || p_partkey || '_TL' AS request, 'AP_' || p_partkey || '_B' AS candidate FROM part WHERE p_partkey % 2 = 0")
def x16(spark, d):
    name = lambda s: F.concat(F.lit("AP_"), "p_partkey", F.lit(s)).alias("table_name")
    p = table(spark, d, "part")
    return X.read_instead(p.select(name("_TL")), p.where("p_partkey % 2 = 0").select(name("_B")))


@query("x17_candidate_areas", "WITH e AS (SELECT l_suppkey AS area, l_partkey % 4 AS t, l_linenumber AS f, l_returnflag AS k FROM lineitem) SELECT area, count(DISTINCT f) FILTER (k = 'R') AS n_facts FROM e GROUP BY 1 HAVING count(DISTINCT t) FILTER (t IN (0, 1)) = 2 ORDER BY n_facts DESC, area LIMIT 10")
def x17(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("area"), F.col("l_linenumber").alias("folder"), F.when(F.col("l_returnflag") == "R", "fact").otherwise("dimension").alias("kind"), (F.col("l_partkey") % 4).alias("table_name"))
    return X.candidate_areas(e, [0, 1])


_CLS = "SELECT p_partkey AS name, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'DIRECT' WHEN p_partkey % 3 = 0 THEN 'REGISTERED_NO_GRANT' WHEN p_partkey % 5 = 0 THEN 'DISALLOWED' WHEN p_partkey % 7 = 0 THEN 'VIA_JOIN' WHEN p_partkey % 11 = 0 THEN 'VIA_PARENT' ELSE 'UNSECURABLE' END AS class FROM part"


def _classes(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("name"))
    by = lambda n: p.where(f"name % {n} = 0")
    return X.classify_objects(p, by(3), by(2), p.limit(0), by(7), by(11), by(5))


@query("x18_classify_objects", _CLS)
def x18(spark, d):
    return _classes(spark, d)


@query("x19_class_report", f"SELECT class, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM ({_CLS}) GROUP BY 1")
def x19(spark, d):
    return X.class_report(_classes(spark, d))


@query("x20_masked_twins", duck("SELECT table_name, column_name, 'MASKED_' || column_name AS twin FROM {catalog} WHERE ordinal % 2 = 0"))
def x20(spark, d):
    c = view(spark, d, "catalog")
    return X.masked_twins(c.unionByName(c.where("ordinal % 2 = 0").withColumn("column_name", F.concat(F.lit("MASKED_"), "column_name"))))


@query("x21_upsert_curated", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'curated' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 > 0")
def x21(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    pairs = o.unionByName(o.where("k % 3 = 0").withColumn("v", F.lit("other")))
    return X.upsert_curated(o.where("k % 2 = 0").withColumn("v", F.lit("curated")), pairs, "k", "v")[0]


@query("x21_conflicts", "SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def x21b(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    pairs = o.unionByName(o.where("k % 3 = 0").withColumn("v", F.lit("other")))
    return X.upsert_curated(o.where("k % 2 = 0").withColumn("v", F.lit("curated")), pairs, "k", "v")[1].select("k")


@query("x22_map_roles", "SELECT c_custkey AS area, CASE c_custkey % 3 WHEN 0 THEN 'R' || c_custkey WHEN 1 THEN 'R' || c_custkey || '_JOB' END AS role_name, CASE c_custkey % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'template' ELSE 'unmapped' END AS how FROM customer")
def x22(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("area"), F.concat(F.lit("R"), "c_custkey").alias("code"))
    template = F.concat("code", F.lit("_JOB"))
    carried = c.where("area % 3 = 0").select(F.col("code").alias("role_name")).union(c.where("area % 3 = 1").select(template))
    return X.map_roles(c, carried, template)


@query("x23_decide_access", f"WITH v AS ({_ACCESS}) SELECT table_name AS request_id, table_name, CASE WHEN verdict = 'secured' AND route <> 'pool' THEN area END AS area, CASE WHEN verdict = 'secured' AND route <> 'pool' THEN 'secured' WHEN table_name % 4 = 0 THEN 'reference' ELSE 'refused' END AS decision FROM v")
def x23(spark, d):
    v = X.resolve_access(_access(spark, d))
    reqs = v.select(F.col("table_name").alias("request_id"), "table_name", F.array(F.lit("nowhere"), "area").alias("areas"))
    return X.decide_access(reqs, v, v.select("table_name", (F.col("table_name") % 4 == 0).alias("readable")))


@query("x24_secured_objects", "SELECT p_partkey AS name FROM part WHERE p_partkey % 2 = 0 OR (p_partkey % 3 = 0 AND p_partkey % 5 = 0)")
def x24(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("name"))
    return X.secured_objects(p.where("name % 2 = 0"), p.where("name % 3 = 0"), p.where("name % 5 = 0"))


@query("x25_access_coverage", f"SELECT verdict, route, reason, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM ({_ACCESS}) GROUP BY 1, 2, 3")
def x25(spark, d):
    return X.access_coverage(X.resolve_access(_access(spark, d)))


def _staged(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("path"), (F.col("doc_id") % 3).cast("int").alias("idx"))
    empty = spark.createDataFrame([], "id string, refs array<struct<path:string,idx:int>>")
    return docs, T.stage(docs.where("doc_id % 2 = 0"), empty)


_IDS = f"SELECT 'sql:' || sha256({NORM_SQL}) AS id, source || '#' || doc_id % 3 AS ref FROM documents"


@query("t01_stage", f"SELECT id, count(DISTINCT ref) AS n_refs FROM ({_IDS}) GROUP BY 1")
def t01(spark, d):
    docs, base = _staged(spark, d)
    return T.stage(docs, base).select("id", F.size("refs").cast("long").alias("n_refs"))


@query("t01_stage_again", "SELECT CAST(0 AS BIGINT) AS changed")
def t01c(spark, d):
    """Rows that staging the same batch twice would change: none."""
    docs, base = _staged(spark, d)
    once = T.stage(docs, base)
    return T.stage(docs, once).exceptAll(once).agg(F.count("*").alias("changed"))


@query("t02_upsert_source", "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 OR doc_id % 3 > 0 THEN 'd' END AS note FROM documents")
def t02(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    base = docs.select("id", F.sha2("text", 256).alias("hash"), F.lit("d").alias("note"))
    new = docs.where("id % 2 > 0").withColumn("text", F.when(F.col("id") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return T.upsert_source(base, new, ["note"]).select("id", "note")


@query("t03_pending", "SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' ELSE 'undescribed' END AS why FROM documents WHERE doc_id % 4 < 3")
def t03(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    k = F.col("id") % 4
    base = docs.where("id % 4 > 0").select("id", F.when(k == 1, "old").otherwise(F.sha2("text", 256)).alias("hash"), F.when(k != 2, "d").alias("note"))
    return T.pending(docs, base, "note")


@query("t04_plan_vectors", "SELECT doc_id AS owner_id, 0 AS slot, CASE doc_id % 4 WHEN 0 THEN 'compute' WHEN 1 THEN 'delete' WHEN 2 THEN 'keep' ELSE 'compute' END AS action FROM documents")
def t04(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("owner_id"), F.lit(0).alias("slot"), "text")
    stored = docs.where("owner_id % 4 > 0").select("owner_id", "slot", F.md5("text").alias("text_hash"), F.when(F.col("owner_id") % 4 == 3, "old").otherwise("m").alias("model"))
    return T.plan_vectors(docs.where("owner_id % 4 <> 1"), stored, "m")


@query("t05_work_queue", "SELECT doc_id AS id, n_chars AS size FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 > 0 ORDER BY n_chars DESC, doc_id LIMIT 50")
def t05(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 > 0, "d").alias("note"), F.col("n_chars").alias("size"))
    return T.work_queue(rows, rows.where("id % 5 = 0"), "note", "size", 50).select("id", "size")


@query("t05_queue_counts", "SELECT count(*) AS total, count(*) FILTER (doc_id % 3 > 0) AS done, count(*) FILTER (doc_id % 3 = 0) AS pending FROM documents")
def t05b(spark, d):
    return T.queue_counts(table(spark, d, "documents").select(F.when(F.col("doc_id") % 3 > 0, "d").alias("note")), "note")


@query("t06_todo", "SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 1 OR doc_id % 2 = 0")
def t06(spark, d):
    g = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("ghash"))
    j = g.where("id % 3 > 0").select("id", (F.col("id") % 2 > 0).alias("ok"), F.when(F.col("id") % 3 == 1, F.col("ghash")).otherwise("old").alias("ghash"))
    return T.todo(j, g)


@query("t07_cohort", "SELECT o_custkey AS id, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS locality FROM orders GROUP BY 1 HAVING count(*) > 8")
def t07(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list("o_orderpriority").alias("members"))
    return T.cohort(rows, "members", F.size("members") > 8).select("id", "locality")


@query("t08_materialise_new", "SELECT doc_id AS id FROM documents WHERE doc_id % 3 > 0 AND doc_id % 2 > 0")
def t08(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 > 0, F.col("lang")).otherwise("  ").alias("description"))
    return T.materialise_new(rows, rows.where("id % 2 = 0")).select("id")


@query("t10_refresh_sources", "SELECT doc_id AS id, CASE WHEN source = 'src1' THEN doc_id % 2 = 0 ELSE true END AS has_vector FROM documents")
def t10(spark, d):
    base = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "text", F.array(F.lit(1.0)).alias("embedding"))
    seed = base.where("source in ('src1', 'src2')").withColumn("text", F.when(F.col("id") % 2 == 0, F.col("text")).otherwise("new"))
    return T.refresh_sources(base, seed, ["src1"]).select("id", F.col("embedding").isNotNull().alias("has_vector"))


@query("t12_persist_wave", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS note FROM documents")
def t12(spark, d):
    docs = table(spark, d, "documents")
    targets = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(" ").alias("note"))
    return T.persist_wave(targets, docs.select(F.col("doc_id").alias("id"), F.col("source").alias("found")), {"note": "found"})


@query("s02_load_catalog", duck("SELECT table_name, column_name, ordinal % 2 = 0 AS nullable, ordinal FROM {catalog} WHERE kind < 2"))
def s02(spark, d):
    c = view(spark, d, "catalog")
    kind = F.when(F.col("kind") == 0, "table").when(F.col("kind") == 1, "View").otherwise("SYNONYM")
    raw = {"tables": c.select("table_name", kind.alias("table_type")).distinct()}
    raw["columns"] = c.select(F.concat(F.lit(" "), "table_name").alias("table_name"), "column_name", F.when(F.col("ordinal") % 2 == 0, "Y").otherwise("N").alias("nullable"), F.col("ordinal").cast("string").alias("ordinal"))
    return S.load_catalog(raw)["columns"]


@query("s03_load_fkeys", duck("SELECT child, parent, col FROM {fk} WHERE child IN (SELECT table_name FROM {catalog} WHERE kind = 0) OR parent IN (SELECT table_name FROM {catalog} WHERE kind = 0)"))
def s03(spark, d):
    return S.load_fkeys(view(spark, d, "fk"), view(spark, d, "catalog").where("kind = 0").select("table_name"))


@query("s04_load_snapshot", "SELECT event_type, count(*) AS n FROM events WHERE event_id % 7 > 0 GROUP BY 1")
def s04(spark, d):
    e = table(spark, d, "events").withColumn("event_id", F.when(F.col("event_id") % 7 > 0, F.col("event_id")))
    return S.load_snapshot_csv(e, ["event_id", "event_type"], ["event_id"], "event_type")[1]


@query("s05_scan_units", "SELECT CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '#' || i ELSE '' END AS unit_id, CAST(i AS INTEGER) AS idx FROM documents, range(2) t(i) WHERE i = 0 OR doc_id % 2 = 0")
def s05(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array("lang")).alias("texts"))
    return S.scan_units(docs, "id", "texts").select("unit_id", "idx")


def _lines(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("src_file"), F.col("turn").alias("line_no"), F.to_json(F.struct("turn", "role")).alias("line"))
    return c.withColumn("line", F.when(F.col("line_no") % 5 == 4, F.left("line", F.lit(5))).otherwise(F.col("line")))


@query("s06_parse_journal", "SELECT CAST(conv_id AS VARCHAR) AS src_file, turn AS line_no, turn, role FROM conversations WHERE turn % 5 <> 4")
def s06(spark, d):
    return S.parse_journal(_lines(spark, d), "turn long, role string")[0]


@query("s06_bad_lines", "SELECT CAST(conv_id AS VARCHAR) AS src_file, turn AS line_no FROM conversations WHERE turn % 5 = 4")
def s06b(spark, d):
    return S.parse_journal(_lines(spark, d), "turn long, role string")[1].select("src_file", "line_no")


@query("s07_check_pages", "SELECT 'row count' AS problem, '3' AS detail UNION ALL SELECT 'several instances', '2' UNION ALL SELECT 'repeated key', '5' FROM events WHERE event_id = 5")
def s07(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 4 + 1).cast("int").alias("page"), F.when(F.col("event_id") == 7, "b").otherwise("a").alias("instance"), F.col("event_id").alias("k"))
    rows = e.unionByName(e.where("k = 5"))
    counts = rows.groupBy("page").agg(F.count("*").alias("n_rows")).withColumn("n_rows", F.col("n_rows") + F.when(F.col("page") == 3, 1).otherwise(0))
    return S.check_pages(rows, counts, ["k"])


@query("s07_read_numbered_pages", "SELECT CAST(doc_id // 500 + 1 AS INTEGER) AS page, 'a' AS instance, doc_id % 500 AS row_no, doc_id, source, lang, n_chars, md5(text) AS text_md5 FROM documents WHERE doc_id // 500 + 1 >= 2")
def s07_numbered(spark, d):
    """Documents as pages of 500 ids, read again from the second page on."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars", "text", (F.floor(F.col("doc_id") / 500) + 1).cast("int").alias("page"))
    path = fresh_path(spark, "numbered-pages")
    pattern = SP.write_numbered_pages(docs, path, "page", "a")
    schema = "page int, instance string, row_no long, doc_id long, source string, lang string, n_chars long, text string"
    rows = SP.read_numbered_pages(spark, path, schema, pattern=pattern, instance="a").where("page >= 2")
    return rows.withColumn("text_md5", F.md5("text")).drop("text")


@query("s08_flatten_hierarchy", "SELECT r_name AS area, CASE WHEN n_nationkey % 4 > 0 THEN n_name END AS folder, unnest(['a', 'b']) AS col FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 > 0")
def s08(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    f = F.struct(F.when(F.col("n_nationkey") % 4 > 0, F.col("n_name")).alias("name"), F.array(F.lit("a"), F.lit("b")).alias("columns"))
    return S.flatten_hierarchy(n.groupBy(F.col("r_name").alias("area")).agg(F.collect_list(f).alias("folders")))[0].select("area", "folder", F.col("column").alias("col"))


@query("s09_load_lineage", "SELECT CAST(page_id AS VARCHAR) AS k, url AS v, 'sheet' AS source FROM pages WHERE page_id % 3 > 0")
def s09(spark, d):
    q = lambda c: F.concat(F.lit(' "'), c, F.lit('"'))
    p = table(spark, d, "pages").select(F.when(F.col("page_id") % 3 > 0, q(F.col("page_id").cast("string"))).otherwise('" "').alias("k"), q("url").alias("v"))
    return S.load_lineage(p, ["k"], F.lit("sheet"))


@query("s11_export_corpus", "SELECT doc_id, lang FROM documents WHERE source = 'src1'")
def s11(spark, d):
    return S.export_corpus(table(spark, d, "documents").withColumn("embedding", F.array(F.lit(1.0))), "data", "src1").select("doc_id", "lang")


@query("s12_import_corpus", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 6 = 0")
def s12(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return S.import_corpus(e, e.where("id % 3 = 0").withColumn("embedding", F.when(F.col("id") % 2 > 0, F.col("embedding"))))[1]


_P_TEXT = "trim(" + _ENT.format("unnest(regexp_extract_all(html, '(?s)<p(?:\\s[^>]*)?>(.*?)</p>', 1))") + ")"
_CLEAN_A = _TRIM.format(_ENT.format("regexp_extract(block, '(?s)<a(?:\\s[^>]*)?>(.*?)</a>', 1)"))


@query("s15_extract_dataset_texts", f"SELECT DISTINCT path, md5(text) AS text_md5 FROM (SELECT page_id AS path, {_P_TEXT} AS text FROM pages) WHERE regexp_matches(text, '^[A-Z]')")
def s15(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("path"), "html")
    return S.extract_dataset_texts(pages, "path", "html", tag="p", keep="^[A-Z]").select("path", F.md5("text").alias("text_md5"))


@query("s16_extract_blocks", f"SELECT page_id, CAST(i AS INTEGER) AS block_no, CASE WHEN a <> '' AND lower(a) <> 'null' THEN a END AS a, NULL::VARCHAR AS b FROM (SELECT page_id, i, {_CLEAN_A} AS a FROM (SELECT page_id, unnest(blocks) AS block, unnest(range(len(blocks))) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?s)<li(?:\\s[^>]*)?>(.*?)</li>', 1) AS blocks FROM pages)))")
def s16(spark, d):
    return S.extract_blocks(table(spark, d, "pages").select("page_id", "html"), "page_id", "html", "li", ["a", "b"])


@query("s17_load_edges", duck("SELECT child AS from_table, parent AS to_table, col || ', fk' AS evidence, 'a < b' AS predicate FROM {fk} WHERE child <> 'T1'"))
def s17(spark, d):
    f = view(spark, d, "fk")
    e = f.select(F.col("child").alias("from_table"), F.col("col").alias("from_col"), F.when(F.col("child") != "T1", F.col("parent")).alias("to_table"), F.col("col").alias("to_col"), F.array("col", F.lit("fk")).alias("evidence"), F.lit(1).alias("occurrences"), F.lit("HIGH").alias("confidence"), F.lit("a &lt; b").alias("predicate"))
    return S.load_edges(e, "mined").select("from_table", "to_table", "evidence", "predicate")


@query("s18_filter_by_ids", "SELECT doc_id FROM documents WHERE doc_id % 10 = 0")
def s18(spark, d):
    docs = table(spark, d, "documents")
    return S.filter_by_ids(docs, docs.where("doc_id % 10 = 0").select("doc_id").union(docs.select(F.col("doc_id") + 1_000_000)), "doc_id")[0].select("doc_id")


@query("s18_missing_ids", "SELECT doc_id + 1000000 AS doc_id FROM documents")
def s18b(spark, d):
    docs = table(spark, d, "documents")
    return S.filter_by_ids(docs, docs.where("doc_id % 10 = 0").select("doc_id").union(docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"))), "doc_id")[1]


@query("t01_stage_stream", f"SELECT id, count(DISTINCT ref) AS n_refs FROM ({_IDS}) GROUP BY 1")
def t01d(spark, d):
    folder, target = fresh_path(spark, "landing"), fresh_path(spark, "staged")
    docs = table(spark, d, "documents").select("text", F.col("source").alias("path"), (F.col("doc_id") % 3).cast("int").alias("idx"))
    docs.write.json(folder)
    T.stage_stream(spark, folder, "text string, path string, idx int", target, fresh_path(spark, "progress")).awaitTermination()
    return T.read_staged(spark, target).select("id", F.size("refs").cast("long").alias("n_refs"))


@query("t09_t11_ensure_registry", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def t09(spark, d):
    path = fresh_path(spark, "registry")
    o = table(spark, d, "orders")
    T.ensure_registry(spark, path, "1", lambda: o.groupBy("o_orderstatus").agg(F.count("*").alias("n")))
    return T.ensure_registry(spark, path, "1", lambda: o.limit(0))


@query("u10_carry_forward", "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'orders', count(*) FILTER (o_orderstatus = 'F') FROM orders")
def u10(spark, d):
    n, o = table(spark, d, "nation"), table(spark, d, "orders")
    return Q.counts(W.carry_forward({"orders": o.where("o_orderstatus = 'F'")}, {"nation": n, "orders": o}))


@query("u11_prune_sources", "SELECT doc_id FROM documents WHERE source NOT IN ('src1', 'src2') OR doc_id % 2 = 0")
def u11(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return W.prune_sources(docs, docs.where("doc_id % 2 = 0"), ["src1", "src2"], "doc_id", {})[0].select("doc_id")


@query("u11_prune_dependents", "SELECT doc_id, quality FROM labels JOIN documents USING (doc_id) WHERE source NOT IN ('src1', 'src2') OR doc_id % 2 = 0")
def u11b(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return W.prune_sources(docs, docs.where("doc_id % 2 = 0"), ["src1", "src2"], "doc_id", {"labels": table(spark, d, "labels").select("doc_id", "quality")})[1]["labels"]


@query("s01_read_dictionary_csv", "SELECT CAST(c_custkey AS VARCHAR) AS k, c_name || chr(10) || ' \"x\", y' AS name FROM customer")
def s01(spark, d):
    path = fresh_path(spark, "csv")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat("c_name", F.lit('\n "x", y')).alias("name"))
    c.write.csv(path, header=True, escape='"', quoteAll=True)
    return S.read_dictionary_csv(spark, path, ["k", "name"])


@query("s10_write_table", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS v FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0")
def s10(spark, d):
    path = fresh_path(spark, "table")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(0).alias("v"))
    S.write_table(o, path, ["o_orderstatus"])
    S.write_table(o.where("o_orderstatus = 'F' and o_orderkey % 2 = 0").withColumn("v", F.lit(1)), path, ["o_orderstatus"])
    return spark.read.parquet(path).select("o_orderkey", "v")


@query("s13_export_inventory", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1")
def s13(spark, d):
    path = fresh_path(spark, "inventory")
    S.export_inventory(table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")), path, [F.desc("n"), F.col("l_suppkey")], 20)
    return spark.read.schema("l_suppkey long, n long").json(f"{path}/json")


@query("s14_load_with_count", "SELECT count(*) AS n FROM lineitem")
def s14(spark, d):
    path = fresh_path(spark, "loaded")
    S.load_with_count(table(spark, d, "lineitem"), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"))


@query("q06_gate", "SELECT n_name FROM nation")
def q06(spark, d):
    n = table(spark, d, "nation")
    Q.gate(Q.violations({"no name": n.where("n_name is null").select("n_nationkey")}))
    return n.select("n_name")


@query("q10_publish", "SELECT n_nationkey, n_name FROM nation")
def q10(spark, d):
    root = fresh_path(spark, "release")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    Q.publish(spark, {"nation": n}, root, "v1", [n.where("n_name is null").select(F.col("n_nationkey").cast("string").alias("message"))])
    return spark.read.parquet(f"{root}/v1/nation")

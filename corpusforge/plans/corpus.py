"""Queries of the corpus-mining composites (M) over stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls as A
from ..operators import mining as M
from ..operators.aggregates import cooccurrence
from .registry import query, table
from .scalar import NORM_SQL
from .standins import duck, view

_UNITS = f"(SELECT *, sha256({NORM_SQL.replace('text', 'original_sql', 1)}) AS sql_hash FROM {{unit}})"


@query("m01_dedup_units", duck(f"SELECT sql_hash, first(unit_id ORDER BY CASE source WHEN 'src1' THEN 0 WHEN 'src2' THEN 1 ELSE 9 END, title NULLS LAST, unit_id) AS primary_unit_id, first(source ORDER BY CASE source WHEN 'src1' THEN 0 WHEN 'src2' THEN 1 ELSE 9 END, title NULLS LAST, unit_id) AS source, count(*) AS n_units, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, array_to_string(list_sort(list(DISTINCT title)), ',') AS titles FROM {_UNITS} GROUP BY 1"))
def m01(spark, d):
    out = M.dedup_units(view(spark, d, "unit"), view(spark, d, "unit_ref"), {"src1": 0, "src2": 1})
    return out.select("sql_hash", "primary_unit_id", "source", "n_units", F.array_join("sources", ",").alias("sources"), F.array_join("titles", ",").alias("titles"))


@query("m01_unit_reports", duck(f"SELECT sql_hash, count(DISTINCT path || '#' || idx) AS n_reports FROM {_UNITS} JOIN {{unit_ref}} USING (unit_id) GROUP BY 1"))
def m01b(spark, d):
    return M.dedup_units(view(spark, d, "unit"), view(spark, d, "unit_ref"), {}).select("sql_hash", F.size("reports").cast("long").alias("n_reports"))


@query("m02_dedup_exact", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents")
def m02(spark, d):
    return M.dedup_exact(table(spark, d, "documents"), "text", "doc_id")


@query("m02_drop_copies", "SELECT doc_id, source FROM documents QUALIFY doc_id = min(doc_id) OVER (PARTITION BY text)")
def m02b(spark, d):
    docs = table(spark, d, "documents")
    return M.drop_copies(docs.select("doc_id", "source"), M.dedup_exact(docs, "text", "doc_id"), "doc_id")


@query("m03_tag_mentions", "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(upper(text), '[A-Z0-9_]+')) AS name FROM documents) SELECT doc_id, name, false AS after_from FROM w WHERE name IN ('LICENSE', 'WORK', 'VERSION')")
def m03(spark, d):
    return M.tag_mentions(table(spark, d, "documents"), spark.createDataFrame([("license",), ("work",), ("Version",)], "name string"), "doc_id", "text")


#: M4's facts of the stand-in statements, by their shape.
_FACTS = """facts AS (
  SELECT sql_hash, 0 AS seq, NULL AS schema_name, 'PKG_' || c AS package_name, 'F' || k AS function_name, 3 AS arg_count, true AS paren, 'sql' AS found_in, 7 AS pos, 'PKG_' || c || '.F' || k || '(x, ''(k'', g(1,2))' AS snippet, false AS truncated FROM {sql_text} WHERE shape = 0
  UNION ALL SELECT sql_hash, 1, NULL, 'PKG_' || m, 'G', 0, false, 'sql', strpos(text, ', pkg_') + 1, trim(substr(text, strpos(text, ', pkg_') - 38, 47)), false FROM {sql_text} WHERE shape = 0 AND m <> 2
  UNION ALL SELECT sql_hash, 0, 'APP', 'PKG_' || c, 'F' || k, 0, true, 'sql', 13, 'APP.PKG_' || c || ' . F' || k || '( )', false FROM {sql_text} WHERE shape = 1
  UNION ALL SELECT sql_hash, 1, NULL, 'PKG_' || m, 'H', NULL, true, 'sql', strpos(text, ' pkg_'), 'pkg_' || m || '.H(1 from x', true FROM {sql_text} WHERE shape = 1
  UNION ALL SELECT sql_hash, 0, NULL, 'PKG_' || c, 'F', 2, true, 'plsql', strpos(text, 'PKG_') - 1, 'PKG_' || c || '.F(1, q''[,)]'')', false FROM {sql_text} WHERE shape = 2
  UNION ALL SELECT sql_hash, 1, NULL, 'PKG_' || c, 'G' || k, 2, true, 'sql', strpos(text, 'select PKG_') + 6, 'PKG_' || c || '.G' || k || '("a,b", 2)', false FROM {sql_text} WHERE shape = 2
  UNION ALL SELECT sql_hash, 0, NULL, 'PKG_' || c, 'L', 2, true, 'plsql', 6, substr(text, 7, 240), true FROM {sql_text} WHERE shape = 3
  UNION ALL SELECT sql_hash, 1, NULL, 'DBMS_LOB', 'LEN', 0, false, 'plsql', strpos(text, 'dbms_lob') - 1, trim(replace(substr(text, strpos(text, 'dbms_lob') - 40, 52), '  ', ' ')), false FROM {sql_text} WHERE shape = 3)"""


def _facts(spark, d):
    objects, packages = (spark.createDataFrame([(n,)], "name string") for n in ("pkg_2", "other_pkg"))
    return A.call_facts(view(spark, d, "sql_text"), objects, packages, "sql_hash", "text")


@query("m04_call_facts", duck(f"WITH {_FACTS} SELECT * FROM facts"))
def m04(spark, d):
    return _facts(spark, d)


def _calls(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("sql_hash"), F.concat(F.lit("P"), F.col("l_suppkey") % 10, F.lit("_X")).alias("package_name"), F.concat(F.lit("F"), "l_linenumber").alias("function_name"), F.col("l_linenumber").alias("arg_count"))


_KEY = "package_name, function_name"
_INVENTORY = f"""WITH {_FACTS},
modules AS (SELECT 'S' || s_suppkey AS name, 'M' || s_nationkey % 6 AS module FROM supplier UNION ALL SELECT 'DBMS_' || n_name, 'N' || n_regionkey FROM nation WHERE n_nationkey <> 3),
units AS (SELECT l_orderkey AS sql_hash, l_orderkey || '-' || l_linenumber AS unit_id, l_returnflag AS title, l_linestatus AS path FROM lineitem),
once AS (SELECT DISTINCT sql_hash, {_KEY} FROM facts),
base AS (SELECT {_KEY}, count(DISTINCT sql_hash) AS statements FROM facts GROUP BY ALL),
u AS (SELECT {_KEY}, count(DISTINCT unit_id) AS units, count(DISTINCT title) AS titles, count(DISTINCT path) AS reports FROM once JOIN units USING (sql_hash) GROUP BY ALL),
s AS (SELECT {_KEY}, string_agg(o_orderstatus || ':' || n, ',' ORDER BY o_orderstatus) AS by_source FROM (SELECT {_KEY}, o_orderstatus, count(*) AS n FROM once JOIN orders ON o_orderkey = sql_hash GROUP BY ALL) GROUP BY ALL),
a AS (SELECT {_KEY}, string_agg(k || ':' || n, ',' ORDER BY k) AS arg_counts FROM (SELECT {_KEY}, coalesce(arg_count::VARCHAR, '?') AS k, count(*) AS n FROM facts GROUP BY ALL) GROUP BY ALL),
f AS (SELECT {_KEY}, string_agg(k || ':' || n, ',' ORDER BY k) AS found_in FROM (SELECT {_KEY}, found_in AS k, count(*) AS n FROM facts GROUP BY ALL) GROUP BY ALL),
t AS (SELECT {_KEY}, string_agg(table_name || ':' || n, ',' ORDER BY n DESC, table_name) AS top_tables FROM (SELECT {_KEY}, table_name, count(*) AS n FROM once JOIN {{f_tables}} USING (sql_hash) GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY n DESC, table_name) <= 8) GROUP BY ALL),
m AS (SELECT {_KEY}, first(module ORDER BY n DESC, module) AS usage, string_agg(module || ':' || n, ',' ORDER BY n DESC, module) AS top_modules FROM (SELECT {_KEY}, module, count(DISTINCT sql_hash) AS n FROM once JOIN {{f_tables}} USING (sql_hash) JOIN modules ON name = table_name GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY n DESC, module) <= 5) GROUP BY ALL),
p AS (SELECT module AS prefix FROM modules WHERE name LIKE 'DBMS%' GROUP BY 1 ORDER BY count(*) DESC, module LIMIT 1),
x AS (SELECT {_KEY}, string_agg(snippet || '|' || sql_hash || '|' || o_orderstatus || '|' || o_orderpriority, chr(10) ORDER BY r) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY o_custkey % 2 <> 0, o_orderstatus <> 'P', truncated, length(snippet), sql_hash) AS r FROM (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY {_KEY}, sql_hash ORDER BY truncated, length(snippet), pos) = 1) JOIN orders ON o_orderkey = sql_hash QUALIFY r <= 2) GROUP BY ALL)
SELECT CASE WHEN package_name = 'DBMS_LOB' THEN 'oracle' ELSE 'product' END AS api_class, CASE WHEN package_name = 'DBMS_LOB' THEN prefix ELSE usage END AS module, CASE WHEN package_name = 'DBMS_LOB' THEN 'prefix' WHEN usage IS NOT NULL THEN 'usage' END AS module_source, {_KEY}, false AS in_dictionary, statements, coalesce(units, 0) AS units, coalesce(reports, 0) AS reports, coalesce(titles, 0) AS titles, by_source, arg_counts, found_in, top_tables, top_modules, samples
FROM base JOIN s USING ({_KEY}) JOIN a USING ({_KEY}) JOIN f USING ({_KEY}) JOIN x USING ({_KEY}) LEFT JOIN u USING ({_KEY}) LEFT JOIN t USING ({_KEY}) LEFT JOIN m USING ({_KEY}), p"""


@query("m05_api_inventory", duck(_INVENTORY))
def m05(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    corpus = o.select(F.col("o_orderkey").alias("sql_hash"), F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("title"), (F.col("o_custkey") % 2 == 0).alias("described"))
    units = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("unit_id"), F.col("l_orderkey").alias("sql_hash"), F.col("l_returnflag").alias("title"), F.col("l_linestatus").alias("path"))
    modules = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("name"), F.concat(F.lit("M"), F.col("s_nationkey") % 6).alias("module"))
    modules = modules.union(table(spark, d, "nation").where("n_nationkey <> 3").select(F.concat(F.lit("DBMS_"), "n_name"), F.concat(F.lit("N"), "n_regionkey")))
    inv = A.api_inventory(_facts(spark, d), corpus, units, units, view(spark, d, "f_tables"), modules, spark.createDataFrame([("other_pkg",)], "name string"), "P")
    counts = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias(c)
    tops = lambda c, name: F.array_join(F.transform(c, lambda e: F.concat_ws(":", e[name], e["statements"])), ",").alias(c)
    samples = F.array_join(F.transform("samples", lambda e: F.concat_ws("|", e["snippet"], e["sql_hash"], e["source"], e["title"])), "\n").alias("samples")
    return inv.select("api_class", "module", "module_source", "package_name", "function_name", "in_dictionary", "statements", "units", "reports", "titles", counts("by_source"), counts("arg_counts"), counts("found_in"), tops("top_tables", "table_name"), tops("top_modules", "module"), samples)


@query("m06_package_rollup", "WITH c AS (SELECT 'P' || l_suppkey % 10 AS name, count(DISTINCT l_linenumber) AS functions, count(*) AS s FROM lineitem GROUP BY 1) SELECT coalesce(c.name, k.name) AS name, k.name IS NOT NULL AS in_dictionary, coalesce(functions, 0) AS functions FROM c FULL JOIN (VALUES ('P1'), ('P77')) k(name) ON c.name = k.name")
def m06(spark, d):
    calls = _calls(spark, d).withColumn("package_name", F.substring_index("package_name", "_", 1)).groupBy("package_name", "function_name").agg(F.countDistinct("sql_hash").alias("statements"))
    return M.package_rollup(calls, spark.createDataFrame([("P1",), ("P77",)], "name string")).select("name", "in_dictionary", "functions")


_MINED = "SELECT least(from_t, to_t) AS t1, greatest(from_t, to_t) AS t2, count(DISTINCT j.sql_hash) AS occurrences, CASE WHEN count(DISTINCT j.sql_hash) >= 3 THEN 'HIGH' WHEN count(DISTINCT j.sql_hash) = 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, round(count(*) FILTER (join_type = 'LEFT') / count(*), 4) AS outer_share, least(from_t, to_t) = 'S1' AND greatest(from_t, to_t) = 'S2' AS matches_declared FROM {f_joins} j JOIN {corpus} c ON j.sql_hash = c.sql_hash WHERE c.source <> 'P' GROUP BY 1, 2"


@query("m07_mine_relationships", duck(_MINED))
def m07(spark, d):
    names = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"))
    declared = spark.createDataFrame([("S2", "S1", "k")], "child string, parent string, col string")
    mined = M.mine_relationships(view(spark, d, "f_joins"), view(spark, d, "corpus").where("source <> 'P'"), names, declared)
    return mined.select("t1", "t2", "occurrences", "confidence", "outer_share", "matches_declared")


@query("m08_usage_graph", duck("SELECT * FROM (SELECT table_name, sql_hash, score, CAST(row_number() OVER (PARTITION BY table_name ORDER BY score DESC, sql_hash) AS INTEGER) AS rank FROM (SELECT sql_hash, CASE source WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END * 100000 + least(chars, 90000) AS score FROM {corpus}) c JOIN {f_tables} f USING (sql_hash)) WHERE rank <= 60"))
def m08(spark, d):
    return M.usage_graph(view(spark, d, "f_tables"), view(spark, d, "corpus"), {"F": 3, "O": 2}).select("table_name", "sql_hash", "score", "rank")


@query("p14_not_id_literal", "SELECT o_orderkey, NOT (o_orderkey % 2 = 0 AND o_orderkey + 100000 > 99999) AS keep FROM orders")
def p14(spark, d):
    o = table(spark, d, "orders")
    name = F.when(F.col("o_orderkey") % 2 == 0, "cust_id").otherwise("status")
    return o.select("o_orderkey", M.not_id_literal(name, (F.col("o_orderkey") + 100_000).cast("string")).alias("keep"))


@query("m09_predicate_registry", duck("WITH c AS (SELECT table_name, column_name, op, left(literal, 80) AS literal, count(DISTINCT sql_hash) AS occurrences FROM {f_predicates} GROUP BY 1, 2, 3, 4) SELECT *, CASE WHEN (SELECT count(DISTINCT literal) FROM c b WHERE b.table_name = c.table_name) >= 8 THEN 'discriminator' ELSE 'structural' END AS role FROM c"))
def m09(spark, d):
    return M.predicate_registry(view(spark, d, "f_predicates"))


@query("m10_join_column_stats", duck("WITH j AS (SELECT * FROM {f_joins}), e AS (SELECT sql_hash, from_t AS t FROM j UNION ALL SELECT sql_hash, to_t FROM j), n AS (SELECT t, count(DISTINCT sql_hash) n FROM e GROUP BY 1), s AS (SELECT table_name, count(DISTINCT sql_hash) m FROM {f_tables} GROUP BY 1) SELECT t AS table_name, 'K' AS column_name, n, round(n / m, 3) AS share FROM n JOIN s ON t = table_name WHERE n / m >= 0.5"))
def m10(spark, d):
    return M.join_column_stats(view(spark, d, "f_joins"), view(spark, d, "f_tables"), 0.5)


@query("m11_grain_registry", duck("SELECT c.table_name, CASE WHEN d IS NOT NULL THEN 'dated' WHEN k IS NOT NULL THEN 'keyed' ELSE 'ordered' END AS grain, coalesce(d, k, o) AS signal, coalesce(statements, 0) AS statements FROM (SELECT table_name, min(column_name) FILTER (column_name LIKE '%5_DATE') AS d, min(column_name) FILTER (column_name LIKE '%9_KEY') AS k, min(column_name) FILTER (column_name LIKE '%_ORDER') AS o FROM {catalog} GROUP BY 1) c LEFT JOIN (SELECT 'T' || l_suppkey AS table_name, count(DISTINCT l_orderkey) AS statements FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) e ON e.table_name = c.table_name WHERE coalesce(d, k, o) IS NOT NULL"))
def m11(spark, d):
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    evidence = returned.groupBy(F.concat(F.lit("T"), "l_suppkey").alias("table_name")).agg(F.count_distinct("l_orderkey").alias("statements"))
    return M.grain_registry(view(spark, d, "catalog"), {"dated": "5_DATE$", "keyed": "9_KEY$", "ordered": "_ORDER$"}, evidence)


@query("m12_lookup_values", "SELECT o_orderkey AS sql_hash, CASE WHEN o_orderstatus < 'Z' THEN o_orderstatus || ',Z' END AS vals FROM orders")
def m12(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("sql_hash"), F.lit("K").alias("column_name"), F.lit("IN").alias("op"), F.concat(F.lit("'Z', '"), "o_orderstatus", F.lit("' ,'Z'")).alias("literal"))
    return M.lookup_values(p, "K").select("sql_hash", F.array_join("values", ",").alias("vals"))


@query("m13_assemble_rows", duck("SELECT c.sql_hash, c.source, row_number() OVER (ORDER BY c.sql_hash) AS id, (SELECT count(DISTINCT table_name) FROM {f_tables} f WHERE f.sql_hash = c.sql_hash) AS n_tables, p.table_name || '.O_ORDERPRIORITY = ' || p.literal AS filter FROM {corpus} c JOIN {f_predicates} p ON p.sql_hash = c.sql_hash"))
def m13(spark, d):
    rows = M.assemble_rows(view(spark, d, "corpus"), view(spark, d, "f_tables"), view(spark, d, "f_joins"), view(spark, d, "f_predicates"))
    return rows.select("sql_hash", "source", "id", F.coalesce(F.size("tables"), F.lit(0)).cast("long").alias("n_tables"), F.col("filters")[0].alias("filter"))


@query("m14_merge_sources", "WITH a AS (SELECT c_custkey AS k, 'N' || c_nationkey AS r, 0 AS i FROM customer UNION ALL SELECT o_custkey, 'N' || o_custkey % 3, 1 FROM orders) SELECT k, bool_or(i = 0) AS in_c, bool_or(i = 1) AS in_o, count(DISTINCT r) AS n_refs, first(r ORDER BY i, r) AS first_ref FROM a GROUP BY 1")
def m14(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("N"), "c_nationkey").alias("r"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.concat(F.lit("N"), F.col("o_custkey") % 3).alias("r"))
    return M.merge_sources({"c": c, "o": o}, ["k"], "r").select("k", "in_c", "in_o", F.size("refs").cast("long").alias("n_refs"), F.col("refs")[0]["ref"].alias("first_ref"))


@query("m15_inherit_descriptions", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'kind ' || p_type || '; of ' || p_brand ELSE 'kind ' || p_type END AS description, CASE WHEN p_partkey % 2 = 0 THEN 'expression' ELSE 'reference' END AS source FROM part")
def m15(spark, d):
    p = table(spark, d, "part")
    remarks = p.select("p_type").distinct().select(F.concat(F.lit("t"), "p_type").alias("ref"), F.col("p_type").alias("name"), F.concat(F.lit("kind "), "p_type").alias("remark"))
    remarks = remarks.unionByName(p.select("p_brand").distinct().select(F.concat(F.lit("b"), "p_brand").alias("ref"), F.col("p_brand").alias("name"), F.concat(F.lit("of "), "p_brand").alias("remark")))
    remarks = remarks.unionByName(spark.createDataFrame([("junk", "Some_Name", "some name")], "ref string, name string, remark string"))
    e = p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 2 == 0).alias("derived"), F.array(F.lit("junk"), F.concat(F.lit("t"), "p_type"), F.concat(F.lit("b"), "p_brand")).alias("refs"))
    return M.inherit_descriptions(e, remarks)


def _hier(spark, d):
    n, r, c = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "customer")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("area"), F.col("n_name").alias("folder"), F.col("c_name").alias("column"), (F.col("c_acctbal") < -900).alias("is_measure"))


_H = "(SELECT r_name AS area, n_name AS folder, c_acctbal < -900 AS m FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query("m16_rollup_folders", f"SELECT area, folder, count(*) AS n_columns, count(*) FILTER (m) AS n_measures, CASE WHEN bool_or(m) THEN 'fact' ELSE 'dimension' END AS kind FROM {_H} GROUP BY 1, 2")
def m16(spark, d):
    return M.rollup_hierarchy(_hier(spark, d))[0]


@query("m16_rollup_areas", f"SELECT area, count(*) AS n_folders, count(*) FILTER (f) AS n_facts, sum(n)::BIGINT AS n_columns FROM (SELECT area, folder, bool_or(m) AS f, count(*) AS n FROM {_H} GROUP BY 1, 2) GROUP BY 1")
def m16b(spark, d):
    return M.rollup_hierarchy(_hier(spark, d))[1]


@query("m17_dedup_texts", "SELECT md5(text) AS text_hash, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1")
def m17(spark, d):
    return M.dedup_texts(table(spark, d, "documents"), "text", "doc_id")


def _claims(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    claims = o.select(k.alias("sql_hash"), F.when(k % 2 == 0, "missing").otherwise("extra").alias("kind"), F.concat(F.lit("s"), k % 150).alias("table_name"))
    texts = o.select(k.alias("sql_hash"), F.concat(F.lit("select 1 from S"), k % 150, F.lit(", S"), k % 7).alias("text")).where("sql_hash % 3 > 0")
    return claims, view(spark, d, "f_tables"), table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("name")), texts


_VERDICT = "SELECT o_orderkey AS sql_hash, CASE WHEN o_orderkey % 2 = 0 THEN 'missing' ELSE 'extra' END AS kind, 'S' || o_orderkey % 150 AS table_name, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN f.sql_hash IS NOT NULL THEN 'already_there' WHEN s_suppkey IS NOT NULL AND o_orderkey % 3 > 0 THEN 'added' WHEN s_suppkey IS NOT NULL OR o_orderkey % 3 > 0 THEN 'likely' ELSE 'rejected' END ELSE CASE WHEN f.sql_hash IS NULL THEN 'not_there' WHEN o_orderkey % 3 > 0 THEN 'kept' ELSE 'disputed' END END AS verdict FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey % 150 LEFT JOIN {f_tables} f ON f.sql_hash = o_orderkey AND f.table_name = 'S' || o_orderkey % 150"


@query("m18_reconcile", duck(_VERDICT))
def m18(spark, d):
    return M.reconcile(*_claims(spark, d)).select("sql_hash", "kind", "table_name", "verdict")


@query("m18_reconciled_tables", duck(f"WITH v AS ({_VERDICT}) SELECT f.sql_hash, f.table_name, CASE WHEN v.verdict = 'disputed' THEN 'disputed' ELSE 'parser' END AS provenance FROM {{f_tables}} f LEFT JOIN v ON v.sql_hash = f.sql_hash AND v.table_name = f.table_name UNION ALL SELECT sql_hash, table_name, 'model' FROM v WHERE verdict = 'added'"))
def m18b(spark, d):
    claims, facts, names, texts = _claims(spark, d)
    return M.reconciled_tables(facts, M.reconcile(claims, facts, names, texts))


@query("m19_compact_journal", duck("SELECT id, line_no, ok, count(*) OVER (PARTITION BY id) AS n_lines, count(*) FILTER (NOT ok) OVER (PARTITION BY id) AS n_failed FROM (SELECT DISTINCT ON (id, line_no) * FROM {journal} ORDER BY id, line_no, ok DESC) QUALIFY row_number() OVER (PARTITION BY id ORDER BY ok DESC, line_no DESC) = 1"))
def m19(spark, d):
    j = view(spark, d, "journal").groupBy("id", "line_no").agg(F.max("ok").alias("ok"))
    return M.compact_journal(j).select("id", "line_no", "ok", "n_lines", "n_failed")


@query("m20_claims_union", "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id, unnest([role, 'T' || turn % 2]) AS claim FROM conversations")
def m20(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.array("role", F.concat(F.lit("T"), F.col("turn") % 2)).alias("claims"))
    return M.claims_union(c, "claims")


@query("m21_pick_record", "SELECT text_key AS sql_hash, id FROM (SELECT md5(text) AS text_key, doc_id AS id, row_number() OVER (PARTITION BY text ORDER BY (doc_id % 3 = 0) DESC, (doc_id % 2 = 0) DESC, doc_id) r FROM documents) WHERE r = 1")
def m21(spark, d):
    docs = table(spark, d, "documents").select(F.md5("text").alias("sql_hash"), F.col("doc_id").alias("id"), (F.col("doc_id") % 3 == 0).alias("ok"), (F.col("doc_id") % 2 == 0).alias("is_primary"))
    return M.pick_record(docs).select("sql_hash", "id")


@query("m22_promote_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, NULL::VARCHAR AS note, CASE WHEN json_extract(props, '$.k') IS NULL THEN 0 ELSE 1 END AS n_filled FROM events")
def m22(spark, d):
    return M.promote_fields(table(spark, d, "events").select("event_id", "props"), "props", {"k": "int", "note": "string"})


@query("m23_build_grounding", duck("WITH n AS (SELECT DISTINCT table_name, literal AS column_name, 'n' || sql_hash % 50 AS note FROM {f_predicates}), r AS (SELECT *, dense_rank() OVER (PARTITION BY table_name ORDER BY column_name) AS c, row_number() OVER (PARTITION BY table_name ORDER BY column_name, note) AS k FROM n), p AS (SELECT table_name, column_name, list(note ORDER BY note) AS notes FROM r WHERE c <= 24 AND k <= 120 GROUP BY 1, 2), j AS (SELECT table_name, CAST(to_json({'table_name': table_name, 'columns': list({'column_name': column_name, 'notes': notes} ORDER BY column_name)}) AS VARCHAR) AS payload FROM p GROUP BY 1) SELECT *, md5(payload) AS ghash FROM j"))
def m23(spark, d):
    notes = view(spark, d, "f_predicates").select("table_name", F.col("literal").alias("column_name"), F.concat(F.lit("n"), F.col("sql_hash") % 50).alias("note"))
    return M.build_grounding(notes, notes, "table_name")


@query("m24_resolve_labels", "SELECT p_partkey AS sql_hash, p_brand AS column_name, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '.c' ELSE p_brand || '.o' END AS label, CASE WHEN p_partkey % 2 = 0 THEN 'context' ELSE 'owner' END AS how FROM part")
def m24(spark, d):
    p = table(spark, d, "part")
    labels = p.select("p_brand").distinct().select(F.col("p_brand").alias("column_name"), F.inline(F.array(F.struct(F.lit("C").alias("context"), F.concat("p_brand", F.lit(".c")).alias("label")), F.struct(F.lit("O").alias("context"), F.concat("p_brand", F.lit(".o")).alias("label")))))
    columns = p.select(F.col("p_partkey").alias("sql_hash"), F.col("p_brand").alias("column_name"), F.lit("O").alias("owner"))
    return M.resolve_labels(columns, p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("sql_hash"), F.lit("C").alias("context")), labels)


def _exposed(spark, d):
    li = table(spark, d, "lineitem")
    refs = F.array(F.struct(F.concat(F.lit("T"), F.col("l_suppkey") % 5).alias("t"), F.concat(F.lit("C"), "l_linenumber").alias("c"), F.col("l_linestatus").alias("src")))
    return li.select(F.col("l_returnflag").alias("area"), (F.col("l_partkey") % 10).alias("folder"), F.col("l_linenumber").alias("column"), (F.col("l_quantity") > 45).alias("is_expression"), refs.alias("refs"))


_EXP = "(SELECT l_returnflag AS area, l_partkey % 10 AS folder, l_linenumber AS col, 'T' || l_suppkey % 5 AS table_name, 'C' || l_linenumber AS column_name, count(DISTINCT l_linestatus) AS n_sources, bool_or(l_quantity > 45) AS via_expression FROM lineitem GROUP BY 1, 2, 3, 4, 5)"


@query("m25_exposure_index", f"SELECT * FROM {_EXP}")
def m25(spark, d):
    return M.exposure_index(_exposed(spark, d)).select("area", "folder", F.col("column").alias("col"), "table_name", "column_name", F.size("sources").cast("long").alias("n_sources"), "via_expression")


@query("m26_exposure_stats", f"SELECT table_name, column_name, count(DISTINCT area) AS n_areas, count(*) AS n_columns FROM {_EXP} GROUP BY 1, 2")
def m26(spark, d):
    return M.exposure_stats(M.exposure_index(_exposed(spark, d)))


@query("m27_map_areas", "SELECT DISTINCT p_type AS area, CASE p_type WHEN 'SMALL' THEN 'small' WHEN 'LARGE' THEN 'Big Role' END AS role, CASE p_type WHEN 'SMALL' THEN 'name' WHEN 'LARGE' THEN 'alias' ELSE 'unmapped' END AS how FROM part")
def m27(spark, d):
    roles = spark.createDataFrame([("small",), ("Big Role",), ("medium admin",)], "role string")
    return M.map_areas(table(spark, d, "part").select(F.col("p_type").alias("area")), roles, spark.createDataFrame([("LARGE", "big  role")], "area string, alias string"), "(?i)admin")


@query("m28_derive_families", "SELECT p_partkey % 997 AS module, CASE WHEN count(DISTINCT p_type) FILTER (p_size > 45) = 1 THEN min(p_type) FILTER (p_size > 45) WHEN count(DISTINCT p_type) FILTER (p_size > 45) = 0 AND count(DISTINCT p_type) FILTER (p_size <= 45) = 1 THEN min(p_type) END AS family FROM part GROUP BY 1")
def m28(spark, d):
    p = table(spark, d, "part")
    return M.derive_families(p.select((F.col("p_partkey") % 997).alias("module"), F.col("p_type").alias("family"), F.when(F.col("p_size") > 45, "code").otherwise("object").alias("evidence")))


@query("m29_candidates", duck("SELECT table_name, column_name, 'cust' AS context, CASE WHEN column_name = 'C30_KEY' THEN 'name' ELSE 'suffix' END AS how, table_name IN (SELECT table_name FROM {catalog} WHERE kind = 1) AS excluded FROM {catalog} WHERE ends_with(column_name, '0_KEY')"))
def m29(spark, d):
    c = view(spark, d, "catalog")
    return M.candidates(c, [{"context": "cust", "name": "C30_KEY", "suffix": "0_KEY"}], c.where("kind = 1").select("table_name"))


@query("m30_usage_evidence", "WITH b AS (SELECT o_custkey AS k, 'orders' AS b FROM orders UNION ALL SELECT c_custkey, 'customers' FROM customer WHERE c_acctbal > 0) SELECT k, array_to_string(list_sort(list(DISTINCT b)), ',') AS evidence, count(*) AS n, count(DISTINCT b) AS n_sources FROM b GROUP BY 1")
def m30(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return M.usage_evidence({"orders": table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "customers": c}, "k").withColumn("evidence", F.array_join("evidence", ","))


@query("m31_compare_extractions", "WITH x AS (SELECT l_orderkey, l_partkey, bool_or(l_quantity > 10) a, bool_or(l_discount > 0.02) b FROM lineitem GROUP BY 1, 2), p AS (SELECT l_orderkey, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (b AND NOT a) AS gained, count(*) FILTER (a AND NOT b) AS lost FROM x WHERE a OR b GROUP BY 1) SELECT *, CASE WHEN gained = 0 AND lost = 0 THEN 'equal' WHEN lost = 0 THEN 'gain' WHEN gained = 0 THEN 'loss' ELSE 'mixed' END AS verdict FROM p")
def m31(spark, d):
    li = table(spark, d, "lineitem")
    return M.compare_extractions(li.where("l_quantity > 10"), li.where("l_discount > 0.02"), "l_orderkey", "l_partkey")


@query("m32_suspect_text", "SELECT doc_id, regexp_matches(text, ',\\s*$') AS trailing_comma, regexp_matches(text, '(--|/\\*)[^\\n]*(rest|remaining|omitted|etc)', 'i') AS elided, NOT regexp_matches(text, '\\bfrom\\b', 'i') AS no_from, contains(text, '...') OR contains(text, '…') AS ellipsis FROM documents")
def m32(spark, d):
    return M.suspect_text(table(spark, d, "documents").select("doc_id", "text"), "text").drop("text")


@query("m33_coverage_gate", "SELECT 'P' || l_partkey * 3 // 2 AS name, count(DISTINCT l_orderkey) AS n, CASE WHEN any_value(p_partkey) IS NULL THEN 'missing' WHEN any_value(p_size) > 25 THEN 'described' ELSE 'exists' END AS state FROM lineitem LEFT JOIN part ON p_partkey = l_partkey * 3 // 2 GROUP BY 1")
def m33(spark, d):
    refs = table(spark, d, "lineitem").select(F.concat(F.lit("P"), F.expr("l_partkey * 3 div 2")).alias("name"), F.col("l_orderkey").alias("sql_hash"))
    p = table(spark, d, "part")
    return M.coverage_gate(refs, p.select(F.concat(F.lit("P"), "p_partkey").alias("name"), F.when(F.col("p_size") > 25, "a remark").otherwise("").alias("remark")))


@query("m34_ab_compare", "SELECT doc_id // 10 AS canonical, round(avg(quality), 4) AS old_avg, round(avg(toxic), 4) AS new_avg, round(round(avg(toxic), 4) - round(avg(quality), 4), 4) AS change FROM labels GROUP BY 1")
def m34(spark, d):
    lab = table(spark, d, "labels")
    canon = lab.select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 10).alias("canonical"))
    return M.ab_compare(lab.select(F.col("doc_id").alias("id"), F.col("quality").alias("m")), lab.select(F.col("doc_id").alias("id"), F.col("toxic").alias("m")), canon, "m")


@query("m35_validate_records", duck("SELECT o_orderkey AS sql_hash, CASE WHEN EXISTS (SELECT 1 FROM {f_tables} f WHERE f.sql_hash = o_orderkey AND f.table_name = 'S1') THEN '' ELSE 'S1' END AS unknown, o_custkey % 2 = 0 OR NOT EXISTS (SELECT 1 FROM {f_tables} f WHERE f.sql_hash = o_orderkey AND f.table_name = 'S1') AS review FROM orders"))
def m35(spark, d):
    o = table(spark, d, "orders")
    recs = o.select(F.col("o_orderkey").alias("sql_hash"), F.when(F.col("o_custkey") % 2 == 0, "short").otherwise("a description of some length").alias("description"), F.array(F.lit("S1")).alias("names"), F.array().cast("array<int>").alias("seqs"))
    facts = view(spark, d, "f_tables").withColumn("seq", F.lit(0))
    return M.validate_records(recs, facts).select("sql_hash", F.array_join("unknown_names", ",").alias("unknown"), "review")


@query("m36_merge_config", "SELECT user_id AS k, CASE WHEN user_id % 2 = 0 THEN 'new' ELSE 'old' END AS label, user_id % 3 AS anchor FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 5 > 0 OR (user_id % 2 = 0 AND user_id % 3 > 0))")
def m36(spark, d):
    u = table(spark, d, "events").select(F.col("user_id").alias("k")).distinct()
    base = u.where("k % 5 > 0").select("k", F.lit("old").alias("label"), (F.col("k") % 3).alias("anchor"))
    fields = u.where("k % 2 = 0").select("k", F.lit("new").alias("label"), F.when(F.col("k") % 3 > 0, F.col("k") % 3).alias("anchor"))
    return M.merge_config(base, fields, ["k"], "anchor")


@query("m37_table_dossier", duck("WITH r AS (SELECT DISTINCT 'C' || o_custkey % 60 AS name FROM orders), c AS (SELECT table_name, count(*) n FROM {f_predicates} GROUP BY 1) SELECT name, n IS NOT NULL AS \"exists\", CASE WHEN n IS NOT NULL THEN 'O_ORDERPRIORITY' END AS filters FROM r LEFT JOIN c ON table_name = name"))
def m37(spark, d):
    preds = view(spark, d, "f_predicates")
    reqs = table(spark, d, "orders").select(F.concat(F.lit("C"), F.col("o_custkey") % 60).alias("name"))
    out = M.table_dossier(reqs, preds.select(F.col("table_name").alias("name")), M.predicate_registry(preds), M.join_column_stats(view(spark, d, "f_joins"), view(spark, d, "f_tables")))
    return out.select("name", "exists", F.array_join("filters", ",").alias("filters"))


@query("m38_evidence_pack", duck("WITH p AS (SELECT a.table_name AS name, b.table_name AS o, count(*) n FROM {f_tables} a JOIN {f_tables} b ON a.sql_hash = b.sql_hash AND a.table_name <> b.table_name WHERE a.table_name IN ('S1', 'S2', 'S3') GROUP BY 1, 2) SELECT name, string_agg(o, ',' ORDER BY o) AS co_used FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, o) <= 5) GROUP BY 1"))
def m38(spark, d):
    reqs = spark.createDataFrame([("S1",), ("S2",), ("S3",)], "name string")
    return M.evidence_pack(reqs, view(spark, d, "f_tables"), view(spark, d, "f_joins")).select("name", F.array_join("co_used", ",").alias("co_used"))


@query("m39_ship_inventory", "WITH e AS (SELECT DISTINCT l_orderkey k, l_suppkey e FROM lineitem), t AS (SELECT DISTINCT l_orderkey k, l_partkey % 50 t FROM lineitem), s AS (SELECT e, count(*) c FROM e GROUP BY 1) SELECT e.e AS entity, t.t AS table_name, count(*) AS n FROM e JOIN t USING (k) JOIN s ON s.e = e.e WHERE e.e % 2 = 0 AND t.t IN (SELECT p_size FROM part) GROUP BY 1, 2 HAVING count(*) >= 45 OR count(*) / any_value(c) >= 0.09")
def m39(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("entity"), (F.col("l_partkey") % 50).alias("table_name"))
    pairs = cooccurrence(li, li, "entity", "table_name", "l_orderkey", 9)
    inv = li.select("entity").distinct().withColumn("class", F.when(F.col("entity") % 2 == 0, "own").otherwise("vendor"))
    return M.ship_inventory(inv, pairs, table(spark, d, "part").select(F.col("p_size").alias("table_name")), ["own"], 45, 0.09)[1].select("entity", "table_name", "n")


@query("m40_title_aliases", duck(f"SELECT DISTINCT title, sql_hash FROM {_UNITS}"))
def m40(spark, d):
    from ..functions.columns import content_hash

    units = view(spark, d, "unit").withColumn("sql_hash", content_hash(F.col("original_sql")))
    return M.title_aliases(units, units.select("sql_hash").distinct())


@query("m41_carry_over", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang END AS note, CASE WHEN doc_id % 3 = 0 THEN 'carried' ELSE 'new' END AS state FROM documents")
def m41(spark, d):
    docs = table(spark, d, "documents")
    return M.carry_over(docs.select("doc_id"), docs.where("doc_id % 3 = 0").select("doc_id", F.col("lang").alias("note")), "doc_id", ["note"])


@query("m42_precedents", "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(upper(text), '[A-Z0-9_]+')) AS c FROM documents) SELECT source AS table_name, c AS column_name, count(*) AS n FROM w JOIN documents USING (doc_id) WHERE c IN ('LICENSE', 'WORK') GROUP BY 1, 2")
def m42(spark, d):
    docs = table(spark, d, "documents")
    return M.precedents(docs.select(F.col("doc_id").alias("sql_hash"), "text"), docs.select(F.col("doc_id").alias("sql_hash"), F.col("source").alias("table_name")), ["license", "work"], "text")


@query("m43_join_evidence", duck("WITH e AS (SELECT sql_hash, from_t AS t, to_t AS o FROM {f_joins} UNION ALL SELECT sql_hash, to_t, from_t FROM {f_joins}) SELECT t AS table_name, 'K' AS column_name, CASE WHEN o = 'S1' THEN 'one' ELSE 'two' END AS context, count(DISTINCT sql_hash) AS n FROM e WHERE o IN ('S1', 'S2', 'S3') GROUP BY 1, 2, 3"))
def m43(spark, d):
    ctx = spark.createDataFrame([("one", "S1"), ("two", "S2"), ("two", "S3")], "context string, evidence string")
    return M.join_evidence(view(spark, d, "f_joins"), ctx)


@query("m44_error_families", "SELECT CASE WHEN event_id % 5 = 0 THEN 'none' WHEN event_id % 5 = 1 THEN 'E-' || user_id % 10 ELSE event_type END AS family, count(*) AS n FROM events GROUP BY 1")
def m44(spark, d):
    k = F.col("event_id") % 5
    e = table(spark, d, "events").select(F.when(k == 0, None).when(k == 1, F.concat(F.lit("failed [E-"), F.col("user_id") % 10, F.lit("] at x"))).otherwise(F.col("event_type")).alias("error"))
    return M.error_families(e, "error")


@query("m45_gap_estimate", "SELECT count(*) AS gaps, count(DISTINCT source) AS names, count(DISTINCT source || lang) AS by_expression, count(DISTINCT source) AS by_ref FROM documents WHERE doc_id % 3 = 0")
def m45(spark, d):
    docs = table(spark, d, "documents").where("doc_id % 3 = 0").withColumn("ref", F.lit(None).cast("string"))
    return M.gap_estimate(docs, "source", "lang", "ref")

"""Queries of lookups and gates (P, Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup as P
from ..operators import quality as Q
from ..sources import content_tree
from ..sources.shared import fresh_path
from .registry import query, table
from .standins import duck, view

@query("p01_validate_names", "WITH n AS (SELECT DISTINCT upper(p_name) AS x FROM part), r AS (SELECT DISTINCT p_name || CASE WHEN p_partkey % 3 = 0 THEN 'zz' ELSE '' END AS request FROM part), q AS (SELECT request, upper(request) AS name, upper(request) IN (SELECT x FROM n) AS \"exists\" FROM r), s AS (SELECT request, x, CASE WHEN contains(x, name) OR contains(name, x) THEN abs(length(x) - length(name)) * 0.5 WHEN levenshtein(name, x) <= greatest(2, length(name) // 3) THEN levenshtein(name, x) + 5 END AS score FROM q, n WHERE NOT \"exists\"), t AS (SELECT request, x, row_number() OVER (PARTITION BY request ORDER BY score, x) AS k FROM s WHERE score IS NOT NULL QUALIFY k <= 5) SELECT q.request, name, \"exists\", string_agg(x, '|' ORDER BY k) AS suggestions FROM q LEFT JOIN t ON q.request = t.request GROUP BY ALL")
def p01(spark, d):
    p = table(spark, d, "part")
    reqs = p.select(F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, "zz").otherwise("")).alias("request"))
    out = P.validate_names(reqs, p.select(F.upper("p_name").alias("name")))
    return out.select("request", "name", "exists", F.array_join("suggestions", "|").alias("suggestions"))


@query("p02_validate_columns", duck("WITH r AS (SELECT DISTINCT 'T' || o_custkey % 400 AS table_name, 'C' || o_orderkey % 210 || '_KEY' AS column_name FROM orders) SELECT *, CASE WHEN table_name NOT IN (SELECT table_name FROM {catalog}) THEN 'unknown_table' WHEN (table_name, column_name) NOT IN (SELECT (table_name, column_name) FROM {catalog}) THEN 'unknown_column' ELSE 'ok' END AS state FROM r"))
def p02(spark, d):
    reqs = table(spark, d, "orders").select(F.concat(F.lit(" t"), F.col("o_custkey") % 400).alias("table_name"), F.concat(F.lit("c"), F.col("o_orderkey") % 210, F.lit("_key ")).alias("column_name"))
    return P.validate_columns(reqs, view(spark, d, "catalog"))


@query("p03_object_cards", duck("SELECT table_name, string_agg(column_name, ',' ORDER BY ordinal DESC) FILTER (ordinal <= 2) AS pkey, count(*) AS n_columns FROM {catalog} GROUP BY 1"))
def p03(spark, d):
    cols = view(spark, d, "catalog")
    keys = cols.where("ordinal <= 2").select("table_name", "column_name", (3 - F.col("ordinal")).alias("seq"))
    return P.object_cards(cols.select("table_name").distinct(), keys, cols).withColumn("pkey", F.array_join("pkey", ","))


@query("p04_list_columns", duck("SELECT table_name, column_name, total FROM (SELECT *, count(*) OVER (PARTITION BY table_name) AS total, row_number() OVER (PARTITION BY table_name ORDER BY ordinal) r FROM {catalog} WHERE column_name LIKE '%KEY%') WHERE r <= 12"))
def p04(spark, d):
    return P.list_columns(view(spark, d, "catalog"), "key", 12).select("table_name", "column_name", "total")


@query("p05_list_indexes", "SELECT 'L' || l_suppkey AS table_name, 'I' || l_linenumber AS index_name, string_agg(c, ',' ORDER BY l_partkey, c) AS columns FROM (SELECT DISTINCT l_suppkey, l_linenumber, l_partkey, 'C' || l_partkey AS c FROM lineitem) GROUP BY 1, 2")
def p05(spark, d):
    idx = table(spark, d, "lineitem").select(F.concat(F.lit("L"), "l_suppkey").alias("table_name"), F.concat(F.lit("I"), "l_linenumber").alias("index_name"), F.lit(True).alias("is_unique"), F.col("l_partkey").alias("ordinal"), F.concat(F.lit("C"), "l_partkey").alias("column_name")).distinct()
    return P.list_indexes(idx).select("table_name", "index_name", F.array_join("columns", ",").alias("columns"))


@query("p06_overlay_rules", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 9 ELSE quality END AS quality, doc_id % 4 = 0 AS curated FROM labels")
def p06(spark, d):
    lab = table(spark, d, "labels").select("doc_id", "quality")
    rule = lambda q, on, v: lab.where("doc_id % 4 = 0").select("doc_id", F.lit(q).alias("quality"), F.lit(on).alias("enabled"), F.lit(v).alias("version"))
    return P.overlay_rules(lab, rule(7, True, 1).unionByName(rule(9, True, 2)).unionByName(rule(5, False, 3)), "doc_id", "quality")


@query("p07_lookup_text", "SELECT source AS request, CAST(doc_id AS VARCHAR) AS id, n_chars AS chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, CAST(doc_id AS VARCHAR)) = 1 UNION ALL SELECT CAST(doc_id AS VARCHAR), CAST(doc_id AS VARCHAR), n_chars FROM documents")
def p07(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("n_chars").alias("chars"))
    reqs = docs.select(F.col("title").alias("request")).unionByName(docs.select(F.col("id").alias("request")))
    return P.lookup_text(reqs, docs.withColumn("title", F.when(F.col("id") < "5", F.col("title"))), docs.select("title", "id"))


@query("p08_siblings", "SELECT source AS request, doc_id AS id, n_chars AS chars, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents WHERE source IN ('src1', 'src2')")
def p08(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("n_chars").alias("chars"))
    return P.siblings(spark.createDataFrame([("src1",), ("src2",)], "request string"), docs)


@query("p09_list_by_prefix", duck("SELECT 'en' AS request, title FROM (SELECT DISTINCT title FROM {unit}) WHERE title LIKE 'en.%' UNION ALL SELECT 'd', title FROM (SELECT DISTINCT title FROM {unit}) WHERE title LIKE 'd%'"))
def p09(spark, d):
    return P.list_by_prefix(spark.createDataFrame([("en",), ("d",)], "request string"), view(spark, d, "unit").select("title"))


@query("p10_near_titles", duck("SELECT request, title FROM (VALUES ('src1'), ('.src'), ('n.s')) r(request), (SELECT DISTINCT title FROM {unit}) WHERE contains(title, request) QUALIFY row_number() OVER (PARTITION BY request ORDER BY title) <= 8"))
def p10(spark, d):
    return P.near_titles(spark.createDataFrame([("src1",), (".SRC",), ("n.s",)], "request string"), view(spark, d, "unit")).withColumn("request", F.lower("request"))


@query("p11_search_like", "SELECT p_partkey, p_name FROM part WHERE contains(upper(p_name), 'OLD') AND contains(upper(p_name), 'P') ORDER BY p_partkey LIMIT 50")
def p11(spark, d):
    return P.search_like(table(spark, d, "part"), "p_name", ["old", "p"], [F.col("p_partkey")], 50).select("p_partkey", "p_name")


@query("p12_search_snapshot", "SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' AND contains(props, '1') AND contains(props, 'k') GROUP BY 1")
def p12(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "props")
    out = P.search_snapshot(e, {"event_type": "click", "event_id": None}, ["props"], hints=["k", "1"], by="user_id", limit=None)
    return out.select("user_id", F.size("rows").cast("long").alias("n"))


@query("f28_longest_prefixes", "WITH n AS (SELECT DISTINCT left(p_type, p_size % 9 + 2) AS name FROM part) SELECT p_partkey, arg_max(name, length(name)) AS entry FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '' END || p_type AS t FROM part) LEFT JOIN n ON starts_with(t, name) GROUP BY 1")
def f28b(spark, d):
    p = table(spark, d, "part")
    texts = p.select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(""), "p_type").alias("t"))
    return P.longest_prefixes(texts, "t", p.select(F.left("p_type", (F.col("p_size") % 9 + 2).cast("int")).alias("name"))).select("p_partkey", "entry")


@query("p13_drop_artifacts", "SELECT p_partkey FROM part WHERE p_partkey % 4 > 0")
def p13(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.when(k % 8 == 0, "dual").when(k % 4 == 0, F.concat(F.lit("SAWITH"), k)).otherwise(F.col("p_name")).alias("name"))
    return P.drop_artifacts(p, "name").select("p_partkey")


@query("p15_classify_first", "SELECT doc_id, CASE WHEN regexp_matches(text, '!!') THEN 'shout' WHEN contains(text, '|') THEN 'table' ELSE 'prose' END AS label FROM documents")
def p15(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", P.classify_first([("shout", t.rlike("!!")), ("table", F.contains(t, F.lit("|")))], "prose").alias("label"))


@query("p16_classify_names", "SELECT DISTINCT p_name AS name, CASE WHEN p_name LIKE 'old%' THEN 'vendor' WHEN p_name LIKE '%e' THEN 'known' ELSE 'unknown' END AS class, p_name LIKE '%e' AS in_dictionary FROM part")
def p16(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name"))
    return P.classify_names(names, [("vendor", "^old")], names.where("name like '%e'"))


@query("p17_ship_scope", "SELECT doc_id, (lang = 'en' OR source = 'src1') AND source <> 'src2' AS ships FROM documents")
def p17(spark, d):
    return table(spark, d, "documents").select("doc_id", P.ship_scope(F.col("lang") == "en", F.col("source") == "src1", F.col("source"), "^src2$").alias("ships"))


@query("p18_gap_cause", "SELECT doc_id, CASE WHEN quality IS NULL THEN 'no_label' WHEN toxic = 1 THEN 'toxic' WHEN n_chars < 200 THEN 'short' ELSE 'none' END AS cause FROM documents LEFT JOIN labels USING (doc_id)")
def p18(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", P.classify_first([("no_label", F.col("quality").isNull()), ("toxic", F.col("toxic") == 1), ("short", F.col("n_chars") < 200)], "none").alias("cause"))


def _arrays(spark, d):
    cols = view(spark, d, "catalog")
    return cols.groupBy("table_name").agg(F.sort_array(F.collect_list("column_name")).alias("columns"))


@query("p19_family_match", duck("SELECT * FROM (SELECT table_name, CASE WHEN bool_or(column_name = 'C30_KEY') AND bool_or(column_name = 'C61_ORDER') THEN 'order' WHEN table_name LIKE '%7' THEN 'place' WHEN bool_or(column_name IN ('C90_KEY', 'X')) THEN 'keyed' END AS family FROM {catalog} GROUP BY 1) WHERE family IS NOT NULL"))
def p19(spark, d):
    return P.family_match(_arrays(spark, d), [{"family": "order", "all": ["C30_KEY", "C61_ORDER"]}, {"family": "place", "name": "7$"}, {"family": "keyed", "any": ["C90_KEY", "X"]}])


@query("p20_family_translation", duck("SELECT table_name || '_TL' AS table_name, table_name AS base_table, CAST(count(*) AS INTEGER) AS shared FROM {catalog} GROUP BY table_name"))
def p20(spark, d):
    a = _arrays(spark, d)
    return P.family_translation(a.unionByName(a.withColumn("table_name", F.concat("table_name", F.lit("_TL")))))


@query("p21_violations", "SELECT 'negative' AS \"check\", 'negative: {\"c_custkey\":' || c_custkey || '}' AS message FROM customer WHERE c_acctbal < -900 UNION ALL SELECT 'name', 'name: {\"n_name\":\"' || n_name || '\"}' FROM nation WHERE n_regionkey = 0")
def p21(spark, d):
    return Q.violations({"negative": table(spark, d, "customer").where("c_acctbal < -900").select("c_custkey"), "name": table(spark, d, "nation").where("n_regionkey = 0").select("n_name")})


@query("p22_list_usages", duck("SELECT table_name AS name, sql_hash, CAST(row_number() OVER (PARTITION BY table_name ORDER BY sql_hash DESC) AS INTEGER) AS rank, count(*) OVER (PARTITION BY table_name) AS total, CASE WHEN sql_hash % 2 = 0 THEN 'short' END AS text FROM {f_tables} WHERE table_name IN ('S1', 'S5') QUALIFY rank <= 5"))
def p22(spark, d):
    f = view(spark, d, "f_tables")
    texts = f.select("sql_hash").distinct().withColumn("text", F.when(F.col("sql_hash") % 2 == 0, "short").otherwise("a longer text"))
    return P.list_usages(spark.createDataFrame([("S1",), ("S5",)], "name string"), f.withColumn("score", F.col("sql_hash")), texts, 5, 5)


@query("p23_list_predicates", duck("SELECT table_name AS name, literal, count(*) AS occurrences FROM {f_predicates} WHERE table_name IN ('C1', 'C2') GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY count(*) DESC, literal) <= 3"))
def p23(spark, d):
    from ..operators.aggregates import literal_roles

    return P.list_predicates(spark.createDataFrame([("C1",), ("C2",)], "name string"), literal_roles(view(spark, d, "f_predicates")), 3).select("name", "literal", "occurrences")


@query("p24_list_apis", "SELECT 'T' || l_partkey % 20 AS name, l_suppkey AS entity, count(*) AS n FROM lineitem WHERE l_partkey % 20 < 5 GROUP BY 1, 2 HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, entity) <= 5")
def p24(spark, d):
    pairs = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("entity"), F.concat(F.lit("T"), F.col("l_partkey") % 20).alias("table_name")).agg(F.count("*").alias("n"))
    return P.list_apis(spark.createDataFrame([(f"T{i}",) for i in range(5)], "name string"), pairs)


@query("p25_describe_hierarchy", "SELECT r_name AS area, string_agg(n_name, ',' ORDER BY n_name) FILTER (n_nationkey % 2 = 0) AS facts, count(*) AS n_folders FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def p25(spark, d):
    f = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("area"), F.col("n_name").alias("folder"), F.when(F.col("n_nationkey") % 2 == 0, "fact").otherwise("dimension").alias("kind"))
    out = P.describe_hierarchy(table(spark, d, "region").select(F.col("r_name").alias("area")), f)
    return out.select("area", F.when(F.size("facts") > 0, F.array_join("facts", ",")).alias("facts"), "n_folders")


@query("p26_exclusion_class", "SELECT p_partkey, CASE WHEN p_name LIKE 'old%' THEN 'name' WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'listed' ELSE 'kept' END AS class FROM part")
def p26(spark, d):
    rules = [("name", F.col("p_name").rlike("^old")), ("listed", F.col("p_brand").isin("Brand#1", "Brand#2"))]
    return table(spark, d, "part").select("p_partkey", P.classify_first(rules, "kept").alias("class"))


@query("p27_package_cards", "SELECT 'AP_INV_' || n AS request, n < 10 AS \"exists\", CASE WHEN n < 10 AND n % 2 = 0 THEN 'F' END AS functions, CASE WHEN n >= 10 THEN 'AP_INV_0' END AS near, CASE WHEN n < 10 AND n % 2 > 0 THEN 'never called' END AS note FROM (SELECT DISTINCT l_linenumber + 5 AS n FROM lineitem)")
def p27(spark, d):
    n = table(spark, d, "lineitem").select((F.col("l_linenumber") + 5).alias("n")).distinct()
    name = lambda c: F.concat(F.lit("AP_INV_"), c)
    known = spark.range(10)
    packages = known.select(name("id").alias("name"), F.lit("own").alias("class"))
    out = P.package_cards(n.select(F.lower(name("n")).alias("request")), packages, known.where("id % 2 = 0").select(name("id").alias("package_name"), F.lit("F").alias("function_name")))
    return out.select("request", "exists", F.array_join("functions", ",").alias("functions"), F.col("near")[0].alias("near"), "note")


@query("q01_compare_counts", "SELECT 'nation' AS name, (SELECT count(*) FROM nation) AS built, (SELECT count(*) FROM nation) AS previous, CAST(25 AS BIGINT) AS expected, 'same' AS state UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_orderstatus = 'F'), NULL, 'changed'")
def q01(spark, d):
    n, o = table(spark, d, "nation"), table(spark, d, "orders")
    return Q.compare_counts({"nation": n, "orders": o}, {"nation": n, "orders": o.where("o_orderstatus = 'F'")}, {"nation": 25})


@query("q02_compare_content", "SELECT 'orders' AS name, count(*) FILTER (o_orderkey % 3 = 0) AS only_built, count(*) FILTER (o_orderkey % 5 = 0) AS only_previous FROM orders WHERE (o_orderkey % 3 = 0) <> (o_orderkey % 5 = 0)")
def q02(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return Q.compare_content({"orders": o.where("o_orderkey % 3 = 0")}, {"orders": o.where("o_orderkey % 5 = 0")})


_BUILT = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 1000 <> 0"
_PREVIOUS = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 777 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders"


def _releases(spark, d):
    """Paths of two stored releases of orders that differ in few keys."""
    built, previous = fresh_path(spark, "built"), fresh_path(spark, "previous")
    orders = table(spark, d, "orders")
    for sql, path in ((_BUILT, built), (_PREVIOUS, previous)):
        content_tree.save_release(spark.sql(sql.replace("FROM orders", "FROM {orders}"), orders=orders), path, ["o_orderkey"], leaves=256, fanout=16)
    return built, previous


@query("q02_compare_releases", f"SELECT 'orders' AS name, (SELECT count(*) FROM ({_BUILT} EXCEPT ALL {_PREVIOUS})) AS only_built, (SELECT count(*) FROM ({_PREVIOUS} EXCEPT ALL {_BUILT})) AS only_previous")
def q02_stored(spark, d):
    return content_tree.compare_releases(spark, {"orders": _releases(spark, d)})


@query("u03_diff_releases", f"SELECT *, 'a' AS side, CAST(1 AS BIGINT) AS n FROM ({_BUILT} EXCEPT ALL {_PREVIOUS}) UNION ALL SELECT *, 'b', 1 FROM ({_PREVIOUS} EXCEPT ALL {_BUILT})")
def u03_stored(spark, d):
    return content_tree.diff_releases(spark, *_releases(spark, d))


@query("q03_dangling_report", "SELECT 'orders' AS child, 'o_custkey' AS key, 'customer' AS parent, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT 'nation', 'n_regionkey', 'region', 0")
def q03(spark, d):
    t = {k: table(spark, d, k) for k in ("orders", "nation", "region")} | {"customer": table(spark, d, "customer").where("c_acctbal > 0")}
    return Q.dangling_report(t, [("orders", "o_custkey", "customer", "c_custkey"), ("nation", "n_regionkey", "region", "r_regionkey")])


@query("q04_vector_completeness", "SELECT coalesce(c, 0) AS n_slots, count(*) AS n FROM (SELECT c_custkey FROM customer) LEFT JOIN (SELECT o_custkey, count(*) c FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1")
def q04(spark, d):
    return Q.vector_completeness(table(spark, d, "customer").withColumnRenamed("c_custkey", "k"), table(spark, d, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_custkey", "k"), "k")


@query("q05_check_exploded", "SELECT count(DISTINCT l_partkey) AS elements, (SELECT count(*) FROM part) AS index_rows, count(DISTINCT l_partkey) = (SELECT count(*) FROM part) AS equal FROM lineitem")
def q05(spark, d):
    arrays = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    return Q.check_exploded(arrays, "parts", table(spark, d, "part"))


@query("q07_compare_field_coverage", "SELECT 'lang' AS field, count(lang) AS n_a, count(*) FILTER (lang <> 'en') AS n_b FROM documents UNION ALL SELECT 'source', count(source), count(source) FROM documents")
def q07(spark, d):
    docs = table(spark, d, "documents")
    return Q.compare_field_coverage(docs, docs.withColumn("lang", F.when(F.col("lang") != "en", F.col("lang")).otherwise(" ")), ["lang", "source"])


@query("q08_compare_ids", "SELECT count(*) AS total, count(*) FILTER (doc_id % 3 > 0) AS mapped, count(*) FILTER (doc_id % 3 > 0 AND doc_id % 5 > 0) AS reachable, count(*) FILTER (doc_id % 3 > 0 AND doc_id % 5 > 0) AS same_text FROM documents")
def q08(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    new = docs.where("id % 5 > 0").withColumn("id", F.col("id") + 1_000_000)
    return Q.compare_ids(docs, new, docs.where("id % 3 > 0").select("id", (F.col("id") + 1_000_000).alias("new_id")), "text")


@query("q09_check_stamps", "SELECT 'parser' AS key, CAST(count(*) AS VARCHAR) AS value, '0' AS expected FROM nation UNION ALL SELECT 'gone', NULL, '1'")
def q09(spark, d):
    stamps = table(spark, d, "nation").agg(F.lit("parser").alias("key"), F.count("*").cast("string").alias("value"))
    return Q.check_stamps(stamps.unionByName(stamps.withColumn("key", F.lit("ddl"))), {"parser": "0", "gone": "1", "ddl": "25"})


@query("q11_check_layer", "SELECT o_custkey AS k, CASE WHEN o_custkey % 7 = 0 OR bool_and(o_orderstatus = 'P') THEN 'missing' ELSE 'members differ' END AS problem FROM orders GROUP BY 1 HAVING o_custkey % 7 = 0 OR bool_or(o_orderstatus = 'P')")
def q11(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus")
    return Q.check_layer({"a": o, "b": o.where("k % 7 > 0 and o_orderstatus <> 'P'")}, "k", "o_orderkey", "b", "a")


@query("q12_catalog_stats", "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def q12(spark, d):
    return Q.counts({k: table(spark, d, k) for k in ("nation", "orders", "lineitem")})


@query("q13_check_vectors", "SELECT count(*) AS n, count(*) FILTER (vec_id % 5 = 0) AS missing, count(*) FILTER (vec_id % 5 <> 0 AND vec_id % 7 = 0) AS changed FROM embeddings")
def q13(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    other = e.where("vec_id % 5 <> 0").withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.reverse("embedding")).otherwise(F.col("embedding")))
    return Q.check_vectors(e, other, "vec_id")

"""Queries of picks, set operations, aggregations and joins (W, U, A, J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import picks as W
from .registry import query, table
from .standins import duck, view


@query("w01_pick_first", "SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 0 ELSE 1 END, n_chars DESC NULLS LAST, doc_id) r FROM documents) WHERE r = 1")
def w01(spark, d):
    order = [F.when(F.col("lang") == "en", 0).otherwise(1), F.col("n_chars").desc_nulls_last(), F.col("doc_id")]
    return W.pick_first(table(spark, d, "documents"), ["source"], order).select("doc_id", "source", "lang")


@query("w02_distinct_on", "SELECT DISTINCT ON (l_orderkey) l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_orderkey, l_linenumber")
def w02(spark, d):
    """Some lines of an order share a number: the first in the file is taken, as SQL does that reads it in order."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return W.distinct_on(lines, ["l_orderkey"], W.ascending("l_linenumber", "_file", "_row")).select("l_orderkey", "l_linenumber", "l_partkey")


@query("w03_top_n", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) r FROM lineitem) WHERE r <= 8")
def w03(spark, d):
    return W.top_n(table(spark, d, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 8).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("w04_top_ties", "WITH v AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2) SELECT quality, toxic, n FROM (SELECT *, rank() OVER (PARTITION BY quality ORDER BY n DESC) r FROM v) WHERE r = 1")
def w04(spark, d):
    votes = table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    return W.top_ties(votes, ["quality"], F.col("n"))


@query("w05_surrogate_id", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS id FROM documents")
def w05(spark, d):
    return W.surrogate_id(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("w06_ordinal_in", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INTEGER) AS ordinal FROM conversations")
def w06(spark, d):
    return W.ordinal_in(table(spark, d, "conversations"), ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "ordinal")


@query("w07_a09_share_of_total", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM events GROUP BY 1")
def w07(spark, d):
    return W.share_of_total(table(spark, d, "events"), ["event_type"])


@query("w08_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def w08(spark, d):
    return W.top_k(table(spark, d, "lineitem"), [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 25).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("w09_cap_with_more", "SELECT l_orderkey, l_linenumber, n > 3 AS more FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) r, count(*) OVER (PARTITION BY l_orderkey) n FROM lineitem) WHERE r <= 3")
def w09(spark, d):
    return W.cap_with_more(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber"], 3).select("l_orderkey", "l_linenumber", "more")


@query("w11_primary_flag", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_type WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 2 ELSE 3 END, p_size DESC, p_partkey) = 1 AS is_primary FROM part")
def w11(spark, d):
    return W.primary_flag(table(spark, d, "part"), ["p_brand"], "p_type", {"SMALL": 1, "LARGE": 2}, [F.desc("p_size"), "p_partkey"]).select("p_partkey", "is_primary")


@query("u01_union_labelled", "SELECT o_orderkey, 'open' AS branch FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'large' FROM orders WHERE o_totalprice > 200000")
def u01(spark, d):
    o = table(spark, d, "orders")
    return W.union_labelled({"open": o.where("o_orderstatus = 'O'").select("o_orderkey"), "large": o.where("o_totalprice > 200000").select("o_orderkey")})


@query("u02_universe", "SELECT k, bool_or(s = 'c') AS in_customers, bool_or(s = 'o') AS in_orders FROM (SELECT c_custkey AS k, 'c' AS s FROM customer WHERE c_acctbal > 0 UNION ALL SELECT o_custkey, 'o' FROM orders) GROUP BY 1")
def u02(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))
    return W.universe({"customers": c, "orders": table(spark, d, "orders").select(F.col("o_custkey").alias("k"))}, ["k"])


@query("u03_diff_two_way", "SELECT n_name, 'a' AS side, CAST(1 AS BIGINT) AS n FROM nation WHERE n_regionkey = 0 UNION ALL SELECT n_name, 'b', 1 FROM nation WHERE n_regionkey = 1")
def u03(spark, d):
    n = table(spark, d, "nation")
    return W.diff_two_way(n.where("n_regionkey <> 1"), n.where("n_regionkey <> 0"), ["n_name"])


@query("u04_upsert", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 5 = 0")
def u04(spark, d):
    o = table(spark, d, "orders")
    return W.upsert(o.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderstatus").alias("s")), o.where("o_orderkey % 5 = 0").select("o_orderkey", F.lit("X").alias("s")), ["o_orderkey"])


@query("u04_upsert_counts", "SELECT count(*) FILTER (o_orderkey % 2 = 0) AS replaced, count(*) FILTER (o_orderkey % 2 <> 0) AS inserted FROM orders WHERE o_orderkey % 5 = 0")
def u04b(spark, d):
    o = table(spark, d, "orders")
    return W.upsert_counts(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 5 = 0"), ["o_orderkey"])


@query("u05_upsert_if", "SELECT n_nationkey, CASE WHEN n_regionkey > 2 THEN n_regionkey ELSE 2 END AS rank FROM nation")
def u05(spark, d):
    n = table(spark, d, "nation")
    return W.upsert_if(n.select("n_nationkey", F.lit(2).alias("rank")), n.select("n_nationkey", F.col("n_regionkey").alias("rank")), ["n_nationkey"], [F.desc("rank")])


@query("u06_replace_snapshot", duck("SELECT source, user_id FROM {upload} WHERE source <> 'click' UNION ALL SELECT 'click', user_id FROM {upload} WHERE source = 'click' AND user_id % 2 = 0"))
def u06(spark, d):
    u = view(spark, d, "upload").select("source", "user_id")
    return W.replace_snapshot(u, u.where("source = 'click' and user_id % 2 = 0"), "source")


@query("u07_members_of_all", "SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2")
def u07(spark, d):
    return W.members_of_all(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ["A", "R"])


@query("u09_upsert_rules", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN coalesce(CASE WHEN doc_id % 2 = 0 THEN 9 END, quality) ELSE quality END AS quality, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE toxic END AS toxic FROM labels WHERE doc_id % 7 <> 0")
def u09(spark, d):
    base = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    changes = base.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, 9).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    merged = W.upsert_rules(base, changes, "doc_id", ["quality"], {"toxic": 1})
    return W.delete_by_id(merged, base.where("doc_id % 7 = 0"), "doc_id")


@query("a01_distinct_counts", "SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_suppkey) FILTER (l_discount > 0.05) AS discounted FROM lineitem GROUP BY 1")
def a01(spark, d):
    return A.distinct_counts(table(spark, d, "lineitem"), ["l_returnflag"], {"suppliers": ("l_suppkey", None), "discounted": ("l_suppkey", F.col("l_discount") > 0.05)})


@query("a02_pivot_counts", "SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value > 50) AS large FROM events GROUP BY 1")
def a02(spark, d):
    return A.pivot_counts(table(spark, d, "events"), ["user_id"], {"clicks": F.col("event_type") == "click", "large": F.col("value") > 50})


@query("a03_basic_aggs", "SELECT o_custkey, bool_or(o_orderstatus = 'O') AS any_flag, bool_and(o_orderstatus = 'O') AS all_flag, min(o_totalprice) AS min_v, max(o_totalprice) AS max_v, round(avg(o_totalprice), 0) AS avg_v, round(sum(o_totalprice), 0) AS sum_v FROM orders GROUP BY 1")
def a03(spark, d):
    return A.basic_aggs(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", F.col("o_orderstatus") == "O", 0)


@query("a04_collect_sorted", "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), '|') AS items FROM customer GROUP BY 1")
def a04(spark, d):
    return A.collect_sorted(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", "|")


@query("a05_collect_structs", "SELECT o_custkey, '[' || string_agg('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}', ',' ORDER BY o_orderkey) || ']' AS items FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) r FROM orders) WHERE r <= 5 GROUP BY 1")
def a05(spark, d):
    return A.collect_structs(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey", "o_orderstatus"], [F.col("o_orderkey")], 5)


@query("a06_first_where", "SELECT p_brand, arg_min(p_name, p_partkey) FILTER (p_size > 25) AS first FROM part GROUP BY 1")
def a06(spark, d):
    return A.first_where(table(spark, d, "part"), ["p_brand"], "p_name", "p_partkey", F.col("p_size") > 25)


@query("a07_mode_of", "SELECT p_brand, sum(c)::BIGINT AS n, first(p_type ORDER BY c DESC, p_type) AS mode FROM (SELECT p_brand, p_type, count(*) c FROM part GROUP BY 1, 2) GROUP BY 1 HAVING sum(c) >= 5")
def a07(spark, d):
    return A.mode_of(table(spark, d, "part"), ["p_brand"], "p_type", 5)


@query("a08_count_map", "SELECT user_id, string_agg(event_type || '=' || c, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) c FROM events GROUP BY 1, 2) GROUP BY 1")
def a08(spark, d):
    m = A.count_map(table(spark, d, "events"), ["user_id"], "event_type")
    return m.select("user_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query("a10_having", "SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 2")
def a10(spark, d):
    return A.having(table(spark, d, "orders"), ["o_custkey"], "kinds > 2", n=F.count("*"), kinds=F.countDistinct("o_orderstatus"))


@query("a11_cooccurrence", "WITH e AS (SELECT DISTINCT l_orderkey k, l_suppkey % 20 e FROM lineitem), t AS (SELECT DISTINCT l_orderkey k, l_partkey % 50 t FROM lineitem), s AS (SELECT e, count(*) c FROM e GROUP BY 1) SELECT e.e AS entity, t.t AS tab, count(*) AS n, round(count(*) / any_value(s.c), 4) AS share FROM e JOIN t USING (k) JOIN s ON s.e = e.e GROUP BY 1, 2")
def a11(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 20).alias("entity"), (F.col("l_partkey") % 50).alias("tab"))
    return A.cooccurrence(li, li, "entity", "tab", "l_orderkey")


@query("a12_participation_share", duck("WITH j AS (SELECT * FROM {f_joins}), e AS (SELECT sql_hash, from_t AS t, from_c AS c FROM j UNION ALL SELECT sql_hash, to_t, to_c FROM j), n AS (SELECT t, c, count(DISTINCT sql_hash) n FROM e GROUP BY 1, 2), s AS (SELECT table_name, count(DISTINCT sql_hash) m FROM {f_tables} GROUP BY 1) SELECT t AS table_name, c AS column_name, n, round(n / m, 3) AS share FROM n JOIN s ON t = table_name WHERE n / m >= 0.2"))
def a12(spark, d):
    return A.participation_share(view(spark, d, "f_joins"), view(spark, d, "f_tables"))


@query("a13_literal_roles", duck("WITH c AS (SELECT table_name, column_name, op, left(literal, 80) AS literal, count(DISTINCT sql_hash) AS occurrences FROM {f_predicates} GROUP BY 1, 2, 3, 4) SELECT *, CASE WHEN (SELECT count(DISTINCT literal) FROM c b WHERE b.table_name = c.table_name) >= 5 THEN 'discriminator' ELSE 'structural' END AS role FROM c"))
def a13(spark, d):
    return A.literal_roles(view(spark, d, "f_predicates"), 5)


@query("a14_column_signals", duck("SELECT table_name, arg_min(column_name, ordinal) FILTER (column_name LIKE '%DATE') AS dated, arg_min(column_name, ordinal) FILTER (column_name LIKE '%KEY') AS keyed FROM {catalog} GROUP BY 1"))
def a14(spark, d):
    return A.column_signals(view(spark, d, "catalog"), {"dated": "DATE$", "keyed": "KEY$"})


@query("a15_pattern_evidence", "SELECT source, count(*) FILTER (regexp_matches(text, '[0-9]{4}')) AS digits, count(*) FILTER (regexp_matches(text, '!!')) AS shouts FROM documents GROUP BY 1")
def a15(spark, d):
    docs = table(spark, d, "documents")
    return A.pattern_evidence(docs.select("doc_id", "text"), docs.select("doc_id", "source"), {"digits": "[0-9]{4}", "shouts": "!!"}, "doc_id", "text", "source")


@query("a16_coverage", "SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 1000) AS long, count(*) FILTER (source = 'src0') AS src0 FROM documents GROUP BY 1")
def a16(spark, d):
    return A.coverage(table(spark, d, "documents"), ["lang"], {"long": F.col("n_chars") > 1000, "src0": F.col("source") == "src0"})


@query("a17_set_agreement", "WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) a, list_sort(list(DISTINCT CASE WHEN l_quantity > 25 THEN 'A' ELSE 'N' END)) b FROM lineitem GROUP BY 1), x AS (SELECT len(list_filter(a, lambda v: NOT list_contains(b, v))) al, len(list_filter(b, lambda v: NOT list_contains(a, v))) bl FROM s) SELECT count(*) AS \"both\", count(*) FILTER (al = 0 AND bl = 0) AS agree, count(*) FILTER ((al = 0) <> (bl = 0)) AS subset, count(*) FILTER (al > 0 AND bl > 0) AS disagree FROM x")
def a17(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("a"), F.collect_set(F.when(F.col("l_quantity") > 25, "A").otherwise("N")).alias("b"))
    return A.set_agreement(li, "a", "b")


@query("a18_usage_cost", "WITH u AS (SELECT event_type AS model, count(*) AS n, sum(user_id)::BIGINT AS tokens FROM events GROUP BY 1) SELECT model, n, tokens, round(tokens * length(model) / 1e6, 4) AS cost, round(tokens * length(model) / 1e6 / n * 1000, 4) AS projected FROM u")
def a18(spark, d):
    usage = table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("tokens"))
    prices = usage.select("model").distinct().withColumn("price", F.length("model"))
    return A.usage_cost(usage, prices, 1000, 4)


@query("a19_text_stats", "SELECT lang, round(avg(length(text)), 4) AS mean_len, median(length(text)) AS median_len, CAST(min(length(text)) AS INTEGER) AS min_len, CAST(max(length(text)) AS INTEGER) AS max_len, round(count(*) FILTER (trim(text) <> '') / count(*), 4) AS filled FROM documents GROUP BY 1")
def a19(spark, d):
    return A.text_stats(table(spark, d, "documents"), ["lang"], "text")


@query("a20_precision_recall", "WITH g AS (SELECT DISTINCT l_suppkey % 10 k, l_partkey i FROM lineitem WHERE l_quantity > 10), t AS (SELECT DISTINCT l_suppkey % 10 k, l_partkey i FROM lineitem WHERE l_discount > 0.02), x AS (SELECT coalesce(g.k, t.k) AS k, count(*) FILTER (g.k IS NOT NULL AND t.k IS NOT NULL) AS tp, count(*) FILTER (t.k IS NULL) AS fp, count(*) FILTER (g.k IS NULL) AS fn FROM g FULL JOIN t ON g.k = t.k AND g.i = t.i GROUP BY 1) SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall FROM x")
def a20(spark, d):
    li = table(spark, d, "lineitem").withColumn("k", F.col("l_suppkey") % 10)
    return A.precision_recall(li.where("l_quantity > 10"), li.where("l_discount > 0.02"), "k", "l_partkey")


@query("a21_cross_tab", "SELECT quality AS a, toxic AS b, count(*) AS n, CASE WHEN toxic > quality THEN 'improved' WHEN toxic < quality THEN 'regressed' ELSE 'same' END AS change FROM labels GROUP BY 1, 2")
def a21(spark, d):
    lab = table(spark, d, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b"))
    return A.cross_tab(lab, "a", "b", {0: 0, 1: 1})


@query("a22_template_histogram", "SELECT regexp_replace(url, '[0-9]+', '#', 'g') AS template, count(*) AS n, min(url) AS example FROM pages GROUP BY 1 ORDER BY n DESC, template LIMIT 20")
def a22(spark, d):
    return A.template_histogram(table(spark, d, "pages"), F.regexp_replace("url", "[0-9]+", "#"), "url", 20)


@query("a24_set_signature", "SELECT o_custkey, count(*) OVER (PARTITION BY list_sort(s)) AS same FROM (SELECT o_custkey, list(DISTINCT o_orderpriority) s FROM orders GROUP BY 1)")
def a24(spark, d):
    s = A.set_signature(table(spark, d, "orders"), ["o_custkey"], ["o_orderpriority"])
    n = s.groupBy("signature").agg(F.count("*").alias("same"))
    return s.join(n, "signature").select("o_custkey", "same")


@query("a25_group_all", "SELECT o_custkey, bool_and(o_totalprice > 50000) AS all_meet, bool_and(o_orderstatus = 'F') AS only_kind FROM orders GROUP BY 1")
def a25(spark, d):
    return A.group_all(table(spark, d, "orders"), ["o_custkey"], F.col("o_totalprice") > 50000, "o_orderstatus", "F")


@query("j01_join_facts", duck("SELECT sql_hash, table_name, source FROM {f_tables} JOIN {corpus} USING (sql_hash)"))
def j01(spark, d):
    return J.join_facts(view(spark, d, "f_tables"), view(spark, d, "corpus"), ["sql_hash"]).select("sql_hash", "table_name", "source")


@query("j02_assemble_left", "SELECT c_custkey, n, m FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) n FROM orders GROUP BY 1) USING (c_custkey) LEFT JOIN (SELECT o_custkey AS c_custkey, max(o_orderkey) m FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) USING (c_custkey)")
def j02(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    parts = [o.groupBy("c_custkey").agg(F.count("*").alias("n")), o.where("o_orderstatus = 'O'").groupBy("c_custkey").agg(F.max("o_orderkey").alias("m"))]
    return J.assemble_left(table(spark, d, "customer").select("c_custkey"), parts, ["c_custkey"])


@query("j03_full_union_join", "SELECT k, n, bal FROM (SELECT c_custkey AS k, c_acctbal AS bal FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT o_custkey AS k, count(*) n FROM orders GROUP BY 1) USING (k)")
def j03(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    b = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return J.full_union_join(a, b, ["k"]).select("k", "n", "bal")


@query("j04_keep_existing", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def j04(spark, d):
    return J.keep_existing(table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal > 0"), {"o_custkey": "c_custkey"}).select("o_orderkey")


@query("j05_dangling", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def j05(spark, d):
    return J.dangling(table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal > 0"), {"o_custkey": "c_custkey"}).select("o_orderkey")


@query("j06_flag_exists", "SELECT l_orderkey, l_linenumber, EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25) AS in_dict FROM lineitem")
def j06(spark, d):
    return J.flag_exists(table(spark, d, "lineitem"), table(spark, d, "part").where("p_size > 25"), {"l_partkey": "p_partkey"}, "in_dict").select("l_orderkey", "l_linenumber", "in_dict")


_EDGES = "SELECT DISTINCT least(from_t, to_t) AS t1, 'K' AS c1, greatest(from_t, to_t) AS t2, 'K' AS c2 FROM {f_joins}"


@query("j07_match_pairs", duck(f"SELECT t1, t2, CAST(right(t1, 1) AS INT) % 2 = 0 AND right(t1, 1) <> right(t2, 1) AS matches_declared FROM ({_EDGES})"))
def j07(spark, d):
    e = view(spark, d, "f_joins").select(F.least("from_t", "to_t").alias("t1"), F.lit("K").alias("c1"), F.greatest("from_t", "to_t").alias("t2"), F.lit("K").alias("c2")).distinct()
    declared = e.where("cast(right(t1, 1) as int) % 2 = 0 and right(t1, 1) <> right(t2, 1)").select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), F.lit("K").alias("c"))
    return J.match_pairs(e, declared).select("t1", "t2", "matches_declared")


@query("j08_top1_join", "SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) r FROM documents) WHERE r = 1")
def j08(spark, d):
    docs = table(spark, d, "documents")
    return J.top1_join(docs.select("source").distinct(), docs.select("source", "n_chars", "doc_id"), "source", ["n_chars", "doc_id"]).select("source", "doc_id", "n_chars")


@query("j09_explode_ordered", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) t(i)")
def j09(spark, d):
    return J.explode_ordered(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", "pos", F.col("embedding").cast("double").alias("v"))


@query("j10_mention_flags", "SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9_$#])license($|[^A-Za-z0-9_$#])', 'i') AS in_text, regexp_matches(text, '\\b(from|join|update|into)\\s+([A-Za-z0-9_]+\\.)?license($|[^A-Za-z0-9_$#])', 'i') AS after_from FROM documents")
def j10(spark, d):
    docs = table(spark, d, "documents")
    return J.mention_flags(docs.select("doc_id", F.lit("license").alias("name")), docs.select("doc_id", "text"), "doc_id", "name", "text").drop("name")


@query("j11_match_rules", duck("SELECT table_name, column_name, r AS rule FROM {catalog}, (VALUES ('k', 'KEY$', ''), ('o', '1_ORDER', '^T[0-9]$')) v(r, c, t) WHERE regexp_matches(column_name, c) AND regexp_matches(table_name, t)"))
def j11(spark, d):
    return J.match_rules(view(spark, d, "catalog"), [{"id": "k", "column": "KEY$"}, {"id": "o", "column": "1_ORDER", "table": "^T[0-9]$"}]).select("table_name", "column_name", "rule")


@query("j12_join_labels", "SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'little' ELSE lower(p_type) END AS key FROM part WHERE p_type IN ('SMALL', 'LARGE')")
def j12(spark, d):
    b = spark.createDataFrame([("little",), ("large",)], "key string")
    return J.join_labels(table(spark, d, "part").select("p_partkey", "p_type"), b, F.lower("p_type"), spark.createDataFrame([("small", "little")], "label string, alias string")).select("p_partkey", "key")


@query("j13_both_directions", duck("SELECT sql_hash, from_t, to_t FROM {f_joins} UNION ALL SELECT sql_hash, to_t, from_t FROM {f_joins}"))
def j13(spark, d):
    return J.both_directions(view(spark, d, "f_joins")).select("sql_hash", "from_t", "to_t")


@query("j14_with_config", "SELECT r_regionkey, r_name, CAST(0.2 AS DOUBLE) AS floor FROM region")
def j14(spark, d):
    return J.with_config(table(spark, d, "region"), spark.createDataFrame([(0.2,)], "floor double")).select("r_regionkey", "r_name", "floor")


@query("j15_share_join", "SELECT l_suppkey, l_returnflag, count(*) AS n, any_value(t) AS total, round(count(*) / any_value(t), 4) AS share FROM lineitem JOIN (SELECT l_suppkey, count(*) t FROM lineitem GROUP BY 1) USING (l_suppkey) GROUP BY 1, 2")
def j15(spark, d):
    li = table(spark, d, "lineitem")
    return J.share_join(li.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n")), li.groupBy("l_suppkey").agg(F.count("*").alias("total")), ["l_suppkey"])


@query("j16_related", duck("WITH m AS (SELECT from_t, to_t, count(DISTINCT sql_hash) n FROM {f_joins} GROUP BY 1, 2), e AS (SELECT from_t AS name, to_t AS other, 'out' AS way, n FROM m UNION ALL SELECT to_t, from_t, 'in', n FROM m) SELECT name, other, way, CASE WHEN n >= 3 THEN 'HIGH' WHEN n = 2 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, n AS occurrences, CASE WHEN n >= 3 THEN 1 WHEN n = 2 THEN 2 ELSE 3 END AS tier FROM e WHERE name IN ('S1', 'S2') UNION ALL SELECT 'S1', 'S2', 'out', 'DECLARED', NULL, 0 UNION ALL SELECT 'S2', 'S1', 'in', 'DECLARED', NULL, 0"))
def j16(spark, d):
    from ..functions.columns import confidence

    mined = view(spark, d, "f_joins").groupBy("from_t", "to_t").agg(F.countDistinct("sql_hash").alias("occurrences")).withColumn("confidence", confidence(F.col("occurrences")))
    return J.related(spark.createDataFrame([("S1",), ("S2",)], "name string"), spark.createDataFrame([("S1", "S2")], "from_t string, to_t string"), mined)


@query("j17_join_array_member", "SELECT l_orderkey, p AS k FROM (SELECT l_orderkey, unnest(list(DISTINCT l_partkey % 100)) p FROM lineitem GROUP BY 1) WHERE p IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def j17(spark, d):
    arrays = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey") % 100).alias("items"))
    return J.join_array_member(arrays, "items", table(spark, d, "part").where("p_size > 40").select(F.col("p_partkey").alias("k")), "k").select("l_orderkey", "k")

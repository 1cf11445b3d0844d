"""Queries of the scalar functions (F1 to F33) over stand-in columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from .registry import query, table

_SP = "translate(text, '" + C.UNICODE_SPACES + "', '" + " " * 19 + "')"
NORM_SQL = f"lower(trim(regexp_replace(regexp_replace(regexp_replace({_SP}, '--[^\\n]*', ' ', 'g'), '/\\*.*?\\*/', ' ', 'gs'), '\\s+', ' ', 'g')))"
_SPACE = r"[\s" + C.UNICODE_SPACES + "]+"
_TRIM = "regexp_replace(regexp_replace({0}, '^" + _SPACE + "', ''), '" + _SPACE + "$', '')"
_ENT = "replace(replace(replace(replace(replace(replace(replace({0}, '&quot;', '\"'), '&apos;', ''''), '&#39;', ''''), '&#34;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


def _docs(spark, d):
    return table(spark, d, "documents")


@query("f01_norm_text", f"SELECT doc_id, md5({NORM_SQL}) AS norm_md5, length({NORM_SQL}) AS norm_len FROM documents")
def f01(spark, d):
    n = C.norm_text(F.col("text"))
    return _docs(spark, d).select("doc_id", F.md5(n).alias("norm_md5"), F.length(n).cast("long").alias("norm_len"))


@query("f02_content_id", f"SELECT doc_id, 'sql:' || sha256({NORM_SQL}) AS id FROM documents")
def f02(spark, d):
    return _docs(spark, d).select("doc_id", C.content_id(F.col("text")).alias("id"))


@query("f03_raw_hash", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md, left(sha1(text), 20) AS sha20 FROM documents")
def f03(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", C.raw_hash(t).alias("sha"), C.raw_hash(t, "md5").alias("md"), C.raw_hash(t, "sha1_20").alias("sha20"))


@query("f04_decode_entities", f"SELECT page_id, md5({_ENT.format('html')}) AS h FROM pages")
def f04(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(C.decode_entities(F.col("html"))).alias("h"))


@query("f05_js_trim", f"SELECT doc_id, md5({_TRIM.format('line')}) AS h FROM (SELECT doc_id, chr(160) || ' ' || text || chr(8239) AS line FROM documents)")
def f05(spark, d):
    line = F.concat(F.lit(chr(160) + " "), "text", F.lit(chr(8239)))
    return _docs(spark, d).select("doc_id", F.md5(C.js_trim(line)).alias("h"))


@query("f06_null_norm", f"SELECT n_nationkey, CASE WHEN {_TRIM.format('x')} NOT IN ('') AND lower({_TRIM.format('x')}) <> 'null' THEN {_TRIM.format('x')} END AS v FROM (SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN ' NULL ' WHEN 1 THEN '  ' ELSE ' ' || n_name END AS x FROM nation)")
def f06(spark, d):
    x = F.when(F.col("n_nationkey") % 3 == 0, " NULL ").when(F.col("n_nationkey") % 3 == 1, "  ").otherwise(F.concat(F.lit(" "), "n_name"))
    return table(spark, d, "nation").select("n_nationkey", C.null_norm(x).alias("v"))


@query("f07_clean_text", f"SELECT page_id, md5({_ENT.format(_TRIM.format('html'))}) AS h FROM pages WHERE {_TRIM.format('html')} <> ''")
def f07(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(C.clean_text(F.col("html"))).alias("h")).where("h is not null")


@query("f08_json_nonempty", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE props END AS v, CASE WHEN trim(event_type) <> '' THEN event_type END AS t FROM events")
def f08(spark, d):
    x = F.when(F.col("event_id") % 4 == 0, F.when(F.col("event_id") % 8 == 0, "{ }").otherwise(' "" ')).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", C.json_nonempty(x).alias("v"), C.text_nonempty(F.col("event_type")).alias("t"))


@query("f09_to_int", "SELECT event_id, CAST(event_id % 1000 AS INTEGER) AS n, CAST(NULL AS INTEGER) AS none FROM events")
def f09(spark, d):
    n = F.concat(F.lit("  +"), F.col("event_id") % 1000, F.lit(" rows"))
    return table(spark, d, "events").select("event_id", C.to_int(n).alias("n"), C.to_int(F.col("event_type")).alias("none"))


@query("f10_norm_name", "SELECT p_partkey, upper(trim(p_name)) AS name FROM part")
def f10(spark, d):
    return table(spark, d, "part").select("p_partkey", C.norm_name(F.concat(F.lit(' "Owner.'), "p_name", F.lit('" '))).alias("name"))


@query("f11_strip_prefix", "SELECT p_partkey, p_name AS a, p_brand AS b FROM part")
def f11(spark, d):
    return table(spark, d, "part").select("p_partkey", C.strip_prefix(F.concat(F.lit("P."), "p_name"), "P").alias("a"), C.strip_prefix(F.col("p_brand"), "P").alias("b"))


@query("f12_norm_label", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) || ' - ' || lower(p_brand) AS label FROM part")
def f12(spark, d):
    return table(spark, d, "part").select("p_partkey", C.norm_label(F.concat("p_name", F.lit(" –  "), "p_brand")).alias("label"))


@query("f13_match_key", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS k, trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS l FROM part")
def f13(spark, d):
    return table(spark, d, "part").select("p_partkey", C.match_key(F.concat(F.lit("  "), "p_name")).alias("k"), C.loose_key(F.concat(F.lit(" -- - "), "p_name")).alias("l"))


@query("f14_display_hint", "SELECT p_partkey, 'order item ' || lower(p_type) AS hint FROM part")
def f14(spark, d):
    return table(spark, d, "part").select("p_partkey", C.display_hint(F.concat(F.lit("orderItem_"), F.lower("p_type"), F.lit("__c"))).alias("hint"))


@query("f15_name_stem", "SELECT p_partkey, 'AP_' || upper(replace(p_name, ' ', '_')) AS a, 'AP_INV' AS b, 'X_Y' AS c FROM part")
def f15(spark, d):
    name = F.concat(F.lit("AP_"), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))))
    return table(spark, d, "part").select("p_partkey", C.name_stem(F.concat(name, F.lit("_ALL_TL"))).alias("a"), C.name_stem(F.lit("AP_ALL_INV_B")).alias("b"), C.name_stem(F.lit("X_Y_V")).alias("c"))


@query("f16_prefix_of", "SELECT c_custkey, regexp_extract(c_name, '^[^_.#]*') AS p FROM customer")
def f16(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.prefix_of(F.replace("c_name", F.lit("#"), F.lit("_"))).alias("p"))


@query("f17_is_junk_remark", "SELECT p_partkey, p_partkey % 2 = 0 AS junk FROM part")
def f17(spark, d):
    remark = F.when(F.col("p_partkey") % 2 == 0, F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))).otherwise(F.concat("p_name", F.lit(" of the order")))
    return table(spark, d, "part").select("p_partkey", C.is_junk_remark(remark, F.col("p_name")).alias("junk"))


@query("f18_clean_literal", "SELECT o_orderkey, left(o_orderpriority, 6) AS v FROM orders")
def f18(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.clean_literal(F.concat(F.lit(" '"), "o_orderpriority", F.lit("'")), 6).alias("v"))


@query("f19_render", "SELECT o_orderkey, 'ORDERS.PRIORITY = ' || o_orderpriority AS p, 'A.x=B.y' || CASE WHEN o_orderstatus = 'F' THEN '' ELSE '[LEFT]' END AS e FROM orders")
def f19(spark, d):
    kind = F.when(F.col("o_orderstatus") == "F", "INNER").otherwise("LEFT")
    one = F.lit
    return table(spark, d, "orders").select("o_orderkey", C.render_predicate(one("ORDERS"), one("PRIORITY"), one("EQ"), F.col("o_orderpriority")).alias("p"), C.render_edge(one("A"), one("x"), one("B"), one("y"), kind).alias("e"))


@query("f20_json_str_array", "SELECT event_id, '[\"' || event_type || '\",\"' || user_id || '\"]' AS a FROM events")
def f20(spark, d):
    return table(spark, d, "events").select("event_id", C.json_str_array(F.array("event_type", F.col("user_id").cast("string"))).alias("a"))


@query("f21_compose_lines", "SELECT conv_id, turn, 'role: ' || role || chr(10) || 'turn: ' || turn AS lines FROM conversations")
def f21(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", C.compose_lines([("role", F.array("role")), ("none", F.lit(None).cast("array<string>")), ("turn", F.array(F.col("turn").cast("string")))]).alias("lines"))


@query("f22_embed_texts", "SELECT doc_id, 0 AS slot, source || chr(10) || 'Tables: ' || lang || ', T' AS t FROM documents UNION ALL SELECT doc_id, 1, 'find ' || lang FROM documents")
def f22(spark, d):
    texts = C.embed_texts(F.col("source"), F.array("lang", F.lit("T")), F.array(F.lit(" "), F.concat(F.lit("find "), "lang")))
    return _docs(spark, d).select("doc_id", F.posexplode(texts).alias("slot", "t"))


@query("f23_l2_to_score", "SELECT o_orderkey, round(1 - (o_orderkey % 7 / 4.0) * (o_orderkey % 7 / 4.0) / 2, 3) AS s FROM orders")
def f23(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.l2_to_score((F.col("o_orderkey") % 7 / 4.0)).alias("s"))


@query("f24_cosine_l2", "SELECT a.vec_id, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-9), 6) AS cos, round(list_distance(a.v, b.v), 6) AS dist FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) b")
def f24(spark, d):
    e = table(spark, d, "embeddings")
    one = e.where("vec_id = 0").select(F.col("embedding").alias("other"))
    return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(C.cosine(F.col("embedding"), F.col("other")), 6).alias("cos"), F.round(C.l2(F.col("embedding"), F.col("other")), 6).alias("dist"))


@query("f25_usage_score", "SELECT doc_id, CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 2 ELSE 1 END * 100000 + least(n_chars, 90000) AS score FROM documents")
def f25(spark, d):
    w = F.when(F.col("lang") == "en", 3).when(F.col("lang") == "de", 2).otherwise(1)
    return _docs(spark, d).select("doc_id", C.usage_score(w, F.col("n_chars")).alias("score"))


@query("f26_confidence", "SELECT l_orderkey, count(*) AS n, CASE WHEN count(*) >= 3 THEN 'HIGH' WHEN count(*) = 2 THEN 'MEDIUM' ELSE 'LOW' END AS conf FROM lineitem GROUP BY 1")
def f26(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).withColumn("conf", C.confidence(F.col("n")))


@query("f27_lcp_suffix", "SELECT p_partkey, length('part ') + CASE WHEN left(p_type, 1) = 'S' THEN 1 ELSE 0 END AS n FROM part")
def f27(spark, d):
    return table(spark, d, "part").select("p_partkey", C.lcp_length(F.lit("part S#"), F.concat(F.lit("part "), F.left("p_type", F.lit(1)))).cast("long").alias("n"))


@query("f28_longest_prefix", "SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'Brand#1' WHEN p_brand LIKE 'Brand#%' THEN 'Brand' END AS entry FROM part")
def f28(spark, d):
    return table(spark, d, "part").select("p_partkey", C.longest_prefix(F.col("p_brand"), ["Brand", "Brand#1", "Other"]).alias("entry"))


@query("f29_exposes_inputs", "SELECT doc_id, lang <> 'en' AS shown FROM documents")
def f29(spark, d):
    e = F.when(F.col("lang") == "en", "MASK(x)").when(F.col("lang") == "de", "upper(trim(x))").otherwise("x + 1")
    return _docs(spark, d).select("doc_id", C.exposes_inputs(e, ["UPPER", "TRIM"]).alias("shown"))


@query("f30_clip", "SELECT doc_id, left(text, 100) AS text, length(text) > 100 AS truncated FROM documents")
def f30(spark, d):
    return _docs(spark, d).select("doc_id", C.clip(F.col("text"), 100).alias("c")).select("doc_id", "c.*")


@query("f31_tokens", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS n, upper(regexp_extract_all(text, '[A-Za-z0-9_]+')[1]) AS first FROM documents")
def f31(spark, d):
    t = C.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n"), F.try_element_at(t, F.lit(1)).alias("first"))


@query("f32_jaccard", "SELECT doc_id, round(coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 6) AS j FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(left(text, length(text) // 2)), '[a-z]{4,}')) AS a, list_distinct(regexp_extract_all(lower(right(text, length(text) - length(text) // 2)), '[a-z]{4,}')) AS b FROM documents)")
def f32(spark, d):
    """The two halves of every text."""
    half = F.floor(F.length("text") / 2).cast("int")
    a, b = (C.content_words(x) for x in (F.left("text", half), F.right("text", F.length("text") - half)))
    return _docs(spark, d).select("doc_id", F.round(C.jaccard(a, b), 6).alias("j"))


@query("f33_split_filters", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user=1' END AS matched, CASE WHEN role = 'user' THEN 2 ELSE 3 END AS n_rest FROM conversations")
def f33(spark, d):
    s = C.split_filters(F.array(F.lit("a=1"), F.concat("role", F.lit("=1")), F.lit("b>2")), "^user=")
    return table(spark, d, "conversations").select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", "s.matched", F.size("s.rest").alias("n_rest"))

"""Queries of search, vectors and graphs (K, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import search as K
from ..operators import text_index, vector_index
from ..operators import vectors as V
from .registry import query, table
from .standins import duck, view


def _names(spark, d):
    return table(spark, d, "part").select(F.upper("p_name").alias("name")).distinct()


def _requests(spark, d):
    """Part names with a letter dropped or replaced, or cut to their first word."""
    n = F.col("p_partkey") % 3
    name = F.upper("p_name")
    r = F.when(n == 0, F.substr(name, F.lit(2))).when(n == 1, F.concat(F.left(name, F.length(name) - 1), F.lit("Q"))).otherwise(F.substring_index(name, " ", 1))
    return table(spark, d, "part").where("p_partkey % 5 = 0").select(r.alias("request")).distinct()


_REQ = "(SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN substr(upper(p_name), 2) WHEN 1 THEN left(upper(p_name), length(p_name) - 1) || 'Q' ELSE split_part(upper(p_name), ' ', 1) END AS request FROM part WHERE p_partkey % 5 = 0)"
_NAMES = "(SELECT DISTINCT upper(p_name) AS name FROM part)"
_DOCS = "SELECT p_partkey AS id, p_name AS name, p_type || ' ' || p_brand AS remark FROM part"


def _docs(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_type", "p_brand").alias("remark"))


#: Documents as weighted tokens, distinct tokens under each query term, then weights, hits and ranks.
_K01 = """WITH doc AS (SELECT p_partkey AS id, p_name AS name, regexp_extract_all(upper(p_name), '[A-Z0-9]+') AS a, regexp_extract_all(upper(p_type || ' ' || p_brand), '[A-Z0-9]+') AS b FROM part),
tok AS (SELECT id, unnest(a) AS t, 4.0::DOUBLE AS w FROM doc UNION ALL SELECT id, unnest(b), 1.0::DOUBLE FROM doc),
per AS (SELECT id, t, sum(w) AS w FROM tok GROUP BY 1, 2),
q AS (SELECT DISTINCT left(lower(p_type), 3) || ' ' || split_part(p_name, ' ', 1) || CASE WHEN length(p_name) % 4 = 0 THEN ' zz' ELSE '' END AS query_id FROM part),
term AS (SELECT DISTINCT query_id, unnest(list_distinct(regexp_extract_all(upper(query_id), '[A-Z0-9]+'))) AS x FROM q),
n AS (SELECT query_id, count(*) AS n_terms FROM term GROUP BY 1),
v AS (SELECT x, t FROM (SELECT DISTINCT x FROM term), (SELECT DISTINCT t FROM per) WHERE starts_with(t, x)),
m AS (SELECT query_id, id, count(DISTINCT x) AS hits, sum(w) AS w FROM term JOIN v USING (x) JOIN per USING (t) GROUP BY 1, 2),
k AS (SELECT *, max(hits) OVER (PARTITION BY query_id) AS best FROM m JOIN n USING (query_id))
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, score DESC, length(name), name, id) AS INTEGER) AS rank, hits, score, mode FROM (
  SELECT query_id, id, name, hits, CASE WHEN hits = n_terms THEN 'and' ELSE 'or' END AS mode, round(w / (1 + ln(len(a) + len(b))), 6) AS score FROM k JOIN doc USING (id) WHERE hits = n_terms OR best < n_terms) QUALIFY rank <= 20"""


@query("k01_k02_text_search", _K01)
def k01(spark, d):
    """A type's stem and a word of a name, and for some a word that no part has: those are answered by any term."""
    rare = F.when(F.length("p_name") % 4 == 0, " zz").otherwise("")
    q = table(spark, d, "part").select(F.concat(F.left(F.lower("p_type"), F.lit(3)), F.lit(" "), F.substring_index("p_name", " ", 1), rare).alias("query_id")).distinct()
    return text_index.text_search(q.withColumn("query", F.col("query_id")), _docs(spark, d), {"name": 4.0, "remark": 1.0}, "id")


@query("k03_phrase_search", "SELECT q.name AS query_id, count(*) AS found FROM (SELECT DISTINCT p_name AS name FROM part) q JOIN part p ON ' ' || p.p_name LIKE '% ' || q.name || '%' GROUP BY 1")
def k03(spark, d):
    q = table(spark, d, "part").select(F.col("p_name").alias("query_id"), F.col("p_name").alias("query")).distinct()
    return text_index.phrase_search(q, _docs(spark, d), "name", "id").groupBy("query_id").agg(F.count("*").alias("found"))


@query("k04_knn", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, v.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.e, v.e), 9), v.vec_id) AS INTEGER) AS rank FROM v q, v WHERE q.vec_id % 50 = 0) WHERE rank <= 10")
def k04(spark, d):
    e = table(spark, d, "embeddings")
    return V.knn(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 10).select("query_id", "vec_id", "rank")


@query("k05_knn_multi", "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), h AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.label, list_distance(q.e, v.e) AS x, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.e, v.e), 9), v.label, v.vec_id) AS r FROM v q, v WHERE q.vec_id % 50 = 0) WHERE r <= 15) SELECT query_id, label AS owner_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(min(x), 9), label) AS INTEGER) AS rank FROM h GROUP BY 1, 2 QUALIFY rank <= 5")
def k05(spark, d):
    e = table(spark, d, "embeddings")
    slots = e.select(F.col("label").alias("owner_id"), F.col("vec_id").alias("slot"), "embedding")
    return V.knn_multi(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), slots, 5).select("query_id", "owner_id", "rank")


@query("k06_rank_within", "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) SELECT request_id, vec_id, rank FROM (SELECT q.vec_id AS request_id, v.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e)) + 1e-9), 6) DESC, v.vec_id) AS INTEGER) AS rank FROM v q JOIN v USING (label) WHERE q.vec_id % 100 = 0) WHERE rank <= 5")
def k06(spark, d):
    e = table(spark, d, "embeddings")
    return V.rank_within(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("request_id"), "label", "embedding"), e, "label", "vec_id", 5).select("request_id", "vec_id", "rank")


@query("k07_suggest", f"WITH p AS (SELECT request, name, greatest(2, length(request) // 3) AS b, contains(name, request) OR contains(request, name) AS i, levenshtein(request, name) AS l FROM {_REQ} r, {_NAMES} n WHERE request <> name), s AS (SELECT request, name, CASE WHEN i THEN abs(length(name) - length(request)) * 0.5 WHEN l <= b THEN l + 5 END AS score FROM p) SELECT request, name, score::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY request ORDER BY score, name) AS INTEGER) AS rank FROM s WHERE score IS NOT NULL QUALIFY rank <= 5")
def k07(spark, d):
    return K.suggest(_requests(spark, d), _names(spark, d)).select("request", "name", "score", "rank")


@query("k08_nearest_labels", f"WITH p AS (SELECT request, name, lower(request) AS q, lower(name) AS n FROM {_REQ} r, {_NAMES} x), s AS (SELECT request, name, CASE WHEN q = n THEN 0 WHEN contains(n, q) OR contains(q, n) THEN round(1 + abs(length(n) - length(q)) * 0.01, 4) WHEN levenshtein(q, n) <= greatest(2, length(q) // 4) THEN 2 + levenshtein(q, n) END AS score FROM p) SELECT request, name, score::DOUBLE AS score, CAST(row_number() OVER (PARTITION BY request ORDER BY score, name) AS INTEGER) AS rank FROM s WHERE score IS NOT NULL QUALIFY rank <= 5")
def k08(spark, d):
    return K.nearest_labels(_requests(spark, d), _names(spark, d)).select("request", "name", "score", "rank")


@query("k09_match_label", "SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) || ' ' END AS request, p_name AS name, p_partkey % 2 = 0 AS exact FROM part")
def k09(spark, d):
    p = table(spark, d, "part")
    return K.match_label(p.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.upper("p_name"), F.lit(" "))).alias("request")), p.select(F.col("p_name").alias("name")))


def _alias_sides(spark, d):
    """Two catalogs of the part names in other families: suffixes, family words put in, letters changed, payloads by name or by part."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    pick = lambda by, *x: F.element_at(F.array(*[F.lit(v) for v in x]), (by % len(x) + 1).cast("int"))
    a = p.select(F.concat(pick(F.length("p_name"), "Sales", "Order Entry", "Ledger"), F.lit(" - "), "p_name", pick(F.col("p_size"), "", "s", " Real Time", " entry")).alias("name"))
    odd = F.when(F.crc32("p_name") % 3 == 0, F.concat(F.left("p_name", F.length("p_name") - 1), F.lit("z"))).otherwise(F.concat("p_name", pick(F.crc32("p_name"), "", " order")))
    b = p.select(F.concat(pick(F.crc32("p_name") + F.when(F.crc32("p_name") % 5 == 1, k % 2).otherwise(0), "Old Sales", "Order Entry", "Books"), F.lit(" – "), odd).alias("name"), F.when(F.crc32("p_name") % 5 == 0, F.lit(None)).when(F.crc32("p_name") % 5 == 1, k).otherwise(F.length("p_name")).alias("payload"))
    return a.distinct(), b.distinct()


@query("k10_propose_aliases")
def k10(spark, d):
    return K.propose_aliases(*_alias_sides(spark, d))


@query("k11_classify_domain", "WITH m AS (SELECT l_orderkey AS id, CASE WHEN l_suppkey % 9 = 5 THEN 'C' WHEN l_suppkey % 3 = 0 THEN 'A' WHEN l_suppkey % 3 = 1 THEN 'B' END AS dom, count(*) AS n FROM lineitem GROUP BY 1, 2), w AS (SELECT id, dom FROM m WHERE dom IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, dom) = 1) SELECT o.l_orderkey AS id, coalesce(dom, CASE WHEN o.l_orderkey % 2 = 0 THEN 'T' ELSE 'Other' END) AS domain FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN w ON id = o.l_orderkey")
def k11(spark, d):
    m = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.when(F.col("l_suppkey") % 9 == 5, "Z_5").otherwise(F.concat(F.element_at(F.array(F.lit("X_"), F.lit("Y_"), F.lit("Z_")), (F.col("l_suppkey") % 3 + 1).cast("int")), "l_suppkey")).alias("m"))
    items = m.groupBy("id").agg(F.collect_list("m").alias("members")).withColumn("title", F.when(F.col("id") % 2 == 0, "total").otherwise("none"))
    return K.classify_domain(items, {"Z_5": "C"}, {"X": "A", "Y": "B"}, [("^total", "T")])


#: Neighbours in SQL: the nearest `n` rows of each query, ties by `order`.
_V = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), "


def _hits(n, order, keys, where="TRUE", name="h"):
    return f"{name} AS (SELECT * FROM (SELECT q.vec_id AS query_id, {keys}, list_distance(q.e, v.e) AS x, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_distance(q.e, v.e), 9), {order}) AS r FROM v q, v WHERE q.vec_id % 50 = 0 AND {where}) WHERE r <= {n})"


def _stage(number, level, rows):
    best = f"SELECT query_id, {level} AS level, max(score) AS score, count(*) AS n FROM {rows} GROUP BY 1, 2"
    return f"s{number} AS (SELECT query_id, {number}::INTEGER AS stage, min(level) FILTER (r = 1) AS winner, count(*) > 1 AND round(max(score) - min(score), 6) <= 0.1 AS tied FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n DESC, level) AS r FROM ({best})) WHERE r <= 2 GROUP BY 1)"


_OWNERS = "o AS (SELECT query_id, owner_id, min(x) AS x FROM h GROUP BY 1, 2)"


@query("k12_ambiguity", _V + _hits(8, "v.vec_id, v.label", "v.label") + ", s AS (SELECT query_id, round(1 - x * x / 2, 3) AS score, CAST(label % 3 AS VARCHAR) AS top, CASE WHEN label > 2 THEN CAST(label AS VARCHAR) END AS sub FROM h), " + _stage(1, "top", "s") + ", " + _stage(2, "sub", "(SELECT s.* FROM s JOIN s1 ON s.query_id = s1.query_id AND s.top = s1.winner WHERE sub IS NOT NULL)") + " SELECT * FROM s1 UNION ALL SELECT * FROM s2")
def k12(spark, d):
    e = table(spark, d, "embeddings")
    hits = V.knn(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select("vec_id", "label", "embedding"), 8, ["vec_id", "label"])
    hits = hits.select("query_id", "rank", F.round(1 - F.col("distance") ** 2 / 2, 3).alias("score"), (F.col("label") % 3).cast("string").alias("top"), F.when(F.col("label") > 2, F.col("label").cast("string")).alias("sub"))
    return V.ambiguity(hits, 5)


@query("k13_retrieve", _V + _hits(72, "v.label, v.vec_id", "CAST(v.label AS BIGINT) AS owner_id") + ", " + _OWNERS + ", f AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9), owner_id) AS INTEGER) AS rank FROM o) SELECT query_id, rank, owner_id, round(1 - x * x / 2, 3) AS score, CAST(owner_id % 2 AS VARCHAR) AS top, CAST(owner_id AS VARCHAR) AS sub, CASE WHEN length(text) <= 6000 THEN text END AS text, length(text) > 6000 AS pointer_only FROM f LEFT JOIN documents ON doc_id = owner_id WHERE rank <= 3")
def k13(spark, d):
    e, docs = table(spark, d, "embeddings"), table(spark, d, "documents")
    slots = e.select(F.col("label").cast("long").alias("owner_id"), F.col("vec_id").alias("slot"), "embedding")
    domains = e.select(F.col("label").cast("long").alias("owner_id"), (F.col("label") % 2).cast("string").alias("top"), F.col("label").cast("string").alias("sub")).distinct()
    return V.retrieve(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), slots, domains, docs.select(F.col("doc_id").alias("owner_id"), "text"), 3)


@query("k14_search_expand", _V + _hits(3, "CAST(v.vec_id AS VARCHAR)", "CAST(v.vec_id AS VARCHAR) AS text_hash") + ", p AS (SELECT DISTINCT CAST(l_orderkey % 500 AS VARCHAR) AS text_hash, l_partkey AS place FROM lineitem) SELECT query_id, CAST(r AS INTEGER) AS rank, text_hash, place, CAST(row_number() OVER (PARTITION BY query_id, text_hash ORDER BY place) AS INTEGER) AS place_no FROM h JOIN p USING (text_hash) QUALIFY place_no <= 6")
def k14(spark, d):
    e = table(spark, d, "embeddings").withColumn("text_hash", F.col("vec_id").cast("string"))
    places = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).cast("string").alias("text_hash"), F.col("l_partkey").alias("place")).distinct()
    return V.search_expand(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select("text_hash", "embedding"), places, 3)


@query("k15_retrieve_patterns", _V + _hits(54, "v.label, v.vec_id", "v.label AS owner_id") + ", " + _OWNERS + ", few AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(x, 9), owner_id) <= 18), k AS (SELECT *, CASE WHEN owner_id < 3 THEN 'anti' ELSE 'good' END AS kind, CASE WHEN owner_id < 3 THEN 'anti' ELSE 'pattern' END AS part FROM few) SELECT query_id, part, CAST(row_number() OVER (PARTITION BY query_id, part ORDER BY round(x, 9), owner_id) AS INTEGER) AS rank, owner_id, kind FROM k QUALIFY rank <= CASE WHEN part = 'anti' THEN 2 ELSE 3 END")
def k15(spark, d):
    e = table(spark, d, "embeddings")
    slots = e.select(F.col("label").alias("owner_id"), F.col("vec_id").alias("slot"), "embedding")
    kinds = e.select(F.col("label").alias("owner_id"), F.when(F.col("label") < 3, "anti").otherwise("good").alias("kind")).distinct()
    return V.retrieve_patterns(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), slots, kinds, 3, "anti")


@query("k16_topk_overlap", _V + _hits(10, "v.vec_id", "v.vec_id") + ", " + _hits(10, "v.vec_id", "v.vec_id", "v.vec_id % 7 <> 0", "g") + " SELECT h.query_id, CAST(count(*) FILTER (h.vec_id = g.vec_id) AS INTEGER) AS overlap, min(h.vec_id) FILTER (h.r = 1) = min(g.vec_id) FILTER (g.r = 1) AS same_first FROM h JOIN g ON h.query_id = g.query_id GROUP BY 1")
def k16(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return V.topk_overlap(V.knn(q, e, 10), V.knn(q, e.where("vec_id % 7 <> 0"), 10), "vec_id")


@query("k17_knn_approx")
def k17(spark, d):
    e = table(spark, d, "embeddings")
    return vector_index.knn_approx(e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, 10)


@query("k18_resolve_references", "SELECT p_partkey AS ref_id, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN p_brand END AS to_folder, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN p_name END AS to_column, CASE WHEN p_partkey % 7 = 0 THEN 'unknown_area' WHEN p_partkey % 5 = 0 THEN 'unknown_folder' WHEN p_partkey % 2 = 0 THEN 'spelling' ELSE 'ok' END AS code FROM part")
def k18(spark, d):
    p = table(spark, d, "part")
    catalog = p.select(F.col("p_type").alias("area"), F.col("p_brand").alias("folder"), F.col("p_name").alias("column")).distinct()
    k = F.col("p_partkey")
    refs = p.select(k.alias("ref_id"), F.when(k % 7 == 0, "nowhere").otherwise(F.col("p_type")).alias("area"), F.when(k % 5 == 0, "none").otherwise(F.col("p_brand")).alias("folder"), F.when(k % 2 == 0, F.concat(F.upper("p_name"), F.lit(" "))).otherwise(F.col("p_name")).alias("column"))
    return K.resolve_references(refs, catalog)


_MISSES = """
WITH cat AS (SELECT DISTINCT p_type AS a, p_brand AS f, p_name AS c FROM part),
r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN left(p_type, length(p_type) - 1) ELSE p_type END AS a,
  CASE WHEN p_partkey % 6 = 2 THEN NULL WHEN p_partkey % 5 = 0 THEN replace(p_brand, '#', '') ELSE p_brand END AS f,
  CASE p_partkey % 3 WHEN 0 THEN left(p_name, length(p_name) - 1) WHEN 1 THEN 'hot gear' ELSE p_name END AS c FROM part),
n AS (SELECT *, (SELECT count(DISTINCT x.f) FROM cat x WHERE x.a = r.a AND x.c = r.c AND (r.f IS NULL OR x.f = r.f)) AS n FROM r),
k AS (SELECT id, a, f, c, CASE WHEN a NOT IN (SELECT a FROM cat) THEN 'unknown_area' WHEN f IS NOT NULL AND NOT EXISTS (SELECT 1 FROM cat x WHERE x.a = n.a AND x.f = n.f) THEN 'unknown_folder' WHEN n = 0 THEN 'unknown_column' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS code FROM n),
q AS (SELECT id, code, CASE code WHEN 'unknown_area' THEN 'area' WHEN 'unknown_folder' THEN 'folder' ELSE 'column' END AS kind, CASE code WHEN 'unknown_area' THEN '' WHEN 'unknown_folder' THEN a ELSE a || '|' || f END AS within, CASE code WHEN 'unknown_area' THEN a WHEN 'unknown_folder' THEN f ELSE c END AS request
  FROM k WHERE code IN ('unknown_area', 'unknown_folder') OR code = 'unknown_column' AND f IS NOT NULL),
d AS (SELECT DISTINCT 'area' AS kind, '' AS within, a AS name FROM cat UNION SELECT 'folder', a, f FROM cat UNION SELECT 'column', a || '|' || f, c FROM cat),
s AS (SELECT id, code, kind, name, lower(request) AS x, lower(name) AS y, CASE WHEN x = y THEN 0 WHEN contains(x, y) OR contains(y, x) THEN round(1 + abs(length(x) - length(y)) * 0.01, 4) WHEN levenshtein(x, y) <= greatest(2, length(x) // 4) THEN 2 + levenshtein(x, y) END AS score FROM q JOIN d USING (kind, within)),
h AS (SELECT a, c, f AS name, row_number() OVER (PARTITION BY a, c ORDER BY f) AS rank FROM cat)
SELECT id AS ref_id, code, kind, CAST(row_number() OVER (PARTITION BY id ORDER BY score, name) AS INTEGER) AS rank, name AS suggestion FROM s WHERE score IS NOT NULL QUALIFY rank <= 5
UNION ALL SELECT id, code, 'holder', CAST(rank AS INTEGER), name FROM k JOIN h ON k.a = h.a AND k.c = h.c WHERE code = 'unknown_column' AND rank <= 5 OR code = 'ambiguous' AND rank <= 8
"""


@query("k18_explain_misses", _MISSES)
def k18_misses(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    catalog = p.select(F.col("p_type").alias("area"), F.col("p_brand").alias("folder"), F.col("p_name").alias("column")).distinct()
    short = lambda c: F.left(c, F.length(c) - 1)
    area = F.when(k % 7 == 0, short("p_type")).otherwise(F.col("p_type"))
    folder = F.when(k % 6 == 2, None).when(k % 5 == 0, F.replace("p_brand", F.lit("#"), F.lit(""))).otherwise(F.col("p_brand"))
    column = F.when(k % 3 == 0, short("p_name")).when(k % 3 == 1, "hot gear").otherwise(F.col("p_name"))
    return K.explain_misses(p.select(k.alias("ref_id"), area.alias("area"), folder.alias("folder"), column.alias("column")), catalog)


#: Orders as a forest: each order refers to the order of half its number.
_TREE = "SELECT o_orderkey AS src, o_orderkey // 2 AS dst FROM orders WHERE o_orderkey > 1 AND o_orderkey // 2 IN (SELECT o_orderkey FROM orders)"


def _tree(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    half = F.floor(F.col("o_orderkey") / 2)
    return o.where("o_orderkey > 1").select(F.col("o_orderkey").alias("src"), half.alias("dst")).join(o.select(F.col("o_orderkey").alias("dst")), "dst", "left_semi").select("src", "dst")


@query("g01_closure", f"WITH RECURSIVE e AS ({_TREE}), c AS (SELECT o_orderkey AS seed, o_orderkey AS node, 0 AS depth FROM orders UNION ALL SELECT seed, dst, depth + 1 FROM c JOIN e ON node = src) SELECT seed, node, depth FROM c")
def g01(spark, d):
    return G.closure(table(spark, d, "orders").select(F.col("o_orderkey").alias("seed")), _tree(spark, d))


_ORACLE_G02 = f"WITH RECURSIVE e AS ({_TREE}), c AS (SELECT o_orderkey AS seed, o_orderkey AS node, 0 AS depth FROM orders UNION ALL SELECT seed, dst, depth + 1 FROM c JOIN e ON node = src) SELECT seed, count(*) AS size, max(depth) AS depth FROM c GROUP BY 1 ORDER BY size DESC, depth DESC, seed % 100 DESC, seed LIMIT 20"


@query("g02_rank_seeds", _ORACLE_G02)
def g02(spark, d):
    seeds = table(spark, d, "orders").select(F.col("o_orderkey").alias("seed"))
    return G.rank_seeds(G.closure(seeds, _tree(spark, d)), seeds.withColumn("chars", F.col("seed") % 100), 20)


@query("g02_top_seeds", _ORACLE_G02)
def g02_sketched(spark, d):
    seeds = table(spark, d, "orders").select(F.col("o_orderkey").alias("seed"))
    return G.top_seeds(seeds, _tree(spark, d), seeds.withColumn("chars", F.col("seed") % 100), 20, k=4)


@query("g02_union_closure", f"WITH RECURSIVE e AS ({_TREE}), r AS (SELECT DISTINCT dst AS node, 0 AS depth FROM e WHERE dst NOT IN (SELECT src FROM e) UNION ALL SELECT src, depth + 1 FROM r JOIN e ON node = dst), c AS (SELECT o_orderkey AS node FROM orders WHERE o_orderkey % 10 = 1 UNION SELECT dst FROM c JOIN e ON node = src) SELECT c.node, max(depth) AS depth FROM c LEFT JOIN r ON c.node = r.node GROUP BY 1")
def g02_union(spark, d):
    tree = _tree(spark, d)
    seeds = table(spark, d, "orders").where("o_orderkey % 10 = 1").select(F.col("o_orderkey").alias("seed"))
    return G.union_closure(seeds, tree, G.dependency_depth(tree))


@query("g03_dependency_depth", f"WITH RECURSIVE e AS ({_TREE}), r AS (SELECT DISTINCT dst AS node, 0 AS depth FROM e WHERE dst NOT IN (SELECT src FROM e) UNION ALL SELECT src, depth + 1 FROM r JOIN e ON node = dst) SELECT node, max(depth) AS depth FROM r GROUP BY 1")
def g03(spark, d):
    return G.dependency_depth(_tree(spark, d))


@query("g04_vote_fixpoint")
def g04(spark, d):
    li = table(spark, d, "lineitem").select(F.concat(F.lit("P"), "l_partkey").alias("node"), F.concat(F.lit("S"), "l_suppkey").alias("other"))
    joins = li.unionByName(li.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct()
    p = table(spark, d, "part").select(F.concat(F.lit("P"), "p_partkey").alias("node"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("family"), F.col("p_type").alias("own"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("node"), F.lit(None).cast("string").alias("family"), F.lit(None).cast("string").alias("own"))
    lineage = p.where("node < 'P2'").select("node", F.lit("P3").alias("other"))
    return G.vote_fixpoint(p.unionByName(s), lineage, joins)


@query("g05_resolve_chain", "SELECT p_partkey AS node, CASE WHEN p_size > 40 THEN p_type WHEN p_brand LIKE 'Brand#1%' THEN 'B1' END AS value, CASE WHEN p_size > 40 THEN 'policy' WHEN p_brand LIKE 'Brand#1%' THEN 'prefix' END AS stage FROM part")
def g05(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_partkey", "node")
    return G.resolve_chain(p, [("policy", p.where("p_size > 40").select("node", F.col("p_type").alias("value"))), ("prefix", lambda cur: p.where("p_brand like 'Brand#1%'").select("node", F.lit("B1").alias("value")))])


@query("g06_absorb_when_all", f"WITH RECURSIVE e AS ({_TREE}), r AS (SELECT o_orderkey AS node, 0 AS round FROM orders WHERE o_orderkey % 4 = 1 AND o_orderkey NOT IN (SELECT src FROM e WHERE dst % 4 = 1) UNION ALL SELECT src, round + 1 FROM r JOIN e ON node = dst) SELECT node, CAST(min(round) AS INTEGER) AS round FROM r GROUP BY 1")
def g06(spark, d):
    t = _tree(spark, d)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"))
    start = o.where("node % 4 = 1").join(t.where("dst % 4 = 1").select(F.col("src").alias("node")), "node", "left_anti")
    return G.absorb_when_all(o, t.select(F.col("src").alias("node"), F.col("dst").alias("other")), start)


@query("g07_inherit_from_parent", "SELECT n_nationkey AS node, CASE WHEN n_nationkey % 5 = 0 THEN n_name ELSE (SELECT b.n_name FROM nation b WHERE b.n_nationkey = a.n_nationkey - a.n_nationkey % 5 AND a.n_nationkey % 5 <= 3) END AS value, CASE WHEN n_nationkey % 5 <= 3 THEN n_nationkey % 5 END AS hop FROM nation a")
def g07(spark, d):
    n = table(spark, d, "nation")
    nodes = n.select(F.col("n_nationkey").alias("node"), F.when(F.col("n_nationkey") % 5 == 0, F.col("n_name")).alias("value"))
    parents = n.where("n_nationkey % 5 > 0").select(F.col("n_nationkey").alias("node"), (F.col("n_nationkey") - 1).alias("parent"), F.lit(True).alias("strict"), F.lit(1).alias("rank"))
    return G.inherit_from_parent(nodes, parents, 3).select("node", "value", "hop")


@query("g08_resolve_alias_chain", "SELECT c_custkey AS output, 'region' AS block, r_name AS alias, 'SUM' AS agg FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def g08(spark, d):
    c = table(spark, d, "customer")
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    s = lambda x: F.col(x).cast("string")
    e1 = c.select(F.lit("customer").alias("block"), s("c_custkey").alias("alias"), F.lit("nation").alias("source_block"), s("c_nationkey").alias("source_alias"), F.lit(None).cast("string").alias("agg"))
    e2 = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("nation").alias("block"), s("n_nationkey").alias("alias"), F.lit("region").alias("source_block"), F.col("r_name").alias("source_alias"), F.lit("SUM").alias("agg"))
    return G.resolve_alias_chain(c.select(F.col("c_custkey").alias("output"), F.lit("customer").alias("block"), s("c_custkey").alias("alias")), e1.unionByName(e2))


@query("g09_view_edges", duck("SELECT DISTINCT o_orderkey AS src, table_name AS dst FROM orders JOIN {f_tables} f ON f.sql_hash = o_orderkey WHERE o_orderstatus = 'F'"))
def g09(spark, d):
    units = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderkey").alias("sql_hash"), "o_orderstatus")
    return G.view_edges(units, view(spark, d, "f_tables"), F.col("o_orderstatus") == "F")

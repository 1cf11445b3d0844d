"""Stand-in tables for the reference's inputs, the same views in Spark and in SQL.

SQL is written in the dialect that Spark and DuckDB share; `{name}` in a query's SQL expands to a view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .registry import table

VIEWS = {
    "unit": "SELECT cast(doc_id AS string) AS unit_id, source, concat(lang, '.', source) AS title, text AS original_sql FROM documents",
    "unit_ref": "SELECT cast(doc_id AS string) AS unit_id, concat('/', lang, '/', source) AS path, cast(doc_id % 3 AS int) AS idx FROM documents",
    "f_tables": "SELECT DISTINCT l_orderkey AS sql_hash, concat('S', l_suppkey) AS table_name FROM lineitem",
    "f_joins": "SELECT a.l_orderkey AS sql_hash, concat('S', a.l_suppkey) AS from_t, 'K' AS from_c, concat('S', b.l_suppkey) AS to_t, 'K' AS to_c, CASE WHEN a.l_returnflag = 'R' THEN 'LEFT' ELSE 'INNER' END AS join_type FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber",
    "f_predicates": "SELECT o_orderkey AS sql_hash, 0 AS seq, concat('C', o_custkey % 50) AS table_name, 'O_ORDERPRIORITY' AS column_name, 'EQ' AS op, o_orderpriority AS literal FROM orders",
    "corpus": "SELECT o_orderkey AS sql_hash, o_orderstatus AS source, cast(floor(o_totalprice) AS bigint) AS chars FROM orders",
    "journal": "SELECT cast(conv_id AS string) AS id, turn AS line_no, role = 'assistant' AS ok, text FROM conversations",
    "grants": "SELECT DISTINCT concat('R', o_custkey % 20) AS role_name, o_orderstatus AS obj_name, o_orderpriority AS privilege FROM orders",
    "upload": "SELECT event_type AS source, user_id, max(ts) AS loaded_at FROM events GROUP BY 1, 2",
    "catalog": "SELECT concat('T', l_suppkey) AS table_name, concat('C', c, CASE WHEN c % 3 = 0 THEN '_KEY' WHEN c % 7 = 0 THEN '_DATE' ELSE '_ORDER' END) AS column_name, cast(row_number() OVER (PARTITION BY l_suppkey ORDER BY c) AS int) AS ordinal, l_suppkey % 3 AS kind FROM (SELECT DISTINCT l_suppkey, l_partkey % 210 AS c FROM lineitem)",
    "sql_text": "SELECT o_orderkey AS sql_hash, o_custkey % 7 AS c, o_custkey % 5 AS m, o_orderkey % 3 AS k, o_orderkey % 4 AS shape, CASE o_orderkey % 4 WHEN 0 THEN concat('select PKG_', o_custkey % 7, '.F', o_orderkey % 3, '(x, ', chr(39), '(k', chr(39), ', g(1,2)), ', chr(39), 'A.B(c)', chr(39), ' /* Z.Z(1) */, pkg_', o_custkey % 5, '.g from T t -- no.call(1)') WHEN 1 THEN concat('select ', chr(39), '--', chr(39), ', APP.PKG_', o_custkey % 7, ' . F', o_orderkey % 3, '( ) from t, u where u.b_col (+) = ', chr(39), '/*', chr(39), ' and pkg_', o_custkey % 5, '.H(1 from x') WHEN 2 THEN concat('with function f return number is begin return PKG_', o_custkey % 7, '.F(1, q', chr(39), '[,)]', chr(39), '); end; select PKG_', o_custkey % 7, '.G', o_orderkey % 3, '(', chr(34), 'a,b', chr(34), ', 2) from t') ELSE concat('begin PKG_', o_custkey % 7, '.L(', chr(39), repeat('x', 300), chr(39), ', ', chr(39), ' a  b', chr(39), '); v := dbms_lob.len; end;') END AS text FROM orders",
    "fk": "SELECT DISTINCT concat('T', l_suppkey) AS child, concat('T', l_partkey % 97) AS parent, concat('C', l_partkey % 210) AS col FROM lineitem",
}
#: DuckDB's words for types that the views name in Spark's.
_DUCK = {"AS string": "AS varchar"}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in over the tables it names."""
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in ("documents", "lineitem", "orders", "conversations", "events") if f" {t}" in sql}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    """SQL with `{name}` replaced by the view's text."""
    for name, text in VIEWS.items():
        for a, b in _DUCK.items():
            text = text.replace(a, b)
        sql = sql.replace("{" + name + "}", f"({text})")
    return sql

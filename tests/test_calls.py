"""Call facts on the statements that a masking in several passes gets wrong, and the classes of the inventory."""

import re

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import calls as A


def found(text, **kw):
    return [(f[0], f[1], f[2], f[3], f[4], f[5]) for f in A.scan(text, **kw)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("select '--', PKG_A.F(1) from t", [(None, "PKG_A", "F", 1, True, "sql")]),
        ("select '/*', PKG_B.G(2), '*/' from t", [(None, "PKG_B", "G", 1, True, "sql")]),
        ("select 1 from t u where u.b_col (+) = t.c(1)", [(None, "T", "C", 1, True, "sql")]),
        ("select 1 from a x, b y where x.y(+) = y.x ( + )", []),
        ("select -- it's\n p.f('--', \"a(b\", c), /* ' */ s.p.g() from dual", [(None, "P", "F", 3, True, "sql"), ("S", "P", "G", 0, True, "sql")]),
        ("select q'[it's (]' || P.F(q'(')', (1)) from t", [(None, "P", "F", 2, True, "sql")]),
        ("select p.f(g(1, 2), h(3)), p.f((1)), p.f( ) from t", [(None, "P", "F", 2, True, "sql"), (None, "P", "F", 0, True, "sql"), (None, "P", "F", 0, True, "sql")]),
        ("select p.f(1, 2", [(None, "P", "F", None, True, "sql")]),
        ("declare x number; begin p.f(1); end;", [(None, "P", "F", 1, True, "plsql")]),
        ("with function f return number is begin return a.b(1); end; select c.d(2), e.g from t", [(None, "A", "B", 1, True, "plsql"), (None, "C", "D", 1, True, "sql"), (None, "E", "G", 0, False, "sql")]),
        ("select t.a, (select 1) as u, u.b, v.c from big_table t", [(None, "V", "C", 0, False, "sql")]),
        ("select b.\"X\" from (select 1) b, a.b.c.d(1), 'x.y(1)'", []),
        ("", []),
    ],
)
def test_scan(text, want):
    assert found(text) == want


def test_blanking_keeps_lengths_and_never_opens_twice():
    pieces = ["'a''b'", "-- x\n", "/* ' */", '"q--"', "q'{'}'", "p.f(1)", "'", "/*", " "]
    for i in range(9**4):
        text = "".join(pieces[i // 9**k % 9] for k in range(4))
        masked = A.blanked(text)
        assert len(masked) == len(text) and not re.search("q--", masked)


def test_parentheses_of_deep_nesting_are_matched_in_one_pass():
    n = 50_000
    closed = A.parentheses("(a," * n + "b" + ")" * n)
    assert len(closed) == n and closed[0] == (4 * n, 2)


def test_snippets():
    long = "p.f('" + "x" * 400 + "')"
    (fact,) = A.scan("select " + long)
    assert fact[6:] == (7, long[:240], True)
    (fact,) = A.scan("select a,\n   b,  PKG.ID from t")
    assert fact[6:] == (17, "select a, b, PKG.ID", False)
    (fact,) = A.scan("select p.f(1,\n\t 2) from t")
    assert fact[6:] == (7, "p.f(1, 2)", False)


def test_bare_references_depend_on_all_statements(spark):
    texts = [(1, "select a_b.x, c_d.y, obj_1.z, only_1.q, xx_own.r, dbms_lob.len, nodash.k from t"), (2, "begin c_d.f(1); obj_1.f(2); nodash.g(3); end;"), (3, "select c_d.g(1), obj_1.g(1), nodash.g(1), only_1.f(1) from t"), (4, None), (5, "")]
    df = spark.createDataFrame(texts, "id long, text string")
    one = lambda n: spark.createDataFrame([(n,)], "name string")
    got = A.call_facts(df, one("Obj_1"), one("a_b"), "id", "text").where("id = 1").orderBy("seq").collect()
    assert [(r.seq, r.package_name) for r in got] == [(0, "A_B"), (1, "C_D"), (2, "XX_OWN"), (3, "DBMS_LOB")]
    assert A.call_facts(df.limit(0), one("o"), one("p"), "id", "text").count() == 0


def test_classes_and_methods(spark):
    texts = [(1, "select x_v.extract(1), y_v.trim(2), y_v.real_one(3), sys.z_v.f(1), xx_a.f(1), dict_p.f(1), lone_p.q from t"), (2, "select x_v.extract(1) from t")]
    df = spark.createDataFrame(texts, "sql_hash long, text string")
    none = spark.createDataFrame([], "name string")
    packages = spark.createDataFrame([("DICT_P",), ("LONE_P",)], "name string")
    facts = A.call_facts(df, none, packages, "sql_hash", "text")
    corpus = spark.createDataFrame([(1, "s", "t", False), (2, None, None, True)], "sql_hash long, source string, title string, described boolean")
    units = spark.createDataFrame([("u", 1, "t"), ("v", 1, "w")], "unit_id string, sql_hash long, title string")
    refs = spark.createDataFrame([("u", "/p")], "unit_id string, path string")
    tables = spark.createDataFrame([(1, "T")], "sql_hash long, table_name string")
    modules = spark.createDataFrame([("T", "M")] + [(f"XX_{i}", "own") for i in range(9)] + [(f"DICT_{i}", "D") for i in range(5)], "name string, module string")
    inv = {(r.package_name, r.function_name): r for r in A.api_inventory(facts, corpus, units, refs, tables, modules, packages, "s").collect()}
    assert {k: v.api_class for k, v in inv.items()} == {("X_V", "EXTRACT"): "method", ("Y_V", "TRIM"): "product", ("Y_V", "REAL_ONE"): "product", ("Z_V", "F"): "oracle", ("XX_A", "F"): "custom", ("DICT_P", "F"): "product"}
    x = inv["X_V", "EXTRACT"]
    assert (x.statements, x.units, x.titles, x.reports, x.by_source, x.arg_counts) == (2, 2, 2, 1, {"?": 1, "s": 1}, {"1": 2})
    assert [s.sql_hash for s in x.samples] == [2, 1] and [tuple(t) for t in x.top_tables] == [("T", 1)]
    assert (inv["DICT_P", "F"].module, inv["DICT_P", "F"].module_source, inv["XX_A", "F"].module, inv["XX_A", "F"].module_source) == ("D", "prefix", "M", "usage")
    assert facts.where(F.col("package_name") == "LONE_P").count() == 1  # kept as a fact; in the inventory it needs two statements

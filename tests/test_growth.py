"""Steps that must not grow with the tables in one task or on the driver, and picks whose ties the file's order settles."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from corpusforge.operators import calls as A
from corpusforge.operators import graph as G
from corpusforge.operators import search as K
from corpusforge.operators import text_index
from corpusforge.operators import vectors as V


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_search_broadcasts_no_documents(spark, tmp_path):
    """files that look small hold many rows."""
    spark.range(2000).selectExpr("id", "concat('red ', id % 7) AS name").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    queries = spark.createDataFrame([("a", "re 3"), ("b", "r zz")], "query_id string, query string")
    found = text_index.index_of(docs, {"name": 1.0}, "id")
    found.block = 300  # `red` falls into parts
    got = found.search(queries)
    assert "BroadcastHashJoin [id" not in plan_of(got) and "BuildLeft" not in plan_of(got)
    rows = {(r["query_id"], r["id"], r["mode"]) for r in got.collect()}
    assert rows == {("a", 7 * i + 3, "and") for i in range(20)} | {("b", 7 * i, "or") for i in range(20)}


def test_distinct_on_takes_the_first_in_the_file(spark, tmp_path):
    """lines of one number, in row groups that Spark may read in any order."""
    rnd = np.random.default_rng(1)
    lines = pa.table({"l_orderkey": rnd.integers(0, 300, 20_000), "l_linenumber": rnd.integers(0, 3, 20_000).astype(np.int32), "l_partkey": rnd.integers(0, 10_000, 20_000)})
    pq.write_table(lines, tmp_path / "lineitem.parquet", row_group_size=1000)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = sorted(tuple(r) for r in entry.queries()["w02_distinct_on"](spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    assert got == sorted(con.execute(entry.oracle_sql()["w02_distinct_on"]).fetchall())


def test_references_meet_counted_holders(spark):
    """500 folders hold the column, a reference stays one row; equal references are one."""
    catalog = spark.createDataFrame([("A", f"f{i}", "c") for i in range(500)] + [("A", "F0", "C "), ("A", None, "c"), ("B", "x", "D")], "area string, folder string, column string")
    rows = [(1, "a", None, "c"), (2, "A", "f7", "c"), (2, "A", "f7", "c"), (3, "A", "f0", "c"), (4, "b", None, "d"), (5, "A", "zz", "c"), (6, None, "x", "D"), (7, "B", "x", None)]
    got = K.resolve_references(spark.createDataFrame(rows, "ref_id int, area string, folder string, column string"), catalog)
    assert "fits" not in plan_of(got) and "count(distinct CASE" not in plan_of(got)
    want = {(1, None, None, "ambiguous"), (2, "f7", "c", "ok"), (3, None, None, "ambiguous"), (4, "x", "D", "spelling"), (5, None, None, "unknown_folder"), (6, None, None, "unknown_area"), (7, None, None, "unknown_column")}
    found = [tuple(r) for r in got.collect()]
    assert set(found) == want and len(found) == 7


def test_misses_read_the_catalog_once(spark):
    """the catalog's rows are made once; a reference isn't joined with the 500 folders that hold its column."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = [("A", f"f{i:03}", "Total") for i in range(500)] + [("A", "f000", "Totals"), ("B", "x", "Other")]
    schema = "area string, folder string, column string"
    catalog = spark.createDataFrame(rows * 2, schema).mapInArrow(count, schema)
    refs = [(i, "A", None, "total") for i in range(40)] + [(40, "A", "f000", "Totls"), (41, "A", "f1", "Total"), (42, "C", "x", "Other"), (43, "B", "x", "Total")]
    got = K.explain_misses(spark.createDataFrame(refs, f"ref_id int, {schema}"), catalog)
    found = {}
    for r in got.orderBy("ref_id", "kind", "rank").collect():
        found.setdefault((r["ref_id"], r["code"], r["kind"]), []).append(r["suggestion"])
    assert made.value == len(rows) * 2
    first = [f"f{i:03}" for i in range(8)]
    assert {k: v for k, v in found.items() if k[0] < 40} == {(i, "ambiguous", "holder"): first for i in range(40)}
    near = [f"f1{i:02}" for i in range(5)]
    assert {k: v for k, v in found.items() if k[0] >= 40} == {(40, "unknown_column", "column"): ["Totals", "Total"], (41, "unknown_folder", "folder"): near, (42, "unknown_area", "area"): ["A", "B"]}


def test_equal_texts_are_scanned_once(monkeypatch):
    """a batch of 3,000 rows with four texts takes four scans; facts come in blocks."""
    texts = ["select p.f(1), q.g(2) from t", None, "", "begin a.b; end;", "no call"] * 600
    want = sorted((i, s, sum(x[4] for x in A.scan(t)), *f) for i, t in enumerate(texts) if t for s, f in enumerate(A.scan(t)))
    asked, scan = [], A.scan
    monkeypatch.setattr(A, "scan", lambda t: asked.append(t) or scan(t))
    monkeypatch.setattr(A, "BLOCK", 100)
    got = list(A._batch_facts(pa.record_batch([pa.array(range(3000)), pa.array(texts)], ["k", "t"]), "k"))
    assert len(asked) == 4 and max(b.num_rows for b in got) <= 102
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r.values()) for b in got for r in b.to_pylist()), key=key) == sorted(want, key=key)
    assert [list(A._batch_facts(pa.record_batch([pa.array([1] * n), pa.array([None] * n, pa.string())], ["k", "t"]), "k")) for n in (0, 2)] == [[], []]


def test_inventory_counts_shared_units_without_expanding(spark):
    """units of several statements, without a name, repeated, of several titles and paths; two counts in one pass."""
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    ids = list(range(1, 7))
    calls = A.call_facts(df([(i, f"select p_a.f({'1,' * (i % 3)}1), p_a.f(2), p_b.g{i % 2}(1) from t") for i in ids], "sql_hash long, text string"), df([], "name string"), df([], "name string"), "sql_hash", "text")
    units = [("u1", 1, "t"), ("u1", 2, "t"), ("u1", 2, "t"), ("u1", 2, "w"), ("u2", 2, None), (None, 3, "n"), ("u3", 3, "x"), ("u3", 3, "y"), ("u4", None, "z"), ("u5", 4, "t"), ("u6", 9, "q")]
    refs = [("u1", "/a"), ("u1", "/b"), ("u1", "/b"), ("u3", "/a"), ("u3", None), (None, "/z"), ("u5", "/c"), ("u6", "/d"), ("u2", None)]
    tables = [(i, f"T{j}") for i in ids for j in range(i % 4 + 1)] * 2
    modules = [("T0", "M0"), ("T1", "M0"), ("T2", "M1"), ("T2", "M2"), ("T2", "M2"), ("T3", None)]
    corpus = [(i, None if i == 5 else "ab"[i % 2], f"title {i}", i > 4) for i in ids]
    inv = A.api_inventory(calls, df(corpus, "sql_hash long, source string, title string, described boolean"), df(units, "unit_id string, sql_hash long, title string"), df(refs, "unit_id string, path string"), df(tables, "sql_hash long, table_name string"), df(modules, "name string, module string"), df([], "name string"), "a")
    assert "Expand" not in plan_of(inv)
    got = {(r.package_name, r.function_name): r for r in inv.collect()}
    for name, held in ((("P_A", "F"), ids), (("P_B", "G0"), ids[1::2]), (("P_B", "G1"), ids[::2])):
        r, mine = got.pop(name), [u for u in units if u[1] in held]
        named = {u[0] for u in mine} - {None}
        assert (r.statements, r.units, r.titles) == (len(held), len(named), len({u[2] for u in mine} - {None}))
        assert r.reports == len({p for u, p in refs if u in named} - {None})
        assert r.by_source == {s: n for s in "?ab" if (n := sum((c[1] or "?") == s for c in corpus if c[0] in held))}
        per = lambda of: sorted(((sum(v in of(i) for i in held), v) for v in {v for i in held for v in of(i)}), key=lambda x: (-x[0], x[1]))
        mine_tables = lambda i: {t for h, t in tables if h == i}
        assert [(t.statements, t.table_name) for t in r.top_tables] == per(mine_tables)
        assert [(m.statements, m.module) for m in r.top_modules] == per(lambda i: {m for t, m in modules if m and t in mine_tables(i)})
        assert [s.sql_hash for s in r.samples] == sorted((i for i in held), key=lambda i: (i <= 4, {"a": 0, "b": 1, None: -1}[corpus[i - 1][1]], i if name[0] == "P_B" else 0, i))[:2]
    assert not got


def _shapes():
    """Forests, forks, circles, chains: links (src, dst)."""
    rnd = np.random.default_rng(5)
    tree = [(i, i // 2) for i in range(2, 40)]
    chain = [(100 + i, 101 + i) for i in range(37)]
    dag = [(200 + i, 200 + int(j)) for i in range(1, 20) for j in set(rnd.integers(0, i, 2))]
    return tree + chain + dag + [(300, 225), (301, 2)], [(400, 401), (401, 402), (402, 400), (403, 400), (404, 404)]


def _closure(links, seeds):
    to = {}
    for a, b in links:
        to.setdefault(a, set()).add(b)
    out = set()
    for s in seeds:
        seen, wave, depth = {s}, {s}, 0
        while wave:
            out |= {(s, n, depth) for n in wave}
            wave = {b for a in wave for b in to.get(a, ())} - seen
            seen, depth = seen | wave, depth + 1
    return out


def test_graphs_of_all_shapes(spark):
    """Jumps where ways never fork, waves elsewhere."""
    acyclic, circles = _shapes()
    links = acyclic + circles
    nodes = sorted({n for e in links for n in e} | {999})
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    edges, seeds = df(links + links[:3], "src long, dst long"), df([(n,) for n in nodes + nodes[:5]], "seed long")
    want = _closure(links, nodes)
    got = [tuple(r) for r in G.closure(seeds, edges).collect()]
    assert len(got) == len(want) and set(got) == want
    some = nodes[::7]
    depth = {}
    for n in sorted({n for e in acyclic for n in e}, key=lambda n: len([1 for s, _, _ in _closure(acyclic, [n])])):
        depth[n] = 1 + max([depth[b] for a, b in acyclic if a == n], default=-1)
    waves = G.dependency_depth(df(acyclic, "src long, dst long"))
    assert {tuple(r) for r in waves.collect()} == set(depth.items()) and waves.count() == len(depth)
    reached = {n for _, n, _ in _closure(links, some)}
    got = [tuple(r) for r in G.union_closure(df([(n,) for n in some], "seed long"), edges, waves).collect()]
    assert len(got) == len(reached) and set(got) == {(n, depth.get(n)) for n in reached}


def test_forest_takes_rounds_by_digits(spark, monkeypatch):
    """A chain of 300 nodes is no 300 rounds."""
    frames = []
    kept = G.checkpointed
    monkeypatch.setattr(G, "checkpointed", lambda df: frames.append(1) or kept(df))
    chain = spark.range(300).selectExpr("id AS src", "id + 1 AS dst")
    assert {tuple(r) for r in G.dependency_depth(chain).collect()} == {(300 - i, i) for i in range(301)}
    assert len(frames) < 20
    assert G.closure(spark.range(0, 301, 50).withColumnRenamed("id", "seed"), chain).count() == sum(301 - i for i in range(0, 301, 50))
    assert len(frames) < 60


def test_nearest_holds_few_pairs_and_cuts_ties(monkeypatch):
    """3,000 equal vectors give k rows a query, ties by key; few distances at once."""
    rnd = np.random.default_rng(2)
    one = rnd.normal(size=8)
    x = np.vstack([np.tile(one, (3000, 1)), rnd.normal(size=(50, 8))])
    keys = rnd.permutation(len(x))
    column = lambda m: pa.array(list(m), pa.list_(pa.float64()))
    held = pa.table({"vec_id": keys, "embedding": column(x)})
    asked = pa.table({"query_id": np.arange(5), "embedding": column(np.vstack([one, x[-4:]]))})
    sizes, partition = [], np.partition
    monkeypatch.setattr(V.np, "partition", lambda d, *a, **k: sizes.append(d.size) or partition(d, *a, **k))
    monkeypatch.setattr(V, "PAIRS", 7000)
    got = V._nearest(asked, held, 6, ["vec_id"]).to_pylist()
    assert max(sizes) <= 7000 and len(got) == 30
    for i, v in enumerate(np.vstack([one, x[-4:]])):
        order = sorted((round(float(np.sqrt(((v - y) ** 2).sum())), 9), int(k)) for y, k in zip(x, keys))[:6]
        assert [r["vec_id"] for r in got if r["query_id"] == i] == [k for _, k in order]

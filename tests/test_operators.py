"""Gates, files, streams and brute-force twins of operators that SQL doesn't express."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusforge.functions import columns as C
from corpusforge.operators import graph as G
from corpusforge.operators import lookup as P
from corpusforge.operators import quality as Q
from corpusforge.operators import search as K
from corpusforge.operators import text_index, vector_index
from corpusforge.operators import vectors as V
from corpusforge.sources import files as S
from corpusforge.sources import shared
from corpusforge.streaming import incremental as T


def test_comments_go_lines_first(spark):
    df = spark.createDataFrame([("SELECT 1 -- a /* b\nFROM t /* c */ x ",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(C.norm_text(F.col("t"))).collect()] == ["select 1 from t x", None, ""]


def test_ampersand_is_decoded_last(spark):
    df = spark.createDataFrame([("&amp;quot; &lt;&#39;",)], "t string")
    assert df.select(C.decode_entities(F.col("t"))).first()[0] == "&quot; <'"


def test_gate_raises_only_on_violations(spark):
    none = spark.createDataFrame([], "message string")
    Q.gate(none)
    with pytest.raises(Q.GateError, match="a; b"):
        Q.gate(spark.createDataFrame([("b",), ("a",)], "message string"))


def test_publish_is_a_no_op_the_second_time(spark, tmp_path):
    t = {"t": spark.range(5)}
    root = f"file://{tmp_path}/r"
    assert Q.publish(spark, t, root, "v1")
    assert not Q.publish(spark, t, root, "v1")
    (tmp_path / "r" / "v2").mkdir()
    with pytest.raises(Q.GateError, match="v2"):
        Q.publish(spark, t, root, "v2")


def test_csv_with_bom_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿A,B\n"x ""y""","line\nbreak"\n\n1,2\n', encoding="utf-8")
    rows = S.read_dictionary_csv(spark, str(tmp_path / "a.csv"), ["A", "B"]).collect()
    assert [tuple(r) for r in rows] == [('x "y"', "line\nbreak"), ("1", "2")]


def test_journal_numbers_lines_and_keeps_bad_ones_apart(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"id": "a"}\nnot json\n\n{"id": "b"}\n')
    good, bad = S.read_journal(spark, [str(tmp_path / "j.jsonl")], "id string")
    assert sorted((r.line_no, r.id) for r in good.collect()) == [(1, "a"), (4, "b")]
    assert [r.line_no for r in bad.collect()] == [2]
    with pytest.raises(Q.GateError):
        S.read_journal(spark, [str(tmp_path / "j.jsonl")], "id string", superseded=["j.jsonl"])


def test_pages_with_a_gap_are_refused(spark, tmp_path):
    for page in (1, 3):
        (tmp_path / f"k_{page}.json").write_text(json.dumps({"page": page, "instance": "i", "n_rows": 1, "rows": [{"k": page}]}))
    with pytest.raises(Q.GateError, match="1 to N"):
        S.read_pages(spark, str(tmp_path), "k", "k int", ["k"])


def test_writes_and_exports(spark, tmp_path):
    assert S.load_with_count(spark.range(7), f"file://{tmp_path}/n") == 7
    S.write_table(spark.range(4).withColumn("p", F.col("id") % 2), f"file://{tmp_path}/p", ["p"])
    S.write_table(spark.createDataFrame([(9, 1)], "id long, p long"), f"file://{tmp_path}/p", ["p"])
    assert sorted(r.id for r in spark.read.parquet(f"file://{tmp_path}/p").collect()) == [0, 2, 9]
    table = S.export_inventory(spark.range(3), f"file://{tmp_path}/x", [F.desc("id")], 2)
    assert table.splitlines()[2:] == ["| 1 | 2 |", "| 2 | 1 |"]


def test_stage_stream_equals_one_batch(spark, tmp_path):
    folder, table = tmp_path / "in", f"file://{tmp_path}/t"
    folder.mkdir()
    schema = "text string, path string, idx int"
    rows = [{"text": "a b", "path": "p", "idx": 0}, {"text": "A  b", "path": "q", "idx": 1}, {"text": "c", "path": "p", "idx": 2}]
    for i in range(3):
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, rows[: i + 1])))
        T.stage_stream(spark, str(folder), schema, table, f"file://{tmp_path}/c").awaitTermination()
    empty = spark.createDataFrame([], "id string, refs array<struct<path:string,idx:int>>")
    want = T.stage(spark.createDataFrame([tuple(r.values()) for r in rows], schema), empty)
    assert sorted(map(str, T.read_staged(spark, table).collect())) == sorted(map(str, want.collect()))


def test_registry_is_rebuilt_only_for_another_version(spark, tmp_path):
    built = []
    build = lambda: built.append(1) or spark.range(len(built))
    for version in ("1", "1", "2"):
        n = T.ensure_registry(spark, f"file://{tmp_path}/r", version, build).count()
    assert len(built) == 2 and n == 2


def test_embedding_runs_once_a_changed_text(spark):
    texts = spark.createDataFrame([(1, 0, "a"), (2, 0, "a"), (3, 0, "b")], "owner_id long, slot int, text string")
    stored = spark.createDataFrame([(3, 0, "x", "m", [1.0]), (9, 0, "y", "m", [1.0])], "owner_id long, slot int, text_hash string, model string, embedding array<double>")
    out = T.embed_changed(texts, stored, "m", lambda c: F.array(F.length(c).cast("double")))
    assert sorted(r.owner_id for r in out.collect()) == [1, 2, 3]


def test_knn_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (60, 4)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = df.where("vec_id < 7").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r["rank"]): r.vec_id for r in V.knn(q, df, 9, block=3).collect()}
    for i in range(7):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1)).round(9)
        want = sorted(range(60), key=lambda j: (d[j], j))[:9]
        assert [got[i, r] for r in range(1, 10)] == want


def test_knn_approx_recall(spark):
    x = np.random.default_rng(2).normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>")
    q = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    for block in (7, 60):
        both = V.topk_overlap(V.knn(q, df, 10), vector_index.knn_approx(q, df, 10, block=block), "vec_id")
        assert both.agg(F.avg("overlap")).first()[0] >= 9
    assert vector_index.knn_approx(q, df.limit(0), 3).count() == 0
    one = vector_index.knn_approx(q, df.where("vec_id = 5"), 3).collect()
    assert {(r.vec_id, r["rank"]) for r in one} == {(5, 1)} and len(one) == 30


def test_knn_approx_reads_few_of_many_clustered_vectors(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(300, 32))[rng.integers(0, 300, 50_000)] + 0.3 * rng.normal(size=(50_000, 32))).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(50_000), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    q = df.where("vec_id % 500 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = vector_index.build_index(df)
    assert index.candidate_share(q) < 0.1
    found = {}
    for r in index.search(q, 10).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = {i: set(np.argsort(((x - x[i]) ** 2).sum(1))[:10].tolist()) for i in range(0, 50_000, 500)}
    assert sum(len(found[i] & want[i]) for i in want) >= 0.9 * 10 * len(want)


def test_ranks_within_groups_and_the_cache(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "hot" if i % 3 else f"g{i % 7}", rng.normal(size=4).round(1).tolist()) for i in range(240)]
    df = spark.createDataFrame([*rows, (998, None, [1.0] * 4), (999, "hot", None)], "vec_id long, grp string, embedding array<double>")
    asked = df.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "request_id")
    got = {}
    for r in sorted(V.rank_within(asked, df, "grp", "vec_id", 4, block=9).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.request_id, []).append((r.vec_id, r.score))
    for i, g, v in rows:
        if i % 5 == 0:
            score = lambda w: round(float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w) + 1e-9)), 6)  # noqa: E731, B023
            assert [x for x, _ in got[i]] == [j for _, j in sorted((-score(w), j) for j, h, w in rows if h == g)[:4]]
    texts = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bb"), (4, " "), (5, None)], "id long, text string")
    length = lambda c: F.array(F.length(c).cast("double"))
    none = spark.createDataFrame([], "text_hash string, model string, embedding array<double>")
    made, fresh = V.cached_vectors(texts, none, "m", length)
    assert fresh.count() == 2 and {r.id: r.embedding for r in made.collect()} == {1: [1.0], 2: [1.0], 3: [2.0], 4: None, 5: None}
    wrong = lambda c: F.array(F.lit(-1.0))
    again, fresh = V.cached_vectors(texts.union(spark.createDataFrame([(6, "new")], texts.schema)), fresh, "m", wrong)
    assert fresh.count() == 1 and {r.id: r.embedding for r in again.collect()}[3] == [2.0]
    assert V.cached_vectors(texts, fresh, "other", wrong)[1].count() == 2


def test_votes_follow_the_snapshot_and_ties_stay(spark):
    nodes = spark.createDataFrame([("a", "X", None), ("b", "Y", None), ("c", None, "Y"), ("d", None, None), ("e", None, None)], "node string, family string, own string")
    joins = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "a"), ("d", "b"), ("e", "d"), ("e", "c")], "node string, other string")
    lineage = spark.createDataFrame([], "node string, other string")
    got = {r.node: r.family for r in G.vote_fixpoint(nodes, lineage, joins).collect()}
    assert got == {"a": "X", "b": "Y", "c": "Y", "d": "tie", "e": "Y"}


def test_cycles_end_closure_and_fail_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    got = G.closure(spark.createDataFrame([("a",)], "seed string"), edges).collect()
    assert sorted((r.node, r.depth) for r in got) == [("a", 0), ("b", 1), ("c", 2)]
    with pytest.raises(ValueError, match="cycle"):
        G.dependency_depth(edges.union(spark.createDataFrame([("x", "y"), ("b", "y")], "src string, dst string")))


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(63)], "src long, dst long").coalesce(1)
    got = G.closure(spark.createDataFrame([(0,)], "seed long").coalesce(1), edges).collect()
    assert sorted((r.node, r.depth) for r in got) == [(i, i) for i in range(64)]


def test_alias_loops_are_refused(spark):
    edges = spark.createDataFrame([("q", "a", "q", "b", None), ("q", "b", "q", "a", None)], "block string, alias string, source_block string, source_alias string, agg string")
    with pytest.raises(ValueError, match="loop"):
        G.resolve_alias_chain(spark.createDataFrame([(1, "q", "a")], "output long, block string, alias string"), edges, 4)


def test_a_cluster_needs_a_shared_folder():
    assert shared.folder_of("hdfs://x/y", "yarn") == "hdfs://x/y" and shared.folder_of(None, "local[4]").startswith("file://")
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,1000]", "k8s://h"):
        with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
            shared.folder_of(None, master)


def plain_suggestions(request, names, k):
    q = request.strip().upper()
    scored = []
    for n in names:
        a, prev = q, list(range(len(n) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(n, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
            prev = row
        if not q or n == q:
            continue
        if q in n or n in q:
            scored.append((abs(len(n) - len(q)) * 0.5, n))
        elif prev[-1] <= max(2, len(q) // 3):
            scored.append((prev[-1] + 5.0, n))
    return [(n, s) for s, n in sorted(scored)[:k]]


def test_suggestions_equal_plain_ones(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("ABCD_"), rng.integers(1, 9)))
    names, requests = sorted({word() for _ in range(120)}), sorted({word().lower() for _ in range(40)} | {"", "a", "zz"})
    out = K.suggest(spark.createDataFrame([(r,) for r in requests], "request string"), spark.createDataFrame([(n,) for n in names], "name string"), 6)
    got = {}
    for r in sorted(out.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.request, []).append((r.name, r.score))
    assert got == {r: w for r in requests if (w := plain_suggestions(r, names, 6))}


def test_short_requests_find_titles_and_prefixes(spark):
    titles = spark.createDataFrame([("Abc",), ("xab",), ("c",), ("éa",)], "title string")
    asked = spark.createDataFrame([("a",), ("AB",), ("c",), ("É",), ("",), ("abcd",)], "request string")
    got = sorted((r.request, r.title) for r in P.near_titles(asked, titles).collect())
    assert got == sorted((q, t) for q in ("a", "AB", "c", "É", "abcd") for t in ("Abc", "xab", "c", "éa") if q.lower() in t.lower())
    docs = spark.createDataFrame([(1, "big apple"), (2, "big a"), (3, "apple big")], "id long, t string")
    assert sorted(r.id for r in text_index.phrase_search(spark.createDataFrame([("q", "big a")], "query_id string, query string"), docs, "t", "id").collect()) == [1, 2]
    labels = spark.createDataFrame([("Ａ—b",), ("a – b",), (None,), ("plain - x",)], "t string")
    assert [r[0] for r in labels.select(C.norm_label(F.col("t"))).collect()] == ["a-b", "a - b", None, "plain - x"]


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert V.knn(none.withColumnRenamed("vec_id", "query_id"), none, 3).count() == 0
    assert G.closure(spark.createDataFrame([], "seed string"), spark.createDataFrame([], "src string, dst string")).count() == 0

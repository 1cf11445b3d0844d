"""Stored releases, seeds ranked by sketches, and help on references that don't resolve."""

import random
import shutil
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusforge.operators import graph as G
from corpusforge.operators import search as K
from corpusforge.sources import content_tree as R

SCHEMA = "id long, name string, price double, tags array<string>"


def rows_of(rnd, n):
    out = [(rnd.randrange(n), rnd.choice(["a", "b", None, ""]), rnd.choice([0.5, None, -1.0]), rnd.choice([None, [], ["x", None]])) for _ in range(n)]
    return out + out[:5] + [(None, "lost", None, None)] * 3


def kept(rows):
    return Counter((r[0], r[1], r[2], None if r[3] is None else tuple(r[3])) for r in rows)


def save(spark, rows, path, **kw):
    R.save_release(spark.createDataFrame(rows, SCHEMA), f"file://{path}", ["id"], **({"leaves": 20, "fanout": 4} | kw))
    return f"file://{path}"


def test_diff_of_releases_reads_differing_leaves_only(spark, tmp_path):
    rnd = random.Random(3)
    old = rows_of(rnd, 300)
    new = [r for r in old if r[0] != 7] + [(7, "seven", None, None)] * 2 + [(None, "lost", None, None)]
    new[0] = (*new[0][:2], 9.0, new[0][3])
    a, b = save(spark, old, tmp_path / "a"), save(spark, new, tmp_path / "b")
    odd = {leaf for leaf, _, _ in R.changed_leaves(spark, a, b)}
    assert 1 <= len(odd) <= 3
    for side in ("a", "b"):  # what isn't read can be gone
        for folder in Path(tmp_path / side / "data").glob(f"{R.LEAF}=*"):
            if int(folder.name.split("=")[1]) not in odd:
                shutil.rmtree(folder)
    got = Counter()
    for r in R.diff_releases(spark, a, b).collect():
        got[(r["id"], r["name"], r["price"], None if r["tags"] is None else tuple(r["tags"]), r["side"])] += r["n"]
    only_a, only_b = kept(old) - kept(new), kept(new) - kept(old)
    assert got == Counter({(*k, "a"): n for k, n in only_a.items()} | {(*k, "b"): n for k, n in only_b.items()})
    (counts,) = R.compare_releases(spark, {"t": (a, b)}).collect()
    assert (counts["only_built"], counts["only_previous"]) == (only_a.total(), only_b.total())
    assert R.release_count(spark, b) == len(new)


def test_equal_releases_need_the_root_only(spark, tmp_path):
    rows = rows_of(random.Random(4), 100)
    a, b = save(spark, rows, tmp_path / "a"), save(spark, rows[::-1], tmp_path / "b")
    for side in ("a", "b"):
        shutil.rmtree(tmp_path / side / "data")
        for level in (1, 2):
            shutil.rmtree(tmp_path / side / "tree" / f"level={level}")
    assert R.changed_leaves(spark, a, b) == []
    assert R.diff_releases(spark, a, b).count() == 0


def test_moved_nulls_and_copies_change_a_digest(spark, tmp_path):
    base = [(1, None, None, ["x"]), (1, "x", None, None), (2, "y", 1.0, None)]
    a = save(spark, base, tmp_path / "a", leaves=1)
    for i, other in enumerate([[(1, "x", None, None)] * 2 + base[2:], base + base[:1], [(1, None, None, None), (1, "x", None, ["x"]), base[2]], []]):
        assert R.changed_leaves(spark, a, save(spark, other, tmp_path / f"b{i}", leaves=1))
    assert R.diff_releases(spark, a, f"file://{tmp_path}/b3").count() == 3


def test_broken_and_unlike_releases_are_refused(spark, tmp_path):
    rows = rows_of(random.Random(5), 20)
    a, b = save(spark, rows, tmp_path / "a"), save(spark, rows, tmp_path / "b", leaves=10)
    with pytest.raises(ValueError, match="differ in columns"):
        R.changed_leaves(spark, a, b)
    (tmp_path / "b" / "_release.json").unlink()
    with pytest.raises(ValueError, match="no whole release"):
        R.release_count(spark, b)


def plain_top(seeds, edges, chars, n):
    down = {}
    for s, t in edges:
        down.setdefault(s, set()).add(t)
    rows = []
    for seed in seeds:
        depth, wave, d = {seed: 0}, [seed], 0
        while wave:
            d += 1
            wave = sorted({t for s in wave for t in down.get(s, ()) if t not in depth})
            depth.update(dict.fromkeys(wave, d))
        rows.append((seed, len(depth), max(depth.values())))
    return sorted(rows, key=lambda r: (-r[1], -r[2], -chars[r[0]], r[0]))[:n]


@pytest.mark.parametrize("kind", ["layers", "cycles", "none"])
def test_top_seeds_without_all_closures(spark, monkeypatch, kind):
    rnd, size = random.Random(6), 240
    if kind == "layers":  # each layer reaches into the next: early layers reach most
        edges = [(i, rnd.randrange((i // 20 + 1) * 20, (i // 20 + 2) * 20)) for i in range(size - 20) for _ in range(2)]
    elif kind == "cycles":
        edges = [(rnd.randrange(size), rnd.randrange(size)) for _ in range(size)] + [(5, 5), (1, 2), (2, 1)]
    else:
        edges = []
    seeds = list(range(0, size, 2)) if kind != "none" else [3, 1, 2]
    chars = {s: s % 7 for s in seeds}
    made, closure = [], G.closure

    def counted(*args):
        out = closure(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(G, "closure", counted)
    df = spark.createDataFrame([(s, chars[s]) for s in seeds], "seed long, chars long")
    got = G.top_seeds(df.select("seed"), spark.createDataFrame(edges, "src long, dst long"), df, 5, k=8)
    want = plain_top(seeds, edges, chars, 5)
    assert [tuple(r) for r in got.collect()] == want
    if kind == "layers":
        every = plain_top(seeds, edges, chars, len(seeds))
        assert sum(made) < 0.7 * sum(r[1] for r in every)


def test_top_seeds_of_odd_texts(spark, monkeypatch):
    """Seeds without a text's row are out, as in rank_seeds; a null length is the shortest; equal rows go by seed."""
    edges = spark.createDataFrame([(i, i + 100) for i in range(1, 9)], "src long, dst long")
    meta = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, 0), (6, None)], "seed long, chars long")
    seeds = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 6)], "seed long")
    for n in (2, 4, 5, 9):
        want = G.rank_seeds(G.closure(seeds, edges), meta, n).collect()
        assert G.top_seeds(seeds, edges, meta, n, k=4).collect() == want
    made, closure = [], G.closure
    monkeypatch.setattr(G, "closure", lambda *a: made.append(a) or closure(*a))
    G.top_seeds(seeds, edges, meta, 2, k=4).collect()
    assert len(made) == 1  # all six tie in size and depth: lengths decide, no other closure is made


def test_sketches_are_exact_below_k(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, 6)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    got = {r["node"]: (r["n"], r["estimate"]) for r in G.reach_sketches(nodes, edges, 5).collect()}
    assert {n: got[n][0] for n in got} == {1: 3, 2: 3, 3: 3, 4: 4, 5: 5, 6: 1, 7: 1}
    assert got[4][1] == 4.0 and got[5][1] > 0


def test_union_closure_gives_each_node_once(spark):
    edges = spark.createDataFrame([(1, 3), (2, 3), (3, 4), (4, 3), (8, 9)], "src long, dst long")
    waves = spark.createDataFrame([(3, 1), (4, 0), (9, 0)], "node long, depth int")
    got = G.union_closure(spark.createDataFrame([(1,), (2,), (2,)], "seed long"), edges, waves)
    assert sorted(map(tuple, got.collect())) == [(1, None), (2, None), (3, 1), (4, 0)]


def test_misses_name_holders_and_nearest(spark):
    catalog = spark.createDataFrame([("Sales", "Orders", "Amount"), ("Sales", "Orders", "Order Date"), ("Sales", "Lines", "Line No"), ("Sales", "Lines", "Amount"), ("Stock", "Items", "Amounts")], "area string, folder string, column string")
    refs = [(1, "Sale", "Orders", "Amount"), (2, "sales", "Order", "Amount"), (3, "Sales", "Orders", "line no"), (4, "Sales", None, "Amount"), (5, "Sales", "Orders", "Amuont"), (6, "Sales", "Orders", "Amount"), (7, None, "x", "y"), (8, "Sales", "Lines", None), (9, "Sales", None, "Gone")]
    got = K.explain_misses(spark.createDataFrame(refs, "ref_id int, area string, folder string, column string"), catalog)
    found = {}
    for r in got.orderBy("ref_id", F.desc("kind"), "rank").collect():
        found.setdefault(r["ref_id"], []).append((r["kind"], r["suggestion"]))
    assert found == {1: [("area", "Sales")], 2: [("folder", "Orders")], 3: [("holder", "Lines")], 4: [("holder", "Lines"), ("holder", "Orders")], 5: [("column", "Amount")]}

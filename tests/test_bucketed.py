"""Bucketed tables: which files a batch leaves alone, crashes between data and commit, replays, two writers."""

import pytest
from pyspark.sql import functions as F

from corpusforge.sources import bucketed
from corpusforge.sources.bucketed import BucketedTable, CommitLog
from corpusforge.streaming import incremental as T

ROWS = "id long, source string, v string"


@pytest.fixture
def table(spark, tmp_path):
    made = BucketedTable.create(spark, f"file://{tmp_path}/t", ROWS, "id", buckets=8)
    made.upsert(spark.createDataFrame([(i, "a", "old") for i in range(100)], ROWS))
    return made


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_batch_rewrites_its_buckets_only(spark, table):
    before = table.snapshot()[1]["files"]
    assert len(before) == 8
    new = spark.createDataFrame([(3, "a", "new")], ROWS)
    cell = str(new.select(table.cell()).first()[0])
    table.upsert(new)
    after = table.snapshot()[1]["files"]
    assert {c for c in before if before[c] != after[c]} == {cell}
    assert rows(table.read()) == sorted((i, "a", "new" if i == 3 else "old") for i in range(100))
    assert rows(table.read(1)) == [(i, "a", "old") for i in range(100)]
    assert set(table.read_keys(spark.createDataFrame([(3,), (777,)], "id long")).collect()) == {(3, "a", "new")}
    table.delete(spark.createDataFrame([(3,), (4,)], "id long"))
    assert table.read().count() == 98


def test_a_crash_before_the_commit_changes_nothing_and_a_replay_is_committed_once(spark, table, monkeypatch):
    held = rows(table.read())
    new = spark.createDataFrame([(i, "a", "new") for i in range(50)], ROWS)
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.upsert(new, stream="s", batch_id=0)
    assert rows(table.read()) == held
    done = table.upsert(new, stream="s", batch_id=0)
    assert table.upsert(new.withColumn("v", F.lit("again")), stream="s", batch_id=0) == done
    assert table.read().where("v = 'new'").count() == 50
    other = table.upsert(new.withColumn("v", F.lit("third")), stream="t", batch_id=0)  # another stream's batch
    assert other == done + 1 and table.read().where("v = 'third'").count() == 50
    kept = rows(table.read())
    assert table.vacuum(keep=1) > 0 and rows(table.read()) == kept
    assert table.vacuum(keep=1) == 0 and table.log.versions() == [other]


def test_of_two_writers_the_later_starts_again(spark, table):
    done = []

    def merge(old, batch):
        if not done:
            done.append(BucketedTable(spark, table.path).upsert(spark.createDataFrame([(1, "a", "first"), (2, "a", "first")], ROWS)))
        return old.join(batch.select("id"), "id", "left_anti").unionByName(batch)

    table.apply(spark.createDataFrame([(2, "a", "second")], ROWS), merge)
    assert {r.id: r.v for r in table.read().where("id in (1, 2)").collect()} == {1: "first", 2: "second"}
    assert table.log.commit(1, {}) is False


def test_a_snapshot_a_source_touches_its_cells_only(spark, tmp_path):
    t = BucketedTable.create(spark, f"file://{tmp_path}/l", ROWS, "id", buckets=4, lead="source", leads=5)
    t.upsert(spark.createDataFrame([(i, f"s{i % 6}", "old") for i in range(120)], ROWS))
    before = t.snapshot()[1]["files"]
    new = spark.createDataFrame([(i, "s2", "new") for i in (2, 500)], ROWS)
    group = new.select(t.cell()).first()[0] // 4
    t.replace_leads(new)
    after = t.snapshot()[1]["files"]
    assert {int(c) // 4 for c in before if before[c] != after.get(c)} == {group}
    assert rows(t.read()) == sorted([(i, f"s{i % 6}", "old") for i in range(120) if i % 6 != 2] + [(2, "s2", "new"), (500, "s2", "new")])
    with pytest.raises(ValueError, match="doesn't touch"):
        t.apply(new, lambda old, b: old.unionByName(spark.createDataFrame([(i, "s0", "x") for i in range(99)], ROWS)))


def test_compaction_keeps_rows(spark, table):
    table.apply(spark.createDataFrame([(0, "a", "x")], ROWS), lambda old, b: old.unionByName(b))
    version, entry = table.snapshot()
    cell, files = next(iter(entry["files"].items()))
    extra = table._written(table.read().where(table.cell() == int(cell)).withColumn("v", F.lit("more")))
    table.log.commit(version + 1, entry | {"files": entry["files"] | {cell: files + extra[cell]}})
    held = rows(table.read())
    assert table.compact() == version + 2 and rows(table.read()) == held
    assert all(len(f) == 1 for f in table.snapshot()[1]["files"].values()) and table.compact() == version + 2


def test_registry_survives_a_failed_build(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/r"
    one = T.ensure_registry(spark, path, "1", lambda: spark.range(3))
    assert one.count() == 3

    def broken():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        T.ensure_registry(spark, path, "2", broken)
    with monkeypatch.context() as m:
        m.setattr(bucketed.CommitLog, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            T.ensure_registry(spark, path, "2", lambda: spark.range(9))
    assert T.ensure_registry(spark, path, "1", broken).count() == 3
    assert T.ensure_registry(spark, path, "2", lambda: spark.range(9)).count() == 9

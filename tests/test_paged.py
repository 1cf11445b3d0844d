"""The format of numbered pages: gates, pruning, types and streams."""

import json

import pytest

from corpusforge.operators.quality import GateError
from corpusforge.sources import paged as P

SCHEMA = "page int, instance string, row_no int, name string, n long, tags array<string>"


def put(folder, number, rows, file=None, **header):
    page = {"page": number, "instance": "a", "n_rows": len(rows), "rows": rows} | header
    (folder / (file or f"objects_{number}.json")).write_text(json.dumps(page))


def read(spark, folder, **given):
    return P.read_numbered_pages(spark, str(folder), SCHEMA, kind="objects", **given)


@pytest.fixture
def pages(tmp_path):
    put(tmp_path, 1, [{"name": "x", "n": 1, "extra": 5}, {"name": None, "tags": ["p", None]}])
    put(tmp_path, 2, [])
    put(tmp_path, 3, [{"name": "é\n", "n": 2**40}] * 2)
    (tmp_path / "objects_notes.json").write_text("no page")
    (tmp_path / "other_1.json").write_text("no page")
    (tmp_path / "_objects_4.json").write_text("being written")
    return tmp_path


def test_rows_of_all_pages(spark, pages):
    want = [(1, "a", 0, "x", 1, None), (1, "a", 1, None, None, ["p", None]), (3, "a", 0, "é\n", 2**40, None), (3, "a", 1, "é\n", 2**40, None)]
    assert sorted((tuple(r) for r in read(spark, pages, instance="a").collect()), key=lambda r: r[:3]) == want
    assert [r.n for r in P.read_numbered_pages(spark, str(pages), "n long", kind="objects").where("n > 1").collect()] == [2**40] * 2
    assert read(spark, "file://" + str(pages)).count() == 4


def test_small_pages_share_tasks_and_large_ones_do_not():
    files = [P.PageFile(i, str(i), size) for i, size in enumerate((4, 5, 30, 1, 9, 1), 1)]
    assert [[p.number for p in g.pages] for g in P.grouped(files, 10)] == [[1, 2], [3], [4, 5], [6]]
    assert P.grouped([], 10) == []
    assert P.whole_run(files[:2] + files[3:]) == 2 and P.whole_run([]) == 0


def test_filters_on_page_prune_files(spark, pages):
    """Page 1 is broken inside: a read that opens it fails, one that prunes it doesn't."""
    (pages / "objects_1.json").write_text("{")
    before = spark.conf.get(P._PUSHDOWN)
    try:
        spark.conf.set(P._PUSHDOWN, "false")
        with pytest.raises(Exception, match="objects_1.json: not a page"):
            read(spark, pages).where("page > 1").collect()
        spark.conf.set(P._PUSHDOWN, "true")
        for test, n in (("page > 1", 2), ("page >= 2 and n > 5", 2), ("page = 3", 2), ("page in (2, 3) and name = 'no'", 0), ("page < 3 and page > 1", 0), ("page > 9", 0), ("page <= 3 and page <> 1 and page > 2", 2)):
            assert read(spark, pages).where(test).count() == n, test
        with pytest.raises(Exception, match="objects_1.json: not a page"):
            read(spark, pages).where("page <= 2").collect()
    finally:
        spark.conf.set(P._PUSHDOWN, before)


@pytest.mark.parametrize(
    "break_, message",
    [
        (lambda d: (d / "objects_2.json").unlink(), "pages 1 to 1 are whole"),
        (lambda d: put(d, 3, [], file="objects_03.json"), "4 files from 1 to 3"),
        (lambda d: put(d, 2, [], n_rows=1), "0 of 1 rows"),
        (lambda d: put(d, 2, [], page=5), "holds page 5"),
        (lambda d: put(d, 2, [], instance="b"), "from instance b"),
        (lambda d: put(d, 2, [{"n": "many"}]), "don't fit the schema"),
        (lambda d: put(d, 2, ["row"]), "don't fit the schema"),
        (lambda d: (d / "objects_2.json").write_text("[1]"), "not a page"),
    ],
)
def test_gates(spark, pages, break_, message):
    break_(pages)
    with pytest.raises(Exception, match=message):
        read(spark, pages, instance="a").collect()


def test_a_folder_without_pages_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="no pages"):
        read(spark, tmp_path).collect()
    with pytest.raises(GateError):
        P.PageReader({"path": str(tmp_path), "kind": "k"}, None).partitions()
    with pytest.raises(ValueError):
        P.PageReader({"path": str(tmp_path)}, None)


def test_a_stream_reads_each_page_once_and_waits_at_gaps(spark, pages, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")

    def step():
        stream = P.stream_numbered_pages(spark, str(pages), "page int, name string", kind="objects")
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(out / "log")).trigger(availableNow=True).start(str(out / "rows"))
        q.awaitTermination(60)
        return sorted(r.page for r in spark.read.schema("page int, name string").parquet(str(out / "rows")).collect())

    assert step() == [1, 1, 3, 3]
    put(pages, 5, [{"name": "late"}])
    assert step() == [1, 1, 3, 3]
    put(pages, 4, [{"name": "y"}])
    assert step() == [1, 1, 3, 3, 4, 5]


def test_written_pages_are_read_again(spark, tmp_path):
    for rows in ([(i, None if i % 3 else "t", i // 4 + 1) for i in range(10)], []):
        path = str(tmp_path / f"p{len(rows)}")
        df = spark.createDataFrame(rows, "k long, t string, page int")
        pattern = P.write_numbered_pages(df, path, "page", "a")
        got = P.read_numbered_pages(spark, path, "k long, t string, page int", pattern=pattern, instance="a")
        assert sorted(got.collect()) == sorted(df.collect())

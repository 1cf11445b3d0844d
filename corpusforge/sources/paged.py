"""The format `numbered_pages`: pages of a folder as planned partitions, pruned by number, or as a stream of pages.

    spark.dataSource.register(NumberedPages)
    spark.read.format("numbered_pages").schema("page int, name string").option("kind", "objects").load(folder)

A page is a JSON object {page, instance, n_rows, rows: [{...}]} in a file of its own. Columns `page`, `instance` and `row_no` (from
0) are the page's; the others are fields of its rows, null where a row lacks them. Only columns of the schema are made.

Options: `kind`: files are `<kind>_<n>.json`; `pattern`: a regex in place of it, searched in the path below the folder, whose first
group is the number; `instance`: the only one allowed; `partition_bytes`: small pages share a task up to so many; `prune`: take
filters on `page`, which needs spark.sql.python.filterPushdown.enabled.

The folder is listed by the planner and pages are opened by tasks, both through pyarrow (local, HDFS, S3 and other stores it
knows), unpacked where their names end in .gz; `files.read_pages` reads stores that only Spark can open. A task holds one page at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..operators.quality import GateError

#: Columns that come from the page; the others come from its rows.
PAGE_COLUMNS = ("page", "instance", "row_no")
BATCH_ROWS = 10_000
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass(frozen=True)
class PageFile:
    number: int
    path: str
    size: int


@dataclass
class PageGroup(InputPartition):
    """Consecutive pages that one task reads."""

    pages: tuple[PageFile, ...]


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/*", "/", path))


def list_pages(folder: str, pattern: str) -> list[PageFile]:
    """Files below the folder whose path matches, by page number; hidden ones (`_` or `.` first) are left out."""
    store, root = _store(folder)
    found = []
    for info in store.get_file_info(pafs.FileSelector(root, recursive=True)):
        below = info.path[len(root) :].lstrip("/")
        number = re.search(pattern, below)
        if info.type == pafs.FileType.File and number and not re.search(r"(^|/)[_.]", below):
            found.append(PageFile(int(number[1]), info.path, info.size))
    return sorted(found, key=lambda p: (p.number, p.path))


def whole_run(pages: Sequence[PageFile]) -> int:
    """The N up to which pages 1 to N are all there."""
    n = 0
    for p in pages:
        if p.number == n + 1:
            n = p.number
        elif p.number > n:
            break
    return n


def grouped(pages: Iterable[PageFile], most: int) -> list[PageGroup]:
    """Consecutive pages together while their bytes stay within `most`; a page above it is alone."""
    groups: list[list[PageFile]] = []
    size = 0
    for p in pages:
        if not groups or size + p.size > most:
            groups.append([])
            size = 0
        groups[-1].append(p)
        size += p.size
    return [PageGroup(tuple(g)) for g in groups]


class _Pages:
    """What batches and streams share: listing, and reading the pages of a group."""

    def __init__(self, options: dict[str, str], schema: StructType):
        if "path" not in options or not ("kind" in options or "pattern" in options):
            raise ValueError("numbered_pages: needs a path, and a kind or a pattern")
        self.folder, self.schema = options["path"], schema
        self.pattern = options.get("pattern") or rf"^{re.escape(options['kind'])}_(\d+)\.json$"
        self.instance = options.get("instance")
        self.most = int(options.get("partition_bytes", 64 << 20))

    def listed(self) -> list[PageFile]:
        return list_pages(self.folder, self.pattern)

    def read(self, partition: PageGroup) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.folder)
        schema = to_arrow_schema(self.schema)
        for p in partition.pages:
            with store.open_input_stream(p.path) as stream:
                data = stream.readall()
            yield from self.batches(p, data, schema)

    def batches(self, p: PageFile, data: bytes, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The rows of one page; raises GateError where the page isn't what its name and header say."""
        where = f"numbered_pages: {p.path}"
        try:
            page = json.loads(data)
            rows = page["rows"]
            number, n_rows = page["page"], page["n_rows"]
        except (ValueError, KeyError, TypeError) as e:
            raise GateError(f"{where}: not a page ({e!r})") from e
        if number != p.number:
            raise GateError(f"{where}: holds page {number}")
        if len(rows) != n_rows:
            raise GateError(f"{where}: {len(rows)} of {n_rows} rows")
        if self.instance is not None and page.get("instance") != self.instance:
            raise GateError(f"{where}: from instance {page.get('instance')}")
        for start in range(0, len(rows), BATCH_ROWS):
            part = rows[start : start + BATCH_ROWS]
            own = {"page": [number] * len(part), "instance": [page.get("instance")] * len(part), "row_no": range(start, start + len(part))}
            try:
                columns = [pa.array(own[f.name] if f.name in PAGE_COLUMNS else [r.get(f.name) for r in part], f.type) for f in schema]
            except (pa.ArrowInvalid, pa.ArrowTypeError, AttributeError) as e:
                raise GateError(f"{where}: rows from {start} on don't fit the schema ({e})") from e
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


class PageReader(_Pages, DataSourceReader):
    """All pages; raises at planning, before any page is read, unless they are 1 to N, each in one file."""

    def wanted(self, page: PageFile) -> bool:
        return True

    def partitions(self) -> list[PageGroup]:
        pages = self.listed()
        if not pages:
            raise GateError(f"numbered_pages: no pages in {self.folder}")
        n = whole_run(pages)
        if len(pages) != n:
            raise GateError(f"numbered_pages: {len(pages)} files from {pages[0].number} to {pages[-1].number} in {self.folder}, pages 1 to {n} are whole")
        # a plan without a partition would be asked for one without pages
        return grouped(filter(self.wanted, pages), self.most) or [PageGroup(())]


class PrunedPageReader(PageReader):
    """Pages that filters on `page` leave; the others are neither planned nor opened, but must be there."""

    def __init__(self, options: dict[str, str], schema: StructType):
        super().__init__(options, schema)
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("page",):
                self.tests.append(f)
            else:
                yield f

    def wanted(self, page: PageFile) -> bool:
        return all(_holds(f, page.number) for f in self.tests)


def _holds(f: Filter, number: int) -> bool:
    if isinstance(f, In):
        return number in f.value
    if isinstance(f, EqualTo):
        return number == f.value
    if isinstance(f, GreaterThan):
        return number > f.value
    if isinstance(f, GreaterThanOrEqual):
        return number >= f.value
    if isinstance(f, LessThan):
        return number < f.value
    return number <= f.value


class PageStream(_Pages, DataSourceStreamReader):
    """Pages in order of their numbers; the offset is the last one read. Those after a gap wait until it is filled."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"page": whole_run(self.listed())}

    def partitions(self, start: dict, end: dict) -> list[PageGroup]:
        pages = [p for p in self.listed() if start["page"] < p.number <= end["page"]]
        if [p.number for p in pages] != list(range(start["page"] + 1, end["page"] + 1)):
            raise GateError(f"numbered_pages: pages {start['page'] + 1} to {end['page']} aren't all there once")
        return grouped(pages, self.most)


class NumberedPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "numbered_pages"

    def schema(self) -> str:
        raise ValueError("numbered_pages: name the columns by schema()")

    def reader(self, schema: StructType) -> DataSourceReader:
        pruned = self.options.get("prune", "false").lower() == "true"
        return (PrunedPageReader if pruned else PageReader)(self._plain(), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return PageStream(self._plain(), schema)

    def _plain(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}


def read_numbered_pages(spark: SparkSession, folder: str, schema: str, kind: str | None = None, pattern: str | None = None, instance: str | None = None) -> DataFrame:
    """The pages of a folder; filters on `page` reach the planner where the session allows it."""
    return _with_options(spark, spark.read, schema, kind, pattern, instance).option("prune", spark.conf.get(_PUSHDOWN, "false")).load(folder)


def stream_numbered_pages(spark: SparkSession, folder: str, schema: str, kind: str | None = None, pattern: str | None = None, instance: str | None = None) -> DataFrame:
    """The same as a stream: each page once, in order."""
    return _with_options(spark, spark.readStream, schema, kind, pattern, instance).load(folder)


def _with_options(spark, reader, schema, kind, pattern, instance):
    spark.dataSource.register(NumberedPages)
    given = {"kind": kind, "pattern": pattern, "instance": instance}
    return reader.format("numbered_pages").schema(schema).options(**{k: v for k, v in given.items() if v is not None})


def write_numbered_pages(df: DataFrame, path: str, page: str, instance: str) -> str:
    """Pages of df's rows by its column of page numbers, one gzipped file each, below `page=<n>`; returns the pattern that reads them.

    A page is one value in one task: choose numbers that bound its rows. Page 1 is written even where it is empty.
    """
    fields = [c for c in df.columns if c != page]
    rows = df.select(F.col(page).alias("page"), F.struct(*fields).alias("row"))
    first = df.sparkSession.range(1).select(F.lit(1).alias("page"), F.lit(None).alias("row"))  # lists leave nulls out
    rows = rows.unionByName(first).groupBy("page").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    body = F.to_json(F.struct("page", F.lit(instance).alias("instance"), F.size("rows").alias("n_rows"), "rows"))
    rows.select("page", body.alias("value")).write.mode("overwrite").partitionBy("page").text(path, compression="gzip")
    return r"^page=(\d+)/part-[^/]*$"

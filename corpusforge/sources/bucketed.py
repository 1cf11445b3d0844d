"""Stored tables in hash buckets with a commit log: a batch rewrites the buckets that it touches and no others.

    <path>/_log/00000000000000000007.json   one entry a commit, put only if absent
    <path>/<attempt>/_cell=12/part-*.parquet    what an attempt wrote

An entry names the files of every cell (bucket), so reading needs the last entry alone. Data come first and the entry
last: a crash in between leaves files that no entry names, and the batch runs again from the same snapshot. Entries hold the number
of the last batch of each stream, so a batch that is replayed after its commit changes nothing. Writers at the same time
are told apart by the entry's name: the later one starts again from the new snapshot. `vacuum` removes what the last
entries don't name.

Tables are read and merged by Spark; the driver holds names of files only, some for each cell.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CELL = "_cell"


class CommitLog:
    """Numbered entries under `<path>/_log`, each written once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._at("_log").getFileSystem(conf)
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("_log").toUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def names(self, folder: str = "") -> list[str]:
        """Names of what stands in a folder below the path."""
        at = self._at(folder or ".")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n[:-5]) for n in self.names("_log") if n.endswith(".json") and n[0] != "."]

    def read(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/_log/{version:020d}.json", wholetext=True).first()[0])

    def last(self) -> tuple[int, dict] | None:
        found = self.versions()
        return (found[-1], self.read(found[-1])) if found else None

    def commit(self, version: int, entry: Mapping) -> bool:
        """Whether the entry was put; False if there is one of that number already."""
        draft, final = self._at(f"_log/.{uuid.uuid4().hex}"), self._at(f"_log/{version:020d}.json")
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(entry), "utf-8"))
        out.close()
        try:
            self.context.rename(draft, final, self._no_options)  # fails where `final` exists
            return True
        except Exception as e:  # noqa: BLE001 - py4j wraps what the JVM throws
            self.fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class BucketedTable:
    """A table of rows by `key`, dealt into buckets by the key's hash; with `lead`, by its hash and then the key's.

    A lead (such as the source of a row) keeps its rows in `buckets` of `leads * buckets` cells, so replacing all of a
    lead's rows touches only these.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, CommitLog(spark, path)
        self.path, found = self.log.path, self.log.last()
        if found is None:
            raise ValueError(f"no table at {path}")
        entry = found[1]
        self.key, self.lead, self.buckets, self.leads = entry["key"], entry["lead"], entry["buckets"], entry["leads"]
        self.schema = StructType.fromJson(entry["schema"])

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str | StructType, key: str, buckets: int = 64, lead: str | None = None, leads: int = 16) -> BucketedTable:
        """The table at `path`, made empty if there is none."""
        made = spark.createDataFrame([], schema).schema
        entry = {"schema": made.jsonValue(), "key": key, "lead": lead, "buckets": buckets, "leads": leads if lead else 1, "files": {}, "streams": {}}
        log = CommitLog(spark, path)
        if not log.versions():
            log.commit(0, entry)
        return cls(spark, path)

    def cell(self) -> Column:
        own = F.pmod(F.xxhash64(self.key), F.lit(self.buckets))
        return (own if self.lead is None else F.pmod(F.xxhash64(self.lead), F.lit(self.leads)) * self.buckets + own).cast("int")

    def _read(self, files: Sequence[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in files])

    def snapshot(self) -> tuple[int, dict]:
        return self.log.last()

    def read(self, version: int | None = None) -> DataFrame:
        """All rows, of the last version or of one that is still kept."""
        entry = self.snapshot()[1] if version is None else self.log.read(version)
        return self._read([f for fs in entry["files"].values() for f in fs])

    def read_keys(self, keys: DataFrame) -> DataFrame:
        """Rows of the given keys (and leads): only their cells are read."""
        files = self.snapshot()[1]["files"]
        cells = {str(r[0]) for r in keys.select(self.cell()).distinct().collect()}
        on = [self.key, *([self.lead] if self.lead else [])]
        return self._read([f for c, fs in files.items() if c in cells for f in fs]).join(keys.select(*on).distinct(), on, "left_semi")

    def _written(self, rows: DataFrame) -> dict[str, list[str]]:
        attempt = f"data-{uuid.uuid4().hex}"
        shaped = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).withColumn(CELL, self.cell())
        # Rebalanced and not just dealt out by cell: adaptive execution cuts a large cell into several tasks and files.
        shaped.hint("rebalance", CELL).write.partitionBy(CELL).parquet(f"{self.path}/{attempt}")
        cells = [n for n in self.log.names(attempt) if n.startswith(f"{CELL}=")]
        return {c.split("=")[1]: [f"{attempt}/{c}/{f}" for f in self.log.names(f"{attempt}/{c}") if f.endswith(".parquet")] for c in cells}

    def apply(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], stream: str = "", batch_id: int | None = None, whole_leads: bool = False) -> int:
        """Replaces the rows of the cells that `batch` touches by merge(rows there, batch); the version committed.

        `batch` has the key (and lead). With whole_leads all cells of its leads are touched. A (stream, batch_id)
        that was committed before is left alone. A merge may only give rows of cells that it was given.
        """
        while True:
            version, entry = self.snapshot()
            if batch_id is not None and entry["streams"].get(stream, -1) >= batch_id:
                return version
            cells = {int(r[0]) for r in batch.select(self.cell()).distinct().collect()}
            if whole_leads:
                cells = {g * self.buckets + b for g in {c // self.buckets for c in cells} for b in range(self.buckets)}
            files = entry["files"]
            old = self._read([f for c in sorted(cells) for f in files.get(str(c), [])])
            new = self._written(merge(old, batch))
            if strange := set(new) - {str(c) for c in cells}:
                raise ValueError(f"the merge gave rows of cells {sorted(strange)}, which the batch doesn't touch")
            kept = {c: fs for c, fs in files.items() if int(c) not in cells}
            streams = entry["streams"] | ({stream: batch_id} if batch_id is not None else {})
            if self.log.commit(version + 1, entry | {"files": kept | new, "streams": streams}):
                return version + 1

    def upsert(self, new: DataFrame, **kw) -> int:
        """U4 on the stored table: rows of `new` (one a key) in place of those of their keys."""
        return self.apply(new, lambda old, b: old.join(b.select(self.key), self.key, "left_anti").unionByName(b.select(*old.columns)), **kw)

    def delete(self, keys: DataFrame, **kw) -> int:
        return self.apply(keys, lambda old, b: old.join(b.select(self.key), self.key, "left_anti"), **kw)

    def replace_leads(self, new: DataFrame, **kw) -> int:
        """U6 on the stored table: `new` in place of all rows of its leads (a snapshot a source)."""
        if self.lead is None:
            raise ValueError("the table has no lead column")
        return self.apply(new, lambda old, b: old.join(b.select(self.lead).distinct(), self.lead, "left_anti").unionByName(b.select(*old.columns)), whole_leads=True, **kw)

    def compact(self) -> int:
        """Writes cells that have several files as one each; the version committed."""
        while True:
            version, entry = self.snapshot()
            many = {c: fs for c, fs in entry["files"].items() if len(fs) > 1}
            if not many:
                return version
            new = self._written(self._read([f for fs in many.values() for f in fs]))
            if self.log.commit(version + 1, entry | {"files": entry["files"] | new}):
                return version + 1

    def vacuum(self, keep: int = 2) -> int:
        """Removes entries before the last `keep` and data that no kept entry names; call it while nobody writes. Files removed."""
        versions = self.log.versions()
        named = {f for v in versions[-keep:] for fs in self.log.read(v)["files"].values() for f in fs}
        removed = 0
        for attempt in [n for n in self.log.names() if n.startswith("data-")]:
            cells = self.log.names(attempt)
            files = [f"{attempt}/{c}/{f}" for c in cells if c.startswith(CELL) for f in self.log.names(f"{attempt}/{c}")]
            gone = [f for f in files if f not in named and f.endswith(".parquet")]
            removed += len(gone)
            if len(gone) == len([f for f in files if f.endswith(".parquet")]):
                self.log.remove(attempt)
            else:
                for f in gone:
                    self.log.remove(f)
        for v in versions[:-keep]:
            self.log.remove(f"_log/{v:020d}.json")
        return removed


def rebuilt(spark: SparkSession, path: str, stamp: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows at `path`, built anew only if the stamp that they were built with differs. The entry comes last: a crash
    while building leaves the former rows in place."""
    log = CommitLog(spark, path)
    while True:
        found = log.last()
        if found and found[1]["stamp"] == stamp:
            return spark.read.parquet(f"{log.path}/{found[1]['folder']}")
        folder = f"data-{uuid.uuid4().hex}"
        build().write.parquet(f"{log.path}/{folder}")
        if log.commit(found[0] + 1 if found else 0, {"stamp": stamp, "folder": folder}) and found:
            log.remove(found[1]["folder"])


"""Ids of their own for rows that have none or share one, so that each row is a document of its own in joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import saved

GIVEN = "_given_id"


class Numbered:
    """`docs` with a doc_id (long) of each row's own; rows whose doc_id is null or repeated have numbers above all ids.

    Those rows are saved, as their numbers hold for one run only; the others stay as they are. In their order
    they come after all others. Where there are such rows, `docs` has the ids as given in a column GIVEN.
    Raises if there is no room above the largest id.
    """

    def __init__(self, docs: DataFrame, few: int = 100_000):
        self.kind = docs.schema["doc_id"].dataType
        self.docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
        repeated = saved(self.docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
        n = repeated.count()
        self.odd = n > 0 or not self.docs.where("doc_id is null").isEmpty()
        if not self.odd:
            return
        largest = self.docs.agg(F.max("doc_id")).first()[0]
        least = max(-1, largest if largest is not None else -1) + 1
        some = F.broadcast(repeated) if n <= few else repeated
        odd = self.docs.where("doc_id is null").unionByName(self.docs.join(some, "doc_id", "left_semi").select(*docs.columns))
        odd = saved(odd.withColumn(GIVEN, F.col("doc_id")).withColumn("doc_id", F.monotonically_increasing_id()))
        if least + (odd.agg(F.max("doc_id")).first()[0] or 0) >= 1 << 63:
            raise ValueError("rows with a null or repeated doc_id: no numbers are left above the largest doc_id")
        odd = odd.withColumn("doc_id", F.col("doc_id") + F.lit(least).cast("long"))
        own = self.docs.where("doc_id is not null").join(some, "doc_id", "left_anti").select(*docs.columns)
        self.docs = own.withColumn(GIVEN, F.col("doc_id")).unionByName(odd)

    def columns(self) -> list[str]:
        """The columns that carry a row's number and, where it differs, its given id."""
        return ["doc_id", GIVEN] if self.odd else ["doc_id"]

    def given(self) -> Column:
        """A row's id as it was given, in frames that keep `columns`."""
        return F.col(GIVEN if self.odd else "doc_id").cast(self.kind)

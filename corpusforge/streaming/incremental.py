"""Incremental operators T1 to T12: batch functions, and T1 as a stream of files through foreachBatch."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import content_id, raw_hash
from ..operators.picks import top_k
from ..sources.bucketed import BucketedTable, rebuilt


def stage(batch: DataFrame, base: DataFrame) -> DataFrame:
    """Base (id, refs) with a batch (text, path, idx): new ids inserted, known ids gain each ref once.

    refs: array<struct<path, idx>>. The same batch twice changes nothing.
    """
    new = batch.select(content_id(F.col("text")).alias("id"), F.struct("path", "idx").alias("ref"))
    both = base.select("id", F.explode_outer("refs").alias("ref")).unionByName(new)
    return both.groupBy("id").agg(F.sort_array(F.collect_set("ref")).alias("refs"))


def staged_counts(batch: DataFrame, base: DataFrame) -> DataFrame:
    """(staged, unique_ids, new_ids) of a batch against base."""
    ids = batch.select(content_id(F.col("text")).alias("id"))
    j = ids.join(base.select("id", F.lit(True).alias("_b")), "id", "left")
    return j.agg(F.count("*").alias("staged"), F.countDistinct("id").alias("unique_ids"), F.countDistinct(F.when(F.col("_b").isNull(), F.col("id"))).alias("new_ids"))


STAGED = "id string, refs array<struct<path:string,idx:int>>"


def stage_stream(spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str, buckets: int = 64):
    """T1 as a stream: JSON files that arrive in `folder` are staged into the bucketed table, batch by batch.

    A batch rewrites the buckets of its ids only and is committed once, also if it runs again after a failure.
    Returns the started query.
    """
    held = BucketedTable.create(spark, table, STAGED, "id", buckets)

    def merge(batch: DataFrame, batch_id: int) -> None:
        held.apply(batch.withColumn("id", content_id(F.col("text"))), lambda old, b: stage(b, old), checkpoint, batch_id)

    return spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_staged(spark: SparkSession, table: str) -> DataFrame:
    """The rows of a table of stage_stream."""
    return BucketedTable(spark, table).read()


def upsert_source(base: DataFrame, new: DataFrame, derived: Sequence[str]) -> DataFrame:
    """New rows (id, text) over base (id, hash, derived ...); derived fields stay only while the hash does."""
    n = new.select("id", raw_hash(F.col("text")).alias("_h"))
    j = base.join(n, "id", "full")
    keep = F.col("_h").isNull() | F.coalesce(F.col("_h") == F.col("hash"), F.lit(False))
    return j.select("id", F.coalesce("_h", "hash").alias("hash"), *[F.when(keep, F.col(c)).alias(c) for c in derived])


def pending(sources: DataFrame, base: DataFrame, field: str) -> DataFrame:
    """(id, why): source rows (id, text) that are new, changed or not described in base (id, hash, field)."""
    j = sources.select("id", raw_hash(F.col("text")).alias("_h")).join(base, "id", "left")
    why = F.when(F.col("hash").isNull(), "new").when(F.col("hash") != F.col("_h"), "changed").when(F.col(field).isNull(), "undescribed")
    return j.select("id", why.alias("why")).where("why is not null")


def plan_vectors(texts: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """T4: (owner_id, slot, action): compute, delete or keep, from texts (owner_id, slot, text) and stored vectors
    (owner_id, slot, text_hash, model)."""
    t = texts.select("owner_id", "slot", F.md5("text").alias("_h"))
    s = stored.select("owner_id", "slot", "text_hash", "model")
    same = (F.col("_h") == F.col("text_hash")) & (F.col("model") == model)
    action = F.when(F.col("_h").isNull(), "delete").when(F.coalesce(same, F.lit(False)), "keep").otherwise("compute")
    return t.join(s, ["owner_id", "slot"], "full").select("owner_id", "slot", action.alias("action"))


def embed_changed(texts: DataFrame, stored: DataFrame, model: str, embed: Callable[[Column], Column]) -> DataFrame:
    """T4: stored vectors brought up to date; `embed` (a user's vectorised function) runs once a distinct changed text."""
    plan = plan_vectors(texts, stored, model)
    kept = stored.join(plan.where("action = 'keep'"), ["owner_id", "slot"], "left_semi")
    new = texts.join(plan.where("action = 'compute'"), ["owner_id", "slot"], "left_semi").withColumn("text_hash", F.md5("text"))
    vectors = new.groupBy("text_hash").agg(F.min("text").alias("text")).select("text_hash", embed(F.col("text")).alias("embedding"))
    made = new.join(vectors, "text_hash").select("owner_id", "slot", "text_hash", F.lit(model).alias("model"), "embedding")
    return kept.select(*made.columns).unionByName(made)


def work_queue(rows: DataFrame, in_flight: DataFrame, field: str, size: str, n: int) -> DataFrame:
    """T5: the n largest rows (id, field, size) without the field that aren't in flight."""
    todo = rows.where(F.col(field).isNull()).join(in_flight.select("id"), "id", "left_anti")
    return top_k(todo, [F.desc_nulls_last(size), F.col("id")], n)


def queue_counts(rows: DataFrame, field: str) -> DataFrame:
    """T5: (total, done, pending)."""
    return rows.agg(F.count("*").alias("total"), F.count(field).alias("done"), F.count_if(F.col(field).isNull()).alias("pending"))


def todo(journal: DataFrame, grounding: DataFrame) -> DataFrame:
    """(id): groundings (id, ghash) whose last ok line is missing or of another hash. journal: (id, ok, ghash), compacted."""
    done = journal.where("ok").select("id", "ghash")
    return grounding.join(done, ["id", "ghash"], "left_anti").select("id")


def cohort(rows: DataFrame, members: str, condition: Column) -> DataFrame:
    """Rows that meet a condition, ordered by their set of members, so that like ones are next to each other."""
    return rows.where(condition).withColumn("locality", F.array_join(F.sort_array(F.array_distinct(members)), ",")).orderBy("locality", "id")


def materialise_new(enriched: DataFrame, served: DataFrame) -> DataFrame:
    """Enriched rows (id, description) not served yet whose description isn't blank."""
    return enriched.where(F.trim("description") != "").join(served.select("id"), "id", "left_anti")


def ensure_registry(spark: SparkSession, path: str, version: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The registry at `path`, built anew only if the version (or file hash) it was built with differs."""
    return rebuilt(spark, path, version, build)


def refresh_sources(base: DataFrame, seed: DataFrame, sources: Sequence[str]) -> DataFrame:
    """The seed's rows in place of base's for the given sources, others kept; vectors are kept where the text is the same."""
    some = seed.where(F.col("source").isin(list(sources)))
    old = base.select("id", F.md5("text").alias("_h"), F.col("embedding").alias("_e"))
    fresh = some.drop("embedding").join(old, "id", "left").withColumn("embedding", F.when(F.md5("text") == F.col("_h"), F.col("_e"))).select(*base.columns)
    gone = base.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    return base.join(gone, "source", "left_anti").unionByName(fresh)


def persist_wave(targets: DataFrame, results: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Targets with empty fields filled from results (target field -> result field), by id; filled ones stay."""
    r = results.select("id", *[F.col(v).alias(f"_{k}") for k, v in fields.items()])
    j = targets.join(r, "id", "left")
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    return j.select(*[F.coalesce(blank(c), f"_{c}").alias(c) if c in fields else F.col(c) for c in targets.columns])

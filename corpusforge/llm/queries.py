"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, decontaminate, durable, jaccard_join, language_id, line_dedup, oracle, packing, periodic_runs, quality, sharding, token_output, url_filter, vector_codes

#: Rules of the URL filter's query (fixed values): verdict, host, path prefix.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids; each source's target is its own share."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, Jaccard similarity of 0.9 or more, components over all documents."""
    return jaccard_join.similar_documents(_table(spark, sf_dir, "documents"), size=3, percent=90)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten words of all benchmark items in all documents."""
    spans = decontaminate.contaminated_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    rows = spans.withColumn("n_hit", n_hit)
    digest = F.sha2(F.array_join("items", ","), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns labels.quality from four folds of five and scores all documents."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    known = labels.where(_fold(F.col("doc_id"), 5) != 0).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.train(docs, known))
    held_out = F.coalesce(_fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids in a permuted order, as shards of records of 2048 ids in a folder of the checkpoint folder."""
    return token_output.write_training_order(_table(spark, sf_dir, "documents"), durable.fresh_path(spark, "training-order"))


def op6_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns lang from two folds of three and predicts it for all documents."""
    docs = _table(spark, sf_dir, "documents")
    fold = _fold(F.col("doc_id"), 3)
    model = language_id.learn_profiles(docs.where(fold != 1).select("doc_id", "text", "lang"))
    found = language_id.identify(docs, model)
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    placed = sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges all pages by five rules and, where none fits, by trees learnt from the others."""
    judged = url_filter.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", F.col("rule"), "verdict")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of which documents repeat an earlier one, up to one word's edit."""
    return line_dedup.line_counts(_table(spark, sf_dir, "documents"))


def _with_tails(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by crc32 of their ids, get a periodic tail: words from `_a` on repeat the `_p` words there."""
    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("_h"))
    words = F.when(F.col("_h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = hashed.withColumns({"_w": words, "_g": F.floor(F.col("_h") / 10)}).withColumn("_n", F.size("_w"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, (F.col("_g") % F.col("_n")).cast("int")))
    rows = rows.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)).cast("int"))
    tailed = F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_w", F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), F.array_join(tailed, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of at least four periods and six words in all documents, a tenth of which get a periodic tail."""
    found = periodic_runs.find_runs(_with_tails(_table(spark, sf_dir, "documents")), least=6, exponent=4)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r.alias("run"))))
    best = found.withColumn("best", longest.getField("run"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    every = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    r = F.col("best")
    milli = F.floor(1000 * r["length"] / r["period"])
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"), milli.alias("exponent_milli"), F.sha2(every, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: eight parts, 16 entries each, six rounds; errors by row and by label."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vector_codes.train(rows, parts=8, entries=16, rounds=6, scale=4096)
    coded = vector_codes.with_label_error(vector_codes.encode(rows, books))
    numbers = ",".join(str(c) for book in books.final for entry in book for c in entry)
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.sha2(F.lit(numbers), 256).alias("codebooks_sha256"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids of the multilingual byte-level vocabulary, and decoded again."""
    coded = byte_bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))
    back = byte_bpe.decode(ids)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("data", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_mixture_packing, op2_ngram_jaccard, op3_decontamination, op4_quality, op5_training_order, op6_multiprobe, op7_language_id, op8_bin_packing, op9_url_filter, op10_line_dedup, op11_periodic_runs, op12_vector_codes, op13_byte_bpe)}
#: Tokenising, learnt scores, hashing, placement and runs have no SQL; tests hold those queries against plain versions.
ORACLE_SQL = {"op2_ngram_jaccard": oracle.OP2, "op3_decontamination": oracle.OP3, "op10_line_dedup": oracle.OP10, "op12_vector_codes": oracle.OP12}

"""Sources and sinks S1 to S18: dictionaries, journals, pages, hierarchies, extracts and exports.

All readers take explicit schemas; nothing is inferred.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.columns import decode_entities, null_norm, to_int
from ..operators.quality import GateError


def read_dictionary_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A header CSV as strings: quotes doubled inside quotes, lines may break inside them, a BOM and empty lines skipped."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", enforceSchema=True, ignoreLeadingWhiteSpace=False)
    return df.where(F.coalesce(*[F.col(c) for c in columns]).isNotNull())


def load_catalog(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Typed tables, columns, pkeys and indexes; only tables and views, and only children of those kept."""
    clean = lambda df: df.select(*[null_norm(F.col(c)).alias(c) for c in df.columns])
    tables = clean(raw["tables"]).where(F.upper("table_type").isin("TABLE", "VIEW"))
    kept = tables.select("table_name").distinct()
    child = lambda name: clean(raw[name]).join(kept, "table_name", "left_semi")
    out = {"tables": tables}
    if "columns" in raw:
        out["columns"] = child("columns").withColumns({"nullable": F.upper("nullable") == "Y", "ordinal": to_int(F.col("ordinal"))})
    if "pkeys" in raw:
        out["pkeys"] = child("pkeys").withColumn("seq", to_int(F.col("seq")))
    if "indexes" in raw:
        out["indexes"] = child("indexes").withColumns({"is_unique": F.lower("non_unique") == "false", "ordinal": to_int(F.col("ordinal"))}).drop("non_unique")
    return out


def load_fkeys(fk: DataFrame, kept: DataFrame) -> DataFrame:
    """S3: foreign keys (child, parent, col) of which either end is kept (table_name)."""
    k = kept.select("table_name").distinct()
    c = k.select(F.col("table_name").alias("_c"))
    p = k.select(F.col("table_name").alias("_p"))
    return fk.join(c, F.col("child") == F.col("_c"), "left").join(p, F.col("parent") == F.col("_p"), "left").where("_c is not null or _p is not null").select(*fk.columns)


def load_snapshot_csv(df: DataFrame, required: Sequence[str], key: Sequence[str], kind: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a whole key, (kind, n)); raises if a required column is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise GateError(f"load_snapshot_csv: missing columns {', '.join(missing)}")
    rows = df.dropna(subset=list(key))
    return rows, rows.groupBy(kind).agg(F.count("*").alias("n"))


def scan_units(records: DataFrame, key: str, texts: str) -> DataFrame:
    """(unit_id, idx, text): one row a text of an array; `#i` ends the id only where there are several."""
    each = records.select(key, F.size(texts).alias("_n"), F.posexplode(texts).alias("idx", "text"))
    return each.select(F.when(F.col("_n") > 1, F.concat(key, F.lit("#"), "idx")).otherwise(F.col(key)).alias("unit_id"), "idx", "text")


def parse_journal(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, bad lines) of JSON lines (src_file, line_no, line). Unparsable lines are kept apart."""
    parsed = lines.withColumn("_p", F.from_json("line", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    good = F.col("_p").isNotNull() & F.col("_p._bad").isNull()
    return parsed.where(good).select("src_file", "line_no", "_p.*").drop("_bad"), parsed.where(~good).select("src_file", "line_no", "line")


def read_journal(spark: SparkSession, paths: Sequence[str], schema: str, superseded: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Journals as JSON lines with the file's name and line numbers from 1; a superseded file is refused by name.

    A journal is one file read whole by one task, which numbers its lines; files are read in parallel.
    """
    for p in paths:
        if p.rsplit("/", 1)[-1] in superseded:
            raise GateError(f"read_journal: {p} is superseded")
    whole = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_name").alias("src_file"), "value")
    lines = whole.select("src_file", F.posexplode(F.split("value", "\n")).alias("line_no", "line")).where(F.trim("line") != "")
    return parse_journal(lines.withColumn("line_no", F.col("line_no") + 1), schema)


def check_pages(rows: DataFrame, pages: DataFrame, key: Sequence[str]) -> DataFrame:
    """Problems (problem, detail) of numbered pages: gaps, wrong row counts, several instances, repeated keys.

    rows: (page, instance, key ...); pages: (page, n_rows).
    """
    n = rows.groupBy("page").agg(F.count("*").alias("_n"))
    counts = pages.join(n, "page", "left").where(F.coalesce("_n", F.lit(0)) != F.col("n_rows")).select(F.lit("row count").alias("problem"), F.col("page").cast("string").alias("detail"))
    span = pages.agg(F.min("page").alias("a"), F.max("page").alias("b"), F.countDistinct("page").alias("c")).where("a <> 1 or b <> c").select(F.lit("pages aren't 1 to N").alias("problem"), F.concat_ws("-", "a", "b").alias("detail"))
    inst = rows.agg(F.countDistinct("instance").alias("k")).where("k > 1").select(F.lit("several instances").alias("problem"), F.col("k").cast("string").alias("detail"))
    dup = rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.lit("repeated key").alias("problem"), F.concat_ws("|", *[F.col(c).cast("string") for c in key]).alias("detail"))
    return counts.unionByName(span).unionByName(inst).unionByName(dup)


def read_pages(spark: SparkSession, folder: str, kind: str, schema: str, key: Sequence[str]) -> DataFrame:
    """All pages `<kind>_<n>.json` ({page, instance, rows: [...]}) of a folder, checked; raises on any problem."""
    raw = spark.read.schema(f"page int, instance string, n_rows long, rows array<struct<{schema}>>").json(f"{folder}/{kind}_*.json", multiLine=True)
    rows = raw.select("page", "instance", F.inline("rows"))
    problems = check_pages(rows, raw.select("page", "n_rows"), key).limit(20).collect()
    if problems:
        raise GateError("; ".join(f"{p.problem}: {p.detail}" for p in problems))
    return rows


def flatten_hierarchy(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(columns, errors) of (area, folders array<struct<name, columns array<string>>>) with ordinals; entries
    without a name are errors."""
    folders = df.select("area", F.posexplode_outer("folders").alias("folder_no", "f"))
    each = folders.select("area", F.col("f.name").alias("folder"), "folder_no", F.posexplode_outer("f.columns").alias("ordinal", "column"))
    bad = F.col("folder").isNull() | F.col("column").isNull()
    return each.where(~bad), each.where(bad).select("area", "folder_no", "ordinal")


def load_lineage(df: DataFrame, key: Sequence[str], source: Column) -> DataFrame:
    """Sheet rows without quotes around values, without rows that lack a part of the key, labelled by source."""
    strip = lambda c: null_norm(F.regexp_replace(F.trim(F.col(c)), '^"(.*)"$', "$1")).alias(c)
    return df.select(*[strip(c) for c in df.columns], source.alias("source")).dropna(subset=list(key))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet; with partitions, only those in df are replaced."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def export_corpus(df: DataFrame, scope: str = "data", source: str | None = None) -> DataFrame:
    """Rows of a source or all, without vectors (`data`) or with them as JSON arrays, which keep floats exact (`full`)."""
    out = df if source is None else df.where(F.col("source") == source)
    if scope == "data":
        return out.drop("embedding")
    if scope != "full":
        raise ValueError(f"export_corpus: data or full, not {scope}")
    return out.withColumn("embedding", F.to_json("embedding"))


def import_corpus(base: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, ids that need a vector): incoming rows replace base's by id; carried vectors stay."""
    merged = base.join(incoming.select("id"), "id", "left_anti").unionByName(incoming)
    return merged, merged.where("embedding is null").select("id")


def export_inventory(df: DataFrame, folder: str, order: Sequence[Column], top: int = 100) -> str:
    """JSON and CSV of all rows under a folder, and the first `top` as a ranked markdown table (returned)."""
    df.write.mode("overwrite").json(f"{folder}/json")
    flat = df.select(*[F.col(f.name) if f.dataType.simpleString() in ("string", "int", "bigint", "double", "boolean") else F.to_json(f.name).alias(f.name) for f in df.schema])
    flat.write.mode("overwrite").csv(f"{folder}/csv", header=True)
    rows = flat.orderBy(*order).limit(top).collect()
    head = "| # | " + " | ".join(flat.columns) + " |\n|" + "-|" * (len(flat.columns) + 1)
    return head + "".join(f"\n| {i} | " + " | ".join("" if v is None else str(v) for v in r) + " |" for i, r in enumerate(rows, 1))


def load_with_count(df: DataFrame, path: str) -> int:
    """Writes df and raises unless as many rows are read back; returns their number."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    n, m = seen.get["n"], df.sparkSession.read.parquet(path).count()
    if n != m:
        raise GateError(f"load_with_count: {m} of {n} rows in {path}")
    return n


def extract_dataset_texts(df: DataFrame, path: str, xml: str, tag: str = "sql", model: str | None = None, keep: str | None = None) -> DataFrame:
    """(path, text): distinct texts of a tag in XML members, CDATA unwrapped, entities decoded; `keep` is a regex
    that texts must match (physical, not logical, statements)."""
    found = F.regexp_extract_all(xml, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    each = df.select(path, F.explode(found).alias("text"))
    each = each.withColumn("text", F.trim(decode_entities(F.regexp_replace("text", r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))))
    each = each.where("text <> ''")
    return (each.where(F.col("text").rlike(keep)) if keep else each).distinct()


def extract_blocks(df: DataFrame, key: str, xml: str, block: str, fields: Sequence[str]) -> DataFrame:
    """(key, block_no, field ...): one row a block, with the text of each field's first tag."""
    blocks = F.regexp_extract_all(xml, F.lit(rf"(?s)<{block}(?:\s[^>]*)?>(.*?)</{block}>"), F.lit(1))
    each = df.select(key, F.posexplode(blocks).alias("block_no", "_b"))
    one = lambda f: null_norm(decode_entities(F.regexp_extract("_b", rf"(?s)<{f}(?:\s[^>]*)?>(.*?)</{f}>", 1))).alias(f)
    return each.select(key, "block_no", *[one(f) for f in fields])


def load_edges(df: DataFrame, source: str) -> DataFrame:
    """Edges (from_table, from_col, to_table, to_col, evidence array, occurrences, confidence, predicate) with
    evidence joined, predicates decoded, and rows that lack an end dropped."""
    return df.dropna(subset=["from_table", "to_table"]).select("from_table", "from_col", "to_table", "to_col", F.array_join("evidence", ", ").alias("evidence"), "occurrences", "confidence", decode_entities(F.col("predicate")).alias("predicate"), F.lit(source).alias("source"))


def filter_by_ids(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of wanted ids, wanted ids that df lacks)."""
    wanted = ids.select(key).distinct()
    return df.join(wanted, key, "left_semi"), wanted.join(df.select(key), key, "left_anti")


def number_lines(df: DataFrame, by: str, order: str) -> DataFrame:
    """Lines of each file numbered from 1 in an order that the rows carry."""
    return df.withColumn("line_no", F.row_number().over(Window.partitionBy(by).orderBy(order)))

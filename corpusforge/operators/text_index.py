"""Ranked text search K1 to K3 over a positional index, made for one job or stored and kept up to date.

Text falls into lexemes (runs of letters and digits, upper case); a query falls into terms (words that may hold
underscores), each a phrase of its lexemes whose last one is a prefix. The index has three parts: terms (token, df), the
dictionary; postings (token, key, at), a document's places of a token; and docs (key, name, n, hash, tokens).

Stored, each is a bucketed table: a search reads the dictionary, then only the buckets of the tokens found;
an update tokenises only documents whose hash differs and rewrites only the buckets of their old and new tokens. It may be
run again after a crash at any point: docs come last, and what comes before doesn't add up twice.

Prefixes meet the dictionary by equality on prefixes of the lengths asked for; tokens of many documents are joined in
salted blocks by their document frequency.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import tokens
from ..sources.bucketed import BucketedTable
from ..sources.shared import checkpointed

AT = "array<struct<pos:int,weight:double>>"
GAP = 10_000_000  # between places of one field and the next


def lexemes(c: Column) -> Column:
    """Runs of letters and digits, upper case, in order."""
    return F.coalesce(F.regexp_extract_all(F.upper(c), F.lit("([A-Z0-9]+)"), F.lit(1)), F.array().cast("array<string>"))


def _places(docs: DataFrame, fields: Mapping[str, float], key: str) -> DataFrame:
    """(key, token, pos, weight) of all fields."""
    def each(k: int, field: str, weight: float) -> Column:
        return F.transform(lexemes(F.col(field)), lambda t, i: F.struct(t.alias("token"), (i + F.lit(k * GAP)).alias("pos"), F.lit(float(weight)).alias("weight")))

    every = [each(k, *fw) for k, fw in enumerate(fields.items())]
    return docs.select(key, F.inline(F.flatten(F.array(*every))))


def _postings(docs: DataFrame, fields: Mapping[str, float], key: str) -> DataFrame:
    return _places(docs, fields, key).groupBy("token", key).agg(F.sort_array(F.collect_list(F.struct("pos", "weight"))).alias("at"))


def _doc_rows(docs: DataFrame, fields: Mapping[str, float], key: str) -> DataFrame:
    every = F.flatten(F.array(*[lexemes(F.col(f)) for f in fields]))
    digest = F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)
    return docs.select(key, F.col(next(iter(fields))).alias("name"), F.size(every).cast("long").alias("n"), digest.alias("hash"), F.array_distinct(every).alias("tokens"))


@dataclass
class TextIndex:
    """An index to search: its dictionary and documents, and where postings of tokens come from."""

    terms: DataFrame
    docs: DataFrame
    postings: DataFrame | BucketedTable
    key: str
    block: int = 100_000

    def _found(self, asked: DataFrame) -> DataFrame:
        """(query_id, term_no, n_lex, nth, key, at) for asked (query_id, term_no, lex): postings of each lexeme's tokens."""
        each = asked.select("query_id", "term_no", F.size("lex").alias("n_lex"), F.posexplode("lex").alias("nth", "lexeme"))
        last = F.col("nth") == F.col("n_lex") - 1
        sizes = sorted(r[0] for r in each.where(last).select(F.length("lexeme")).distinct().collect())
        prefixes = self.terms.withColumn("lexeme", F.explode(F.filter(F.array(*[F.left("token", F.lit(s)) for s in sizes] or [F.lit("")]), lambda p: F.length(p) > 0))).distinct()
        cols = ["query_id", "term_no", "n_lex", "nth", "token", "df"]
        whole = each.where(~last).join(self.terms.withColumn("lexeme", F.col("token")), "lexeme").select(*cols)
        hit = checkpointed(each.where(last).join(prefixes, "lexeme").select(*cols).unionByName(whole))
        held = self.postings.read_keys(hit.select("token").distinct()) if isinstance(self.postings, BucketedTable) else self.postings
        # A token of many documents is split by them, and the queries that ask for it are sent to each part. Only such tokens are
        # broadcast (no more than places / block); postings never are, however small their files make them look.
        parts = F.ceil(F.col("df") / self.block).cast("int")
        large = F.broadcast(hit.where(parts > 1).select("token", parts.alias("_parts")).distinct())
        salted = held.join(large, "token", "left").withColumn("_part", F.pmod(F.xxhash64(self.key), F.coalesce("_parts", F.lit(1))).cast("int"))
        asked = hit.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        return asked.join(salted.hint("merge"), ["token", "_part"]).select("query_id", "term_no", "n_lex", "nth", self.key, "at")

    def _matches(self, asked: DataFrame) -> DataFrame:
        """(query_id, term_no, key, weight): documents that hold a term, with the weights of its places added up."""
        found = self._found(asked)
        weight = F.aggregate("at", F.lit(0.0), lambda acc, p: acc + p["weight"])
        single = found.where("n_lex = 1").select("query_id", "term_no", self.key, weight.alias("weight"))
        several = found.where("n_lex > 1").select("query_id", "term_no", "n_lex", "nth", self.key, F.inline("at"))
        runs = several.groupBy("query_id", "term_no", "n_lex", self.key, (F.col("pos") - F.col("nth")).alias("start")).agg(F.count_distinct("nth").alias("_n"), F.max("weight").alias("weight"))
        return single.unionByName(runs.where("_n = n_lex").select("query_id", "term_no", self.key, "weight"))

    def search(self, queries: DataFrame, k: int = 20) -> DataFrame:
        """K1, K2: (query_id, key, rank, hits, score, mode) for queries (query_id, query).

        A document must hold all terms; only a query of several terms that no document meets is answered by any of them.
        Ranked by an exact name first (the terms joined by underscores), then terms hit, then weights of
        places over 1 + ln(lexemes), then the shorter name, the name and the key.
        """
        words = F.array_distinct(tokens(F.col("query")))
        terms = queries.select("query_id", F.array_join(words, "_").alias("_whole"), F.posexplode(words).alias("term_no", "term")).withColumn("lex", lexemes(F.col("term"))).where("size(lex) > 0")
        counted = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"), F.first("_whole").alias("_whole"))
        # Terms hit as bits, so that one partial aggregation before the shuffle counts them.
        most = terms.agg(F.max("term_no")).first()[0] or 0
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("term_no") % 63)
        words_hit = [F.bit_count(F.bit_or(F.when(F.floor(F.col("term_no") / 63) == i, bit).otherwise(F.lit(0).cast("long")))) for i in range(most // 63 + 1)]
        per = self._matches(terms.select("query_id", "term_no", "lex")).groupBy("query_id", self.key).agg(reduce(Column.__add__, words_hit).cast("long").alias("hits"), F.sum("weight").alias("weight"))
        scored = per.join(self.docs.select(self.key, "name", "n").hint("merge"), self.key).join(counted, "query_id")
        scored = scored.withColumns({"score": F.round(F.col("weight") / (1 + F.ln("n")), 6), "_exact": F.coalesce(F.upper("name") == F.col("_whole"), F.lit(False))})
        order = [F.desc("_exact"), F.desc("hits"), F.desc("score"), F.length("name"), F.col("name").asc_nulls_last(), F.col(self.key)]
        w = Window.partitionBy("query_id").orderBy(*order)
        ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        # Documents with all terms come first (one of an exact name has them all), so the best of k rows tells the mode.
        full = F.col("hits") == F.col("n_terms")
        met = F.max(full).over(Window.partitionBy("query_id"))
        kept = ranked.withColumn("mode", F.when(met, "and").otherwise("or")).where(full | (F.col("mode") == "or"))
        return kept.select("query_id", self.key, "rank", "hits", "score", "mode")

    def phrases(self, queries: DataFrame) -> DataFrame:
        """K3: (query_id, key) of documents that hold a query's lexemes in a row, the last one as a prefix."""
        asked = queries.select("query_id", F.lit(0).alias("term_no"), lexemes(F.col("query")).alias("lex")).where("size(lex) > 0")
        return self._matches(asked).select("query_id", self.key).distinct()


def index_of(docs: DataFrame, fields: Mapping[str, float], key: str) -> TextIndex:
    """An index of `docs` for this job: documents are tokenised once."""
    postings = checkpointed(_postings(docs, fields, key))
    terms = postings.groupBy("token").agg(F.count("*").alias("df"))
    return TextIndex(terms, _doc_rows(docs, fields, key), postings, key)


class StoredTextIndex:
    """An index kept under a path: `update` it with documents, `index` to search it."""

    def __init__(self, spark: SparkSession, path: str, fields: Mapping[str, float], key: str, key_type: str = "long", buckets: int = 64):
        make = lambda name, schema, by: BucketedTable.create(spark, f"{path}/{name}", schema, by, buckets)
        self.fields, self.key = dict(fields), key
        self.postings = make("postings", f"token string, `{key}` {key_type}, at {AT}", "token")
        self.terms = make("terms", "token string, df long", "token")
        self.docs = make("docs", f"`{key}` {key_type}, name string, n long, hash string, tokens array<string>", key)

    def index(self) -> TextIndex:
        return TextIndex(self.terms.read(), self.docs.read(), self.postings, self.key)

    def update(self, docs: DataFrame) -> int:
        """Takes in new and changed documents (distinct keys) and leaves others alone; how many there were."""
        rows = _doc_rows(docs, self.fields, self.key)
        stored = self.docs.read().select(self.key, F.col("hash").alias("_hash"), F.col("tokens").alias("_old"))
        changed = checkpointed(rows.join(stored, self.key, "left").where("_hash is null or _hash <> hash"))
        n = changed.count()
        if n:
            self._replace(changed, _postings(docs.join(changed.select(self.key), self.key, "left_semi"), self.fields, self.key))
            self.docs.upsert(changed.select("name", "n", "hash", "tokens", self.key))
        return n

    def remove(self, keys: DataFrame) -> None:
        gone = checkpointed(self.docs.read_keys(keys).select(self.key, F.col("tokens").alias("_old")))
        if not gone.isEmpty():
            self._replace(gone, self.postings.read().limit(0))
            self.docs.delete(gone.select(self.key))

    def _replace(self, changed: DataFrame, new: DataFrame) -> None:
        """Postings of the changed documents (key, _old) by the new ones, and the frequencies of their tokens."""
        old = changed.select(self.key, F.explode("_old").alias("token")).withColumn("at", F.lit(None).cast(AT))
        batch = checkpointed(new.select("token", self.key, "at").unionByName(old).groupBy("token", self.key).agg(F.first("at", ignorenulls=True).alias("at")))
        if batch.isEmpty():
            return
        on = ["token", self.key]
        self.postings.apply(batch, lambda held, b: held.join(b.select(*on), on, "left_anti").unionByName(b.where("at is not null").select(*held.columns)))
        touched = batch.select("token").distinct()
        counts = touched.join(self.postings.read_keys(touched).groupBy("token").agg(F.count("*").alias("df")), "token", "left")
        self.terms.apply(counts, lambda held, b: held.join(b.select("token"), "token", "left_anti").unionByName(b.where("df > 0").select("token", "df")))


def text_search(queries: DataFrame, docs: DataFrame, fields: Mapping[str, float], key: str, k: int = 20) -> DataFrame:
    """K1, K2 with an index made for this job; see TextIndex.search."""
    return index_of(docs, fields, key).search(queries, k)


def phrase_search(queries: DataFrame, docs: DataFrame, field: str, key: str) -> DataFrame:
    """K3 with an index made for this job; see TextIndex.phrases."""
    return index_of(docs, {field: 1.0}, key).phrases(queries)

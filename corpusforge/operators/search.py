"""Search and similarity K7 to K11, K18: suggestions, labels, aliases, domains.

Requests are rows of a DataFrame; all of them are answered in one job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.columns import loose_key, match_key, norm_label, norm_name
from ..sources.shared import checkpointed
from .near import edit_pairs, near_pairs
from .picks import top_n


def _floor(c: Column) -> Column:
    """The whole part; what a product of decimals falls short of by rounding counts as reached."""
    return F.floor(c + 1e-9).cast("int")


def suggest(requests: DataFrame, names: DataFrame, k: int = 5) -> DataFrame:
    """K7: (request, name, score, rank): did-you-mean names for requested ones (column `request`, dictionary `name`).

    Containment scores half the difference in length, edits within max(2, length / 3) five and their
    number; an exact name suggests nothing of itself.
    """
    r = requests.select("request").distinct().withColumn("q", norm_name(F.col("request"))).where("q <> ''")
    d = names.select("name").distinct().withColumn("key", F.col("name"))
    pairs = near_pairs(r.withColumn("bound", F.greatest(F.lit(2), F.floor(F.length("q") / 3)).cast("int")), d).where("q <> key")
    inside = F.contains("key", "q") | F.contains("q", "key")
    # The bound varies by row and levenshtein's threshold is a literal, so the distance is cut afterwards.
    edits = F.levenshtein("q", "key")
    score = F.when(inside, F.abs(F.length("q") - F.length("key")) * 0.5).when(edits <= F.col("bound"), edits + 5.0)
    scored = pairs.withColumn("score", score).where("score is not null")
    w = Window.partitionBy("request").orderBy("score", "name")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("request", "name", "score", "rank")


def _label_pairs(requests: DataFrame, labels: DataFrame) -> DataFrame:
    """(request, name, score) of all labels near enough to requests."""
    r = requests.select("request").distinct().withColumn("q", loose_key(F.col("request")))
    d = labels.select("name").distinct().withColumn("key", loose_key(F.col("name")))
    pairs = near_pairs(r.withColumn("bound", F.greatest(F.lit(2), F.floor(F.length("q") / 4)).cast("int")), d)
    edits = F.levenshtein("q", "key")
    inside = F.contains("key", "q") | F.contains("q", "key")
    score = F.when(match_key(F.col("request")) == match_key(F.col("name")), 0.0).when(F.col("q") == F.col("key"), 0.5).when(inside, F.round(1 + F.abs(F.length("q") - F.length("key")) * 0.01, 4)).when(edits <= F.col("bound"), 2.0 + edits)
    return pairs.withColumn("score", score).where("score is not null").select("request", "name", "score")


def nearest_labels(requests: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """K8: (request, name, score, rank): nearest labels: equal key 0, equal loose key 0.5, containment 1 and a
    hundredth a character of difference, edits within max(2, length / 4) two and their number."""
    w = Window.partitionBy("request").orderBy("score", "name")
    return _label_pairs(requests, labels).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_in_scope(requests: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """K8 within scopes: (scope, request, name, score, rank) for requests (scope, request) against labels (scope, name).

    Names are compared once, whatever the scopes; what is near is then kept where the scope holds it.
    """
    r, d = requests.select("scope", "request").distinct(), labels.select("scope", "name").distinct()
    pairs = r.join(_label_pairs(r, d), "request").join(d, ["scope", "name"])
    w = Window.partitionBy("scope", "request").orderBy("score", "name")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("scope", "request", "name", "score", "rank")


def match_label(requests: DataFrame, labels: DataFrame) -> DataFrame:
    """K9: (request, name, exact): the verbatim label, else the only one equal but for case and spaces, else null."""
    r = requests.select("request").distinct()
    d = labels.select("name").distinct()
    same = d.select(F.col("name").alias("verbatim"))
    keyed = d.groupBy(match_key(F.col("name")).alias("_key")).agg(F.count("*").alias("_n"), F.min("name").alias("_only"))
    joined = r.join(same, F.col("request") == F.col("verbatim"), "left").join(keyed, match_key(F.col("request")) == F.col("_key"), "left")
    name = F.coalesce("verbatim", F.when(F.col("_n") == 1, F.col("_only")))
    return joined.select("request", name.alias("name"), F.when(name.isNotNull(), F.col("verbatim").isNotNull()).alias("exact"))


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def name_parts(df: DataFrame, name: str, spellings: Mapping[str, str], suffix: str) -> DataFrame:
    """`df` with norm, family (before the first ` - `), words and tails of a name. Words follow the family, without
    `suffix` and a plural s; tails are the words as text, and those behind a whole family repeated at their head."""
    dashed = F.trim(F.regexp_replace(norm_label(F.col(name)), r"\s*-\s*", " - "))
    plain = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), spellings.items(), F.col("norm"))
    split = F.contains("_n", F.lit(" - "))
    rest = F.when(split, F.substr("_n", F.locate(" - ", F.col("_n")) + 3)).otherwise(F.col("_n"))
    cut = lambda c: F.transform(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""), lambda w: F.when((F.length(w) > 3) & F.endswith(w, F.lit("s")), F.left(w, F.length(w) - 1)).otherwise(w))
    out = df.withColumn("norm", dashed).withColumn("_n", plain).withColumn("family", F.when(split, F.substring_index("_n", " - ", 1)).otherwise(""))
    out = out.withColumns({"words": cut(F.regexp_replace(rest, rf"\b{suffix}$", "")), "_f": cut(F.col("family"))})
    behind = F.when((F.size("_f") > 0) & (F.slice("words", 1, F.greatest(F.size("_f"), F.lit(1))) == F.col("_f")), F.slice("words", F.size("_f") + 1, F.size("words") + 1)).otherwise(F.col("words"))
    tails = F.array_distinct(F.array(F.array_join("words", " "), F.array_join(behind, " ")))
    return out.withColumns({"tail": F.array_join("words", " "), "tails": tails}).drop("_n", "_f")


def _less_one(df: DataFrame, tag: str) -> DataFrame:
    """(tag_name, tag_family, tail, word): every tail without one of its words."""
    words = df.select(f"{tag}_name", f"{tag}_family", F.explode(F.transform(f"{tag}_tails", lambda t: F.split(t, " "))).alias("w"))
    without = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.struct(F.array_join(F.filter("w", lambda x, j: j != i), " ").alias("tail"), F.get("w", i).alias("word")))
    return words.select(f"{tag}_name", f"{tag}_family", F.inline(F.array_distinct(without))).where("word <> ''")


def propose_aliases(a: DataFrame, b: DataFrame, least: float = 0.9, spellings: Mapping[str, str] | None = None, suffix: str = "real time") -> DataFrame:
    """(a_name, b_name, rule, tail_ratio, name_ratio, n_candidates, reason): names of catalog a (name) that guide b
    (name, payload) has under another name, and why others aren't taken.

    Names that both sides have, normalised, are left out. tail-equal: some tails are equal, or up to one word that is in either name's
    family. tail-similar: tails of ratio `least` or more that are each other's best (ties: the first name). A pair is
    an alias (reason null) if all of the a's candidates have the same set of payloads, and not the empty one (`no
    payload`). An a of several sets has one row (`different payloads`, b_name null, n_candidates at least); b names without
    any candidate have `no name fits`.

    Blocking: equal tails, tails less a word and, for similar ones, segment keys of the edits that the ratio allows. An a
    whose tail meets different payload sets is settled from counts by tail, before any pairs of it are made.
    """
    left = a.select(F.col("name").alias("a_name")).where("a_name is not null").distinct()
    right = b.where("name is not null").groupBy(F.col("name").alias("b_name")).agg(F.array_join(F.sort_array(F.collect_set(F.col("payload").cast("string"))), "\u0001").alias("payloads"))
    tagged = lambda df, t: df.select(f"{t}_name", *[F.col(c).alias(f"{t}_{c}") for c in ("norm", "family", "tail", "tails")], *([F.col("payloads")] if t == "b" else []))
    left, right = (tagged(name_parts(df, f"{t}_name", spellings or {}, suffix), t) for df, t in ((left, "a"), (right, "b")))
    own, other = left.select("a_norm").distinct(), right.select("b_norm").distinct()
    left = checkpointed(left.join(other, F.col("a_norm") == F.col("b_norm"), "left_anti"))
    right = checkpointed(right.join(own, F.col("a_norm") == F.col("b_norm"), "left_anti"))
    # Equal tails first as groups: which of them have one payload set only.
    b_tails = right.select("b_name", "b_family", "payloads", F.explode("b_tails").alias("tail"))
    groups = b_tails.groupBy("tail").agg(F.count_distinct("payloads").alias("_sets"), F.count_distinct("b_name").alias("_n"))
    a_tails = left.select("a_name", "a_family", F.explode("a_tails").alias("tail"))
    mixed = a_tails.join(groups.where("_sets > 1"), "tail").groupBy("a_name").agg(F.max("_n").alias("n_candidates"))
    open_a = a_tails.join(mixed, "a_name", "left_anti")
    equal = open_a.join(b_tails, "tail").select("a_name", "b_name")
    families = F.array_union(F.split("a_family", r"[\s/]+"), F.split("b_family", r"[\s/]+"))
    extra = [
        _less_one(left.join(mixed, "a_name", "left_anti"), "a").join(b_tails, "tail"),
        _less_one(right, "b").join(open_a, "tail"),
    ]
    equal = reduce(DataFrame.unionByName, [equal, *(x.where(F.array_contains(families, F.col("word"))).select("a_name", "b_name") for x in extra)]).distinct()
    # Similar tails: a ratio of `least` allows (1 - least) * (n + m) single edits, and m is at most n * (2 - least) / least.
    widest = (1 - least) * (1 + (2 - least) / least)
    asked = left.where("a_tail <> ''").select("a_tail").distinct().select(F.col("a_tail").alias("request"), F.col("a_tail").alias("q"), _floor(F.length("a_tail") * widest).alias("bound"))
    near = edit_pairs(asked, right.where("b_tail <> ''").select(F.col("b_tail").alias("name"), F.col("b_tail").alias("key")).distinct())
    near = near.where(F.levenshtein("q", "key") <= _floor((F.length("q") + F.length("key")) * (1 - least)))
    near = checkpointed(near.select(F.col("q").alias("a_tail"), F.col("key").alias("b_tail"), _ratio(F.col("q"), F.col("key")).alias("r")).where(F.col("r") >= least))
    first = lambda df, k: df.groupBy(f"{k}_tail").agg(F.min(f"{k}_name").alias(f"{k}_name"))
    by_tail = near.join(first(left, "a"), "a_tail").join(first(right, "b"), "b_tail")
    # Names of one tail have the same ratios, so a tail's best is its best tail's first name, and only first names can be mutual.
    w = lambda k, o: Window.partitionBy(f"{k}_tail").orderBy(F.desc("r"), f"{o}_name")
    mutual = by_tail.withColumns({"_x": F.row_number().over(w("a", "b")), "_y": F.row_number().over(w("b", "a"))}).where("_x = 1 and _y = 1")
    best = mutual.select("a_name", "b_name")
    mutual = best.join(mixed, "a_name", "left_anti").join(equal, ["a_name", "b_name"], "left_anti")
    pairs = checkpointed(equal.withColumn("rule", F.lit("tail-equal")).unionByName(mutual.withColumn("rule", F.lit("tail-similar"))).join(right.select("b_name", "b_norm", "b_tail", "payloads"), "b_name").join(left.select("a_name", "a_norm", "a_tail"), "a_name"))
    sets = pairs.groupBy("a_name").agg(F.count_distinct("payloads").alias("_sets"), F.count("*").alias("n_candidates"))
    kept = pairs.join(sets, "a_name").where("_sets = 1")
    null = lambda kind="string": F.lit(None).cast(kind)
    ratio = lambda x, y: F.round(_ratio(F.col(x), F.col(y)), 3)
    out = kept.select("a_name", "b_name", "rule", ratio("a_tail", "b_tail").alias("tail_ratio"), ratio("a_norm", "b_norm").alias("name_ratio"), "n_candidates", F.when(F.col("payloads") == "", "no payload").alias("reason"))
    split = mixed.unionByName(sets.where("_sets > 1").select("a_name", "n_candidates"))
    rejected = split.select("a_name", null().alias("b_name"), null().alias("rule"), null("double").alias("tail_ratio"), null("double").alias("name_ratio"), "n_candidates", F.lit("different payloads").alias("reason"))
    # Whether any a fits a b needs no pairs: semi joins stop at the first.
    fits = lambda x, y: x.alias("x").join(y.alias("y"), (F.col("x.tail") == F.col("y.tail")) & F.array_contains(families, F.col("word")), "left_semi").select("b_name")
    met = b_tails.join(a_tails, "tail", "left_semi").select("b_name").union(fits(b_tails, _less_one(left, "a"))).union(fits(_less_one(right, "b"), a_tails)).union(best.select("b_name")).distinct()
    unmet = right.select("b_name").join(met, "b_name", "left_anti").select(null().alias("a_name"), "b_name", null().alias("rule"), null("double").alias("tail_ratio"), null("double").alias("name_ratio"), F.lit(0).cast("long").alias("n_candidates"), F.lit("no name fits").alias("reason"))
    return reduce(DataFrame.unionByName, [out, rejected, unmet])


def classify_domain(members: DataFrame, modules: Mapping[str, str], prefixes: Mapping[str, str], titles: Sequence[tuple[str, str]]) -> DataFrame:
    """(id, domain) of items (id, title, members): the domain of most members by module (the whole name), else
    by prefix; ties by name; else the first title pattern that fits; else Other."""
    def lookup(m: Mapping[str, str], c: Column) -> Column:
        return F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[c] if m else F.lit(None).cast("string")

    each = members.select("id", F.explode("members").alias("m"))
    votes = each.select("id", F.coalesce(lookup(modules, F.col("m")), lookup(prefixes, F.regexp_extract("m", "^[^_#]*", 0))).alias("domain")).where("domain is not null")
    top = top_n(votes.groupBy("id", "domain").agg(F.count("*").alias("_n")), ["id"], [F.desc("_n"), F.col("domain")], 1).select("id", F.col("domain").alias("voted"))
    chain = F.lit(None).cast("string")
    for pattern, name in reversed(titles):
        chain = F.when(F.col("title").rlike(pattern), name).otherwise(chain)
    return members.select("id", "title").join(top, "id", "left").select("id", F.coalesce("voted", chain, F.lit("Other")).alias("domain"))


def resolve_references(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Refs (ref_id, area, folder, column; folder may be null) against catalog (area, folder, column).

    Returns the resolved folder and column and a code: ok, spelling, unknown_area, unknown_folder,
    unknown_column or ambiguous. Without a folder a column resolves if one folder of the area holds it.
    """
    key = lambda c: match_key(F.col(c))
    areas = catalog.select(key("area").alias("ka")).distinct().withColumn("has_area", F.lit(True))
    folders = catalog.select(key("area").alias("ka"), key("folder").alias("kf")).distinct().withColumn("has_folder", F.lit(True))
    r = refs.select("ref_id", "area", "folder", "column").distinct().withColumns({"ka": key("area"), "kf": key("folder"), "kc": key("column")})
    r = r.join(areas, "ka", "left").join(folders, ["ka", "kf"], "left")
    # Holders are counted by key before references meet them, so a reference is one row, whatever the number of its holders.
    # A null kf stands for all folders of the area.
    held = catalog.where("folder is not null").select(key("area").alias("ka"), key("folder").alias("kf"), key("column").alias("kc"), "folder", "column").where("ka is not null and kc is not null").distinct()
    counts = [F.count_distinct("folder").alias("n"), F.min("folder").alias("to_folder"), F.min("column").alias("to_column")]
    holders = held.groupBy("ka", "kf", "kc").agg(*counts).unionByName(held.groupBy("ka", "kc").agg(F.lit(None).cast("string").alias("kf"), *counts))
    holders = holders.select(*[F.col(c).alias(f"_{c}") for c in ("ka", "kf", "kc")], "n", "to_folder", "to_column")
    same = (F.col("ka") == F.col("_ka")) & (F.col("kc") == F.col("_kc")) & F.col("kf").eqNullSafe(F.col("_kf"))
    grouped = r.join(holders, same, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    code = F.when(F.col("has_area").isNull(), "unknown_area").when(F.col("folder").isNotNull() & F.col("has_folder").isNull(), "unknown_folder").when(F.col("n") == 0, "unknown_column").when(F.col("n") > 1, "ambiguous").when((F.col("to_column") != F.col("column")) | (F.col("folder") != F.col("to_folder")), "spelling").otherwise("ok")
    one = F.col("n") == 1
    return grouped.select("ref_id", F.when(one, F.col("to_folder")).alias("to_folder"), F.when(one, F.col("to_column")).alias("to_column"), code.alias("code"))


def explain_misses(refs: DataFrame, catalog: DataFrame, k: int = 5, holders: int = 5, choices: int = 8) -> DataFrame:
    """(ref_id, code, kind, rank, suggestion): what helps on references that resolve_references left open.

    An unknown area has the nearest areas (kind area), an unknown folder the nearest folders of its area (folder), an
    unknown column the nearest columns of its folder (column) and the first folders of the area that do hold it
    (holder); an ambiguous column the first folders that hold it (holder). Names come as the catalog spells them, the first of
    equal keys. A reference without help has no row. Equal references are looked up once.
    """
    key = lambda c: match_key(F.col(c))
    scope = lambda *parts: F.to_json(F.array(*[F.col(p) for p in parts]))
    catalog = checkpointed(catalog.select("area", "folder", "column").distinct())  # read by every part below
    codes = resolve_references(refs, catalog).select("ref_id", "code").where(~F.col("code").isin("ok", "spelling"))
    open_ = checkpointed(refs.select("ref_id", "area", "folder", "column").join(codes, "ref_id").withColumns({"ka": key("area"), "kf": key("folder"), "kc": key("column")}))
    names = catalog.select("area", "folder", "column", key("area").alias("ka"), key("folder").alias("kf"), key("column").alias("kc"))
    first = lambda keys, name: names.groupBy(*keys).agg(F.min(name).alias("name"))
    # One run of the near search answers all three kinds; a scope says what and where.
    dictionaries = [first(["ka"], "area").select(F.lit("area").alias("kind"), F.lit("").alias("within"), "name"), first(["ka", "kf"], "folder").select(F.lit("folder").alias("kind"), scope("ka").alias("within"), "name"), first(["ka", "kf", "kc"], "column").select(F.lit("column").alias("kind"), scope("ka", "kf").alias("within"), "name")]
    labels = reduce(DataFrame.unionByName, dictionaries).select(F.concat("kind", F.lit(" "), "within").alias("scope"), "name")
    no_area, no_folder, no_column = (F.col("code") == c for c in ("unknown_area", "unknown_folder", "unknown_column"))
    in_folder = no_column & F.col("kf").isNotNull()
    asked = open_.select("ref_id", "code", F.when(no_area, "area").when(no_folder, "folder").when(in_folder, "column").alias("kind"), F.when(no_area, "").when(no_folder, scope("ka")).otherwise(scope("ka", "kf")).alias("within"), F.when(no_area, F.col("area")).when(no_folder, F.col("folder")).otherwise(F.col("column")).alias("request")).where("kind is not null").withColumn("scope", F.concat("kind", F.lit(" "), "within"))
    near = asked.join(nearest_in_scope(asked, labels, k), ["scope", "request"]).select("ref_id", "code", "kind", "rank", F.col("name").alias("suggestion"))
    w = Window.partitionBy("ka", "kc").orderBy("suggestion")
    wanted = open_.where(no_column | (F.col("code") == "ambiguous"))
    held = names.join(wanted.select("ka", "kc").distinct(), ["ka", "kc"], "left_semi").select("ka", "kc", F.col("folder").alias("suggestion")).distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(holders, choices))
    most = F.when(no_column, holders).otherwise(choices)
    held = wanted.join(held, ["ka", "kc"]).where(F.col("rank") <= most).select("ref_id", "code", F.lit("holder").alias("kind"), "rank", "suggestion")
    return near.unionByName(held)

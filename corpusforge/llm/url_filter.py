"""URL filter: longest host-and-path rule, else gradient-boosted trees on lexical features (operator 9, native).

Rules name a host (its subdomains included) and the beginning of a path. URLs that a rule decides are the
labelled ones; boosted trees learn from them and decide the rest. Features: lengths, depth, digit ratio,
entropy of the characters, query parameters, and statistics of the host's suffix.

Everything is DataFrame functions and Spark's own tree learner. Features of the suffix are counts and shares among
the labelled rows, joined back by suffix; a training row's are of the other folds (by hash of the URL), so that its own
label is no part of them. Training rows are the first `max_train` labelled ones by hash of
the URL; the learner works on partitions of them and returns a few hundred splits, which are turned into
CASE expressions, so scoring stays inside one generated stage.

Nulls: a null URL, and one without `://`, has an empty host and path, no rule, and features of zero
lengths. With labels of one kind only, or none, undecided URLs are allowed. Repeated rows are judged alike; rows with a null
or repeated page_id each by their own URL. Ties between rules go to the longer host, then to a block. Very long URLs are
read in the JVM, row by row; extra columns are left out, so their names can't clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import saved

#: Folds by which a training row's suffix features leave its own label out.
FOLDS = 4
FEATURES = ["url_length", "host_length", "path_length", "host_depth", "path_depth", "digit_ratio", "entropy", "n_params", "n_hyphens", "has_fragment", "last_digits", "suffix_rows", "suffix_share"]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(df: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Adds rule and rule_verdict: the longest of (verdict, host, path) rules that fits `host` and `path`.

    Ties in length go to the longer host, then to a block.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), -len(r[1]), r[0] != "block"))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for _, h, p in ordered]
    pick = lambda values: reduce(lambda acc, x: acc.when(x[0], x[1]), zip(fits, values, strict=True), F.when(F.lit(False), F.lit(None).cast("string")))
    return df.withColumns({"rule": pick([F.lit(h + p) for _, h, p in ordered]), "rule_verdict": pick([F.lit(v) for v, _, _ in ordered])})


def lexical(df: DataFrame) -> DataFrame:
    """Adds the lexical features of `url`, `host` and `path`, and the suffix (the host's last two labels)."""
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    chars = [*"abcdefghijklmnopqrstuvwxyz0123456789./:-_?&=#%"]
    low = F.lower(url)
    share = [(n - F.length(F.replace(low, F.lit(c), F.lit("")))) / F.greatest(n, F.lit(1)) for c in chars]
    entropy = reduce(lambda a, b: a + b, [F.when(s > 0, -s * F.log2(s)).otherwise(0.0) for s in share])
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return df.withColumns({
        "suffix": F.substring_index("host", ".", -2),
        "url_length": n.cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "host_depth": F.size(F.split("host", r"\.")).cast("double"),
        "path_depth": F.size(F.split("path", "/")).cast("double"),
        "digit_ratio": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(n, F.lit(1)),
        "entropy": entropy,
        "n_params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "n_hyphens": (n - F.length(F.replace(url, F.lit("-"), F.lit("")))).cast("double"),
        "has_fragment": F.contains(url, F.lit("#")).cast("double"),
        "last_digits": F.length(F.regexp_extract("path", r"([0-9]*)[^0-9/]*/?$", 1)).cast("double"),
    })


def tree_column(node) -> Column:
    """The prediction of a learnt tree (its JVM root node) as nested CASE expressions."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    low = F.col(FEATURES[split.featureIndex()]) <= float(split.threshold())
    return F.when(low, tree_column(node.leftChild())).otherwise(tree_column(node.rightChild()))


def fit_trees(labelled: DataFrame, trees: int, depth: int):
    """Boosted trees for `label` over FEATURES; None unless both labels occur."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    if labelled.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(labelled).select("x", "label")
    return GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=64, stepSize=0.3, seed=11).fit(rows)


def log_odds(model) -> Column:
    """The log-odds of `label` 1 by a model of fit_trees, as a column over FEATURES."""
    parts = [F.lit(float(w)) * tree_column(t._java_obj.rootNode()) for t, w in zip(model.trees, model.treeWeights, strict=True)]
    return 2 * reduce(lambda a, b: a + b, parts)


def with_suffix(df: DataFrame, labelled: DataFrame, folds: int = 0) -> DataFrame:
    """Adds suffix_rows and suffix_share: labelled rows of the suffix, and the share of label 1 among them (0.5 if none).

    With `folds`, those of a row's own fold are left out. The labelled rows' suffixes (at most max_train) are broadcast.
    """
    fold = F.pmod(F.xxhash64("url", F.lit(4)), F.lit(max(1, folds)))
    known = labelled.select(F.col("suffix").alias("own_suffix"), fold.alias("f"), "label")
    sums = [F.count("*").cast("double").alias("n"), F.sum("label").alias("ones")]
    total = known.groupBy("own_suffix").agg(*sums)
    joined = df.join(F.broadcast(total), F.col("suffix") == F.col("own_suffix"), "left").drop("own_suffix")
    n, ones = F.coalesce("n", F.lit(0.0)), F.coalesce("ones", F.lit(0.0))
    if folds:
        own = known.groupBy("own_suffix", "f").agg(F.count("*").cast("double").alias("own_n"), F.sum("label").alias("own_ones"))
        joined = joined.withColumn("_f", fold).join(F.broadcast(own), (F.col("suffix") == F.col("own_suffix")) & (F.col("_f") == F.col("f")), "left").drop("own_suffix", "_f", "f")
        n, ones = n - F.coalesce("own_n", F.lit(0.0)), ones - F.coalesce("own_ones", F.lit(0.0))
    return joined.withColumns({"suffix_rows": n, "suffix_share": F.when(n > 0, ones / n).otherwise(0.5)})


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], trees: int = 12, depth: int = 4, max_train: int = 50_000) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of `pages` (page_id, url).

    rules: (block or allow, host, path prefix). score: the learnt probability of block; the verdict is the
    rule's, else block from 0.5 on.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = lexical(with_rule(rows, rules))
    labelled = rows.where("rule is not null").withColumn("label", (F.col("rule_verdict") == "block").cast("double"))
    labelled = saved(labelled.orderBy(F.xxhash64("url"), "page_id").limit(max_train))
    model = fit_trees(saved(with_suffix(labelled, labelled, FOLDS)), trees, depth)
    score = 1 / (1 + F.exp(-log_odds(model))) if model is not None else F.lit(0.0)
    scored = with_suffix(rows, labelled).withColumn("score", score)
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")

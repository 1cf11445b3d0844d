"""Candidate pairs of requests and names: within an edit bound, and by containment. No join on a bigram alone.

Edits: a request is cut into one segment more than its bound, so a name within the bound holds one of them unchanged,
shifted by no more than the edits that can stand before it and after it. Keys are (length of the name, place, segment):
a common bigram is split over all lengths and places. Letter counts, as bits, then drop most pairs that can't be near.

Containment: names inside a request are found by equality with its substrings of the names' lengths; names around
it by its rarest run of three characters.

All of it is built-in functions; requests and names are deduplicated by the callers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
_I = lambda c: c.cast("int")


def _shift(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def letter_bits(c: Column) -> Column:
    """64 bits: characters in 32 classes, one bit for the first and one for a second of a class. An edit adds at most one bit
    and takes at most one away."""
    classes = F.array_sort(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: _I(F.pmod(F.ascii(x), F.lit(32)))))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("bits"))
    step = lambda acc, x: F.struct(x.alias("last"), acc["bits"].bitwiseOR(_shift(F.when(x == acc["last"], x + 32).otherwise(x))).alias("bits"))
    return F.aggregate(classes, start, step, lambda acc: acc["bits"])


def _far(a: Column, b: Column) -> Column:
    """The most letters that one has beyond the other: never more than their edit distance."""
    beyond = lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))
    return F.greatest(beyond(a, b), beyond(b, a))


def _steps(low: Column, high: Column) -> Column:
    return F.when(high >= low, F.sequence(_I(low), _I(high))).otherwise(F.array().cast("array<int>"))


def _request_keys(q: Column, d: Column) -> Column:
    """(size, place, gram) of every segment of q at every place that it can have in a name of every size."""
    n, d = F.length(q), _I(d)

    def of_size(size: Column) -> Column:
        delta = size - n

        def of_segment(j: Column) -> Column:
            begin, end = _I(F.floor(j * n / (d + 1))), _I(F.floor((j + 1) * n / (d + 1)))
            low, high = F.greatest(-j, delta - (d - j)), F.least(j, delta + (d - j))  # edits before it and after it
            gram = F.substr(q, begin + 1, end - begin)
            places = F.transform(_steps(low, high), lambda s: F.struct(size.alias("size"), (begin + s).alias("place"), gram.alias("gram")))
            return F.filter(places, lambda x: (x["place"] >= 0) & (x["place"] + (end - begin) <= size))

        return F.flatten(F.transform(F.sequence(F.lit(0), d), of_segment))

    return F.array_distinct(F.flatten(F.transform(_steps(F.greatest(n - d, F.lit(1)), n + d), of_size)))


def edit_pairs(requests: DataFrame, names: DataFrame) -> DataFrame:
    """Candidates (request, q, bound, name, key) for requests (request, q, bound) and names (name, key): every pair within
    `bound` edits, and those of the others that share a segment and most letters."""
    cols = ["request", "q", "bound", "name", "key"]
    r = requests.where(F.length("q") > 0).withColumn("_rb", letter_bits(F.col("q")))
    d = names.where(F.length("key") > 0).withColumns({"_nb": letter_bits(F.col("key")), "_size": F.length("key")})
    longer = r.where(F.length("q") > F.col("bound")).withColumn("_k", F.explode(_request_keys(F.col("q"), F.col("bound"))))
    asked = longer.select("request", "q", "bound", "_rb", F.col("_k.size").alias("_size"), F.col("_k.place").alias("_place"), F.col("_k.gram").alias("_gram"))
    # Names give grams of those widths that requests ask of their length; (size, width) pairs are few.
    widths = asked.select("_size", F.length("_gram").alias("_width")).distinct()
    held = d.join(widths, "_size").withColumn("_place", F.explode(_steps(F.lit(0), F.col("_size") - F.col("_width"))))
    held = held.withColumn("_gram", F.substr("key", F.col("_place") + 1, F.col("_width"))).drop("_width")
    pairs = asked.join(held, ["_size", "_place", "_gram"])
    # A request no longer than its bound may share nothing with a name within it: those are no longer than the bound
    # either, or else hold one of its letters.
    short = r.where(F.length("q") <= F.col("bound"))
    tiny = short.withColumn("_size", F.explode(F.sequence(F.lit(1), _I(F.col("bound"))))).join(d, "_size")
    letters = lambda c: F.explode(F.array_distinct(F.split(c, "")))
    sizes = F.explode(_steps(F.col("bound") + 1, F.length("q") + F.col("bound")))
    rest = short.withColumn("_size", sizes).withColumn("_gram", letters(F.col("q")))
    bounded = d.join(short.agg(F.max(F.length("q") + F.col("bound")).alias("_most")), F.col("_size") <= F.col("_most")).drop("_most")
    rest = rest.join(bounded.withColumn("_gram", letters(F.col("key"))), ["_size", "_gram"])
    near = [p.where(_far(F.col("_rb"), F.col("_nb")) <= F.col("bound")).select(*cols) for p in (pairs, rest)]
    return reduce(DataFrame.unionByName, [*near, tiny.select(*cols)]).distinct()


def _grams(c: Column, size: int) -> Column:
    return F.array_distinct(F.transform(_steps(F.lit(1), F.length(c) - size + 1), lambda i: F.substr(c, i, F.lit(size))))


def around_pairs(requests: DataFrame, names: DataFrame) -> DataFrame:
    """(request, q, name, key) of names that hold a request: each request is joined on its rarest gram only."""
    r, out = requests.where(F.length("q") > 0), []
    for size in range(1, GRAM + 1):
        some = r.where(F.length("q") == size if size < GRAM else F.length("q") >= GRAM)
        grams = names.withColumn("_gram", F.explode(_grams(F.col("key"), size)))
        asked = some.withColumn("_gram", F.explode(_grams(F.col("q"), size)))
        if size == GRAM:
            counts = grams.groupBy("_gram").agg(F.count("*").alias("_n"))
            w = Window.partitionBy("request").orderBy(F.coalesce("_n", F.lit(0)), "_gram")
            asked = asked.join(counts, "_gram", "left").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_n")
        out.append(asked.join(grams, "_gram").where(F.contains("key", "q")).select("request", "q", "name", "key"))
    return reduce(DataFrame.unionByName, out)


def inside_pairs(requests: DataFrame, names: DataFrame) -> DataFrame:
    """(request, q, name, key) of names that stand within a request: its substrings of the names' lengths, by equality."""
    sizes = names.select(F.length("key").alias("_size")).where("_size > 0").distinct()
    parts = requests.join(sizes, F.col("_size") <= F.length("q"))
    subs = F.array_distinct(F.transform(_steps(F.lit(1), F.length("q") - F.col("_size") + 1), lambda i: F.substr("q", i, F.col("_size"))))
    return parts.select("request", "q", F.explode(subs).alias("key")).join(names, "key").select("request", "q", "name", "key")


def near_pairs(requests: DataFrame, names: DataFrame) -> DataFrame:
    """Candidates (request, q, bound, name, key) by edits and containment, each once."""
    bound = requests.select("request", "bound")
    held = around_pairs(requests, names).unionByName(inside_pairs(requests, names)).join(bound, "request")
    return edit_pairs(requests, names).unionByName(held.select("request", "q", "bound", "name", "key")).distinct()

"""Line deduplication by a deletion-neighbourhood join (operator 10, native).

A line is a sequence of words (runs without spaces, in lower case). The edit bound is one word in
`min_words`, and one at most: with five, two lines of five words or more are near copies if their edit distance in
words is at most 1 (at least four words of five agree), while shorter lines have no copies but equal ones. A line is
dropped if an earlier line, in order of (doc_id, line number), has the same words or is a near copy. Lines
without a word are always kept.

Equal variants are joined from coarse to fine; only lines that share a variant go on, with the part where they may
differ:

1. Lines less a half: an edit lies in the first or the last half of the words, so near copies share the other.
2. Lines less a chunk of about sqrt(n) words, on what step 1 leaves.
3. Lines less one word of the chunk: the deletion neighbourhood. Lines share such a variant iff one word was
   substituted (both lack the word at the same place, which belongs to the key), or one line has a word more (its
   variant is the other line itself). Every pair of a key is within the bound, so the earliest line of a key
   stands for all and no pairs are emitted. The edit distance of what is found is verified on the words.

How it runs on Spark, in SQL functions alone: one pass over the texts sends a row of hashes a line and half, summed
before the shuffle, so a hot line or half costs a row a task. A second pass sends only the halves that may be shared
(a bit set of fixed size tells); texts are shuffled only where a document holds such lines.

Nulls: a null text has no lines. Rows with a null or repeated doc_id are documents of their own, after all
others. An empty table gives no rows. Very long texts and lines cost time and memory in proportion to their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bit_set import bit_set, maybe_in
from .durable import saved
from .row_ids import Numbered

EXACT, FIRST, LAST = 0, 1, 2


def words_of(line: Column) -> Column:
    """Words of a lower-case line."""
    return F.array_remove(F.split(line, " ", -1), "")


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of words are within edit distance 1."""
    longer, shorter = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    gap = F.size(longer) - F.size(shorter)
    equal = F.zip_with(F.slice(longer, 1, F.size(shorter)), shorter, lambda x, y: x == y)
    at = F.array_position(equal, False).cast("int")  # the first place at which they differ, from 1
    rest = F.slice(longer, at + 1, F.size(longer))
    other = F.slice(shorter, F.when(gap == 0, at + 1).otherwise(at), F.size(longer))
    return (gap <= 1) & ((at == 0) | (rest == other))


def xor_of(hashes: Column) -> Column:
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc.bitwiseXOR(h))


class Places:
    """A line's place as one number in order of (doc_id, line_no): a long where doc_ids span less than 2**32."""

    def __init__(self, docs: DataFrame):
        low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
        self.low = low or 0
        self.kind = "long" if (high or 0) - self.low < 1 << 31 else "decimal(38,0)"

    def place(self) -> Column:
        number = (F.col("doc_id").cast("decimal(20,0)") - F.lit(self.low)) if self.kind != "long" else F.col("doc_id") - F.lit(self.low)
        return (number.cast(self.kind) * F.lit(1 << 31).cast("long") + F.col("line_no")).cast(self.kind).alias("place")

    def split(self) -> list[Column]:
        """doc_id and line_no of `place`."""
        return [(F.expr(f"cast(place div {1 << 31}L as decimal(20,0))") + F.lit(self.low)).cast("long").alias("doc_id"), F.expr(f"cast(place % {1 << 31}L as int)").alias("line_no")]


def lines_of(docs: DataFrame, places: Places) -> DataFrame:
    """(place, line, n) of every line with a word: its words joined by one space, and how many they are."""
    # Outer generators here and below: the others make Spark compute the array twice, to leave out empty ones before.
    source = docs.select("doc_id", F.lower(F.col("text").cast("string")).alias("text")).where("text is not null")
    lines = source.select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line")).where(F.trim("line") != "")
    single = F.when(F.contains("line", F.lit("  ")), F.regexp_replace("line", " +", " ")).otherwise(F.col("line"))
    lines = lines.select(places.place(), F.trim(single).alias("line"))
    return lines.withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)


def half_length(m: Column) -> Column:
    """Length of the first and last part that lines of m words, and of m + 1, compare: up to m / 2, mostly equal for both."""
    half = F.floor(m / 2)
    unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(half)) - 2, F.lit(0)))
    return (half - half % unit).cast("int")


def half_keys(min_words: int) -> Column:
    """Keys (kind, k1, k2) of `line`: its first and last words, for both lengths of a shorter near copy."""
    n = F.col("n")
    lengths = F.filter(F.array_distinct(F.array(half_length(n), half_length(F.greatest(n - 1, F.lit(min_words))))), lambda k: n >= min_words)
    words = lambda k: F.call_function("substring_index", F.col("line"), F.lit(" "), k)
    part = lambda kind, k: F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), words(k if kind == FIRST else -k)).alias("k1"), k.cast("long").alias("k2"))
    return F.flatten(F.transform(lengths, lambda k: F.array(part(FIRST, k), part(LAST, k))))


def _identity() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(3), "line").alias("h2")]


def shared_parts(lines: DataFrame, places: Places, min_words: int) -> DataFrame:
    """Rows (EXACT, null, null, first place) of all different lines, and (kind, k1, k2, null) of the halves that several share."""
    own = F.struct(F.lit(EXACT).alias("kind"), F.col("h1").alias("k1"), F.col("h2").alias("k2"))
    keyed = lines.select("place", *_identity(), half_keys(min_words).alias("halves"))
    keyed = keyed.select("place", "h1", F.explode_outer(F.concat(F.array(own), "halves")).alias("key"))
    value = F.when(F.col("key.kind") == EXACT, F.col("place")).otherwise(F.col("h1").cast(places.kind))
    summed = keyed.select("key.*", value.alias("v")).groupBy("kind", "k1", "k2").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    exact = F.col("kind") == EXACT
    kept = summed.where(exact | (F.col("low") != F.col("high")))
    return kept.select("kind", *(F.when(~exact, F.col(c)).alias(c) for c in ("k1", "k2")), F.when(exact, F.col("low")).alias("place"))


def with_shared_halves(docs: DataFrame, lines: DataFrame, shared: DataFrame, places: Places, min_words: int) -> DataFrame:
    """(place, line) of the first of each of the lines that share a half with a different one."""
    keyed = lines.select("place", *_identity(), half_keys(min_words).alias("halves")).select("place", "h1", "h2", F.inline_outer("halves"))
    maybe = maybe_in(keyed, F.col("k1"), bit_set(shared.select("k1")))
    found = maybe.join(shared, ["kind", "k1", "k2"], "left_semi").groupBy("h1", "h2").agg(F.min("place").alias("place"))
    found = saved(found.select("place"))
    wanted = found.select(*places.split()).groupBy("doc_id").agg(F.collect_list("line_no").alias("some"))
    source = docs.select("doc_id", F.lower(F.col("text").cast("string")).alias("text"))
    held = bit_set(found.select(*places.split()).select(F.xxhash64("doc_id")))
    texts = maybe_in(source, F.xxhash64("doc_id"), held).join(wanted, "doc_id")
    pick = F.transform(F.array(F.struct(F.split("text", "\n", -1).alias("lines"), "some")), lambda t: F.transform(t["some"], lambda i: F.struct(i.alias("line_no"), F.get(t["lines"], i).alias("line"))))
    return texts.select("doc_id", F.inline_outer(F.get(pick, 0))).select(places.place(), "line")


def let(value: Column, then) -> Column:
    """then(value), with `value` computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


class Hashed:
    """`words` in the role of a line of m = n - more words: the hashes of its first and of its last m words with their
    places from 0, equal where `more` is 0; and the width of its chunks."""

    def __init__(self, more: int):
        words = F.col("words")
        self.m = F.size(words) - more
        placed = lambda part: F.transform(part, lambda w, i: F.xxhash64(w, i))
        self.both = F.struct(placed(F.slice(words, F.lit(1), self.m)).alias("a"), placed(F.slice(words, F.lit(1 + more), self.m)).alias("b"))
        self.width = F.ceil(F.sqrt(self.m)).cast("int")


def less_chunks(more: int) -> Column:
    """(m, chunk, hash) of `words` without each of its chunks: the words before are hashed with their places from
    the start, those after with the places that they have in a line of m words."""
    h = Hashed(more)
    starts = F.sequence(F.lit(0), h.m - 1, h.width)

    def running(hashes: Column) -> Column:  # of all words before each chunk, and of all at the end
        parts = F.transform(starts, lambda s: xor_of(F.slice(hashes, s + 1, h.width)))
        none = F.struct(F.lit(0).cast("long").alias("x"), F.array(F.lit(0).cast("long")).alias("all"))
        grown = lambda acc, part: F.struct(acc["x"].bitwiseXOR(part).alias("x"), F.array_append(acc["all"], acc["x"].bitwiseXOR(part)).alias("all"))
        return F.aggregate(parts, none, grown, lambda acc: acc["all"])

    before = lambda t: F.struct(running(t["a"]).alias("a"), running(t["b"]).alias("b"))
    rest = lambda t, c: F.get(t["a"], c).bitwiseXOR(F.element_at(t["b"], -1)).bitwiseXOR(F.get(t["b"], c + 1))
    rows = lambda t: F.transform(F.sequence(F.lit(0), F.size(t["a"]) - 2), lambda c: F.struct(h.m.alias("m"), c.alias("chunk"), rest(t, c).alias("hash")))
    return let(h.both, lambda both: let(before(both), rows))


def variants(more: int) -> Column:
    """(kind, m, at, hash, own) of the lines that lack one word of the chunk `chunk` of `words`.

    Without `more`: the line with a gap at each place of the chunk (kind 0), and the line itself (kind 1, own).
    With it: the line without each of the words of the chunk (kind 1), which may be another line of m words.
    """
    h = Hashed(more)
    low, high = F.col("chunk") * h.width, F.least((F.col("chunk") + 1) * h.width, h.m)
    row = lambda kind, at, hashed, own: F.struct(F.lit(kind).alias("kind"), h.m.alias("m"), at.alias("at"), hashed.alias("hash"), F.lit(own).alias("own"))
    if not more:
        gap = lambda t, x: F.transform(F.sequence(low, high - 1), lambda j: row(0, j, x.bitwiseXOR(F.get(t["a"], j)), False))
        return let(h.both, lambda t: let(xor_of(t["a"]), lambda x: F.concat(F.array(row(1, F.lit(-1), x, True)), gap(t, x))))
    # Without word j: words before it with their places, those after it with places one lower.
    steps = lambda t: F.struct(F.zip_with(t["a"], t["b"], lambda x, y: x.bitwiseXOR(y)).alias("u"), xor_of(t["b"]).alias("x"))
    upto = lambda t, j: t["x"].bitwiseXOR(xor_of(F.slice(t["u"], F.lit(1), low))).bitwiseXOR(xor_of(F.slice(t["u"], low + 1, j)))
    return let(h.both, lambda both: let(steps(both), lambda t: F.transform(F.sequence(F.lit(0), high - low), lambda j: row(1, F.lit(-1), upto(t, j), False))))


def near_copies(lines: DataFrame, min_words: int) -> DataFrame:
    """(place, of): each of the different `lines` (place, line) that has an earlier one within one edit, and that one."""
    lines = lines.select("place", words_of(F.col("line")).alias("words"))
    chunks = [lines.where(F.size("words") - more >= min_words).select("place", F.lit(more).alias("more"), F.inline_outer(less_chunks(more))) for more in (0, 1)]
    chunks = chunks[0].unionByName(chunks[1])
    key = ["m", "chunk", "hash"]
    shared = chunks.groupBy(key).agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low <> high").select(*key)
    matched = saved(chunks.join(shared, key, "left_semi").select("place", "more", "chunk"))
    both = matched.join(lines, "place")
    keyed = [both.where(F.col("more") == more).select("place", F.inline_outer(variants(more))) for more in (0, 1)]
    keyed = keyed[0].unionByName(keyed[1])
    key = ["kind", "m", "at", "hash"]
    low = keyed.groupBy(key).agg(F.min(F.when(~F.col("own"), F.col("place"))).alias("low"), F.max(F.when(~F.col("own"), F.col("place"))).alias("high"), F.min(F.when(F.col("own"), F.col("place"))).alias("whole"))
    low = low.where("(kind = 0 and low <> high) or (kind = 1 and low is not null and whole is not null)")
    pairs = keyed.where("not own").join(low, key)
    pairs = pairs.select("kind", F.when(F.col("kind") == 0, F.col("low")).otherwise(F.col("whole")).alias("other"), "place")
    pairs = pairs.select(F.greatest("place", "other").alias("place"), F.least("place", "other").alias("of")).where("place <> of").distinct()
    words = lines.select("place", "words")
    checked = pairs.join(words, "place").join(words.select(F.col("place").alias("of"), F.col("words").alias("earlier")), "of")
    return checked.where(within_one_edit(F.col("words"), F.col("earlier"))).groupBy("place").agg(F.min("of").alias("of"))


def line_decisions(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """(doc_id, firsts, near) of documents that hold the first of equal lines: the numbers of those lines, and of
    those among them that are near copies of an earlier one. `docs` has a doc_id of each row's own."""
    places = Places(docs)
    lines = lines_of(docs, places)
    parts = saved(shared_parts(lines, places, min_words))
    shared = parts.where(F.col("kind") != EXACT).select("kind", "k1", "k2")
    some = saved(with_shared_halves(docs, lines, shared, places, min_words))
    near = near_copies(some, min_words).select(*places.split(), F.lit(True).alias("near"))
    firsts = parts.where(F.col("kind") == EXACT).select(*places.split(), F.lit(False).alias("near"))
    each = firsts.unionByName(near).groupBy("doc_id")
    return each.agg(*(F.collect_list(F.when(F.col("near") == is_near, F.col("line_no"))).alias(name) for name, is_near in (("firsts", False), ("near", True))))


def _kept(blank: Column) -> Column:
    """Line numbers to keep, ascending: first ones that are no near copies, and those without a word."""
    none = F.array().cast("array<int>")
    return F.sort_array(F.array_union(F.array_except(F.coalesce("firsts", none), F.coalesce("near", none)), blank))


def _blank(text: Column) -> Column:
    """Numbers of the lines without a word."""
    numbered = F.transform(F.split(text, "\n", -1), lambda line, i: F.when(F.replace(line, F.lit(" "), F.lit("")) == "", i))
    return F.array_compact(numbered)


def dedup_lines(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """`docs` with the dropped lines cut out of `text` and, where it exists, n_chars counted anew.

    Documents of which every line was dropped go; those without a text, or that lost no line, stay as they are.
    """
    numbered = Numbered(docs)
    rows, columns = numbered.docs, docs.columns
    found = line_decisions(rows.select("doc_id", "text"), min_words)
    joined = rows.join(found.withColumnRenamed("doc_id", "_doc"), F.col("doc_id") == F.col("_doc"), "left")
    lines = F.split("text", "\n", -1)
    joined = joined.withColumns({"_n": F.size(lines), "_kept": _kept(_blank(F.col("text")))})
    lost = F.col("text").isNotNull() & (F.size("_kept") < F.col("_n"))
    picked = F.get(F.transform(F.array(F.struct(lines.alias("lines"), F.col("_kept").alias("kept"))), lambda t: F.array_join(F.transform(t["kept"], lambda i: F.get(t["lines"], i)), "\n")), 0)
    joined = joined.withColumn("_lost", lost).where("not _lost or size(_kept) > 0").withColumn("text", F.when(F.col("_lost"), picked).otherwise(F.col("text")))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        joined = joined.withColumn("n_chars", F.when(F.col("_lost"), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return joined.withColumn("doc_id", numbered.given()).select(*columns)


def line_counts(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """(doc_id, n_lines, n_dropped, dropped) for every row with a text: dropped line numbers, ascending, comma-joined."""
    numbered = Numbered(docs.select("doc_id", "text"))
    rows = numbered.docs
    found = line_decisions(rows.select("doc_id", "text"), min_words)
    text = F.col("text").cast("string")
    own = rows.where("text is not null").select(*numbered.columns(), F.size(F.split(text, "\n", -1)).alias("n_lines"), _blank(text).alias("blank"))
    joined = own.join(found.withColumnRenamed("doc_id", "_doc"), F.col("doc_id") == F.col("_doc"), "left")
    gone = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), _kept(F.col("blank")))
    joined = joined.select(numbered.given().cast("long").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.sort_array(gone).alias("gone"))
    return joined.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_dropped"), F.array_join(F.transform("gone", lambda x: x.cast("string")), ",").alias("dropped"))

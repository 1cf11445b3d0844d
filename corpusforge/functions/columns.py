"""Scalar column functions F1 to F33: text cleaning, hashes, names, rendering and small scores.

All are expressions over built-in functions and stay in generated code; NFKC (F12) is the one Arrow UDF.
Null in, null out, unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space beyond ASCII that counts as a space (fixed values).
UNICODE_SPACES = "".join(map(chr, [160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288, 65279]))
#: Entities in the order of decoding, the ampersand last (fixed values).
ENTITIES = [("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#34;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]
#: Dashes that count as a hyphen in labels (fixed values).
DASHES = "‐‑‒–—―−﹘﹣－"
#: Endings of table names that say their kind (fixed values).
STEM_SUFFIXES = ["TL", "VL", "V", "B", "F", "M", "ALL"]


def norm_text(c: Column) -> Column:
    """comments out (line comments before block comments), white space collapsed, lower case."""
    plain = F.translate(c, UNICODE_SPACES, " " * len(UNICODE_SPACES))
    no_lines = F.regexp_replace(plain, r"--[^\n]*", " ")
    no_blocks = F.regexp_replace(no_lines, r"(?s)/\*.*?\*/", " ")
    return F.lower(F.trim(F.regexp_replace(no_blocks, r"\s+", " ")))


def content_hash(c: Column) -> Column:
    """sha-256 of the normalised text, hex."""
    return F.sha2(norm_text(c), 256)


def content_id(c: Column, prefix: str = "sql:") -> Column:
    return F.concat(F.lit(prefix), content_hash(c))


def raw_hash(c: Column, algo: str = "sha256") -> Column:
    """sha256, md5 or sha1_20 (the first 20 digits of sha-1) of the text as it is."""
    if algo == "sha256":
        return F.sha2(c, 256)
    if algo == "md5":
        return F.md5(c)
    if algo == "sha1_20":
        return F.substring(F.sha1(c), 1, 20)
    raise ValueError(f"raw_hash: unknown algorithm {algo}")


def decode_entities(c: Column) -> Column:
    """seven entities, the ampersand last, so that a doubly escaped one is decoded in one pass."""
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def js_trim(c: Column) -> Column:
    """trim of ASCII and Unicode white space."""
    space = rf"[\s{UNICODE_SPACES}]+"
    return F.regexp_replace(F.regexp_replace(c, f"^{space}", ""), rf"{space}\z", "")


def null_norm(c: Column) -> Column:
    """trimmed; empty and any-case `null` become null."""
    t = js_trim(c)
    return F.when((t != "") & (F.lower(t) != "null"), t)


def clean_text(c: Column) -> Column:
    """F6, then F4."""
    return decode_entities(null_norm(c))


def json_nonempty(c: Column) -> Column:
    """F8: a JSON text, or null where it holds nothing ('', [], {}, null or a blank string)."""
    t = F.trim(c)
    blank = t.rlike(r'^(\[\s*\]|\{\s*\}|null|"\s*")?$')
    return F.when(~blank, c)


def text_nonempty(c: Column) -> Column:
    """F8: null where blank."""
    return F.when(F.trim(c) != "", c)


def to_int(c: Column) -> Column:
    """the leading integer of a text, else null."""
    return F.regexp_extract(null_norm(c), r"^\s*([+-]?\d+)", 1).try_cast("int")


def norm_name(c: Column) -> Column:
    """one quote off each end, the part after the last dot, upper case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), "^[\"'`]", ""), "[\"'`]$", "")
    return F.upper(F.trim(F.substring_index(bare, ".", -1)))


def strip_prefix(c: Column, prefix: str) -> Column:
    """a schema prefix and its dot off the front."""
    return F.when(F.startswith(c, F.lit(prefix + ".")), F.substr(c, F.lit(len(prefix) + 2))).otherwise(c)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def norm_label(c: Column, nfkc: bool = True) -> Column:
    """NFKC, lower case, dashes as hyphens with a space on each side as found, white space collapsed."""
    # NFKC leaves ASCII as it is, so only other values go through Python.
    other = F.when(~c.rlike(r"^[\x00-\x7F]*$"), c)
    t = F.translate(F.lower(F.coalesce(_nfkc(other), c) if nfkc else c), DASHES, "-" * len(DASHES))
    t = F.regexp_replace(t, r"\s*-\s+|\s+-\s*", " - ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def match_key(c: Column) -> Column:
    """lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def loose_key(c: Column) -> Column:
    """match_key without leading dashes."""
    return F.regexp_replace(match_key(c), r"^(-+\s*)+", "")


def display_hint(c: Column) -> Column:
    """an API name as words: no `__c`, no underscores, camel case split, lower case."""
    t = F.regexp_replace(F.regexp_replace(c, "__c$", ""), "_", " ")
    return F.lower(F.trim(F.regexp_replace(t, "([a-z0-9])([A-Z])", "$1 $2")))


def name_stem(c: Column) -> Column:
    """table-kind suffixes off the end while an underscore is left, then an `_ALL_` infix out."""
    cut = F.regexp_replace(c, f"^(.+?_.+?)(_({'|'.join(STEM_SUFFIXES)}))+$", "$1")
    return F.replace(cut, F.lit("_ALL_"), F.lit("_"))


def prefix_of(c: Column) -> Column:
    """F16: what stands before the first underscore or dot."""
    return F.regexp_extract(c, "^[^_.]*", 0)


def is_junk_remark(remark: Column, name: Column) -> Column:
    """blank, or the name itself but for case and punctuation. A null remark is junk."""
    bare = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    return F.coalesce((F.trim(remark) == "") | (bare(remark) == bare(name)), F.lit(True))


def clean_literal(c: Column, n: int = 80) -> Column:
    """trimmed, quotes around it off, at most n characters."""
    return F.left(F.regexp_replace(F.trim(c), "^'(.*)'$", "$1"), F.lit(n))


def render_predicate(table: Column, column: Column, op: Column, literal: Column) -> Column:
    """`T.C op literal`, with EQ as `=`; without a literal the operator ends it."""
    sign = F.when(op == "EQ", "=").otherwise(op)
    return F.concat_ws(" ", F.concat_ws(".", table, column), sign, literal)


def render_edge(from_t: Column, from_c: Column, to_t: Column, to_c: Column, kind: Column) -> Column:
    """`A.x=B.y[KIND]`; an inner join carries no kind."""
    tail = F.when(kind != "INNER", F.concat(F.lit("["), kind, F.lit("]"))).otherwise("")
    return F.concat(F.concat_ws(".", from_t, from_c), F.lit("="), F.concat_ws(".", to_t, to_c), F.coalesce(tail, F.lit("")))


def json_str_array(c: Column) -> Column:
    """an array as a JSON array of strings, in its order."""
    return F.to_json(F.transform(c, lambda x: x.cast("string")))


def compose_lines(groups: Sequence[tuple[str, Column]]) -> Column:
    """`label: entry` lines of several arrays, in the order of the groups; null arrays give none."""

    def lines(label: str, c: Column) -> Column:
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(label + ": "), x))

    return F.array_join(F.concat(*[lines(k, c) for k, c in groups]), "\n")


def embed_texts(description: Column, tables: Column, intents: Column) -> Column:
    """the texts to embed, by slot: the description with its tables, then the phrasings that aren't blank."""
    tail = F.when(F.size(tables) > 0, F.concat(F.lit("\nTables: "), F.array_join(tables, ", "))).otherwise("")
    return F.concat(F.array(F.concat(description, tail)), F.filter(intents, lambda x: F.trim(x) != ""))


def l2_to_score(d: Column, digits: int = 3) -> Column:
    """the cosine of unit vectors from their L2 distance."""
    return F.round(1 - d * d / 2, digits)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """cosine with a guard against zero vectors."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def l2(a: Column, b: Column) -> Column:
    """L2 distance."""
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def usage_score(weight: Column, chars: Column) -> Column:
    """a source's weight first, then the length of the text."""
    return weight * 100_000 + F.least(chars, F.lit(90_000))


def confidence(n: Column) -> Column:
    """HIGH from 3 occurrences on, MEDIUM at 2, else LOW."""
    return F.when(n >= 3, "HIGH").when(n == 2, "MEDIUM").otherwise("LOW")


def lcp_length(a: Column, b: Column) -> Column:
    """length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    same = F.transform(F.sequence(F.lit(0), n), lambda k: F.when(F.left(a, k) == F.left(b, k), k).otherwise(-1))
    return F.array_max(same)


def lcp_suffix(a: Column, b: Column) -> Column:
    """what follows the longest common prefix in b."""
    return F.substr(b, lcp_length(a, b) + 1)


def longest_prefix(c: Column, entries: Sequence[str]) -> Column:
    """the longest of a list of entries that begins the text, else null."""
    return reduce(lambda acc, e: acc.when(F.startswith(c, F.lit(e)), F.lit(e)), sorted(set(entries), key=lambda e: (-len(e), e)), F.when(F.lit(False), F.lit(None).cast("string")))


def exposes_inputs(c: Column, allowed: Sequence[str]) -> Column:
    """whether an expression shows its inputs: only allowed calls, no sub-select, no mask-like literal."""
    calls = F.regexp_extract_all(F.upper(c), F.lit(r"([A-Z_][A-Z0-9_]*)\s*\("), F.lit(1))
    known = F.forall(calls, lambda f: f.isin([a.upper() for a in allowed]))
    return known & ~F.upper(c).rlike(r"\bSELECT\b") & ~c.rlike(r"'[^']*[*Xx#]{3,}[^']*'")


def clip(c: Column, n: int) -> Column:
    """a struct of the first n characters and whether any were cut."""
    return F.struct(F.left(c, F.lit(n)).alias("text"), (F.length(c) > n).alias("truncated"))


def tokens(c: Column) -> Column:
    """runs of ASCII letters, digits and underscores, upper case."""
    return F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.upper)


def content_words(c: Column, stop: Sequence[str] = ()) -> Column:
    """F32: distinct lower-case words of four ASCII letters or more that aren't stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0)))
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else words


def jaccard(a: Column, b: Column) -> Column:
    """F32: Jaccard similarity of two arrays as sets; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def split_filters(filters: Column, pattern: str) -> Column:
    """a struct of the first filter that matches, and the filters without any that do."""
    hit = lambda x: x.rlike(pattern)
    return F.struct(F.try_element_at(F.filter(filters, hit), F.lit(1)).alias("matched"), F.filter(filters, lambda x: ~hit(x)).alias("rest"))

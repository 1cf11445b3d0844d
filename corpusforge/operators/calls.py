"""Call facts M4 and the API inventory M5.

One left-to-right pass over a text blanks comments, literals and quoted names at their length, so that what stands in one
of them never opens another. A second pass matches parentheses with a stack. Both run inside tasks on Arrow batches; which
bare references count is decided by joins, since it depends on the calls of all statements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.shared import stored
from .picks import top_n

#: Packages of the database itself, by name; what methods of its object types are called; its schemas.
BUILTIN = "^(DBMS_|UTL_|XMLTYPE$|XMLTYPE_|XMLDOM|XMLPARSER|XSLPROCESSOR|HTP$|HTF$|OWA_|CTX_|SDO_|ANYDATA|ANYTYPE|APEX_|WWV_|ORA_|SYS$|SYS_|JSON_|OLAP|STANDARD$|ODCI|DBMS$|XDB|MDSYS|CTXSYS|SYSTEM$|WPG_|SEM_)"
METHODS = "EXTRACT EXTRACTVALUE GETSTRINGVAL GETCLOBVAL GETNUMBERVAL GETBLOBVAL EXISTSNODE GETROOTELEMENT TRANSFORM ISFRAGMENT GETNAMESPACE COUNT FIRST LAST NEXT PRIOR EXISTS DELETE TRIM EXTEND LIMIT".split()
SCHEMAS = "SYS SYSTEM XDB MDSYS CTXSYS DBSNMP OUTLN".split()
CUSTOM = "^XX"

_CHAR = r"[A-Za-z0-9_$#]"
_NAME = rf"[A-Za-z]{_CHAR}*"
_ALONE = rf"""(?<![A-Za-z0-9_$#"'.])"""
_SKIPPED = re.compile(rf"""--[^\n]*|/\*.*?\*/|(?<!{_CHAR})[qQ]'(?:\[.*?\]|\{{.*?\}}|\(.*?\)|<.*?>)'|'[^']*(?:''[^']*)*'|"[^"]*\"""", re.S)
_CALL = re.compile(rf"{_ALONE}({_NAME})\s*\.\s*({_NAME})(?:\s*\.\s*({_NAME}))?\s*\((?!\s*\+\s*\))")
_BARE = re.compile(rf"{_ALONE}({_NAME})\s*\.\s*({_NAME})\b(?!\s*[(.])")
_ALIAS = re.compile(rf"""(?<=[)"A-Za-z0-9_$#])\s+(?:AS\s+)?({_NAME})(?![A-Za-z0-9_$#."])""", re.I)
_PIECE = re.compile(r"[(),]|[^\s(),]+")
_BLOCK = re.compile(r"\s*(?:DECLARE|BEGIN)\b", re.I)
_INLINE = re.compile(r"\bWITH\s+(?:FUNCTION|PROCEDURE)\b", re.I)
_END = re.compile(r"\bEND\s*;", re.I)

#: Facts of one Arrow batch, and those of one more text.
BLOCK = 8192
FACT = "schema_name string, package_name string, function_name string, arg_count int, paren boolean, found_in string, pos int, snippet string, truncated boolean"


def blanked(text: str) -> str:
    """`text` at its length, with comments as spaces and literals and quoted names as their delimiters around spaces."""

    def gap(m: re.Match) -> str:
        s = m.group()
        return " " * len(s) if s[0] in "-/" else s[0] + " " * (len(s) - 2) + s[-1]

    return _SKIPPED.sub(gap, text)


def parentheses(masked: str) -> dict[int, tuple[int, int]]:
    """For each `(` that is closed: the place of its `)` and its arguments by commas of its own level (none where only
    white space or parentheses stand between)."""
    closed, held = {}, []
    for m in _PIECE.finditer(masked):
        c = m.group()
        if c == "(":
            held.append([m.start(), 0, False])
        elif c == ")":
            if held:
                at, commas, filled = held.pop()
                closed[at] = m.start(), commas + 1 if filled else 0
        elif held and c == ",":
            held[-1][1] += 1
        elif held:
            held[-1][2] = True
    return closed


def block_of(masked: str) -> tuple[int, int]:
    """Where procedural code stands: all of a block, or from an inline function to the last END; (none: 0, 0)."""
    if _BLOCK.match(masked):
        return 0, len(masked)
    m = _INLINE.search(masked)
    if not m:
        return 0, 0
    ends = [e.end() for e in _END.finditer(masked, m.end())]
    return m.start(), ends[-1] if ends else len(masked)


def scan(text: str, longest: int = 240, before: int = 40) -> list[tuple]:
    """FACT of every dotted call in order, then of every bare dotted name whose first part isn't an alias of the text."""
    masked = blanked(text)
    closed, (low, high) = parentheses(masked), block_of(masked)
    where = lambda at: "plsql" if low <= at < high else "sql"

    def shown(a: int, b: int | None) -> tuple[str, bool]:
        cut = b is None or b - a > longest
        return " ".join(text[a : a + longest if cut else b].split()), cut

    out = []
    for m in _CALL.finditer(masked):
        # The opening parenthesis is the match's last character: the lookahead behind it takes no room.
        to, n = closed.get(m.end() - 1, (None, None))
        names = [x.upper() for x in m.groups() if x]
        out.append((names[0] if len(names) == 3 else None, *names[-2:], n, True, where(m.start()), m.start(), *shown(m.start(), None if to is None else to + 1)))
    aliases = None
    for m in _BARE.finditer(masked):
        if aliases is None:
            aliases = {a.upper() for a in _ALIAS.findall(masked)}
        package, name = m.group(1).upper(), m.group(2).upper()
        if package not in aliases:
            out.append((None, package, name, 0, False, where(m.start()), m.start(), *shown(max(0, m.start() - before), m.end())))
    return out


_NAMES = [f.split(" ")[0] for f in FACT.split(", ")]
_TYPES = [pa.string()] * 3 + [pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.bool_()]


def _batch_facts(batch: pa.RecordBatch, key: str) -> Iterator[pa.RecordBatch]:
    """The facts of a batch (key, text), each different text scanned once."""
    coded = batch.column(1).dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy()
    by_code = np.argsort(codes, kind="stable")
    for low in range(0, len(coded.dictionary), 256):
        found = [scan(t) for t in coded.dictionary.slice(low, 256).to_pylist()]
        facts = [x for f in found for x in f]
        held = [pa.array([x[k] for x in facts], t) for k, t in enumerate(_TYPES)]
        size = np.array([len(f) for f in found])
        start, calls = np.cumsum(size) - size, np.array([sum(x[4] for x in f) for f in found], np.int32)
        rows = by_code[slice(*np.searchsorted(codes, (low, low + 256), sorter=by_code))]
        ends = np.cumsum(size[codes[rows] - low])
        for some in np.split(rows, np.searchsorted(ends, np.arange(BLOCK, ends[-1], BLOCK))):
            n = size[codes[some] - low]
            seq = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            code = np.repeat(codes[some] - low, n)
            at = pa.array(start[code] + seq)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(some, n))), pa.array(seq.astype(np.int32)), pa.array(calls[code]), *(h.take(at) for h in held)], [key, "seq", "n_calls", *_NAMES])


def scanned(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, n_calls, FACT): what `scan` finds; null texts hold nothing. Equal texts of a batch are scanned once."""
    kind = texts.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batch_facts(batch, key)

    return texts.select(key, F.col(text).cast("string").alias(text)).mapInArrow(work, f"`{key}` {kind}, seq int, n_calls int, {FACT}")


def call_facts(texts: DataFrame, objects: DataFrame, packages: DataFrame, key: str, text: str, least: int = 2, builtin: str = BUILTIN, custom: str = CUSTOM) -> DataFrame:
    """M4: (key, seq, schema_name, package_name, function_name, arg_count, paren, found_in, pos, snippet, truncated).

    First each statement's calls in order; arg_count is null and the snippet cut where parentheses never close. Then
    its bare references: their package is in the dictionary, called in `least` statements with an underscore in
    its name, custom or built in; it is no object, and no alias of that statement. Texts are scanned once; the
    facts are saved, and only packages and bare references are shuffled.
    """
    facts = stored(scanned(texts, key, text), "calls")
    names = lambda df: df.select(F.upper("name").alias("package_name")).distinct()
    seen = facts.where(F.col("paren") & F.contains("package_name", F.lit("_"))).groupBy("package_name").agg(F.count_distinct(key).alias("_n")).where(F.col("_n") >= least)
    eligible = names(packages).union(seen.select("package_name")).distinct().withColumn("_e", F.lit(True))
    # What counts is settled by name, so facts meet the names that do in one join.
    asked = facts.where("not paren").select("package_name").distinct().join(names(objects), "package_name", "left_anti").join(eligible, "package_name", "left")
    asked = asked.where(F.col("_e") | F.col("package_name").rlike(builtin) | F.col("package_name").rlike(custom)).select("package_name")
    bare = facts.where("not paren").join(stored(asked, "packages"), "package_name")
    bare = bare.withColumn("seq", F.col("n_calls") + F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1)
    cols = [key, "seq", *(f.split(" ")[0] for f in FACT.split(", "))]
    return facts.where("paren").select(*cols).unionByName(bare.select(*cols))


def package_classes(calls: DataFrame, packages: DataFrame, modules: DataFrame, own: str = "product", builtin: str = BUILTIN, custom: str = CUSTOM, min_module: int = 5) -> DataFrame:
    """M5: (package_name, api_class, in_dictionary, module, real_call, bare_statements) of every package called.

    Classes: oracle (built in, or called through a schema of the database), custom, `own` (in the dictionary or truly
    called: by something other than a method's name), unknown. The module is that of most objects
    (name, module) with the package's prefix, if there are `min_module`; custom packages have none.
    """
    name = F.col("package_name")
    per = calls.groupBy("package_name").agg(
        F.count_distinct(F.when(~F.col("paren"), F.col("sql_hash"))).alias("bare_statements"),
        F.bool_or(F.col("paren") & ~F.col("function_name").isin(METHODS)).alias("real_call"),
        F.bool_or(F.coalesce(F.col("schema_name").isin(SCHEMAS), F.lit(False))).alias("_system"),
    )
    known = packages.select(F.upper("name").alias("package_name")).distinct().withColumn("_in", F.lit(True))
    prefix = modules.where("module is not null").groupBy(C.prefix_of(F.col("name")).alias("_prefix")).agg(F.count("*").alias("_n"), F.mode("module", True).alias("_m")).where(F.col("_n") >= min_module)
    out = per.join(known, "package_name", "left").join(prefix, C.prefix_of(name) == F.col("_prefix"), "left")
    kind = F.when(F.col("_system") | name.rlike(builtin), "oracle").when(name.rlike(custom), "custom").when(F.col("_in") | F.col("real_call"), own).otherwise("unknown")
    return out.select("package_name", kind.alias("api_class"), F.coalesce("_in", F.lit(False)).alias("in_dictionary"), F.when(~name.rlike(custom), F.col("_m")).alias("module"), "real_call", "bare_statements")


def _count_map(df: DataFrame, key: Sequence[str], value: Column, n: str, name: str) -> DataFrame:
    counted = df.groupBy(*key, F.coalesce(value, F.lit("?")).alias("_v")).agg(F.sum(n).alias("_n"))
    return counted.groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_v", "_n")))).alias(name))


def _seen_in(units: DataFrame, refs: DataFrame) -> DataFrame:
    """(sql_hash, title, path, unit, n): a row a unit and path; n is 1 in one row of each unit of a statement, else 0. `unit` names
    units of several statements only, which are counted by name; the others need no more than a sum."""
    w = Window.partitionBy("unit_id")
    rows = units.where("unit_id is not null").select("unit_id", "sql_hash", "title").withColumns({
        "_again": F.row_number().over(Window.partitionBy("unit_id", "sql_hash").orderBy("sql_hash")) > 1,
        "_several": F.min("sql_hash").over(w) < F.max("sql_hash").over(w),
    })
    paths = refs.where("unit_id is not null and path is not null").select("unit_id", "path").withColumn("_r", F.row_number().over(w.orderBy("path")))
    once = ~F.col("_again") & (F.coalesce("_r", F.lit(1)) == 1)
    named = rows.join(paths, "unit_id", "left").select("sql_hash", "title", "path", F.when(F.col("_several"), F.col("unit_id")).alias("unit"), once.cast("long").alias("n"))
    null = F.lit(None)
    return named.unionByName(units.where("unit_id is null").select("sql_hash", "title", null.cast(named.schema["path"].dataType).alias("path"), null.cast(named.schema["unit"].dataType).alias("unit"), F.lit(0).cast("long").alias("n")))


def _parts(df: DataFrame) -> int:
    """Partitions that adaptive execution leaves alone: merged to few by their compressed bytes, each would hold far more rows in memory."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _uses(corpus: DataFrame, tables: DataFrame, modules: DataFrame) -> DataFrame:
    """(sql_hash, kind, value, n): the source of a statement, its tables and their modules, each with its number of rows."""
    named = tables.select("sql_hash", "table_name").join(modules.where("module is not null").select(F.col("name").alias("table_name"), "module").distinct(), "table_name", "left")
    both = F.array(F.struct(F.lit("table").alias("kind"), F.col("table_name").alias("value")), F.struct(F.lit("module").alias("kind"), F.col("module").alias("value")))
    uses = named.select("sql_hash", F.inline(both)).where("kind = 'table' or value is not null").unionByName(corpus.select("sql_hash", F.lit("source").alias("kind"), F.col("source").alias("value")))
    return uses.repartition(_parts(corpus), "sql_hash").groupBy("sql_hash", "kind", "value").agg(F.count("*").alias("n"))


def _ranked(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int, fields: Sequence[Column | str], name: str) -> DataFrame:
    """The first n rows a key as an ordered list of structs."""
    w = Window.partitionBy(*key).orderBy(*order)
    kept = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    lists = kept.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_r", F.struct(*fields).alias("x")))).alias("_l"))
    return lists.select(*key, F.transform("_l", lambda s: s["x"]).alias(name))


def api_inventory(calls: DataFrame, corpus: DataFrame, units: DataFrame, refs: DataFrame, tables: DataFrame, modules: DataFrame, packages: DataFrame, first_source: str, own: str = "product", min_module: int = 5, n_tables: int = 8, n_modules: int = 5, n_samples: int = 2) -> DataFrame:
    """M5: one row a (package_name, function_name) of M4's facts with key sql_hash.

    api_class, module and module_source (prefix or usage), in_dictionary; distinct statements, units, reports and
    titles; statements by source, calls by number of arguments (`?`: never closed) and by found_in; the tables
    and modules of most statements; samples: the best snippets of distinct statements (described first, then of
    first_source, whole, short). Bare references of packages that are never truly called need two statements.

    corpus: (sql_hash, source, title, described); units: (unit_id, sql_hash, title); refs: (unit_id, path);
    tables: (sql_hash, table_name); modules: (name, module) of objects.
    """
    key = ["package_name", "function_name"]
    classes = stored(package_classes(calls, packages, modules, own, min_module=min_module), "classes")
    counted = classes.where("real_call or bare_statements >= 2").select("package_name", F.lit(True).alias("_counted"))
    c = calls.where("package_name is not null").join(counted, "package_name", "left").where("_counted or paren")
    c = stored(c.select("sql_hash", *key, "arg_count", "found_in", "pos", "snippet", "truncated"), "counted")  # read by every part below
    each = c.groupBy(*key, "arg_count", "found_in").agg(F.count("*").alias("n"))
    args = _count_map(each, key, F.col("arg_count").cast("string"), "n", "arg_counts")
    found_in = _count_map(each, key, F.col("found_in"), "n", "found_in")
    # The saved table's files are far smaller than its rows: no join may broadcast it.
    once = c.select("sql_hash", *key).repartition(_parts(calls), "sql_hash").distinct().hint("merge")
    base = once.groupBy(*key).agg(F.count("sql_hash").alias("statements")).join(classes.select("package_name", "api_class", "in_dictionary", "module"), "package_name")
    base = base.withColumn("api_class", F.when((F.col("api_class") == "unknown") & F.col("function_name").isin(METHODS), "method").otherwise(F.col("api_class")))
    # Both frames are counted by function right behind their join, so no row of a statement is dealt again by function.
    seen = stored(once.join(_seen_in(units, refs), "sql_hash").groupBy(*key, "title", "path", "unit").agg(F.sum("n").alias("n")), "seen")
    whole = seen.groupBy(*key).agg(F.sum(F.when(F.col("unit").isNull(), F.col("n"))).alias("_n"), F.count_distinct("unit").alias("_u"))
    numbers = whole.select(*key, (F.col("_n") + F.col("_u")).alias("units"))
    of = lambda c, name: seen.where(F.col(c).isNotNull()).select(*key, c).distinct().groupBy(*key).agg(F.count("*").alias(name))
    used = stored(once.join(_uses(corpus, tables, modules), "sql_hash").groupBy(*key, "kind", "value").agg(F.sum("n").alias("n"), F.count("*").alias("statements")), "used")
    by_source = _count_map(used.where("kind = 'source'"), key, F.col("value"), "n", "by_source")
    top = lambda kind, column, n, name: _ranked(used.where(F.col("kind") == kind).withColumnRenamed("value", column), key, [F.desc("statements"), F.col(column)], n, [column, "statements"], name)
    top_tables, top_modules = top("table", "table_name", n_tables, "top_tables"), top("module", "module", n_modules, "top_modules")
    short = top_n(c.select("sql_hash", *key, "truncated", "snippet", "pos").repartition(_parts(calls), "sql_hash"), ["sql_hash", *key], [F.col("truncated"), F.length("snippet"), F.col("pos")], 1).drop("pos")
    best = short.hint("merge").join(corpus.select("sql_hash", "source", "title", "described"), "sql_hash")
    order = [~F.col("described"), F.col("source") != first_source, F.col("truncated"), F.length("snippet"), F.col("sql_hash")]
    samples = _ranked(best, key, order, n_samples, ["snippet", "sql_hash", "source", "title"], "samples")
    out = base
    for part in (numbers, of("title", "titles"), of("path", "reports"), by_source, args, found_in, top_tables, top_modules, samples):
        out = out.join(part, key, "left")
    usage = F.get("top_modules", F.lit(0))["module"]
    source = F.when(F.col("module").isNotNull(), "prefix").when(usage.isNotNull(), "usage")
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return out.select("api_class", F.coalesce("module", usage).alias("module"), source.alias("module_source"), *key, "in_dictionary", "statements", zero("units"), zero("reports"), zero("titles"), "by_source", "arg_counts", "found_in", "top_tables", "top_modules", "samples")

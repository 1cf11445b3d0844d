"""Periodic runs, vector codes and byte-level BPE against plain versions, and their odd rows."""

import base64
import hashlib
import math
import random
import zlib
from itertools import pairwise

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import byte_bpe, oracle, periodic_runs, queries, vector_codes
from corpusforge.llm import text as T

# -- periodic runs ----------------------------------------------------------------------------------------------------


def words_of(text):
    return [w for w in "".join(" " if c in "\x20\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def plain_runs(w, least=6, exponent=4):
    """Every period by itself: maximal stretches of equal words q apart, whose smallest period is q."""
    out = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, exponent * q) and not any(w[i : i + n - d] == w[i + d : i + n] for d in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_words(rng):
    w = []
    for _ in range(rng.randint(0, 6)):
        base = [rng.choice("abcdefgh"[: rng.randint(1, 5)]) for _ in range(rng.randint(1, 12))]
        many = base * rng.choice([1, 1, 2, 4, 5, 7])
        w += many[: len(many) - rng.randint(0, min(3, len(many) - 1))]
    return w


def test_runs_equal_a_plain_search():
    rng = random.Random(5)
    seen = 0
    for _ in range(250):
        docs = [random_words(rng) for _ in range(rng.randint(1, 5))]
        column = pa.array([" \n".join(w) + rng.choice(["", " "]) for w in docs] + [None, ""], pa.string())
        data, offsets = T.buffers(column)
        starts, ends, first = T.word_spans(data, offsets, T.NOT_SPACE)
        runs = periodic_runs.runs_of(data, starts, ends, first, 6, 4)
        texts = periodic_runs._collapsed(data, starts, ends, first, runs).to_pylist()
        for k, w in enumerate(docs):
            mine = [(a - first[k], n, q) for a, n, q in runs.tolist() if first[k] <= a < first[k + 1]]
            assert mine == plain_runs(w)
            assert texts[k] == plain_collapsed(w, mine)
            seen += len(mine)
        assert texts[-2:] == ["", ""]
    assert seen > 500


def test_common_extensions_equal_comparisons():
    rng = random.Random(6)
    for _ in range(40):
        s = [rng.randint(1, 3) for _ in range(rng.randint(2, 60))] + [0]
        found = periodic_runs.Extensions(s)
        assert np.argsort(found.rank).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        pairs = [(i, j) for i in range(len(s)) for j in range(len(s)) if i != j]
        got = found.common(*np.array(pairs).T)
        for (i, j), n in zip(pairs, got.tolist(), strict=True):
            assert s[i : i + n] == s[j : j + n] and s[i + n : i + n + 1] != s[j + n : j + n + 1]


def test_zones_are_few_in_words_without_runs():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 300, 20_000).astype(np.uint64)
    begins, stops = periodic_runs.zones(T.mix(words), np.array([0, 20_000]))
    assert (stops - begins).sum() < 200


def plain_op11(doc_id, text):
    w = words_of(text)
    n = len(w)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *four, digest("".join(f"{a},{n},{q}\n" for a, n, q in runs)), digest(plain_collapsed(w, runs)))


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_op11_equals_plain(spark, sf):
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 12_000]
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, sf).select(*NAMES).collect()}
    for r in docs:
        assert got[r.doc_id] == plain_op11(r.doc_id, r.text), r.doc_id
    assert sum(v[1] > 0 for v in got.values()) > len(got) / 20


def test_op11_of_odd_rows(spark, odd_docs, no_docs):
    rows = periodic_runs.find_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[1].n_words, by_id[1].runs, by_id[1].collapsed) == (0, [], "")
    assert by_id[3].collapsed == "" and by_id[4].collapsed == by_id[5].collapsed == "one"
    assert by_id[None].collapsed == "no id but words to read here"
    assert periodic_runs.find_runs(no_docs).count() == 0
    tails = {r.doc_id: words_of(r.text) for r in queries._with_tails(odd_docs).where("length(text) < 1000").collect()}
    for r in odd_docs.where("length(text) < 1000").collect():
        w = words_of(r.text)
        h = zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is None or h % 10 or not w:
            assert tails[r.doc_id] == w


def test_op11_of_a_very_long_text(spark):
    text = "a b c " * 40_000 + " ".join(f"w{i}" for i in range(50_000)) + " x" * 70_000
    row = periodic_runs.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(0, 120_000, 3), (170_000, 70_000, 1)]
    assert row.collapsed == "a b c " + " ".join(f"w{i}" for i in range(50_000)) + " x"


# -- vector codes -----------------------------------------------------------------------------------------------------


def test_balls_assign_as_all_distances_do():
    rng = np.random.default_rng(4)
    total = plain = 0
    for k in range(60):
        wide, entries, n = (2, 5, 8)[k % 3], (1, 7, 16)[k % 3], 400
        e = rng.integers(-(3 ** (k % 5 + 1)), 3 ** (k % 5 + 1), (entries, wide))
        x = e[rng.integers(0, entries, n)] + rng.integers(-2, 3, (n, wide))
        d = vector_codes.squared(x[:, None], e[None])
        for held in (np.zeros(n, np.int64), d.argmin(axis=1), rng.integers(0, entries, n)):
            label, error, computed = vector_codes.reassigned(x, e, held)
            assert label.tolist() == d.argmin(axis=1).tolist() and error.tolist() == d.min(axis=1).tolist()
        label, _, computed = vector_codes.reassigned(x, e, d.argmin(axis=1))
        total, plain = total + computed, plain + n * entries
    assert total < plain / 2  # stable cores and rings


def test_op12_equals_sql(spark, sf):
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = sorted(tuple(r) for r in queries.op12_vector_codes(spark, sf).select(*names).collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert got == sorted(con.sql(f"select {', '.join(names)} from ({oracle.OP12})").fetchall())


VECTORS = "vec_id long, embedding array<float>, label int, codes string, error int"


def plain_codes(rows, parts, entries, rounds, scale):
    kept = [(r[0], [math.floor(scale * x) for x in r[1]]) for r in rows]
    wide = len(kept[0][1]) // parts
    cut = [[v[p * wide : (p + 1) * wide] for p in range(parts)] for _, v in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut[i][p] for i in first] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = [near(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                mine = [c[p] for c, h in zip(cut, held, strict=True) if h == k]
                books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else books[p][k]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    return books, [([k for _, k in f], sum(d for d, _ in f)) for f in found]


def test_op12_of_odd_rows(spark):
    rng = np.random.default_rng(8)
    good = [(int(i), [float(np.float32(x)) for x in rng.normal(size=8)], int(i % 3) if i % 4 else None) for i in range(40)]
    good += [good[0], good[5], (None, good[7][1], 1), (90, [0.0] * 8, 2), (91, [-0.00001] * 8, 2)]
    odd = [(100, None, 1), (101, [1.0] * 7 + [None], 1), (102, [float("nan")] * 8, 1), (103, [float("inf")] + [0.0] * 7, None)]
    short = [(104, [1.0, 2.0], 1), (105, [], 1)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in good + odd + short], VECTORS).repartition(3)
    books = vector_codes.train(df, parts=4, entries=5, rounds=3, scale=100)
    want_books, want = plain_codes(good, 4, 5, 3, 100)
    assert books.final == want_books
    coded = vector_codes.encode(df, books)
    got = sorted(((r.vec_id, r.codes, r.error) for r in coded.collect() if r.codes is not None), key=repr)
    assert got == sorted(((r[0], *w) for r, w in zip(good, want, strict=True)), key=repr)
    assert sorted(r.vec_id for r in coded.where("codes is null").collect()) == [104, 105]
    sums = {}
    for r, (_, error) in zip(good, want, strict=True):
        sums[r[2]] = sums.get(r[2], 0) + error
    for most in (100, 2):  # sums broadcast, and labels of few rows joined by a shuffle
        rows = vector_codes.with_label_error(coded, most=most).collect()
        assert len(rows) == len(good) + 2 and all(r.label_error == sums[r.label] for r in rows)
    back = vector_codes.decode(coded.where("codes is not null"), books).first()
    assert len(back.vector) == 8
    assert vector_codes.encode(df.limit(0), vector_codes.train(df.limit(0))).count() == 0
    one = df.where("vec_id = 90")
    assert vector_codes.encode(one, vector_codes.train(one)).first().codes == [0] * 8
    with pytest.raises(ValueError):
        vector_codes.train(df, parts=3)
    with pytest.raises(Exception, match="magnitude"):
        vector_codes.train(spark.createDataFrame([(1, [1e9] * 8)], "vec_id long, embedding array<double>"))


# -- byte-level BPE ---------------------------------------------------------------------------------------------------

HARD = ["", "a" * 90_000, "a" + " " * 80_000 + "b", " " * 70_000, "\n \t" * 30_000 + "x", "中文字。" * 20_000, "x1" * 50_000, "it's we'll 'S don't" * 6_000, "🙂🏽‍" * 9_000, "a b  c \x1c\x85d" * 3_000, "('!');{}" * 9_000, "<|endoftext|> x", "\x00퟿� é"]


def library():
    import public_tokenizers
    import tiktoken

    with open(byte_bpe.default_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library():
    plain, mine = library(), byte_bpe.loaded(byte_bpe.default_path(), byte_bpe.default_pattern())
    rng = random.Random(9)
    texts = HARD + ["".join(rng.choice("ab 1'.\n中é—\t") for _ in range(rng.choice([5, 3_000, 40_000]))) for _ in range(60)]
    for text in texts:
        ids = mine.encode(text).tolist()
        assert ids == plain.encode_ordinary(text), text[:40]
        assert mine.decode(ids) == text.encode()


def test_chunks_end_where_matches_end():
    import regex

    pattern = regex.compile(byte_bpe.default_pattern())
    rng = random.Random(10)
    for _ in range(300):
        text = "".join(rng.choice("ab1 '.,\n中é—t(s") for _ in range(rng.randint(0, 80)))
        parts = list(byte_bpe.chunks(text, 5))
        assert "".join(parts) == text
        assert [m.group() for p in parts for m in pattern.finditer(p)] == [m.group() for m in pattern.finditer(text)]


def test_op13_equals_the_library(spark, sf):
    plain = library()
    got = {r.doc_id: r for r in queries.op13_byte_bpe(spark, sf).collect()}
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = plain.encode_ordinary(r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), digest(",".join(map(str, ids)).encode()), digest((r.text or "").encode()))


def test_op13_of_odd_rows(spark, odd_docs, no_docs):
    coded = byte_bpe.decode(byte_bpe.encode(odd_docs.withColumn("data", F.lit("clash"))))
    rows = coded.collect()
    assert len(rows) == odd_docs.count() and set(odd_docs.columns) < set(coded.columns)
    assert all(bytes(r.data) == (r.text or "").encode() and (r.ids == []) == (not r.text) for r in rows)
    assert byte_bpe.decode(byte_bpe.encode(no_docs)).count() == 0
    hard = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)] + [(99, " " * 1_200_000 + "x")], "doc_id long, text string")
    assert all(bytes(r.data) == r.text.encode() for r in byte_bpe.decode(byte_bpe.encode(hard)).collect())
    broken = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text")
    assert bytes(byte_bpe.decode(byte_bpe.encode(broken)).first().data) == "a�b".encode()
    assert bytes(byte_bpe.decode(spark.createDataFrame([(None,)], "ids array<int>")).first().data) == b""
    ids = byte_bpe.encode(odd_docs.where("doc_id = 11")).first().ids
    assert len(ids) > 5 and all(a is not None for a, _ in pairwise(ids))

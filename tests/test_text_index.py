"""Ranked search against a plain version, and the stored index: what a search reads and an update rewrites."""

import math
import random
import re

import pytest

from corpusforge.operators import text_index
from corpusforge.sources.bucketed import BucketedTable

FIELDS = {"name": 4.0, "remark": 1.0}
DOCS = "id long, name string, remark string"


def lex(s):
    return re.findall("[A-Z0-9]+", (s or "").upper())


def plain_search(query, docs, k):
    terms = list(dict.fromkeys(re.findall("[A-Z0-9_]+", query.upper())))
    asked = [lex(t) for t in terms if lex(t)]
    rows = []
    for i, name, remark in docs:
        hits, weight = 0, 0.0
        for t in asked:
            w = 0.0
            for tokens, by in ((lex(name), 4.0), (lex(remark), 1.0)):
                for a in range(len(tokens) - len(t) + 1):
                    part = tokens[a : a + len(t)]
                    if part[:-1] == t[:-1] and part[-1].startswith(t[-1]):
                        w += by
            hits, weight = hits + (w > 0), weight + w
        n = len(lex(name)) + len(lex(remark))
        if hits:
            rows.append((((name or "").upper() == "_".join(terms)), hits, round(weight / (1 + math.log(n)), 6), name, i))
    full = [r for r in rows if r[1] == len(asked)]
    kept = full or [r for r in rows if len(asked) > 1]
    kept.sort(key=lambda r: (not r[0], -r[1], -r[2], len(r[3] or ""), r[3] is None, r[3] or "", r[4]))
    return [(i, n + 1, h, s, "and" if full else "or") for n, (_, h, s, _, i) in enumerate(kept[:k])]


def plain_phrase(query, docs):
    return {i for i, name, remark in docs for q in [lex(query)] for t in (lex(name), lex(remark)) if q and any(t[a : a + len(q) - 1] == q[:-1] and t[a + len(q) - 1].startswith(q[-1]) for a in range(len(t) - len(q) + 1))}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    word = lambda: rng.choice(["AP", "APX", "INVOICE", "INVOICES", "ALL", "A", "1", "12", "GL", "GLOBAL"])
    docs = [(i, "_".join(word() for _ in range(rng.randint(1, 3))), " ".join(word().lower() for _ in range(rng.randint(0, 5)))) for i in range(150)]
    return docs + [(900, None, "ap invoices"), (901, "AP_INVOICES_ALL", None), (902, "", "")]


QUERIES = ["ap", "ap_invoices_all", "AP invoice", "gl zz", "zz", "ap_inv gl_g", "_ a", "", "1 12", "invoices_a gl ap", "inv inv", "!!", " ".join(f"w{i}" for i in range(70)) + " ap 12"]


def check(index, spark, docs, k=7):
    q = spark.createDataFrame([(t, t) for t in QUERIES], "query_id string, query string")
    got = {}
    for r in sorted(index.search(q, k).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.id, r["rank"], r.hits, r.score, r.mode))
    assert got == {t: w for t in QUERIES if (w := plain_search(t, docs, k))}
    found = {}
    for r in index.phrases(q).collect():
        found.setdefault(r.query_id, set()).add(r.id)
    assert found == {t: w for t in QUERIES if (w := plain_phrase(t, docs))}


def test_search_equals_plain(spark, corpus):
    df = spark.createDataFrame(corpus, DOCS)
    check(text_index.index_of(df, FIELDS, "id"), spark, corpus)
    index = text_index.index_of(df, FIELDS, "id")
    index.block = 5  # most tokens in several parts
    check(index, spark, corpus)
    assert text_index.text_search(spark.createDataFrame([("q", "ap")], "query_id string, query string"), df.limit(0), FIELDS, "id").count() == 0


def test_stored_index_is_searched_and_updated_by_its_buckets(spark, corpus, tmp_path, monkeypatch):
    made = text_index.StoredTextIndex(spark, f"file://{tmp_path}/i", FIELDS, "id", buckets=8)
    df = spark.createDataFrame(corpus, DOCS)
    assert made.update(df) == len(corpus) and made.update(df) == 0
    check(made.index(), spark, corpus)

    # A search neither tokenises documents nor reads other buckets.
    read = []
    inner = BucketedTable._read
    monkeypatch.setattr(BucketedTable, "_read", lambda self, files: (read.append((self.key, set(files))), inner(self, files))[1])
    index = made.index()
    read.clear()
    one = spark.createDataFrame([("q", "global")], "query_id string, query string")
    assert index.search(one).count() > 0
    every = {f for fs in made.postings.snapshot()[1]["files"].values() for f in fs}
    assert [k for k, _ in read] == ["token"] and 0 < len(read[0][1]) < len(every)
    monkeypatch.undo()

    rare = spark.createDataFrame([(800, "RARE", None), (801, None, "seldom")], DOCS)
    assert made.update(rare) == 2
    before = made.postings.snapshot()[1]["files"]
    assert made.update(spark.createDataFrame([(800, "RARE", "rare"), (801, None, "seldom")], DOCS)) == 1
    after = made.postings.snapshot()[1]["files"]
    assert sum(before[c] != fs for c, fs in after.items()) == 1  # its token's bucket only
    made.remove(rare.select("id"))
    changed = [(0, "NEWWORD", "ap"), (901, "AP_INVOICES_ALL", None), (950, "GLOBAL_NEWWORD", "x")]
    assert made.update(spark.createDataFrame(changed, DOCS)) == 2
    docs = {r[0]: r for r in corpus} | {r[0]: r for r in changed}
    check(made.index(), spark, list(docs.values()))
    made.remove(spark.createDataFrame([(0,), (1,), (7777,)], "id long"))
    del docs[0], docs[1]
    check(made.index(), spark, list(docs.values()))


def test_an_update_that_stops_half_way_runs_again(spark, corpus, tmp_path, monkeypatch):
    made = text_index.StoredTextIndex(spark, f"file://{tmp_path}/i", FIELDS, "id", buckets=4)
    made.update(spark.createDataFrame(corpus[:80], DOCS))
    with monkeypatch.context() as m:
        m.setattr(BucketedTable, "upsert", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            made.update(spark.createDataFrame(corpus[40:], DOCS))
    made.update(spark.createDataFrame(corpus[40:], DOCS))
    check(made.index(), spark, corpus)

"""Each operator against a plain version on the small tables, and its odd cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import text as T
from corpusforge.llm import ann, components, decontaminate, jaccard_join, language_id, line_dedup, packing, quality, queries, sharding, token_output, tokens, url_filter


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def plain_ids(text):
    return tokens.tokenizer(tokens.default_path()).inner.encode(text or "", add_special_tokens=False).ids + [1]


# -- tokens and packing ----------------------------------------------------------------------------------------------


def test_tokens_equal_the_librarys(spark, sf, odd_docs):
    words = tokens.WordTokenizer(tokens.default_path())
    texts = [r.text or "" for r in table(spark, sf, "documents").limit(80).union(odd_docs.select("doc_id", "text", "lang", "source", "n_chars")).collect()]
    texts += ["'s't ''s !'s 'sun it's we'll", "ΑΣ Σας", "éa a̧", "12३४", "a\x1cb\x85c", "<|endoftext|>", "'", ""]
    ids, at = words.encode(texts)
    for i, e in enumerate(words.inner.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids, texts[i][:60]


def check_pieces(rows, docs, window):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, copies in docs.items():
        mine = sorted(by_doc[i], key=lambda r: (r.start, r.sequence_id))
        for text in copies:
            ids, at = plain_ids(text), 0
            while at < len(ids):
                r = next(r for r in mine if r.start == at)
                mine.remove(r)
                part = np.array(ids[at : at + r.length], "<u4").tobytes()
                assert (r.ids_crc32, r.doc_tokens) == (zlib.crc32(part), len(ids))
                at += r.length
            assert at == len(ids)
        assert not mine
    for pieces in by_sequence.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == end and r.length > 0
            end += r.length
        assert end <= window
    return by_sequence


@pytest.mark.parametrize("bucket_ids, max_queues", [(20_000, 1000), (2_000_000, 7)])
def test_packing_lays_every_id_once(spark, sf, bucket_ids, max_queues):
    docs = table(spark, sf, "documents")
    rows = packing.pack(docs, bucket_ids=bucket_ids, max_queues=max_queues).collect()
    sequences = check_pieces(rows, {r.doc_id: [r.text] for r in docs.collect()}, 2048)
    assert sorted(sequences) == list(range(-(-sum(r.length for r in rows) // 2048)))
    assert all(sum(p.length for p in s) == 2048 for k, s in sequences.items() if k < len(sequences) - 1)


def mixtures(rows, window):
    """Each full window's ids by source."""
    per = defaultdict(Counter)
    for r in rows:
        per[r.sequence_id][r.source] += r.length
    return [per[k] for k in sorted(per) if per[k].total() == window]


@pytest.mark.parametrize("weighted, bucket_ids", [(False, 2_000_000), (False, 30_000), (True, 30_000)])
def test_packing_follows_the_mixture_in_every_window(spark, weighted, bucket_ids):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    weights = {f"src{k}": 1.0 + k % 3 for k in range(20)} if weighted else None
    rows = packing.pack(docs, weights=weights, bucket_ids=bucket_ids).collect()
    ids = Counter()
    for r in rows:
        ids[r.source] += r.length
    shares = weights or ids
    assert len(ids) == 20 and set(ids) == set(shares)
    target = {s: n / sum(shares.values()) for s, n in shares.items()}
    per = mixtures(rows, 2048)
    lasting = int(min(ids[s] / target[s] for s in target) / 2048) - 1  # until the first queue is empty
    assert lasting > 40
    assert all(abs(w[s] - 2048 * target[s]) <= 512 for w in per[:lasting] for s in target)
    for n in range(1, lasting):  # deficits are carried on: never more than three runs away from the target so far
        assert all(abs(sum(w[s] for w in per[:n]) - n * 2048 * target[s]) <= 1536 for s in target)


def test_pieces_do_not_shrink_as_sources_grow(spark):
    rows = [(i, " ".join(f"w{(i * j) % 50}" for j in range(430))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = {}
    for sources in (1, 20, 1000):
        out = packing.pack(docs.withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % sources)), max_queues=700 if sources == 1000 else 1000)
        n, ids = out.agg(F.count("*"), F.sum("length")).first()
        sizes[sources] = ids / n
    assert min(sizes.values()) >= 200, sizes


def test_quanta_add_up():
    """Windows are full and offsets gapless in every phase, whatever the shares; all ids are laid once."""
    rng = np.random.default_rng(2)
    cases = [(s, run) for s in ([1.0], [3.0, 1e-9, 1.0], [0.0, 2.0, 5.0, 0.0], rng.random(60).tolist(), [1e6, *[1.0] * 40]) for run in (1, 64)]
    for shares, run in cases:
        totals = [int(x) for x in rng.integers(0, 20_000, len(shares))]
        totals[-1] = min(totals[-1], 40)
        plan = packing.schedule(totals, shares, 256, run)
        runs = []
        for s, n in enumerate(totals):
            edges = sorted({0, n, *rng.integers(0, n + 1, 3).tolist()})
            for low, high in zip(edges, edges[1:], strict=False):
                begin, seq, offset = packing.laid(plan, s, low, high, 256, run)
                stop = np.append(begin[1:], high)
                begin, offset = np.maximum(begin, low), offset + np.maximum(low - begin, 0)
                assert begin[0] == low and (stop > begin).all()
                runs += zip(seq.tolist(), offset.tolist(), (stop - begin).tolist(), strict=True)
        at = 0
        for seq, offset, n in sorted(runs):
            assert seq * 256 + offset == at and offset + n <= 256
            at += n
        assert at == sum(totals)


def test_packing_odd_rows(odd_docs, no_docs):
    docs = defaultdict(list)
    for r in odd_docs.collect():
        docs[r.doc_id].append(r.text)
    check_pieces(packing.pack(odd_docs).collect(), docs, 2048)
    assert packing.pack(no_docs).count() == 0
    assert packing.pack(odd_docs, weights={"a": 1.0, "nowhere": 2.0}).agg(F.sum("length")).first()[0] == sum(len(plain_ids(t)) for x in docs.values() for t in x)


# -- near duplicates -------------------------------------------------------------------------------------------------


def shingles(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def plain_components(texts, size, percent):
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [shingles(t, size) for t in texts]
    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("size, percent, block", [(3, 90, 500_000), (5, 80, 400)])
def test_jaccard_components(spark, sf, size, percent, block):
    docs = table(spark, sf, "documents").orderBy("doc_id")
    rows = docs.collect()
    n, root = plain_components([r.text for r in rows], size, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(docs, size, percent, block).collect()}
    assert got == {r.doc_id: (n[i], rows[root[i]].doc_id) for i, r in enumerate(rows)}


def test_jaccard_chains_and_blocks(spark):
    """A chain of near copies is one component though its ends aren't similar; blocks don't lose a link."""
    words = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(60):
        texts.append(" ".join(words))
        words[(k * 7) % 400] = f"n{k}"
    texts += ["a b c d e", "a b c d e", "A  b\tc d E", "", "   "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n, root = plain_components(texts, 3, 90)
    for block in (500_000, 3_000):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(docs, 3, 90, block).collect()}
        assert got == {i: (n[i], root[i]) for i in range(len(texts))}


def test_hot_lists_lose_no_link(spark, monkeypatch):
    """With every list hot (all rows sampled), each class is tied by size class: the same components."""
    monkeypatch.setattr(jaccard_join, "HOT_SAMPLE", 1)
    docs = table(spark, "/root/testdata/sf0.001", "documents").orderBy("doc_id")
    rows = docs.collect()
    for percent, size in ((90, 3), (80, 5), (100, 3)):
        n, root = plain_components([r.text for r in rows], size, percent)
        classes = jaccard_join.set_rows(docs, size, percent).where("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "n", "prefix")).alias("x")).select("x.*")
        edges = jaccard_join.candidates(classes, percent, hot_rows=1)
        group = {r.node: r.component for r in components.components(edges).collect()}
        held = {r.doc_id for r in classes.collect()}
        for i, r in enumerate(rows):
            if r.doc_id in held and rows[root[i]].doc_id in held and root[i] != i:
                assert group[r.doc_id] == group[rows[root[i]].doc_id], (percent, r.doc_id)


def test_jaccard_odd_rows(odd_docs, no_docs):
    rows = jaccard_join.similar_documents(odd_docs, 3, 90).collect()
    assert len(rows) == odd_docs.count()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got[1] == (0, 1) and got[3] == (0, 3) and got[4] == (1, 4) and got[5] == (1, 4) and got[9][1] == 8
    assert jaccard_join.similar_documents(no_docs).count() == 0


def test_null_ids_among_copies_and_lines(spark):
    """Rows without an id stand for no other, but are found as copies, near copies and repeated lines."""
    pipeline = pytest.importorskip("corpus_pipeline")
    a = [f"a{i}" for i in range(60)]
    near = " ".join([*a[:-1], "x"])
    a, b, c = " ".join(a), "b c d e f g h", "only words without an id here"
    rows = [(None, a), (3, a), (5, near), (None, near), (8, b), (None, b), (None, c), (None, c), (None, None), (None, ""), (9, "a text of nine")]
    docs = spark.createDataFrame([(i, t, "en", None) for i, t in rows], "doc_id int, text string, lang string, n_chars int").repartition(3)
    got = sorted(((r.doc_id or 0, r.component_id or 0, r.class_id or 0) for r in jaccard_join.similar_documents(docs, 5, 80).collect()))
    assert got == sorted([(0, 3, 3), (3, 3, 3), (5, 3, 5), (0, 3, 5), (8, 8, 8), (0, 8, 8), *[(0, 0, 0)] * 4, (9, 9, 9)])
    kept = pipeline.near_duplicates(spark, docs, "")
    lines = lambda df: sorted(((r.doc_id or 0, r.text) for r in df.collect()), key=str)
    assert kept.schema == docs.schema and lines(kept) == sorted([(0, c), (0, None), (0, ""), (3, a), (8, b), (9, "a text of nine")], key=str)

    out = line_dedup.dedup_lines(docs)
    assert out.schema == docs.schema and lines(out) == lines(kept)
    counts = sorted((r.doc_id or 0, r.n_lines, r.n_dropped) for r in line_dedup.line_counts(docs).collect())
    assert counts == sorted([(0, 1, 1), (3, 1, 0), (5, 1, 1), (0, 1, 1), (8, 1, 0), (0, 1, 1), (0, 1, 0), (0, 1, 1), (0, 1, 0), (9, 1, 0)])
    assert lines(pipeline.language(spark, docs, "")) == sorted([(i or 0, t) for i, t in rows if t], key=str)


def test_components_by_star_rounds(spark, monkeypatch):
    monkeypatch.setattr(components, "HELD_EDGES", 20)
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (260, 2))] + [(i, i + 1) for i in range(1000, 1200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "a long, b long").repartition(8)).collect()}
    forest = components.Forest(1300)
    for a, b in pairs:
        forest.join(a, b)
    assert got == {x: forest.find(x) for x in {v for p in pairs if p[0] != p[1] for v in p}}


# -- decontamination -------------------------------------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(text, items, window):
    words = WORD.findall((text or "").encode().lower())
    hit, found = [False] * len(words), set()
    for item, t in items:
        w = WORD.findall((t or "").encode().lower())
        size = min(window, len(w))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            for i in range(len(words) - size + 1):
                if words[i : i + size] == w[k : k + size]:
                    hit[i : i + size] = [True] * size
                    found |= {str(item)} - {"None"}
    return len(words), sum(hit), sorted(found)


@pytest.mark.parametrize("max_phrases", [500_000, 60])
def test_decontamination(spark, sf, odd_docs, max_phrases):
    docs = table(spark, sf, "documents").select("doc_id", "text").limit(60).union(odd_docs.selectExpr("doc_id + 10000", "text"))
    bench = table(spark, sf, "benchmark").limit(12)
    extra = spark.createDataFrame([(900, "One"), (901, None), (902, ""), (903, "it s\nx"), (904, "one"), (None, "words come here")], bench.schema)
    bench = bench.union(extra)
    passage = bench.first().text
    docs = docs.union(spark.createDataFrame([(77777, f"Start {passage.upper()} end, and again: {passage} {passage}")], docs.schema))
    items = [(r.item_id, r.text) for r in bench.collect()]
    out = decontaminate.contaminated_spans(docs, bench, 10, max_phrases).collect()
    rows = docs.collect()
    assert len(out) == len(rows)
    want = sorted((r.doc_id or 0, *plain_hits(r.text, items, 10)) for r in rows)
    assert sorted((r.doc_id or 0, r.n_words, sum(s.end - s.start for s in r.word_spans), list(r["items"])) for r in out) == want


def test_suffix_search_equals_find():
    rng = np.random.default_rng(4)
    x = rng.integers(1, 5, 700)
    index = decontaminate.FMIndex(x, 5)
    phrases = rng.integers(1, 5, (40, 4))
    phrases[:5, :2] = 0
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high, strict=True):
        p = p[p > 0]
        want = [i for i in range(len(x) - len(p) + 1) if (x[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_removed_spans_leave_the_rest(spark):
    docs = spark.createDataFrame([(1, "Keep é this. alpha beta gamma delta! And that.", 40), (2, "clean text", 10), (3, None, None)], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_chars) for r in decontaminate.remove_spans(docs, bench).collect()}
    assert got == {1: ("Keep é this. ! And that.", 24), 2: ("clean text", 10), 3: (None, None)}
    none = bench.limit(0)
    assert decontaminate.remove_spans(docs, none).count() == 3
    assert decontaminate.contaminated_spans(docs, none).where("size(items) > 0").count() == 0
    assert decontaminate.contaminated_spans(docs.limit(0), bench).count() == 0


# -- classifiers -----------------------------------------------------------------------------------------------------


def test_several_parts_cut_like_one(spark):
    """Items that overlap, touch or would join over a cut, in parts of their own; null and repeated ids."""
    w = [f"w{i}" for i in range(60)]
    text = "Begin, " + " ".join(w) + "! The end."
    bench = [(1, " ".join(w[1:20])), (2, " ".join(w[11:28])), (3, " ".join(w[28:40])), (4, "begin " + " ".join(w[40:44])), (5, "Begin w0 w40 w41")]
    rows = [(1, text, len(text)), (None, text, len(text)), (None, "clean words", 11), (None, None, None), (7, text, len(text)), (7, "other words " + " ".join(w[11:25]), 9), (7, "clean", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3)
    items = spark.createDataFrame(bench, "item_id long, text string")
    lines = lambda df: sorted(map(str, df.collect()))
    assert len(list(decontaminate.item_parts(items, 10, 15))) == 4
    assert lines(decontaminate.contaminated_spans(docs, items, 10, 15)) == lines(decontaminate.contaminated_spans(docs, items))
    out = decontaminate.remove_spans(docs, items, 10, 15)
    assert out.schema == docs.schema and lines(out) == lines(decontaminate.remove_spans(docs, items))
    rest = "Begin, w0 " + " ".join(w[40:]) + "! The end."
    assert sorted(r.text or "" for r in out.collect()) == sorted([rest] * 3 + ["clean words", "", "other words", "clean"])


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op4_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    y, p = np.array([r.quality for r in rows]), np.array([r.predicted for r in rows])
    assert (y == p).mean() > 0.98 and (p[y == 0] == 0).mean() > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_equals_plain(spark):
    """Features, weights and scores against a dictionary version: plain words, shapes and repeats, plain FTRL."""
    docs = table(spark, "/root/testdata/sf0.001", "documents").where("doc_id < 60").select("doc_id", "text").collect()
    docs = [(r.doc_id, r.text) for r in docs] + [(900, None), (901, ""), (902, "Ab Ab 12x éÉ"), (903, "Ab Ab 12x éÉ")]
    hash_of = lambda raw: T.hash_one(raw) if raw else 0
    mix = lambda x: int(T.mix(np.array([x % 2**64], np.uint64))[0])

    def plain_features(text):
        words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())
        kind = lambda b: 0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x30 if 0x30 <= b <= 0x39 else b
        shape = lambda w: bytes(k for i, k in enumerate(map(kind, w)) if i == 0 or k != kind(w[i - 1]))
        lower = [bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in w) for w in words]
        out = Counter()
        for salt, stream in ((1, [hash_of(w) for w in lower]), (2, [hash_of(shape(w)) for w in words])):
            for i, x in enumerate(stream):
                after = stream[i + 1] if i + 1 < len(stream) else 0
                out[mix(x + salt) >> 64 - quality.BITS] += 1
                out[mix(x * int(T.RADIX) + after + salt + 8) >> 64 - quality.BITS] += 1
        for i, w in enumerate(lower):
            out[mix(21 if i + 1 < len(lower) and lower[i + 1] == w else 20) >> 64 - quality.BITS] += 1
        return {k: v * quality.SCALE / sum(out.values()) for k, v in out.items()}

    feats = {i: plain_features(t) for i, t in docs}
    labels = {i: i % 3 % 2 for i, _ in docs if i % 7}
    z, n = Counter(), Counter()

    def weight(k):
        over = abs(z[k]) - 1e-4
        return 0.0 if over <= 0 else -np.sign(z[k]) * over / ((1 + np.sqrt(n[k])) / 0.1 + 1e-4)

    def margin(f):
        return weight("bias") + sum(v * weight(k) for k, v in f.items())

    rows, order = sorted(labels), np.random.default_rng(7)
    for _ in range(3):
        for j in order.permutation(len(rows)):
            f, w = feats[rows[j]] | {"bias": 1.0}, {}
            p = 1 / (1 + np.exp(-margin(feats[rows[j]])))
            w = {k: weight(k) for k in f}
            for k, v in f.items():
                g = (p - labels[rows[j]]) * v
                z[k] += g - (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / 0.1 * w[k]
                n[k] += g * g
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model = quality.train(df, spark.createDataFrame(list(labels.items()), "doc_id long, label int"))
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert got.keys() == feats.keys() and got[902] == got[903] and got[900] == got[901]
    assert all(abs(got[i] - 1 / (1 + np.exp(-margin(f)))) < 1e-4 for i, f in feats.items())


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 1), (None, 1), (99, 0), (8, None)], "doc_id long, label int")
    model = quality.train(odd_docs, labels)
    assert quality.score(odd_docs, model).where("score between 0 and 1").count() == odd_docs.count()
    untrained = quality.train(no_docs, labels)
    assert {r.score for r in quality.score(odd_docs, untrained).collect()} == {0.5}
    assert quality.score(no_docs, model).count() == 0


def test_languages_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op7_language_id(spark, sf).join(table(spark, sf, "documents"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_profile_distance_equals_plain(spark, sf):
    docs = table(spark, sf, "documents")
    symbols, langs, ranks = language_id.learn_profiles(docs.select("doc_id", "text", "lang"), top=50)
    got = {r.doc_id: r for r in language_id.identify(docs, (symbols, langs, ranks), 50).collect()}
    for r in docs.limit(25).collect():
        s = [symbols[ord(c)] for c in r.text.lower()]
        s = [0, *[x for i, x in enumerate(s) if x or i == 0 or s[i - 1]], 0]
        if s[1] == 0:
            s = s[1:]
        if s[-2] == 0:
            s = s[:-1]
        grams = Counter((x,) for x in s if x) + Counter(zip(s, s[1:])) + Counter(t for t in zip(s, s[1:], s[2:]) if t[1])  # noqa: B905
        base = language_id.BASE
        code = lambda g: {1: lambda a: base**3 + base**2 + a, 2: lambda a, b: base**3 + a * base + b, 3: lambda a, b, c: (a * base + b) * base + c}[len(g)](*map(int, g))
        own = sorted(grams, key=lambda g: (-grams[g], code(g)))[:50]
        d = [sum(50 if ranks[k, code(g)] < 0 else abs(int(ranks[k, code(g)]) - i) for i, g in enumerate(own)) for k in range(len(langs))]
        assert got[r.doc_id].lang_pred == langs[int(np.argmin(d))]
        assert abs(got[r.doc_id].score - (1 - min(d) / (50 * len(own)))) < 1e-9


def test_languages_odd_rows(odd_docs, no_docs):
    model = language_id.learn_profiles(odd_docs.select("doc_id", "text", "lang"))
    rows = language_id.identify(odd_docs, model).collect()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert len(rows) == odd_docs.count() and und == {1, 2, 3, 10}
    empty = language_id.learn_profiles(no_docs.select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in language_id.identify(odd_docs, empty).collect()} == {"und"}
    assert language_id.identify(no_docs, model).count() == 0


def test_languages_of_all_scripts(spark):
    """Two languages a script that differ in letters alone, among many Latin rows."""
    alphabets = {"en": "etaoin", "fr": "ésurlà", "el1": "αεικλμ", "el2": "νοπρστ", "ru1": "аеиодв", "ru2": "кнлрст", "ar1": "ابتثجح", "ar2": "دذرزسش", "ja": "あいうかきく", "ko": "가나다라마바", "zh1": "的一是不了人", "zh2": "我在有他这为", "xx": "𐐨𐐩𐐪𐐫𐐬𐐭"}
    rng = np.random.default_rng(5)
    latin = "abcdefghijklmnopqrstuvwxyzäöüßéèàçñóíáú"
    text = lambda letters, n=60: " ".join("".join(rng.choice(list(letters), 4)) for _ in range(n))
    rows = [(lang, text(letters)) for lang, letters in alphabets.items() for _ in range(8)] + [("de", text(latin, 1500)) for _ in range(8)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.learn_profiles(docs.where("doc_id % 2 = 0"))
    wrong = [r for r in language_id.identify(docs, model).join(docs, "doc_id").collect() if r.lang != r.lang_pred]
    assert not wrong, sorted({(r.lang, r.lang_pred) for r in wrong})


# -- training order --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000])
def test_feistel_is_a_permutation(n):
    got = token_output.feistel(np.arange(n), n, 99)
    assert sorted(got.tolist()) == list(range(n))
    assert n < 64 or (got != token_output.feistel(np.arange(n), n, 98)).any()


def test_shards_hold_all_ids_in_slot_order(spark, sf, tmp_path):
    folder = f"file://{tmp_path}/shards"
    docs = table(spark, sf, "documents")
    rows = token_output.write_training_order(docs, folder, stride=128, shard_docs=70).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.slot for r in rows) == list(range(len(text))) and len({r.shard for r in rows}) == -(-len(text) // 70)
    for r in rows:
        ids = plain_ids(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        records = -(-(r.offset + r.n_tokens) // 128)
        flat = token_output.read_from(folder, r.shard, r.record, records, 128).ravel()
        assert flat[r.offset : r.offset + r.n_tokens].tolist() == ids
    by_slot = sorted(rows, key=lambda r: r.slot)
    for a, b in zip(by_slot, by_slot[1:], strict=False):
        if a.shard == b.shard:
            assert b.record * 128 + b.offset == a.record * 128 + a.offset + a.n_tokens
    assert all(len(x) == 128 for x in token_output.read_records(spark, folder, 128).collect())


def test_training_order_odd_rows(spark, odd_docs, no_docs, tmp_path):
    rows = token_output.write_training_order(odd_docs, f"file://{tmp_path}/a").collect()
    assert sorted(r.slot for r in rows) == list(range(odd_docs.count()))
    assert token_output.write_training_order(no_docs, f"file://{tmp_path}/b").count() == 0


# -- neighbours ------------------------------------------------------------------------------------------------------


def test_many_queries_are_searched_in_blocks(spark):
    """A large cluster that all queries visit, and many queries of too few candidates: the same rows in blocks of seven queries."""
    rng = np.random.default_rng(6)
    x = np.concatenate([np.eye(8)[0] + 0.01 * rng.normal(size=(300, 8)), rng.normal(size=(300, 8))])
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    q = e.where("vec_id % 5 = 0")
    for few in ({}, {"probes": 1, "width": 0.2}):
        whole, blocks = (sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.search(e, q, k=20, query_rows=n, **few).collect()) for n in (10_000, 7))
        assert whole == blocks and len(whole) == 20 * 120


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_multiprobe_recall_and_order(spark, size):
    e = table(spark, f"/root/testdata/{size}", "embeddings")
    rows = e.collect()
    x = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    got = defaultdict(list)
    for r in sorted(ann.search(e, e.where("vec_id % 20 = 0")).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r)
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -9
        hits += len({int(v) for v in ids[np.argsort(-s)[:20]]} & {r.vec_id for r in got[ids[i]]})
        mine = got[ids[i]]
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert all(abs(r.score - x[ids == r.vec_id][0] @ x[i]) < 1e-12 for r in mine)
        assert all((a.score, -a.vec_id) >= (b.score, -b.vec_id) for a, b in zip(mine, mine[1:], strict=False))
    assert hits / (20 * len(got)) >= 0.9


def test_multiprobe_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, None), (101, [0.0, 0.0]), (102, [None, 1.0]), (103, [inf, 1.0]), (104, [nan, 1.0]), (105, [3.0, 0.5]), (105, [3.0, 0.5])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in sorted(ann.search(v, v.where("vec_id % 20 = 0"), bucket_rows=3, group_rows=2).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append(r.vec_id)
    assert got == {0: [105, *range(1, 20)], 20: [105, *range(0, 19)]}
    assert ann.search(v.limit(0), v).count() == 0
    clash = v.withColumns({c: F.lit("clash") for c in ("t", "bucket", "salt", "class", "score", "query", "rank", "v")})
    again = ann.search(clash, clash.where("vec_id % 20 = 0"), bucket_rows=3, group_rows=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in again) == sorted((q, k + 1, x) for q, xs in got.items() for k, x in enumerate(xs))


# -- shards ----------------------------------------------------------------------------------------------------------


def check_shards(rows, texts):
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))


def test_shards_are_balanced_and_gapless(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = sharding.shard_documents(docs, 8, lane_groups=300, bucket_rows=200).collect()
    check_shards(rows, [r.text for r in docs.collect()])
    for most, dim in ((1.01, lambda r: r.size), (1.1, lambda r: r.tokens), (1.05, lambda r: 1)):
        sums = Counter()
        for r in rows:
            sums[r.shard] += dim(r)
        assert max(sums.values()) < most * min(sums.values())
    groups = defaultdict(set)
    for r in rows:
        groups[r.group_hash].add(r.shard)
    assert all(len(s) == 1 for s in groups.values())


def test_placing_equals_plain():
    """The shard of the highest dot product with what is left, group by group."""
    rng = np.random.default_rng(3)
    vectors = np.stack([rng.integers(1, 900, 300), rng.integers(0, 200, 300), rng.integers(1, 4, 300)], axis=1).astype(float)
    share = vectors / vectors.sum(axis=0)
    order = sorted(range(300), key=lambda i: (-vectors[i, 0], i))
    done = np.cumsum(share[order, 0])
    large, small = [i for i, c in zip(order, done, strict=True) if c <= 0.5], [i for i, c in zip(order, done, strict=True) if c > 0.9]
    left, want = np.full((5, 3), 0.2), {}
    for i in large + sorted(set(order) - set(large) - set(small)) + small:
        want[i] = int(np.argmax([float(share[i] * [1 if i in large else 256 if i in small else 16, 1, 1] @ left[s]) for s in range(5)]))
        left[want[i]] -= share[i]
    got = sharding.place(vectors, 5)
    assert [want[i] for i in range(300)] == got.tolist()
    sums = np.stack([vectors[got == s].sum(axis=0) for s in range(5)])
    assert (sums.max(axis=0) < 1.05 * sums.min(axis=0)).all()


def test_a_hot_group_is_dealt_in_pieces(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = sharding.shard_documents(docs, 8).collect()
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    assert max(sums.values()) < 1.02 * min(sums.values())


def test_rows_without_ids_spread_over_pieces(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 500, F.col("id")).alias("doc_id"), F.lit("the same text").alias("text"))
    rows = sharding.shard_documents(docs, 8, lane_groups=50, bucket_rows=100).collect()
    pieces = Counter(r.piece for r in rows)
    assert len(pieces) > 8 and max(pieces.values()) < 3 * len(rows) / len(pieces)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_groups_below_a_shards_share_stay_whole(spark):
    """Groups above a lane's bound have one shard each at any number of lanes; bytes stay balanced."""
    n = 8000
    text = F.when(F.col("id") < 600, "one hot text").when(F.col("id") < 1100, "another hot one").when(F.col("id") < 1150, F.repeat(F.lit("long "), 40)).otherwise(F.concat(F.lit("text number "), "id"))
    docs = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), text.alias("text"))
    for lane_groups in (200, 20_000):
        rows = sharding.shard_documents(docs, 8, lane_groups=lane_groups, bucket_rows=900).collect()
        check_shards(rows, [r.text for r in docs.collect()])
        shards, sums = defaultdict(set), Counter()
        for r in rows:
            shards[r.group_hash].add(r.shard)
            sums[r.shard] += r.size
        assert all(len(s) == 1 for s in shards.values())
        assert max(sums.values()) < 1.05 * min(sums.values())


def test_shards_odd_rows(odd_docs, no_docs):
    check_shards(sharding.shard_documents(odd_docs).collect(), [r.text for r in odd_docs.collect()])
    assert sharding.shard_documents(no_docs).count() == 0


# -- URLs ------------------------------------------------------------------------------------------------------------


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]


def test_url_rules(spark, sf):
    odd = [None, "", "no scheme.com/en/1", "http://COM/en/x", "https://a.example.com/en/7?x#y", "http://example.com/en/8", "x://y://com/en/", "http://éÉ.net/de/8", "http://example.net/de/81", "http://notcom/en/", "http://h?en/", "http://org#f", "http://a.org/es/"]
    pages = table(spark, sf, "pages").select("page_id", "url").union(spark.createDataFrame([(100_000 + i, u) for i, u in enumerate(odd)], "page_id long, url string"))
    pages = pages.withColumns({"host": F.lit("clash"), "score": F.lit("clash")})
    rows = {r.page_id: r for r in url_filter.filter_urls(pages, queries.URL_RULES).collect()}
    for p in pages.collect():
        r = rows[p.page_id]
        host, path = plain_url(p.url)
        fits = [(len(h + pre), v, h + pre) for v, h, pre in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(pre)]
        best = max(fits) if fits else None
        assert (r.host, r.path, r.rule) == (host, path, best and best[2]), p.url
        assert r.verdict in ("allow", "block") and (not best or r.verdict == best[1])
    assert url_filter.filter_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_trees_as_columns_equal_the_model(spark):
    """The CASE expressions give the learner's own probability; a row's suffix share leaves its fold out."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    pages = table(spark, "/root/testdata/sf0.01", "pages").select("page_id", "url")
    rows = pages.withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))})
    rows = url_filter.lexical(rows).withColumn("label", F.pmod(F.length("url") + F.length("path"), F.lit(2)).cast("double"))
    full = url_filter.with_suffix(rows, rows, url_filter.FOLDS)
    model = url_filter.fit_trees(full, 4, 3)
    scored = model.transform(VectorAssembler(inputCols=url_filter.FEATURES, outputCol="x").transform(full))
    apart = scored.select(F.abs(vector_to_array("probability")[1] - 1 / (1 + F.exp(-url_filter.log_odds(model)))).alias("d")).agg(F.max("d"), F.count("*")).first()
    assert apart[0] < 1e-9 and apart[1] == pages.count()
    fold = {r.page_id: r.f for r in rows.select("page_id", F.pmod(F.xxhash64("url", F.lit(4)), F.lit(url_filter.FOLDS)).alias("f")).collect()}
    plain = [(r.page_id, r.suffix, r.label) for r in rows.collect()]
    for r in full.collect():
        others = [y for i, s, y in plain if s == r.suffix and fold[i] != fold[r.page_id]]
        assert r.suffix_rows == len(others) and abs(r.suffix_share - (np.mean(others) if others else 0.5)) < 1e-9
    assert url_filter.fit_trees(full.where("label = 1"), 2, 2) is None


def test_urls_long_tied_and_repeated(spark):
    long = "http://a.org/es/" + "x/" * 40_000
    rows = [(1, long), (1, long), (None, "http://b.net/de/1"), (None, "http://b.net/de/1"), (2, "http://t.co/ab"), (3, long[:-1] + "?" + "q=1&" * 9000)]
    rules = [("block", "org", "/es/"), ("allow", "net", "/de/"), ("block", "t.co", "/a"), ("allow", "co", "/ab"), ("allow", "t.co", "/a")]
    got = sorted(((r.page_id or 0, len(r.path), r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()))
    path = len(long) - len("http://a.org")
    assert got == [(0, 5, "net/de/", "allow")] * 2 + [(1, path, "org/es/", "block")] * 2 + [(2, 3, "t.co/a", "block"), (3, path - 1, "org/es/", "block")]


def test_url_trees_learn_the_rules(spark):
    rows = [(i, f"http://h{i}.bad{i % 3}.test/{'x' * (i % 9)}{'9' * 12}") if i % 2 else (i, f"http://h{i}.good.test/about") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    rules = [("block", f"h{i}.bad{i % 3}.test", "/") for i in range(1, 200, 2)] + [("allow", f"h{i}.good.test", "/") for i in range(0, 200, 2)]
    got = url_filter.filter_urls(pages, rules, trees=5).where("page_id >= 200").collect()
    assert all((r.verdict == "block") == (r.page_id % 2 == 1) and r.rule is None for r in got)


# -- lines -----------------------------------------------------------------------------------------------------------


def plain_lines(docs, least=5):
    rows = [(i, k, [w for w in line.lower().split(" ") if w]) for i, t in docs if t is not None for k, line in enumerate(t.split("\n"))]
    rows.sort(key=lambda r: r[:2])
    first, dropped = {}, set()
    shapes = defaultdict(list)
    for i, k, w in rows:
        key = tuple(w)
        if not w:
            continue
        if key in first:
            if first[key] != (i, k):
                dropped.add((i, k))
            continue
        first[key] = (i, k)
        if len(w) < least:
            continue
        cuts = {(0, key)} | {(1, key[:j] + key[j + 1 :]) for j in range(len(w))}
        near = {o for c in cuts for o in shapes[c[1]]}

        def one_edit(a, b):
            if len(a) == len(b):
                return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
            a, b = (a, b) if len(a) > len(b) else (b, a)
            return len(a) - len(b) == 1 and any(a[:j] + a[j + 1 :] == b for j in range(len(a)))

        if any(one_edit(key, o) for o in near):
            dropped.add((i, k))
        for _, c in cuts:
            shapes[c].append(key)
    return dropped


def test_lines_equal_plain(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    planted = [(50_000, "a b c d e f\na b c d e x\na b c d e\na b c d\nb a c d e f"), (50_001, "a x c d e f g\na a b b c c d\na b b c c d\na a b c c d\n\n  \nshort one\nshort two\nshort one")]
    docs = docs.union(spark.createDataFrame(planted, docs.schema))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = line_dedup.line_counts(docs).collect()
    assert len(rows) == docs.where("text is not null").count()
    assert {(r.doc_id, int(k)) for r in rows for k in r.dropped.split(",") if k} == plain_lines([(r.doc_id, r.text) for r in docs.collect()])
    assert all((r.n_lines, r.n_dropped) == (t.count("\n") + 1, len(r.dropped.split(",")) if r.dropped else 0) for r in rows for t in [texts[r.doc_id]])


def test_lines_of_random_words(spark):
    """Short vocabularies make many near copies, at all lengths, edits at every place, and ids above 2**32."""
    rng = np.random.default_rng(8)
    lines = []
    for n in (4, 5, 6, 9, 17, 40, 100):
        for _ in range(6):
            line = [f"w{x}" for x in rng.integers(0, 9, n)]
            lines.append(line)
            for _ in range(5):
                other, at = list(lines[-1]), int(rng.integers(0, len(lines[-1])))
                {0: lambda: other.pop(at), 1: lambda: other.insert(at, "w3"), 2: lambda: other.__setitem__(at, "x")}[int(rng.integers(0, 3))]()  # noqa: B023, PLC2801
                lines.append(other)
    order = rng.permutation(len(lines))
    docs = [(int(i) * (1 << 36), "\n".join("  ".join(lines[k]).upper() for k in order[i::20])) for i in range(20)]
    rows = line_dedup.line_counts(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert {(r.doc_id, int(k)) for r in rows for k in r.dropped.split(",") if k} == plain_lines(docs)


def test_lines_of_repeated_rows(spark):
    """Rows that share a doc_id are documents of their own: a repeated row loses its lines, others keep theirs."""
    rows = [(7, "one line of five words\nanother"), (7, "one line of five words\nanother"), (7, "not seen before"), (8, "not seen before"), (9, "another\n \n")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id int, text string, n_chars int").repartition(3)
    out = sorted((r.doc_id, r.text, r.n_chars) for r in line_dedup.dedup_lines(docs).collect())
    assert out == [(7, "one line of five words", 22), (8, "not seen before", 15), (9, "another\n \n", 10)]
    counts = sorted((r.doc_id, r.n_lines, r.n_dropped, r.dropped) for r in line_dedup.line_counts(docs).collect())
    assert counts == [(7, 1, 1, "0"), (7, 2, 1, "1"), (7, 2, 2, "0,1"), (8, 1, 0, ""), (9, 3, 0, "")]


def test_lines_odd_rows(odd_docs, no_docs):
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(odd_docs).collect()}
    assert out[1] is None and out[2] == "" and 5 not in out and 7 not in out and None in out
    assert line_dedup.dedup_lines(odd_docs).columns == odd_docs.columns
    assert line_dedup.dedup_lines(no_docs).count() == 0 and line_dedup.line_counts(no_docs).count() == 0


# -- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, sf, "documents")
    found = {r.doc_id for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        kept = {r.doc_id for r in docs.collect()}
        assert kept <= found and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        found = kept
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert sum(plain_hits(t, items, 10)[1] for t in list(texts.values())[:60]) == 0
    out = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    check_pieces(out, {k: [t] for k, t in texts.items()}, 2048)
    run = pipeline.run(spark, sf)
    assert sorted(map(str, run.select(sorted(run.columns)).collect())) == sorted(map(str, spark.createDataFrame(out).select(sorted(run.columns)).collect()))


def test_pipeline_of_odd_rows(spark, odd_docs, no_docs, tmp_path):
    """Every stage with nulls, empty and long texts, ties, repeated rows and ids, clashing columns; and no rows at all."""
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = f"file://{tmp_path}"
    spark.createDataFrame([(1, "no id but words to read here"), (None, "a line of its own"), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, kept = odd_docs, []
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema == docs.schema, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept.append(sorted((r.doc_id or 0 for r in docs.collect())))
        assert all(stage(spark, no_docs, sf).count() == 0 for _ in [0]), name
    assert kept[0] == [0, 4, 5, 6, 7, 7, 8, 9, 11]  # a letter in the text
    assert kept[1] == [0, 4, 6, 7, 8, 11] or kept[1] == [0, 4, 6, 8, 11]  # 5 repeats 4, 7 has near copies of 6's lines
    assert set(kept[2]) <= set(kept[1]) and 0 not in kept[3] and 6 in kept[3]
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert texts[6] == "The same words come here again and again\n stands here now"
    pieces = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    check_pieces(pieces, {k: [t] for k, t in texts.items()}, 2048)
    assert pipeline.STAGES[-1][1](spark, no_docs, sf).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_query_digests(spark, sf):
    rows = queries.op3_decontamination(spark, sf).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert all((r.n_hit > 0) == r.contaminated and (r.n_items > 0 or r.items_sha256 == empty) for r in rows)
    assert sum(r.contaminated for r in rows) > 0

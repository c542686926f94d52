"""Exact search, n-gram join, suffix dedup and the pipeline against brute force."""

import hashlib
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import components, ngram_join, suffix_dedup, topk
from millrace.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, cover string, root int").repartition(4)


# ---- search


def brute_top(rows, k=10, every=100):
    good = [(i, np.floor(np.array(v, dtype=np.float64) * 1024)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q in sorted({i for i, _ in good if i % every == 0}):
        query = min((list(v) for i, v in rows if i == q and v is not None and all(x is not None and np.isfinite(x) for x in v)))
        query = np.floor(np.array(query, dtype=np.float64) * 1024)
        scores = sorted(((-int(query[: len(v)] @ v[: len(query)]), i) for i, v in good if i != q))[:k]
        out[q] = [(i, -s) for s, i in scores]
    return out


def test_top_k(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.0, 0.5, -0.25, rng.random()]) for _ in range(8)]) for i in range(500)]
    rows += [(600, None), (601, [None] * 8), (602, [float("nan")] * 8), (603, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (604, []), (605, [0.5, 0.5]), (300, [0.1] * 8), (17, [0.9] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "'s' AS score").repartition(5)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    for block in (topk.BLOCK, 64):
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk, "QUERY_BLOCK", 2 if block == 64 else 2048)
        got = defaultdict(list)
        for r in topk.exact_top_k(df).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        assert dict(got) == brute_top(rows)
    assert topk.exact_top_k(df.limit(0)).count() == 0
    three = df.filter("vec_id < 3")
    assert topk.exact_top_k(three).count() == 2


def test_top_k_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(f'SELECT query_id, "rank", vec_id, score FROM ({topk.SQL})').fetchall())
    assert sorted(map(tuple, topk.query(spark, SF).select("query_id", "rank", "vec_id", "score").collect())) == want


# ---- near copies


def brute_links(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, s in enumerate(sets):
        for j in range(i):
            both = len(s & sets[j])
            if (not s and not sets[j]) or (both and 9 * both >= 4 * (len(s) + len(sets[j]))):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in range(len(texts))}


def copies(n=260):
    rng = random.Random(1)
    base = [rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randint(0, 99)) for _ in range(200)]
    texts = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(200)] = f"x{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
    # boilerplate that makes large buckets of texts which aren't near copies
    texts += [" ".join(base[:120] + [f"u{i}_{k}" for k in range(60)]) for i in range(90)]
    return texts + [None, "", "one", "one", "One ", "one two", " ".join(base[:150]), " ".join(base), " ".join(base)]


@pytest.mark.parametrize("small", [256, 24])
def test_ngram_join(spark, monkeypatch, small):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    if small == 24:  # several blocks for a part
        monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 20)
        monkeypatch.setattr(ngram_join, "SPREAD", 4)
    texts = copies()
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.linked(frame(spark, texts)).collect()}
    assert got == brute_links(texts)


def test_ngram_join_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.linked(docs).collect()} == brute_links(texts)


def test_ngram_join_odd_rows(spark):
    assert ngram_join.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, None)]
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.class_id, r.n_links) for r in got) == [(3, 2), (3, 2), (3, 2), (4, 0)]


def test_grams_and_runs():
    a, b = ngram_join.grams("a b c d e f"), ngram_join.grams("A  b\nc d e")
    assert len(a) == 2 and len(b) == 1 and b[0] in a and len(ngram_join.grams(None)) == 0 and len(ngram_join.grams("x " * 100_000)) == 1
    assert ngram_join.runs_needed(0.8, 0.9999) > ngram_join.runs_needed(0.8, 0.99)
    assert ngram_join.missed(0.8, ngram_join.runs_needed(0.8, 0.999)) <= 1e-3 and ngram_join.missed(0.8, 11, 1) < 1e-5


def test_compared_by_differences():
    rng = np.random.default_rng(6)
    for case in range(60):
        base = rng.integers(0, 2**63, 40).astype(np.uint64)
        sets = []
        for _ in range(int(rng.integers(2, 40))):
            own = base[rng.random(40) > rng.choice([0.02, 0.1, 0.6])]
            sets.append(np.unique(np.append(own, rng.integers(0, 2**63 if case % 2 else 30, int(rng.integers(1, 6))).astype(np.uint64))))
        m, blocks = len(sets), int(rng.integers(1, 4))
        own, copies, sizes = rng.integers(0, blocks, m), rng.integers(1, 5, m), np.array(list(map(len, sets)))
        sent = [np.setxor1d(x, sets[0]) for x in sets] if case % 3 else sets
        links, root = np.zeros(m, dtype=int), list(range(m))
        for i in range(blocks):
            for j in range(i, blocks):
                some = np.flatnonzero((own == i) | (own == j))
                if len(some) > 1:
                    n, label = ngram_join.compared(i, j, own[some], sizes[some], copies[some], [sent[k] for k in some], 0.8)
                    links[some] += n
                    for k, x in zip(some, label, strict=True):
                        a, b = root[k], root[some[x]]
                        root = [min(a, b) if r in (a, b) else r for r in root]
        near = [[a != b and 10 * len(np.intersect1d(sets[a], sets[b])) >= 8 * len(np.union1d(sets[a], sets[b])) for b in range(m)] for a in range(m)]
        assert links.tolist() == [sum(int(copies[b]) for b in range(m) if near[a][b]) for a in range(m)]
        want = list(range(m))
        for a in range(m):
            for b in range(a):
                if near[a][b]:
                    x, y = want[a], want[b]
                    want = [min(x, y) if r in (x, y) else r for r in want]
        assert root == want


def test_rows_sent_for_a_large_part(spark, monkeypatch):
    """One part of n near copies, all with different sets: the rows that verification sends."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 50)
    sent = {}
    real = ngram_join._verified
    for n in (400, 1600):
        rng = random.Random(n)
        base = [f"w{k}" for k in range(120)]
        texts = [" ".join([*base[: (p := rng.randrange(110))], f"x{i}", *base[p + 1 :]]) for i in range(n)]

        def counted(rows, threshold, n=n):
            kept = rows.cache()
            sent[n] = (kept.count(), kept.selectExpr("sum(octet_length(grams))").first()[0])
            return real(kept, threshold)

        monkeypatch.setattr(ngram_join, "_verified", counted)
        got = ngram_join.linked(frame(spark, texts)).collect()
        assert len({r.class_id for r in got}) == 1 and min(r.n_links for r in got) == n - 1
    assert sent[1600][0] <= 2.1 * 4 * sent[400][0], sent  # the root of four, beside four
    assert sent[400][1] < 400 * 120 * 8 * 0.5, sent  # differences, not texts


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    root = {x: x for e in edges for x in e}
    for _ in range(500):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u int, v int"), Scratch(spark, "test")).collect()}
    assert all(got[k] == root[k] for k in got) and set(got) == {x for a, b in edges if a != b for x in (a, b)}


# ---- repeated bytes


def brute_removed(docs, keep=False):
    seen, out, left = set(), {}, {}
    for i, t in sorted(docs):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            else:
                seen.add(w)
        runs = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        left[i] = t and bytes(x for x, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return left if keep else out


def test_suffix_order():
    rng = random.Random(2)
    for letters, most in ((b"ab", 60), (b"a", 20), (bytes(range(0xF0)), 200), (b"abc ", 5)):
        segments = [bytes(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(50)]
        segments += [segments[3], b"", segments[7][2:]]
        order, prefix = suffix_dedup.suffix_order(segments)
        suffixes = [(segments[x >> 8][x & 255 :], x >> 8) for x in order.tolist()]
        assert [s for s, _ in suffixes] == sorted(s for s, _ in suffixes) and len(suffixes) == sum(len(s) + 1 for s in segments)

        def common(a, b):
            return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

        assert prefix.tolist() == [0] + [common(a, b) for (a, _), (b, _) in zip(suffixes, suffixes[1:], strict=False)]


def passages():
    rng = random.Random(2)
    known = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(80, 300))) for _ in range(10)]
    texts = []
    for _ in range(250):
        t = ""
        for _ in range(rng.randint(0, 4)):
            t += rng.choice([rng.choice(known), "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 150))), "xyz " * rng.randint(0, 60), rng.choice(known)[rng.randint(0, 40) : rng.randint(90, 280)]])
        texts.append(t)
    return [*texts, None, "", "short", texts[3], "q" * 3000]


@pytest.mark.parametrize("group", [1000, 20])
def test_removed_bytes(spark, monkeypatch, group):
    if group == 20:  # several groups for an anchor, several pieces for a text
        for name, value in (("GROUP", 20), ("COLLECTION", 30_000), ("CHUNK", 700), ("HELD", 50)):
            monkeypatch.setattr(suffix_dedup, name, value)
    texts = passages()
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.removed(frame(spark, texts)).collect()}
    assert got == brute_removed(list(enumerate(texts)))


def test_removed_bytes_odd_rows(spark):
    assert suffix_dedup.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(None, "a" * 150), (1, "b" * 200), (1, "b" * 200), (2, None)], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.removed(rows).collect()) == [(0, 0), (150, 149), (200, 199), (200, 200)]
    out = suffix_dedup.deduplicated(frame(spark, passages()))
    assert out.columns == ["doc_id", "text", "cover", "root"]


# ---- pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = Scratch(spark, "stages").keep(stage(spark, before, SF))
        if name != "packing":
            assert docs.columns == columns and docs.schema["doc_id"].dataType == before.schema["doc_id"].dataType
        if name == "ngram_join":
            links = brute_links([r.text for r in before.orderBy("doc_id").collect()])
            ids = [r.doc_id for r in before.orderBy("doc_id").collect()]
            assert {r.doc_id for r in docs.collect()} == {ids[k] for k, (root, _) in links.items() if root == k}
        if name == "suffix_dedup":
            want = brute_removed([(r.doc_id, r.text) for r in before.collect()])
            kept = {r.doc_id: r.text for r in docs.collect()}
            for i, (size, gone, _, _) in want.items():
                assert (i not in kept) if gone and gone == size else len(kept[i].encode()) <= size - gone
    assert docs.count() > 0
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_one_row_of_each_class_whatever_its_ids(spark):
    rows = [(None, "a b c d e f"), (None, "u v w x y z"), (None, "u v w x y  z"), (None, "u v w x y z"), (3, "g h i j k l"), (3, "m n o p q r"), (3, "m n o p q r"), (None, "m n o p q r"), (4, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text and " ".join(r.text.split())) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    want = [(None, "a b c d e f"), (None, "u v w x y z"), (3, "g h i j k l"), (3, "m n o p q r"), (4, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def odd_documents(spark):
    """Null, repeated and mixed ids over copies, near copies, texts that share a passage, toxic, personal and empty ones."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    base = [rng.choice(words) for _ in range(80)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(12)]
    texts += [texts[0], texts[0], " ".join(base), " ".join([*base[:40], "new", *base[41:]]), " ".join([*base, "tail"]), passage + " one end", "begin " + passage, passage]
    texts += [None, None, "", " ", "mail ann@corp.example and ann@corp.example", "call +1 (988) 555-2485", "vile zorgh zorgh text", "vile zorgh zorgh text"]
    ids = [None if k % 3 == 0 else 7 if k % 3 == 1 else k for k in range(len(texts))]
    return spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)


def test_stages_lose_no_row(spark, monkeypatch):
    """Rows in are the rows kept and those that brute force names as removed, whatever their ids."""
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    order = lambda x: (x[0] is None, x[0] or 0, hashlib.md5((x[1] or "").encode()).hexdigest())
    plain = lambda xs: sorted(((r[0], r[1]) for r in xs), key=repr)

    model = corpus_pipeline.toxicity.Model({" zorgh ": 3.0}, frozenset(), (-3.0, 1.0, 3.0))
    monkeypatch.setattr(corpus_pipeline.toxicity, "learn", lambda *_: model)
    assert plain(corpus_pipeline.drop_toxic(spark, docs, SF).collect()) == plain(r for r in rows if "zorgh" not in (r[1] or ""))

    ordered = sorted(rows, key=order)
    links = brute_links([t for _, t in ordered])
    got = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert plain(got) == plain(ordered[k] for k, (root, _) in links.items() if root == k)

    want = brute_removed([(k, t) for k, (_, t) in enumerate(ordered)], keep=True)
    assert plain(corpus_pipeline.cut_repeats(spark, docs, SF).collect()) == plain((i, want[k]) for k, (i, t) in enumerate(ordered) if not t or want[k])

    tidy = lambda t: t and t.replace("ann@corp.example", "[EMAIL]").replace("+1 (988) 555-2485", "[PHONE]")
    assert plain(corpus_pipeline.redact(spark, docs, SF).collect()) == plain((i, tidy(t)) for i, t in rows)

    pieces = corpus_pipeline.pack(spark, docs, SF).collect()
    codec = corpus_pipeline.packing.byte_codec()
    ends = lambda t: (*codec.encode(t).tolist(), 1)
    assert sorted(((r.doc_id, tuple(np.frombuffer(r.ids, dtype="<u4").tolist())) for r in pieces), key=repr) == sorted(((i, ends(t)) for i, t in rows), key=repr)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, name, stage):
    columns = "doc_id long, text string, lang string, source string, n_chars long, cover string, rank int, _digest string"
    assert stage(spark, spark.createDataFrame([], columns), SF).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None, None, None, None), (5, "", "en", "s", 0, "c", 1, "d"), (5, "", "en", "s", 0, "c", 1, "d"), (6, "word " * 5000, None, None, 25000, None, None, None)], columns)
    out = stage(spark, odd, SF)
    assert out.count() > 0 and (name == "packing" or out.columns == odd.columns)

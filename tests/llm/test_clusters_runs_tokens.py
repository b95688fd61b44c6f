"""Centroid clustering, periodic runs and BPE against plain versions, and on odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskspark.llm import bpe, centroids, periodic, queries
from riskspark.llm.common import table

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_clusters(rows, k, rounds, dims, scale=1024, seed=3):
    kept = [(i, np.floor(scale * np.array(v, float)).astype(np.int64)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1].tolist()))[:k]
    c, x = np.array([r[1] for r in first]), np.array([r[1] for r in kept])
    for i in range(rounds + 1):
        d = ((x[:, None] - c) ** 2).sum(axis=2)
        a = d.argmin(axis=1)
        if i < rounds:
            c = np.array([np.floor_divide(x[a == j].sum(axis=0), (a == j).sum()) if (a == j).any() else c[j] for j in range(len(c))])
    d = d[np.arange(len(x)), a]
    return sorted(((r[0] is None, r[0] or 0), int(j), int(e), int(d[a == j].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for r, j, e in zip(kept, a, d, strict=True))


def got_clusters(found):
    return sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found.rows.collect())


def test_clusters_equal_plain_rounds(spark):
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(5, 6))
    rows = [(i, (middles[i % 5] + rng.normal(size=6) * (0.02 if i % 5 else 0.7)).tolist()) for i in range(1500)]
    rows += [(9000 + i, rows[3][1]) for i in range(400)]  # copies
    found = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), clusters=7, rounds=6, dims=6)
    assert got_clusters(found) == plain_clusters(rows, 7, 6, 6)
    assert found.fetched[0] == len(rows) and max(found.fetched[3:]) < len(rows) // 2  # intervals and unchanged centroids spare the rest


def test_clusters_odd_inputs(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(None, [0.1, 0.2, 0.3]), (1, None), (2, []), (3, [1.0, None, 2.0]), (4, [nan, 0.0, 0.0]), (5, [0.0, inf, 0.0]), (6, [0.5, 0.5]), (7, [-0.1, 0.2, 5.0]), (7, [-0.1, 0.2, 5.0]), (8, [0.0, 0.0, 0.0]), (9, [-0.0, 1e-9, -1e-9]), (7, [3.0, 0.2, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    odd = df.select("*", *[F.lit("x").alias(c) for c in ("x", "code", "cluster", "distance", "e", "i", "v", "now", "before", "centroid_sha256")])
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k in (2, 8):
        assert got_clusters(centroids.cluster(odd, clusters=k, rounds=4, dims=3)) == plain_clusters(as_float, k, 4, 3)
    none = centroids.cluster(odd.where("false"), dims=3)
    assert none.rows.count() == 0 and none.rows.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), dims=1).rows.count()


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + n - p)) for p in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out)


def test_runs_equal_plain_scan():
    draw = random.Random(2)
    seen = 0
    for _ in range(4000):
        k = draw.choice([1, 2, 2, 3, 5])
        w = [draw.randrange(k) for _ in range(draw.randint(0, 50))]
        if len(w) > 8 and draw.random() < 0.5:
            a, p = draw.randrange(len(w)), draw.randint(1, 8)
            for i in range(a + p, len(w)):
                w[i] = w[i - p]
        w = w + [9] + w[::-1] + [draw.randrange(k)] * draw.randint(0, 12)
        seen += len(runs := plain_runs(w))
        assert periodic.word_runs(w) == runs
    assert seen > 1000


def test_runs_of_long_texts_and_deep_splits():
    n = 200_000
    assert periodic.word_runs(["a"] * n) == [(0, n, 1)]
    assert periodic.word_runs(["a", "b", "c"] * n) == [(0, 3 * n, 3)]
    deep = np.array([x for i in range(400) for x in (i // 3, (i + 1) // 3)])  # each split leaves the next words too rare
    assert periodic.word_runs(deep.tolist()) == plain_runs(deep.tolist())
    assert all(np.bincount(deep[a:b])[deep[a:b]].min() >= 4 for a, b in periodic.stable_segments(deep))


def plain_op12(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_query_on_whole_documents(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    assert got.keys() == docs.keys() and sum(r.n_runs for r in got.values()) > 5
    for i, text in docs.items():
        w, r = plain_op12(i, text), got[i]
        runs = plain_runs(w) if len(w) < 500 else periodic.word_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        kept = [x for j, x in enumerate(w) if not any(s + q <= j < s + n for s, n, q in runs)]
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], "".join(f"{s},{n},{q}\n" for s, n, q in runs), b" ".join(kept))
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == want[:5]
        assert (r.runs_sha256, r.collapsed_sha256) == (hashlib.sha256(want[5].encode()).hexdigest(), hashlib.sha256(want[6]).hexdigest())


def test_runs_odd_inputs(spark):
    long = "so it goes on " * 50_000
    rows = [(None, "a a a a a a b"), (None, "a a a a a a b"), (1, None), (2, ""), (3, " \t\n\x0b "), (4, long), (5, "x x " * 7)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("runs", "n_words", "collapsed")])
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(odd).collect())
    six = ((True, 0), 7, [(0, 6, 1)], "a b")
    assert got == [((False, 1), 0, [], ""), ((False, 2), 0, [], ""), ((False, 3), 0, [], ""), ((False, 4), 200_000, [(0, 200_000, 4)], "so it goes on"), ((False, 5), 7, [(0, 7, 1)], "x x"), six, six]
    assert periodic.find_runs(odd.where("false")).count() == 0


ODD = ["", " ", "a", "a" * 50, "  \n\n  x", "don't we'll I'M 're", "é" * 50, "日本語テキスト", "\U0001f600\U0001f600 x", "͸ᲊa", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "\x85\xa0x", "1" * 1000, "ab" * 3000, "\x00\x01", "x́", "½²Ⅷ"]


def odd_texts():
    draw = random.Random(3)
    letters = "ab \n'tselv1é.\U0001f600 　"
    out = ODD + ["".join(draw.choice(letters) for _ in range(draw.randint(1, 60))) for _ in range(1000)]
    out += ["".join(draw.choice("abcdeaaei") for _ in range(draw.randint(1, 40))) for _ in range(1000)]
    return out + ["".join(chr(draw.choice([draw.randrange(0x20, 0x250), draw.randrange(0x370, 0x3000), draw.randrange(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(300)]


def test_ids_and_decoding_equal_the_library(spark):
    library = Tokenizer.from_file(PATH)
    texts = odd_texts() + [r.text for r in table(spark, SF, "documents").where("text is not null").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in bpe.encode(df, PATH).collect()}
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got[i].ids, "<u4").tolist() == e.ids, texts[i]
        assert got[i].decoded == library.decode(e.ids, skip_special_tokens=False)


def test_automaton_accepts_one_path_for_a_word():
    """Of all ways to spell a word by tokens, arcs lead along exactly one: the encoding."""
    automaton = bpe.Automaton(PATH)
    draw = random.Random(5)

    def spelled(word, state=None):
        if not word:
            return [[]]
        out = []
        for n in range(1, len(word) + 1):
            t = automaton.token.get(word[:n])
            if t is not None and (state is None or automaton.arc(state, t)):
                out += [[t, *rest] for rest in spelled(word[n:], automaton.into[t])]
        return out

    for _ in range(300):
        word = bytes(draw.choice(b"aeinst aaa\xc3\xa9") for _ in range(draw.randint(1, 9)))
        assert spelled(word) == [automaton.encode(word)]


def test_tokens_odd_inputs(spark):
    long = "the same words again " * 60_000
    rows = [(None, "a b"), (None, "a b"), (1, None), (2, ""), (3, long), (4, "q" * 300_000)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("ids", "decoded", "n_tokens")])
    got = bpe.encode(odd, PATH)
    assert got.columns == ["doc_id", "ids", "decoded"]
    assert sorted((r.doc_id or 0, r.decoded) for r in got.collect()) == sorted((i or 0, t or "") for i, t in rows)
    assert bpe.encode(odd.where("false"), PATH).count() == 0


def test_tokens_query(spark):
    library = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    for r in queries.op13_bpe_automaton(spark, SF).collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

"""The first ten operators on null ids, repeated rows, ties, very long texts, empty tables and extra columns with clashing names."""

import zlib

import brute
import pytest
from pyspark.sql import functions as F

from riskspark.llm import decontam, langid, line_dedup, minhash, mixing, ogg, pii, sharding, suffix_dedup, url_graph
from riskspark.llm.common import broadcast_within

NAMES = ["th", "n", "n_words", "items", "found", "lang_pred", "score", "copies", "taken", "target", "payload_bytes", "feature", "media", "n_bytes", "node", "g", "n_lines", "keep_bitmap", "shard", "slot", "rule", "verdict", "host", "spans", "kd", "runs", "bands", "size", "k", "p"]
LONG = "call me at a.b@mail.example.com or on +1 (555) 123-4567 now\n" + "The same long line that goes on and on for a good while " * 25_000
ROWS = [(None, "one two three four five six", "en"), (None, "one two three four five six", "en"), (1, None, None), (1, "", "en"), (2, LONG, "en"), (2, LONG, "en"), (3, "one two three four five six", "en"), (None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").repartition(3)
    return df.select("*", *[F.lit("x").alias(n) for n in NAMES]).cache()


def test_decontamination(spark, odd):
    items = spark.createDataFrame([("i", "three four"), ("j", None)], "item_id string, text string").withColumn("phrase", F.lit(1))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit) for r in decontam.contamination(odd, items).collect())
    assert got == sorted((d is None, d or 0, x[1], x[2]) for d, x in zip((r[0] for r in ROWS), brute.op1([r[:2] for r in ROWS], [("i", "three four")]), strict=True))


def test_language(odd):
    out = langid.identify(odd, langid.train_profiles(odd))
    assert out.count() == len(ROWS) and {r.lang_pred for r in out.where("length(text) > 0").collect()} == {"en"}
    assert out.where("text is null and lang_pred = 'und' and score = 0").count() == 2
    assert langid.identify(odd.where("false"), langid.train_profiles(odd)).count() == 0


def test_suffix_dedup(odd):
    got = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(odd).collect())
    n = len(LONG)
    assert got == sorted([(27, 0, 0)] * 3 + [(0, 0, 0)] * 3 + [(n, n, 1)] * 2)


def test_mixing(odd):
    docs = odd.withColumns({"sources": F.array("lang"), "size": mixing.word_count(F.col("text"))})
    out = mixing.mix(docs)
    assert out.count() == len(ROWS) and out.where("taken > 2 * size").count() == 0 and set(docs.columns) <= set(out.columns)


def test_media(odd):
    out = ogg.read_media(ogg.text_to_media(odd))
    assert sorted(r.n_bytes for r in out.collect()) == sorted(len(r[1] or "") for r in ROWS)
    long = out.where("n_bytes > 1000").select("timestamps").first()[0]
    assert sum(x.end - x.start for x in long) == pytest.approx((len(LONG) + -len(LONG) % 64) / 8000)
    assert ogg.read_media(ogg.text_to_media(odd.where("false"))).count() == 0
    assert ogg.read_media(odd.select("doc_id", F.lit(None).cast("binary").alias("media"))).where("payload_bytes is null").count() == len(ROWS)


def test_near_duplicates(odd):
    out = minhash.near_duplicates(odd).collect()
    assert len(out) == len(ROWS) and all(r.kept for r in out)


def test_lines(spark, odd):
    out = line_dedup.keep_bitmaps(odd)
    assert sorted(r.n_lines for r in out.collect()) == [1] * 6 + [2] * 2
    line = "a line of more than forty characters that many documents hold"
    same = spark.createDataFrame([(i % 6 if i else None, f"{i}\n{line}\n{line}") for i in range(400)], "doc_id long, text string")
    assert sorted(r.n_dropped for r in line_dedup.keep_bitmaps(same).collect()) == [0] * 66 + [2] * 334


def test_shards(odd):
    docs = sharding.sized(odd)
    out = sharding.assign_shards(docs, shards=4, order=("doc_id", "text_crc32", "size")).collect()
    assert len(out) == len(ROWS) and sorted(r.slot for r in out if r.shard == 0) == list(range(sum(r.shard == 0 for r in out)))
    assert {(r.doc_id, r.text_crc32) for r in out} == {(d, zlib.crc32((t or "").encode())) for d, t, _ in ROWS}


def test_urls(spark, odd):
    rules = spark.createDataFrame(url_graph.RULES, "action string, host string, path string")
    pages = odd.select(F.lit("http://x.net/").alias("url"), F.col("text").alias("html"), *NAMES)
    out = url_graph.judge(pages, rules)
    assert out.where("verdict = 'block' and rule = 'net/'").count() == len(ROWS)


def test_trust_spreads_over_links(spark):
    rows = [(1, "http://good.example.org/fr/", '<a href="http://friend.info/">'), (2, "http://friend.info/x", '<a href="//next.info/">'), (3, "http://bad.net/", ""), (4, "http://spam.info/", '<a href="http://bad.net/">'), (5, "http://alone.info/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = spark.createDataFrame([("block", "net", "/"), ("allow", "org", "/fr/")], "action string, host string, path string")
    got = {r.page_id: r for r in url_graph.judge(pages, rules).collect()}
    assert [got[i].verdict for i in range(1, 6)] == ["allow", "allow", "block", "block", "allow"]
    assert got[2].trust > 0 and got[4].distrust > 0 and got[5].trust == got[5].distrust == 0


def test_personal_data(odd):
    got = sorted((r.doc_id, [(s.k, s.start, s.end) for s in r.spans if s.base]) for r in pii.find(odd).collect())
    assert got == [(2, [(0, 11, 31), (3, 38, 55)])]


def test_broadcast_bound(spark):
    small = spark.range(10)
    plan = lambda b: spark.range(1000).join(broadcast_within(small, 64, b), "id")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan(1 << 20) and "ShuffledHashJoin" in plan(100)

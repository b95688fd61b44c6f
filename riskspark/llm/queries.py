"""Registered queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import bpe, centroids, decontam, langid, line_dedup, minhash, mixing, ogg, periodic, pii, sharding, suffix_dedup, url_graph
from riskspark.llm.common import table, text_hash
from riskspark.llm.oracles import ORACLE_SQL as ORACLE_SQL


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), proximity=True)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    near = [F.size("near").cast("long").alias("n_near"), F.array_join("near", ",").alias("near_items")]
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"), *near)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    profiles = langid.train_profiles(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array("source").alias("sources"), mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = ogg.text_to_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ogg.read_media(media).drop("timestamps")


def op6_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def _kept_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sha = [hashlib.sha256(line_dedup.apply_bitmap(t, m).encode()).hexdigest() for t, m in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_dedup.keep_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "n_lines", "n_dropped", "text", "keep_bitmap").mapInArrow(_kept_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.sized(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    placed = sharding.assign_shards(docs, shards=40, order=("doc_id", "text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_graph.RULES, "action string, host string, path string")
    return url_graph.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op10_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs).select(F.col("doc_id").alias("fd"), F.col("th").alias("ft"), "spans")
    keys = docs.select("doc_id", text_hash(F.col("text")).alias("th"))
    out = keys.join(found, keys["doc_id"].eqNullSafe(found["fd"]) & keys["th"].eqNullSafe(found["ft"]), "left")
    spans = F.coalesce("spans", F.array().cast(found.schema["spans"].dataType))
    names = F.array(*[F.lit(k) for k in pii.ALL_KINDS])
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(i: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["base"] & (s["k"] == i))).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return out.select("doc_id", *counts, F.sha2(joined(F.filter(spans, lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"), joined(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"))


def op11_va_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, dims=64, scale=1024, seed=3).rows


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", periodic.made_periodic(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.find_runs(docs)
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    found = found.withColumn("top", longest)
    start, length, period = F.col("top.start").alias("start"), (-F.col("top.l")).alias("length"), F.col("top.period").alias("period")
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    exponent = F.expr("(1000 * -top.l) div top.period").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start, length, period, exponent, F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op13_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    n = F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return coded.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_language_id": op2_language_id,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_source_mix": op4_source_mix,
    "op5_ogg_media": op5_ogg_media,
    "op6_minmax_near_dedup": op6_minmax_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_byte_shards": op8_byte_shards,
    "op9_host_trust": op9_host_trust,
    "op10_boosted_pii": op10_boosted_pii,
    "op11_va_centroids": op11_va_centroids,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_bpe_automaton": op13_bpe_automaton,
}

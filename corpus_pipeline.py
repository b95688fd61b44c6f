"""Training-corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a frame; stages are written as Parquet and read again in between. All but
the last return the columns of documents; the last returns the shard manifest, one row for each copy of a document that the
mix takes. Null texts and texts without letters leave in the first stage; null languages are filled in, null doc_ids and sources stay
(a null source is a source of its own, the last in order). Texts of any length are taken whole. Extra columns are carried along,
whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import decontam, langid, minhash, mixing, sharding
from riskspark.llm.common import broadcast_within, discard, materialize, scratch, table, text_hash

#: Documents whose nearest language profile shares less than this with them are in no known language.
MIN_LANGUAGE_SCORE = 0.1


def _number() -> Column:
    """doc_id; rows without one get a number from their text, above all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit(2**61 - 1)) + F.lit(2**62))


def _wrapped(docs: DataFrame) -> DataFrame:
    """(doc, id, th): whole rows beside the keys that decisions come back by, so no column's name can clash."""
    return docs.select(F.struct("*").alias("doc"), _number().alias("id"), text_hash(F.col("text")).alias("th"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of docs whose (id, th) isn't in gone (kd, kt)."""
    own = _wrapped(docs)
    gone = broadcast_within(gone, 32)
    return own.join(gone, (own["id"] == gone["kd"]) & (own["th"] == gone["kt"]), "left_anti").select("doc.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the languages that the labelled rows teach; a missing label gets the predicted language.

    Null texts and texts without letters go. Repeated rows are decided alike; ties between languages go to the first by name.
    Without any labelled row nothing can be told and nothing stays. An empty input gives an empty result.
    """
    profiles = materialize(langid.train_profiles(docs), "profiles")
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no column's name can clash
    known = langid.identify(docs.toDF(*names.values()), profiles, names["text"]).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return known.select(*[(F.coalesce(n, "lang_pred") if c == "lang" else F.col(n)).alias(c) for c, n in names.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates: five-word shingles, similarity 0.8.

    Rows without a doc_id take part under a number above all others. Of rows alike in doc_id and text one stays. Texts without
    words are linked with nothing. An empty input gives an empty result.
    """
    found = materialize(minhash.near_duplicates(docs.select(_number().alias("doc_id"), "text"), words=5, percent=80).select(F.col("doc_id").alias("kd"), F.col("th").alias("kt"), "kept"), "near-duplicates")
    left = _without(docs, materialize(found.where("not kept").select("kd", "kt").distinct(), "near-duplicates"))
    again = materialize(found.where("kept and kt is not null").groupBy("kd", "kt").count().where("count > 1").select("kd", "kt"), "repeated-rows")
    if again.isEmpty():
        return left
    own = _wrapped(left)
    again = broadcast_within(again, 32)
    repeated = own.join(again, (own["id"] == again["kd"]) & (own["th"] == again["kt"])).groupBy("id", "th").agg(F.first("doc").alias("doc")).select("doc.*")
    return _without(left, again).unionByName(repeated)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which ten consecutive words of a benchmark item occur (or a whole shorter item).

    Null and empty texts stay; repeated rows are decided alike. Without benchmark items all documents stay.
    """
    found = decontam.contamination(docs.select(_number().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(docs, materialize(found.where("n_hit > 0").select(F.col("doc_id").alias("kd"), F.col("th").alias("kt")).distinct(), "contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources come near their weights; a row for each copy taken.

    Repeated rows are separate documents. Null texts and texts without words have size 0 and aren't taken. An empty input gives an empty result.
    """
    slim = docs.select(F.struct("*").alias("doc"), "doc_id", F.array("source").alias("sources"), mixing.word_count(F.col("text")).alias("size"))
    taken = mixing.mix(slim).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("doc.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The manifest of 40 shards of near equal bytes, contiguous in doc_id.

    All columns but text stay, with size, text_crc32, shard and slot, which replace columns of these names. Null doc_ids come first; a null
    text has no bytes; repeated rows each get a place. An empty input gives an empty result.
    """
    slim = sharding.sized(docs).drop("text")
    return sharding.assign_shards(slim, shards=40, order=("doc_id", "text_crc32", "size"))


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]
#: The stages' samples, components and seeded choices aren't SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of what all stages keep. What a stage wrote for itself, and what it read, goes when its own result is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            kept = materialize(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        if i:
            discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)

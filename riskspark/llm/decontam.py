"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import ascii_lower, broadcast_within, materialize, text_hash

#: What separates words, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Term lists intersected for a phrase, from the rarest on, before its other words are compared.
LISTS = 2
#: Terms of an item, from the rarest on, that a proximity match holds close together.
NEAR_TERMS = 4
_DOC = ["doc_id", "th"]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def phrase_windows(items: DataFrame, length: int = 10, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct phrases (phrase, words) of `length` consecutive words, and (phrase, item_id). A shorter item that has words is
    one phrase; null texts and texts without words give none."""
    words = items.select(F.col(item_id).cast("string").alias("item_id"), words_of(F.col(text)).alias("w")).where("size(w) > 0")
    windows = words.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1))), lambda i: F.slice("w", i, length))).alias("words"))
    windows = materialize(windows.select("item_id", F.array_join("words", " ").alias("phrase"), "words"), "phrases")
    return windows.select("phrase", "words").dropDuplicates(["phrase"]), windows.select("phrase", "item_id").distinct()


def build_index(docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """Postings (tid, doc_id, th, pos) of the vocabulary's terms (term, tid) in every document, written term by term.

    Each output part is the index of a range of documents, sorted by term, so building needs no shuffle, a frequent term
    spreads over all parts and a lookup reads the row groups of its terms. Terms outside the vocabulary take part in no match
    and are not stored; positions count them. Term -1 has one posting for each row of docs: its number of words.
    """
    words = F.concat(words_of(F.col(text)), F.array(F.lit("")))
    tokens = docs.select("doc_id", text_hash(F.col(text)).alias("th"), F.posexplode(words).alias("pos", "term"))
    ends = docs.sparkSession.createDataFrame([("", -1)], vocabulary.select("term", F.col("tid").cast("long").alias("tid")).schema)
    terms = broadcast_within(vocabulary.select("term", F.col("tid").cast("long").alias("tid")).union(ends))
    postings = tokens.join(terms, "term").select("tid", "doc_id", "th", "pos")
    return materialize(postings.sortWithinPartitions("tid"), "postings")


def _same_doc(a: DataFrame, b: DataFrame, names: tuple[str, str]) -> Column:
    return a["doc_id"].eqNullSafe(b[names[0]]) & a["th"].eqNullSafe(b[names[1]])


def phrase_matches(docs: DataFrame, index: DataFrame, terms: DataFrame, phrases: DataFrame, text: str = "text", lists: int = LISTS) -> DataFrame:
    """(doc_id, th, matches): for each document with an exact occurrence of a phrase, its (start, end, phrase), sorted.

    phrases: (phrase, words); terms: (term, tid). Corpus frequencies come from the index; a phrase with a term that no
    document holds is out. The position lists of a phrase's rarest terms, each moved back by its offset, are intersected by
    (document, phrase, start); the remaining words are then compared with the document.
    """
    frequency = index.where("tid >= 0").groupBy("tid").count()
    parts = phrases.select("phrase", F.size("words").alias("len"), F.posexplode("words").alias("offset", "term")).join(terms, "term").join(frequency, "tid", "left")
    ranked = parts.withColumns({
        "nth": F.row_number().over(Window.partitionBy("phrase").orderBy(F.col("count"), "offset")),
        "least": F.min(F.coalesce("count", F.lit(0))).over(Window.partitionBy("phrase")),
    }).where("least > 0")
    ranked = ranked.where(F.col("nth") <= lists).select("tid", "phrase", "offset", F.col("nth").alias("nth"), F.least("len", F.lit(lists)).alias("need"), "len")
    ranked = materialize(ranked, "rarest")
    moved = index.join(broadcast_within(ranked, 120 + F.octet_length("phrase")), "tid").where("pos >= offset")
    moved = moved.select(*_DOC, "phrase", (F.col("pos") - F.col("offset")).alias("start"), "len", F.expr("shiftleft(1, nth - 1)").alias("bit"), "need")
    starts = moved.groupBy(*_DOC, "phrase", "start", "len").agg(F.bit_or("bit").alias("bits"), F.max("need").alias("need")).where("bits = shiftleft(1, need) - 1")
    found = starts.groupBy(*_DOC).agg(F.collect_list(F.struct("start", (F.col("start") + F.col("len")).alias("end"), "phrase")).alias("found"))  # bounded by the document's length
    found = materialize(found.withColumnsRenamed({"doc_id": "fd", "th": "ft"}), "candidates")
    side = broadcast_within(found, 64 + F.aggregate("found", F.lit(0).cast("long"), lambda a, x: a + 48 + F.octet_length(x["phrase"])))
    texts = docs.select("doc_id", text_hash(F.col(text)).alias("th"), F.col(text).alias("t"))
    near = texts.join(side, _same_doc(texts, side, ("fd", "ft")))
    # a lambda over the words, so that a text is split once and not for each candidate
    exact = F.get(F.transform(F.array(words_of(F.col("t"))), lambda w: F.filter("found", lambda x: F.array_join(F.slice(w, x["start"] + 1, x["end"] - x["start"]), " ") == x["phrase"])), F.lit(0))
    return near.select(*_DOC, F.sort_array(exact).alias("matches")).where("size(matches) > 0").dropDuplicates(_DOC)


def rarest_terms(items: DataFrame, index: DataFrame, terms: DataFrame, most: int = NEAR_TERMS) -> DataFrame:
    """A proximity query for each item (item_id, w array<string>): (query, need, span, tid, nth), a row for each of its terms.

    An item's terms are its `most` rarest distinct words among those that documents hold, by occurrences in the corpus and then by
    code point; `need` is the number of terms, or of distinct words if there are fewer. The span is twice the item's words.
    """
    frequency = index.where("tid >= 0").groupBy("tid").count()
    word = items.select(F.struct("item_id", F.xxhash64("w").alias("h")).alias("query"), (F.size("w") * 2).alias("span"), F.array_distinct("w").alias("w")).distinct()
    word = word.select("query", "span", F.least(F.size("w"), F.lit(most)).alias("need"), F.explode("w").alias("term")).join(terms, "term").join(frequency, "tid")
    ranked = word.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy("count", "term")) - 1).where(F.col("nth") < most)
    return ranked.select("query", "need", "span", "tid", "nth")


def proximity_matches(index: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, doc_id, th, start, width): for each query and document in which all terms of the query occur within its span of words,
    in any order, the narrowest such place (the first of equals).

    asked: (query, need, span, tid, nth), the terms of a query numbered from 0; one with fewer than `need` rows matches nothing. The
    index must hold the terms. A document's positions are read once, in order, with the last place of each term at hand.
    """
    asked = materialize(asked, "asked")
    lists = index.join(broadcast_within(asked, 160), "tid")
    near = lists.groupBy("query", "need", "span", *_DOC).agg(F.sort_array(F.collect_set(F.struct(F.col("pos").cast("long").alias("pos"), "nth"))).alias("places"))  # bounded by the document's length
    near = near.where(F.size(F.array_distinct(F.transform("places", lambda x: x["nth"]))) == F.col("need"))
    nowhere = F.lit(-(2**40))

    def step(a: Column, x: Column) -> Column:
        seen = F.transform(a["seen"], lambda v, i: F.when(i == x["nth"], x["pos"]).otherwise(v))
        width = x["pos"] - F.array_min(seen) + 1
        better = width < a["width"]
        return F.struct(seen.alias("seen"), F.when(better, width).otherwise(a["width"]).alias("width"), F.when(better, F.array_min(seen)).otherwise(a["start"]).alias("start"))

    best = F.aggregate("places", F.struct(F.array_repeat(nowhere, F.col("need")).alias("seen"), F.lit(2**40).alias("width"), nowhere.alias("start")), step)
    return near.withColumn("best", best).where("best.width <= span").select("query", *_DOC, "best.start", "best.width")


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", length: int = 10, proximity: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, th, n_words, n_hit, items (sorted item ids, as strings); with proximity also near, the
    sorted ids of items whose rarest terms the document holds close together (rarest_terms, proximity_matches).

    A document word is hit if it lies inside an occurrence of one of the items' windows. Null and empty texts have no words.
    Rows alike in doc_id and text get the same result; th = xxhash64(text) tells other rows of one doc_id apart. A null doc_id is
    an id like others. Texts of any length are taken whole; other columns play no part, whatever their names. Without
    items nothing is hit; without documents the result is empty.
    """
    phrases, of_item = phrase_windows(items, length)
    terms = phrases.select(F.explode("words").alias("term")).distinct()
    terms = materialize(terms.select("term", F.xxhash64("term").bitwiseAND(F.lit(2**62 - 1)).alias("tid")), "terms")
    index = build_index(docs, terms, text)
    matches = materialize(phrase_matches(docs, index, terms, phrases, text), "matches")
    covered = F.aggregate(
        "matches",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["end"]))).cast("long").alias("n"), F.greatest(a["end"], x["end"]).alias("end")),
    )["n"]
    hits = matches.select(F.col("doc_id").alias("hd"), F.col("th").alias("ht"), covered.alias("n_hit"))
    of_doc = matches.select("doc_id", "th", F.explode(F.array_distinct(F.transform("matches", lambda x: x["phrase"]))).alias("phrase"))
    found = of_doc.join(broadcast_within(of_item, 120 + F.octet_length("phrase")), "phrase").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    found = found.withColumnsRenamed({"doc_id": "id", "th": "it"})
    hits = hits.join(found, F.col("hd").eqNullSafe(F.col("id")) & F.col("ht").eqNullSafe(F.col("it"))).select("hd", "ht", "n_hit", "items")
    lengths = index.where("tid = -1").select(*_DOC, F.col("pos").cast("long").alias("n_words"))
    out = lengths.join(hits, _same_doc(lengths, hits, ("hd", "ht")), "left")
    none = F.array().cast("array<string>")
    out = out.select(*_DOC, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"))
    if not proximity:
        return out
    words = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where("size(w) > 0")
    near = proximity_matches(index, rarest_terms(words, index, terms))
    near = near.groupBy(*_DOC).agg(F.sort_array(F.collect_set("query.item_id")).alias("near")).withColumnsRenamed({"doc_id": "nd", "th": "nt"})
    return out.join(near, _same_doc(out, near, ("nd", "nt")), "left").select(*out.columns, F.coalesce("near", none).alias("near"))

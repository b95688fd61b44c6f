"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERS = (1, 2, 3)
PROFILE = 600
UNKNOWN = "und"
#: A gram is packed at 21 bits a character; a word's edge is 1, so that no gram equals a shorter one.
_BITS, _EDGE = 21, 1
#: Grams of one task that are summed up at a time, and held as sums before they leave it.
_FOLD, _HELD = 1 << 18, 1 << 19


def letter_codes(text: str) -> np.ndarray:
    """Lower-cased letters as code points, each run of other characters as one edge, with an edge at both ends; empty without letters.

    str.isalpha decides what a letter is; only the text's distinct characters are asked.
    """
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        return np.zeros(0, np.int64)
    if cp.max() < 0x10000:
        seen = np.flatnonzero(np.bincount(cp))
        table = np.full(int(seen[-1]) + 1, _EDGE, np.int64)
        table[seen] = [int(c) if chr(c).isalpha() else _EDGE for c in seen]
        v = table[cp]
    else:
        seen, back = np.unique(cp, return_inverse=True)
        v = np.array([int(c) if chr(c).isalpha() else _EDGE for c in seen], np.int64)[back]
    v = np.concatenate([[_EDGE], v, [_EDGE]])
    letters = v != _EDGE
    return v[np.concatenate([[True], letters[1:] | letters[:-1]])] if letters.any() else np.zeros(0, np.int64)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, packed into integers (21 bits a character), and their counts. No gram spans two words."""
    v = letter_codes(text)
    parts = []
    for n in ORDERS if len(v) else ():
        if len(v) < n:
            continue
        g = v[: len(v) - n + 1].copy()
        ok = np.ones(len(g), bool) if n > 1 else v != _EDGE
        for k in range(1, n):
            g = (g << _BITS) | v[k : len(v) - n + 1 + k]
            if k < n - 1:
                ok &= v[k : len(v) - n + 1 + k] != _EDGE
        parts.append(g[ok])
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent grams, most frequent first; ties by the gram itself."""
    return grams[np.lexsort((grams, -counts))[:size]]


def _sum(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else np.zeros(0, np.int64)
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts by language. A language's documents are folded into one sum every _FOLD grams; sums over _HELD grams leave."""
    parts: dict[str, list] = {}
    waiting: dict[str, int] = {}

    def out(lang: str) -> pa.RecordBatch:
        g, n = _sum(parts.pop(lang))
        waiting.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "gram", "n"])

    for b in batches:
        for lang, t in zip(b.column(0), b.column(1), strict=True):
            key, found = lang.as_py(), gram_counts(t.as_py())
            parts.setdefault(key, []).append(found)
            waiting[key] = waiting.get(key, 0) + len(found[0])
            if waiting[key] > _FOLD:
                parts[key], waiting[key] = [_sum(parts[key])], 0
                if len(parts[key][0][0]) > _HELD:
                    yield out(key)
                elif sum(waiting.values()) + sum(len(x[0]) for p in parts.values() for x in p[:1]) > 4 * _HELD:  # many languages
                    yield from [out(k) for k in list(parts)]
    yield from [out(k) for k in list(parts)]


def train_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """Rank-order profiles (lang, gram, rank from 0) from all labelled rows; rows with null text or language don't count.

    Grams are counted inside tasks in bounded sums, summed on Spark, and the `size` most frequent of each language stay. Texts of any
    length are taken whole; repeated rows count each time; ties go to the smaller gram. No labelled row gives no profile. Other columns play no part.
    """
    counts = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("t")).mapInArrow(_count, "lang string, gram long, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")) - 1
    return counts.withColumn("rank", rank).where(F.col("rank") < size).select("lang", "gram", "rank")


def _predictor(profiles: list[tuple[str, int, int]], size: int, at: int):
    """profiles: size rows a language at most, whatever the corpus."""
    langs = sorted({p[0] for p in profiles})
    universe = np.unique(np.array([p[1] for p in profiles], np.int64))
    ranks = np.full((len(langs), len(universe) + 1), -1, np.int64)
    for lang, gram, rank in profiles:
        ranks[langs.index(lang), np.searchsorted(universe, gram)] = rank

    def predict(text: str | None) -> tuple[str, float]:
        grams, counts = gram_counts(text or "")
        if not len(grams) or not langs:
            return UNKNOWN, 0.0
        top = ranked(grams, counts, size)
        spot = np.searchsorted(universe, top)
        spot[spot == len(universe)] = 0
        spot = np.where(universe[spot] == top, spot, len(universe))
        r = ranks[:, spot]
        distance = np.where(r < 0, size, np.minimum(np.abs(r - np.arange(len(top))), size)).mean(1)
        best = int(np.argmin(distance))
        return langs[best], float(1 - distance[best] / size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [predict(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: DataFrame, text: str = "text", size: int = PROFILE) -> DataFrame:
    """Add lang_pred and score to every row.

    A document's most frequent n-grams, ranked, are compared with each profile: the mean distance between ranks, `size` for
    grams that the profile lacks. The nearest profile wins, ties by language name; score is 1 - distance / size. Null texts
    and texts without letters get `und` and 0, as do all texts when there is no profile. Columns lang_pred and score are replaced.
    Only the profiles travel to the tasks: `size` rows for each language. Repeated rows are told alike; texts of any length are taken
    whole; an empty input gives an empty result.
    """
    kept = docs.drop("lang_pred", "score")
    rows = [(r["lang"], r["gram"], r["rank"]) for r in profiles.collect()]
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return kept.mapInArrow(_predictor(rows, size, kept.columns.index(text)), T.StructType([*kept.schema.fields, *added]))

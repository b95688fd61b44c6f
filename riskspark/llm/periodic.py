"""Periodic runs of words: recursive frequency splitting, then a scan over lags of the segments that survive."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORTEST, EXPONENT = 6, 4  # a run's least length, in words and in periods
#: Blocks that one step of the lag scan compares.
STEP = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _parts(a: int, b: int, cuts: list[int]) -> list[tuple[int, int]]:
    """Stretches of [a, b) between cuts, long enough for a run."""
    ends = [a - 1, *cuts, b]
    return [(x + 1, y) for x, y in zip(ends, ends[1:], strict=False) if y - x > SHORTEST]


def stable_segments(ids: np.ndarray) -> list[tuple[int, int]]:
    """Segments in which every word occurs EXPONENT times or more, split again until none is rarer.

    A word of a run occurs in it once a period, so a word rarer than that in its segment lies in no run and ends segments. A split
    counts its smaller parts anew and takes them off the counts of the largest, so all splits together cost n log n, however deep.
    """
    often = np.bincount(ids)[ids] >= EXPONENT
    first = _parts(0, len(ids), np.flatnonzero(~often).tolist())
    if not first:
        return []
    order, rank = None, None
    out, todo = [], [(a, b, Counter(ids[a:b].tolist()), None) for a, b in first]
    while todo:
        a, b, count, suspects = todo.pop()
        rare = [w for w in (count if suspects is None else suspects) if 0 < count[w] < EXPONENT]
        if not rare:
            out.append((a, b))
            continue
        if order is None:
            order, rank = np.argsort(ids, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(ids))])
        cuts = []
        for w in rare:
            at = order[rank[w] : rank[w + 1]]
            cuts.extend(at[np.searchsorted(at, a) : np.searchsorted(at, b)].tolist())
        parts = _parts(a, b, sorted(cuts))
        if not parts:
            continue
        big = max(parts, key=lambda p: p[1] - p[0])
        gone = Counter(ids[a : big[0]].tolist())
        gone.update(ids[big[1] : b].tolist())
        count.subtract(gone)
        todo.append((*big, count, list(gone)))
        todo.extend((x, y, Counter(ids[x:y].tolist()), None) for x, y in parts if (x, y) != big)
    return sorted(out)


def _stretch(x: np.ndarray, a: int, b: int, q: int) -> tuple[int, int]:
    """The longest [s, e) around [a, b) in which words q apart are the same."""
    for forward in (False, True):
        step = 64
        while True:
            if forward:
                n = min(step, len(x) - b)
                off = np.flatnonzero(x[b : b + n] != x[b - q : b - q + n])
                b += int(off[0]) if len(off) else n
            else:
                n = min(step, a)
                off = np.flatnonzero(x[a - n : a][::-1] != x[a - n + q : a + q][::-1])
                a -= int(off[0]) if len(off) else n
            if len(off) or n < step:
                break
            step *= 2
    return a, b


def lag_scan(x: np.ndarray) -> list[tuple[int, int, int]]:
    """All (start, length, period) of a segment, by period.

    A run of period q holds three aligned blocks of q words in a row that are the same. So for each lag only aligned blocks are compared, by
    polynomial hashes modulo 2^64: n log n in all. Equal hashes are checked word by word, then stretched. A stretch that a
    run with a period dividing q covers is that run itself.
    """
    n = len(x)
    values = (x.astype(np.uint64) + np.uint64(1)) * _BASE
    values ^= values >> np.uint64(29)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    power = np.full(n + 1, np.uint64(0x2545F4914F6CDD1D), np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[:n])])
    runs: list[tuple[int, int, int]] = []
    known: dict[int, tuple[list[int], list[int]]] = {}  # period: starts, ends

    def found(q: int, starts: np.ndarray) -> None:
        at = 0
        while at < len(starts):
            s = int(starts[at])
            for p, (begins, ends) in known.items():
                if q % p == 0 and (i := bisect_right(begins, s) - 1) >= 0 and ends[i] >= s + 3 * q:
                    at = int(np.searchsorted(starts, ends[i] - 3 * q, side="right"))
                    break
            else:
                at += 1
                if np.array_equal(x[s : s + 2 * q], x[s + q : s + 3 * q]):
                    a, b = _stretch(x, s, s + 3 * q, q)
                    at = int(np.searchsorted(starts, b - 3 * q, side="right"))
                    if b - a >= max(SHORTEST, EXPONENT * q):
                        begins, ends = known.setdefault(q, ([], []))
                        begins.append(a)
                        ends.append(b)
                        runs.append((a, b - a, q))

    top, q = n // EXPONENT, 1
    while q <= top:
        last = min(top, q + max(0, STEP * q // n - 1))
        lags = np.arange(q, last + 1)
        count = n // lags
        lag = np.repeat(lags, count)
        start = (np.arange(len(lag)) - np.repeat(np.cumsum(count) - count, count)) * lag
        block = prefix[start + lag] - prefix[start]
        same = (block[:-1] * power[lag[:-1]] == block[1:]) & (lag[:-1] == lag[1:])
        hit = np.flatnonzero(same[:-1] & same[1:])
        for group in np.split(hit, np.flatnonzero(np.diff(lag[hit])) + 1) if len(hit) else ():
            found(int(lag[group[0]]), start[group])
        q = last + 1
    return runs


def word_runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs, by start and period."""
    if len(words) < SHORTEST:
        return []
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(words) - len(number) < SHORTEST - SHORTEST // EXPONENT - 1:  # too few repeats for any run
        return []
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    return sorted((a + s, length, q) for a, b in stable_segments(ids) for s, length, q in lag_scan(ids[a:b]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """Words without those that a run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for s, length, q in runs:
        drop[s + q] += 1
        drop[s + length] -= 1
    return list(compress(words, (np.cumsum(drop[:-1]) == 0).tolist()))


def find_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_words, runs (start and period order) and collapsed, the words outside repeats joined by one space.

    Words are what spaces and the characters 9 to 13 leave apart. Null and empty texts have no words, no runs and an empty collapsed text; repeated
    rows each get their row; texts of any length are scanned whole, one in a task, in n log n; other columns play no part. Empty
    input: empty result.
    """
    fields = [docs.schema[c] for c in keep]
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), SCHEMA])
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, runs, left = [], [], []
            for t in b.column(len(keep)).cast(pa.binary()):
                words = (t.as_py() or b"").split()  # bytes split at exactly these six characters
                got = word_runs(words)
                n.append(len(words))
                runs.append([{"start": s, "length": length, "period": q} for s, length, q in got])
                left.append(b" ".join(collapse(words, got)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64()), pa.array(runs, kinds), pa.array(left, pa.binary()).cast(pa.string())], [*keep, "n_words", "runs", "collapsed"])

    return docs.select(*keep, text).mapInArrow(run, shape)


WORDS = "[^\\x20\\x09-\\x0D]+"


def made_periodic(doc_id: Column, text: Column) -> Column:
    """The text, of one doc_id in ten with its words from some place on repeated from there with a period, as the digests of the whole ask for."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, words = F.floor(h / 10), F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    turns = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(turns, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), changed).otherwise(text)

"""Repeated byte strings across documents: content-defined shards and induced suffix sorting with common-prefix values.

A window of `length` bytes belongs to its minimizer, the position inside it of the smallest hash of ANCHOR bytes (the leftmost
of equals). Equal windows have the same minimizer at the same offset, so consecutive windows with one minimizer make a run,
and runs of different minimizer hashes never share a window. That deals the corpus into independent shards: a run whose bytes
occur twice is repeated as a whole, a minimizer hash seen once repeats nothing, and only runs that share a minimizer but differ
go on to suffix sorting, one copy each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import materialize, text_hash

ANCHOR = 32
CHUNK = 1 << 20  # bytes of a text looked at together; positions inside fit the low bits of the minimizer keys
SHARD_BYTES = 1 << 21
#: Bytes of runs that a task sorts, shard after shard.
TASK_BYTES = 1 << 27
#: Windows that leave a task together when they are compared by fingerprints.
PRINTS = 1 << 17
#: Runs of one minimizer hash above this many bytes are compared by window fingerprints summed on Spark, not in one task.
HOT_BYTES = 1 << 22
_RUN = "struct<mh:bigint,sh:bigint,at:bigint,n:int,times:bigint>"


def runs_of(data: bytes, length: int) -> list[list[int]]:
    """[minimizer hash, hash of the run's bytes, first window, windows, times] for the whole text, in order.

    A run that follows itself with the same bytes (in periodic text) is one entry that counts how often it comes.
    """
    out: list[list[int]] = []
    for base in range(0, max(0, len(data) - length + 1), CHUNK):
        part = data[base : base + CHUNK + length - 1]
        b = np.frombuffer(part, np.uint8)
        rng = np.random.default_rng(4242)
        h = rng.integers(0, 2**63, 256, dtype=np.uint64)[b]
        step = 1
        while step < ANCHOR:  # hashes of 2, 4, ... ANCHOR bytes
            h = h[:-step] * np.uint64(0x9E3779B97F4A7C15) + (h[step:] ^ np.uint64(step))
            h ^= h >> np.uint64(29)
            step *= 2
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        width, span = length - ANCHOR + 1, 1
        least = key
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(b) - length + 1], least[width - span : width - span + len(b) - length + 1])
        starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        counts = np.diff(np.concatenate([starts, [len(least)]]))
        mh = h[(least[starts] & np.uint64(0xFFFFFF)).astype(np.int64)].view(np.int64)
        last, last_m, last_c = b"", 0, 0
        for m, s, c in zip(mh.tolist(), starts.tolist(), counts.tolist(), strict=True):
            body = part[s : s + c + length - 1]
            if c == last_c and m == last_m and body == last:
                out[-1][4] += 1
                continue
            last, last_m, last_c = body, m, c
            sh = xxhash.xxh3_64_intdigest(body)
            out.append([m, sh - (1 << 64) if sh >> 63 else sh, base + s, c, 1])
    return out


def _emit_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, runs = [0], []
            for t in b.column(2):
                runs += runs_of((t.as_py() or "").encode(), length)
                ends.append(len(runs))
            cols = list(zip(*runs, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            flat = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["mh", "sh", "at", "n", "times"])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "th", "runs"])

    return run


def _induce(t: np.ndarray, sizes: np.ndarray, is_l: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Order all suffixes from sorted ones: first the L type from the seeds, bucket by bucket upward, then the S type downward.

    Every round takes the suffixes that a bucket has just received and sends their left neighbours on, kept in order by a
    stable sort of one character; a round goes deeper only where a character repeats.
    """
    n = len(t)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    chars = np.flatnonzero(sizes)
    seed_c = t[seeds]
    seed_at = np.searchsorted(seed_c, np.arange(len(sizes) + 1))
    sa = np.full(n, -1, np.int64)
    head = begins.copy()
    for c in chars:
        done, stage = begins[c], 0
        while True:
            if done < head[c]:
                batch, done = sa[done : head[c]], head[c]
            elif stage == 0:
                batch, stage = seeds[seed_at[c] : seed_at[c + 1]], 1
            else:
                break
            left = batch[batch > 0] - 1
            left = left[is_l[left]]
            if len(left):
                ch = t[left]
                order = np.argsort(ch, kind="stable")
                left, ch = left[order], ch[order]
                first = np.flatnonzero(np.concatenate([[True], ch[1:] != ch[:-1]]))
                count = np.diff(np.concatenate([first, [len(ch)]]))
                to = head[ch[first]]
                sa[np.repeat(to - first, count) + np.arange(len(ch))] = left
                head[ch[first]] += count
    tail = ends.copy()
    for c in chars[::-1]:
        done, stage = ends[c], 0
        while True:
            if done > tail[c]:
                batch, done = sa[tail[c] : done][::-1], tail[c]
            elif stage == 0:
                batch, stage = sa[begins[c] : head[c]][::-1], 1
            else:
                break
            left = batch[batch > 0] - 1
            left = left[~is_l[left]]
            if len(left):
                ch = t[left]
                order = np.argsort(ch, kind="stable")
                left, ch = left[order], ch[order]
                first = np.flatnonzero(np.concatenate([[True], ch[1:] != ch[:-1]]))
                count = np.diff(np.concatenate([first, [len(ch)]]))
                to = tail[ch[first]] - 1
                sa[np.repeat(to + first, count) - np.arange(len(ch))] = left
                tail[ch[first]] -= count
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative integers by induced sorting; the last symbol must be smaller than all others.

    Leftmost-S suffixes are ordered by recursion: their substrings are sorted by one induction and named, the names' string is
    sorted by doubling (it is a third as long at most, and repeated strings end at run borders), and a second induction
    orders all suffixes.
    """
    n = len(t)
    t = t.astype(np.uint16)
    if n < 2:
        return np.arange(n)
    sizes = np.bincount(t, minlength=int(t.max()) + 1)
    up = np.concatenate([t[:-1] < t[1:], [True]])
    tie = np.concatenate([t[:-1] == t[1:], [False]])
    at = np.where(tie, n, np.arange(n))
    at = np.minimum.accumulate(at[::-1])[::-1]
    is_l = ~up[at]
    is_l[-1] = False
    lms = np.flatnonzero(~is_l[1:] & is_l[:-1]) + 1
    if not len(lms):
        lms = np.array([n - 1])
    start = lms[np.argsort(t[lms], kind="stable")]
    sa = _induce(t, sizes, is_l, start)
    sa[0] = n - 1
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    # names: neighbours in the order with equal substrings share one
    nth = np.full(n, -1, np.int64)
    nth[lms] = np.arange(len(lms))
    stop = np.concatenate([lms[1:], [n - 1]])
    size = stop - lms + 1
    k = nth[order]
    same = np.zeros(len(order), bool)
    same[1:] = size[k[1:]] == size[k[:-1]]
    open_ = np.flatnonzero(same)
    i = 0
    while len(open_):
        open_ = open_[size[k[open_]] > i]
        if not len(open_):
            break
        equal = t[order[open_] + i] == t[order[open_ - 1] + i]
        same[open_[~equal]] = False
        open_, i = open_[equal], i + 1
    name = np.empty(len(lms), np.int64)
    name[k] = np.cumsum(~same) - 1
    m, width = len(lms), 1
    while True:
        ranks = int(name.max()) + 1
        if ranks == m:
            break
        ahead = np.zeros(m, np.int64)
        if width < m:
            ahead[:-width] = name[width:] + 1
        pair = name * (m + 1) + ahead
        o = np.argsort(pair, kind="stable")
        name = np.empty(m, np.int64)
        name[o] = np.cumsum(np.concatenate([[0], (pair[o][1:] != pair[o][:-1]).astype(np.int64)]))
        width *= 2
    sorted_lms = np.empty(m, np.int64)
    sorted_lms[name] = lms
    sa = _induce(t, sizes, is_l, sorted_lms)
    sa[0] = n - 1
    return sa


def common_prefix(data: np.ndarray, p: np.ndarray, q: np.ndarray, length: int) -> np.ndarray:
    """Bytes that the strings at p and q share, up to length."""
    out = np.zeros(len(p), np.int64)
    open_ = np.arange(len(p))
    for i in range(length):
        open_ = open_[data[p[open_] + i] == data[q[open_] + i]]
        if not len(open_):
            break
        out[open_] = i + 1
    return out


def repeated_starts(runs: list[bytes], length: int) -> list[np.ndarray]:
    """For each run, the windows that occur in more than one place of the shard, from neighbours in its suffix array."""
    text = np.concatenate([*(np.concatenate([np.frombuffer(r, np.uint8).astype(np.uint16) + 2, np.ones(1, np.uint16)]) for r in runs), np.zeros(1, np.uint16)])
    begins = np.cumsum([0, *(len(r) + 1 for r in runs)])
    valid = np.zeros(len(text), bool)
    for b, r in zip(begins, runs, strict=False):
        valid[b : b + len(r) - length + 1] = True
    sa = suffix_array(text)
    pairs = np.flatnonzero(valid[sa[1:]] & valid[sa[:-1]]) + 1
    p, q = sa[pairs - 1], sa[pairs]
    full = common_prefix(text, p, q, length) >= length
    hit = np.zeros(len(text), bool)
    hit[p[full]] = hit[q[full]] = True
    return [np.flatnonzero(hit[b : b + len(r)]) for b, r in zip(begins, runs, strict=False)]


def _ranges(x: np.ndarray) -> list[dict]:
    if not len(x):
        return []
    cut = np.flatnonzero(np.diff(x) > 1)
    return [{"a": int(a), "z": int(z) + 1} for a, z in zip(x[np.concatenate([[0], cut + 1])], x[np.concatenate([cut, [len(x) - 1]])], strict=True)]


def _sort_shards(length: int):
    """Over a partition sorted by minimizer hash: whole hashes are gathered up to SHARD_BYTES and sorted together."""

    def solve(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        found = [(m, s, _ranges(x)) for (m, s, _), x in zip(rows, repeated_starts([r for *_, r in rows], length), strict=True)]
        found = [x for x in found if x[2]]
        kind = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], kind)], ["mh", "sh", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for m, s, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if size >= SHARD_BYTES and m != rows[-1][0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append((m, s, body))
                size += len(body)
        if rows:
            yield solve(rows)

    return run


def _cut_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = t.encode()
                out += [(w["mh"], w["sh"], data[w["at"] : w["at"] + w["n"] + length - 1]) for w in want]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["mh", "sh", "body"])

    return run


def _fingerprints(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m, s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                body = x.as_py()
                for at in range(0, len(body) - length + 1, PRINTS):
                    i = np.arange(at, min(at + PRINTS, len(body) - length + 1), dtype=np.int32)
                    w = np.frombuffer(b"".join([xxhash.xxh3_128_digest(body[k : k + length]) for k in i.tolist()]), "<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array(np.full(len(i), m)), pa.array(np.full(len(i), s)), pa.array(i)], ["w1", "w2", "mh", "sh", "i"])

    return run


def repeated_windows(docs: DataFrame, text: str = "text", length: int = 200) -> DataFrame:
    """(doc_id, th, found): per document with repeats, ranges (a, z) of window starts whose `length` bytes also start anywhere else.

    Counts are summed in the tasks first, and what is joined back by a minimizer hash is a written table, so that Spark splits the
    rows of a passage that many documents share.
    """
    source = docs.select("doc_id", text_hash(F.col(text)).alias("th"), F.col(text).alias("t"))
    runs = materialize(source.mapInArrow(_emit_runs(length), f"doc_id long, th long, runs array<{_RUN}>"), "runs")
    each = runs.select("doc_id", "th", F.inline("runs"))
    twice = materialize(each.groupBy("mh").agg(F.sum("times").alias("c")).where("c > 1").select("mh"), "repeated-minimizers")
    shared = materialize(each.join(twice, "mh", "left_semi"), "shared-runs")
    classes = materialize(shared.groupBy("mh", "sh").agg(F.sum("times").alias("c"), F.min(F.struct("doc_id", "th", "at", "n")).alias("one")), "run-classes")
    groups = classes.groupBy("mh").agg(F.count("*").alias("kinds"), F.sum(F.col("one.n") + (length - 1)).alias("bytes")).where("kinds > 1")
    differing = materialize(classes.join(materialize(groups, "run-groups"), "mh"), "differing-runs")

    asked = differing.groupBy(F.col("one.doc_id").alias("fd"), F.col("one.th").alias("ft")).agg(F.collect_list(F.struct("mh", "sh", F.col("one.at").alias("at"), F.col("one.n").alias("n"))).alias("want"))  # one document's runs
    asked = materialize(asked, "asked-runs").hint("shuffle_hash")  # grows with the corpus: never broadcast
    texts = source.where("t is not null").join(asked, source["doc_id"].eqNullSafe(asked["fd"]) & source["th"].eqNullSafe(asked["ft"]))
    bodies = texts.select("t", "want").mapInArrow(_cut_runs(length), "mh long, sh long, body binary").dropDuplicates(["mh", "sh"])
    bodies = materialize(bodies, "run-bodies")
    total = differing.where(F.col("bytes") <= HOT_BYTES).agg(F.sum(F.col("one.n") + (length - 1))).first()[0] or 0
    hot = differing.where(F.col("bytes") > HOT_BYTES).select("mh").distinct()
    ranges = "mh long, sh long, ranges array<struct<a:int,z:int>>"
    cool = bodies.join(hot, "mh", "left_anti").repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_BYTES), "mh").sortWithinPartitions("mh")
    sorted_ = cool.mapInArrow(_sort_shards(length), ranges)
    prints = materialize(bodies.join(hot, "mh", "left_semi").mapInArrow(_fingerprints(length), "w1 long, w2 long, mh long, sh long, i int"), "fingerprints")
    again = prints.groupBy("w1", "w2").count().where("count > 1").drop("count")
    counted = prints.join(again, ["w1", "w2"]).groupBy("mh", "sh").agg(F.transform(F.sort_array(F.collect_set("i")), lambda i: F.struct(i.alias("a"), (i + 1).alias("z"))).alias("ranges"))  # a run's windows

    whole = classes.where("c > 1").select("mh", "sh", F.array(F.struct(F.lit(0).alias("a"), F.col("one.n").alias("z"))).alias("ranges"))
    partly = sorted_.union(counted).join(whole.select("mh", "sh"), ["mh", "sh"], "left_anti")
    hits = shared.join(materialize(whole.union(partly), "repeated-runs"), ["mh", "sh"])
    upto = F.col("at") + F.col("r.z") + (F.col("times") - 1) * F.col("n")  # a run that follows itself is repeated as a whole
    placed = hits.select("doc_id", "th", "at", "n", "times", F.explode("ranges").alias("r")).select("doc_id", "th", F.struct((F.col("at") + F.col("r.a")).alias("a"), upto.alias("z")).alias("r"))
    return placed.groupBy("doc_id", "th").agg(F.collect_set("r").alias("found"))  # one document's runs


def remove_bytes(data: bytes, found: list, length: int) -> tuple[bytes, int]:
    """What stays without the bytes of the windows found, and the number of maximal removed runs."""
    spans: list[list[int]] = []
    for a, z in sorted((r["a"], r["z"] + length - 1) for r in found or ()):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], z)
        else:
            spans.append([a, z])
    kept, at = [], 0
    for a, z in spans:
        kept.append(data[at:a])
        at = z
    return b"".join([*kept, data[at:]]), len(spans)


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, f in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                data = (t or "").encode()
                kept, spans = remove_bytes(data, f, length)
                rows.append((len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "th", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 200) -> DataFrame:
    """One row for each row of docs: doc_id, th, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes).

    Every byte inside a string of `length` bytes that also starts anywhere else, in the same or another document, goes; null and
    empty texts and texts shorter than `length` lose nothing. Rows that repeat are separate documents, so all their
    repeated bytes go. A null doc_id is an id like others. Texts of any length are taken whole, a megabyte at a time. Other columns
    play no part, whatever their names. kept is binary: a cut may fall inside a character. An empty input gives an empty result.
    """
    found = repeated_windows(docs, text, length).withColumnsRenamed({"doc_id": "fd", "th": "ft"}).hint("shuffle_hash")
    source = docs.select("doc_id", text_hash(F.col(text)).alias("th"), F.col(text).alias("t"))
    joined = source.join(found, source["doc_id"].eqNullSafe(found["fd"]) & source["th"].eqNullSafe(found["ft"]), "left").select("doc_id", "th", "t", "found")
    return joined.mapInArrow(_removed(length), "doc_id long, th long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

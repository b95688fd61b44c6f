"""Near-duplicate documents: min-max hashing, banding, links confirmed on full shingle sets, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import discard, materialize, text_hash

PERMUTATIONS = 90
MISS = 1e-6
#: Bytes of shingle hashes that one task compares at a time; larger groups are dealt in blocks of about this size.
BLOCK_BYTES = 1 << 22
#: Bytes of shingle hashes in a batch that leaves a task.
BATCH_BYTES = 1 << 23
_NODE = "struct<d:bigint,h:bigint>"
_SPACES = (9, 10, 11, 12, 13, 32)


def banding(similarity: float, permutations: int = PERMUTATIONS) -> tuple[int, int]:
    """(bands, rows): the longest rows for which a pair of this similarity misses all bands with a chance under MISS.

    A permutation gives two values, its minimum and its maximum.
    """
    values = 2 * permutations
    fits = [r for r in range(1, 33) if (1 - similarity**r) ** (values // r) < MISS]
    rows = max(fits, default=1)
    return values // rows, rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct 64-bit hashes of the word shingles of a text; words are runs other than ASCII white space, A-Z lower-cased."""

    def __init__(self, words: int):
        self.words = words
        rng = np.random.default_rng(20240607)
        value = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for c in range(65, 91):
            value[c] = value[c + 32]
        value[list(_SPACES)] = 0
        self.value, self.space = value, np.isin(np.arange(256), _SPACES)
        self.base, self.inverse = 0x9E3779B97F4A7C15 | 5, pow(0x9E3779B97F4A7C15 | 5, -1, 2**64)
        self.power = self.back = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.power):
            n = max(1 << 16, 1 << n.bit_length())
            for name, base in (("power", self.base), ("back", self.inverse)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def hashes(self, text: str | None) -> np.ndarray:
        b = np.frombuffer((text or "").encode(), np.uint8)
        if not len(b):
            return np.zeros(0, np.uint64)
        gap = np.concatenate([[True], self.space[b], [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return np.zeros(0, np.uint64)
        self._powers(len(b))
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.value[b] * self.power[: len(b)], dtype=np.uint64)])
        w = _mix((s[ends] - s[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))
        k = min(self.words, len(w))
        h = np.full(len(w) - k + 1, k, np.uint64)
        for i in range(k):
            h = h * np.uint64(0xD6E8FEB86659FD93) + w[i : len(w) - k + 1 + i]
        return np.unique(_mix(h))


def band_signer(bands: int, rows: int):
    """A function from a set of hashes to its band hashes."""
    rng = np.random.default_rng(77)
    factor = rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
    band_factor = rng.integers(0, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    band_salt = rng.integers(0, 2**63, bands, dtype=np.uint64)

    def sign(h: np.ndarray) -> np.ndarray:
        low = np.full(PERMUTATIONS, 2**64 - 1, np.uint64)
        high = np.zeros(PERMUTATIONS, np.uint64)
        for i in range(0, len(h), 2048):
            x = h[i : i + 2048][None, :] * factor
            low, high = np.minimum(low, x.min(1)), np.maximum(high, x.max(1))
        values = np.concatenate([low, high])[: bands * rows].reshape(bands, rows)
        return _mix((_mix(values) * band_factor).sum(1, dtype=np.uint64) + band_salt)

    return sign


def _signer(words: int, bands: int, rows: int):
    shingler, sign = Shingler(words), band_signer(bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, f1, f2, bs = [], [], [], []
            for t in b.column(2).to_pylist():
                h = shingler.hashes(t)
                n.append(len(h))
                f1.append(int(h.sum(dtype=np.uint64).astype(np.int64)) if len(h) else 0)
                f2.append(int((_mix(h + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)).astype(np.int64)) if len(h) else 0)
                bs.append(sign(h).view(np.int64) if len(h) else np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in bs])]).astype(np.int32)
            flat = np.concatenate(bs) if bs else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "th", "n", "f1", "f2", "bands"])

    return run


def signatures(docs: DataFrame, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, th, n, f1, f2, bands): set size, 128-bit fingerprint of the shingle set, band hashes (none for empty sets)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col(text)).alias("th"), F.col(text).alias("t"))
    return source.mapInArrow(_signer(words, bands, rows), "doc_id long, th long, n long, f1 long, f2 long, bands array<long>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    g, a, b, role, root, d, h, sets = zip(*rows, strict=True)
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
    longs = [pa.array(c, pa.int64()) for c in (g, a, b, role, root, d, h)]
    return pa.RecordBatch.from_arrays([*longs, hashes], _DEALT)


_DEALT = ["g", "a", "b", "role", "root", "d", "h", "hashes"]
_DEAL = "struct<g:bigint,a:bigint,b:bigint,role:bigint,root:bigint>"


def _to_sets(words: int):
    """Rows (d, h, text, deals) to one row for each deal, with the text's shingle hashes. Rows that repeat in a task count once."""
    shingler = Shingler(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows, size = set(), [], 0
        for batch in batches:
            for d, h, t, deals in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                node = (d, h)
                if node in seen:
                    continue
                seen.add(node)
                hashes = shingler.hashes(t.as_py()).view(np.int64)
                for x in deals.as_py():
                    rows.append((x["g"], x["a"], x["b"], x["role"], x["root"], *node, hashes))
                    size += hashes.nbytes
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    return run


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]


def _ranges(begin: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one range after the other."""
    stop = np.cumsum(width)
    return np.arange(stop[-1]) + np.repeat(begin - (stop - width), width)


def merge_labels(sets: list[np.ndarray], labels: np.ndarray, pivots: np.ndarray, percent: int, main: int | None = None) -> np.ndarray:
    """Labels after merging those of all linked pairs that have a pivot in them and start with different labels.

    A pivot is compared with the members of other labels that hold one of its rarest elements: whoever shares percent of
    its union shares one of the |pivot| - ceil(percent * |pivot|) + 1 rarest. Pivots closest to the common
    elements come first. Members of the label `main` need not be pivots, since each link out of it has a pivot at its other end;
    without a given one it is the most frequent label, so comparing ends when all others have been pivots.
    """
    labels, m = labels.copy(), len(sets)
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), size)
    _, element, count = np.unique(flat, return_inverse=True, return_counts=True)
    rarity = np.empty(len(count), np.int64)
    rarity[np.argsort(count, kind="stable")] = np.arange(len(count))
    order = np.lexsort((rarity[element], owner))
    element = element[order]  # each set's elements, the rarest first
    begin = np.concatenate([[0], np.cumsum(size)])
    holders = owner[np.argsort(element, kind="stable")]  # element by element
    first = np.concatenate([[0], np.cumsum(count)])
    common = np.add.reduceat(count[element], begin[:-1]) / size
    mark = np.zeros(len(count), bool)
    left = pivots.copy()
    queue = np.argsort(-common, kind="stable")
    while True:
        most = main if main is not None else np.bincount(labels).argmax()
        queue = queue[left[queue]]
        outside = labels[queue] != most
        if not outside.any():
            return labels
        p = queue[outside.argmax()]
        left[p] = False
        own = element[begin[p] : begin[p + 1]]
        rare = own[: len(own) - -(-percent * len(own) // 100) + 1]
        rare = rare[count[rare] > 1]
        if not len(rare):
            continue
        near = np.zeros(m, bool)
        near[holders[_ranges(first[rare], count[rare])]] = True
        low, high = np.minimum(size, len(own)), np.maximum(size, len(own))
        near = np.flatnonzero(near & (labels != labels[p]) & (100 * low >= percent * high))
        if not len(near):
            continue
        mark[own] = True
        width = size[near]
        both = np.add.reduceat(mark[element[_ranges(begin[near], width)]].astype(np.int64), np.cumsum(width) - width)
        mark[own] = False
        linked = near[100 * both >= percent * (len(own) + width - both)]
        if len(linked):
            joined = np.isin(labels, np.append(labels[linked], labels[p]))
            labels[joined] = main if main is not None and (labels[joined] == main).any() else labels[joined].min()


def _link_groups(percent: int):
    """Over rows sorted by (g, a, b): links (a, b) that join the members of each such group as its confirmed pairs do, fewer than members."""

    def solve(rows: list[tuple]) -> list[tuple]:
        nodes, sets = [(r[1], r[2]) for r in rows], [r[3] for r in rows]
        if len(rows) == 2 and rows[0][5] != rows[1][5]:
            both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            return [(*nodes[0], *nodes[1])] if 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both) else []
        _, start = np.unique(np.array([r[5] for r in rows]), return_inverse=True)
        role = np.array([r[4] for r in rows])
        if role.any():  # outsiders (1) meet a block of the main component (2) and outsiders (3)
            labels = merge_labels(sets, start, role == 1, percent, int(start[role == 2].max(initial=-1)))
        else:
            labels = merge_labels(sets, start, role == 0, percent)
        out, head, known = [], {}, set()
        for i in range(len(rows)):
            if labels[i] in head and (labels[i], start[i]) not in known:
                out.append((*head[labels[i]], *nodes[i]))
            head.setdefault(labels[i], nodes[i])
            known.add((labels[i], start[i]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple] = []

        def flush() -> pa.RecordBatch:
            a, b, c, d = (pa.array(x, pa.int64()) for x in (zip(*links, strict=True) if links else [[]] * 4))
            links.clear()
            return pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([a, b], ["d", "h"]), pa.StructArray.from_arrays([c, d], ["d", "h"])], ["a", "b"])

        key, rows = None, []
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            for g, a, b, role, root, d, h, x in zip(*cols, _lists(batch.column(7)), strict=True):
                if (g, a, b) != key:
                    links += solve(rows) if len(rows) > 1 else []
                    key, rows = (g, a, b), []
                rows.append((key, int(d), int(h), x.copy(), role, root))
            if len(links) >= 10_000:
                yield flush()
        links += solve(rows) if len(rows) > 1 else []
        yield flush()

    return run


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """(node, t) of the rows with a doc_id."""
    return docs.where(F.col("doc_id").isNotNull()).select(_node(F.col("doc_id").cast("long"), text_hash(F.col(text))).alias("node"), F.col(text).alias("t"))


def _dealt(deals: DataFrame) -> DataFrame:
    return deals.groupBy("node").agg(F.collect_list(F.struct("g", "a", "b", "role", "root")).alias("deals"))  # a node's bands, and blocks of its groups


def _linked(found: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """Links found by dealing each node's set to the tasks (g, a, b) that its deals name; found: (node, t, deals)."""
    dealt = found.select("node.d", "node.h", "t", "deals").mapInArrow(_to_sets(words), "g long, a long, b long, role long, root long, d long, h long, hashes array<bigint>")
    dealt = dealt.repartition("g", "a", "b").sortWithinPartitions("g", "a", "b")
    return materialize(dealt.mapInArrow(_link_groups(percent), f"a {_NODE}, b {_NODE}"), name)


def _blocks(size: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(8 * size / BLOCK_BYTES).cast("long"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node reachable. Each round takes the neighbours' smallest
    label and then the label of that label, until nothing changes; rounds grow with the logarithm of the longest chain."""
    edges = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("m"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = materialize(step.join(up, "root").select("node", "was", F.least("root", "above").alias("root")), "labels")
        discard(labels)
        labels = step
        if step.where("root <> was").isEmpty():
            discard(edges)
            return labels.select("node", "root")


def _node(d: Column, h: Column) -> Column:
    return F.struct(d.alias("d"), h.alias("h"))


def near_duplicates(docs: DataFrame, text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, kept) for every row of docs; th = xxhash64(text) tells rows of one doc_id apart.

    Documents with equal shingle sets form a class, whose first document stands for it. Band hashes of min-max signatures put
    classes into buckets; the buckets whose first class is the same are one group. Each group's sets are dealt once to a task, which compares
    its members with those not yet in their component (an inverted index over rare elements finds them) and returns
    spanning links, fewer than members. A group over BLOCK_BYTES is dealt in blocks by hash, its first class to each, and
    what then is outside the group's most frequent component is dealt, in blocks again, to meet every block. So no link inside a
    bucket is lost, no task holds more than two blocks, and data sent grows with members, times the blocks of outsiders.
    A pair at the threshold shares no bucket with a chance under 1e-6.
    component_id is the smallest doc_id of the component, kept tells whether the row's doc_id is that one.

    Null and empty texts and texts without words have an empty set and are linked with nothing, as are rows with a null doc_id
    (component_id null, kept true). Rows that repeat share their verdict. Texts of any length are taken whole; other columns of docs
    play no part, whatever their names. An empty input gives an empty result.
    """
    bands, rows = banding(percent / 100)
    signed = materialize(signatures(docs, text, words, bands, rows), "signatures")
    linkable = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    this = _node(F.col("doc_id"), F.col("th"))
    classes = signed.where(linkable).groupBy("n", "f1", "f2").agg(F.min(this).alias("node"), F.min_by("bands", this).alias("bands"))
    classes = materialize(classes, "classes")

    cells = classes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = cells.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("centre")).where("size > 1").select("bucket", "centre")
    members = cells.join(shared, "bucket").select(F.xxhash64("centre").alias("g"), "node", "n", (F.col("node") == F.col("centre")).alias("first")).distinct()
    members = materialize(members, "groups")
    blocks = members.groupBy("g").agg(_blocks(F.sum("n")).alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks"))
    spots = F.when(F.col("first"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(own))
    zero = F.lit(0).cast("long")
    deals = members.join(blocks, "g").select("node", "g", zero.alias("a"), F.explode(spots).alias("b"), zero.alias("role"), F.xxhash64("node").alias("root"))
    # the texts meet the deals once: a second round of deals reads those of the groups' members alone, each once
    found = _texts(docs, text).join(_dealt(deals).hint("shuffle_hash"), "node").dropDuplicates(["node"])
    grouped = materialize(found, "grouped-texts")
    links = _linked(grouped, words, percent, "links")
    roots = components(links)

    large = materialize(blocks.where("blocks > 1"), "large-groups")
    if not large.isEmpty():
        inside = members.join(large, "g").join(roots, "node", "left").withColumn("root", F.xxhash64(F.coalesce("root", "node"))).select("g", "node", "n", "blocks", "root")
        inside = materialize(inside, "large-members")
        held = inside.groupBy("g", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
        most = held.groupBy("g").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("n").alias("all"), F.max_by("n", F.struct("c", "root")).alias("in_main"))
        most = most.where(F.col("all") > F.col("in_main")).select("g", "main", _blocks(F.col("all") - F.col("in_main")).alias("outside"))
        open_ = inside.join(most, "g")
        out = F.col("root") != F.col("main")
        spot = lambda n: F.pmod(F.xxhash64("node", F.lit(3)), F.col(n))
        every = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
        met = open_.select("node", "g", every("outside").alias("a"), spot("blocks").alias("b"), F.when(out, 3).otherwise(2).cast("long").alias("role"), "root")
        asking = open_.where(out).select("node", "g", spot("outside").alias("a"), every("blocks").alias("b"), F.lit(1).cast("long").alias("role"), "root")
        again = grouped.select("node", "t").join(_dealt(met.union(asking)).hint("shuffle_hash"), "node")
        links = links.union(_linked(again, words, percent, "links"))
        roots = components(links)
    discard(grouped)

    of_class = classes.join(roots, "node", "left").select("n", "f1", "f2", F.coalesce("root", "node")["d"].alias("component"))
    out = signed.drop("bands").join(of_class, ["n", "f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

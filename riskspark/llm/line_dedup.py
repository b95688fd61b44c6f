"""Line deduplication: range-partitioned line hashes, streamed in order, answered with keep bitmaps."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import materialize, text_hash

SPACE = b" \t\n\x0b\x0c\r"
_LINES = "h1 long, h2 long, doc_id long, th long, pos int"
_FOUND = "kind int, h1 long, h2 long, doc_id long, th long, pos int, n_docs long"


def line_key(line: bytes) -> bytes:
    """A line's key: stripped of ASCII white space, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, ids, ths, pos = [], [], [], []
            for d, t, th in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not t or len(t) < min_chars:
                    continue
                for i, line in enumerate(t.encode().split(b"\n")):
                    if len(line) >= min_chars and len(k := line_key(line)) >= min_chars and (k.isascii() or len(k.decode()) >= min_chars):
                        h.append(xxhash.xxh3_128_digest(k)), ids.append(d), ths.append(th), pos.append(i)
            w = np.frombuffer(b"".join(h), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(w[:, 0]), pa.array(w[:, 1]), pa.array(ids, pa.int64()), pa.array(ths, pa.int64()), pa.array(pos, pa.int32())], ["h1", "h2", "doc_id", "th", "pos"])

    return run


def _stream(min_docs: int):
    """Over one sorted partition. Rows out: 0 a line to drop, 1 the count and first document of a key that may go on
    in another partition, 2 a line of the partition's first or last key that can't be judged here.

    Only the rows of one unfinished key are held, and of those no more than the first min_docs documents'.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, docs, last_doc, held, opening = None, None, 0, None, [], True

        def out(kind: int, n: int, cols: list, counts: int = 0) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *cols, pa.array(np.full(n, counts, np.int64))], ["kind", "h1", "h2", "doc_id", "th", "pos", "n_docs"])

        def summary() -> pa.RecordBatch:
            return out(1, 1, [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([first], pa.int64()), pa.array([0], pa.int64()), pa.array([0], pa.int32())], docs)

        def judged(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            mask = [x != first for x in rows.column(2).to_pylist()]
            rows = rows.filter(pa.array(mask, pa.bool_()))
            if rows.num_rows:
                yield out(0, rows.num_rows, list(rows.columns))

        for b in batches:
            if not b.num_rows:
                continue
            h1, h2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            d = b.column(2).fill_null(-(2**63)).to_numpy()
            change = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            starts = np.concatenate([[0], change])
            ends = np.concatenate([change, [b.num_rows]])
            fresh = np.concatenate([[0], (d[1:] != d[:-1]).astype(np.int64)])
            inner = np.cumsum(fresh)
            n_docs = inner[ends - 1] - inner[starts] + 1
            # whole groups inside the batch count for something only with enough documents; the first and last group may go on
            look = np.flatnonzero((n_docs >= min_docs) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1))
            for g in look:
                a, z = int(starts[g]), int(ends[g])
                k = (int(h1[a]), int(h2[a]))
                rows = b.slice(a, z - a)
                if k != key:
                    if key is not None:
                        if opening:
                            yield summary()
                        opening = False
                    key, first, docs, last_doc, held = k, b.column(2)[a].as_py(), 0, None, []
                docs += int(n_docs[g]) - (docs > 0 and last_doc == d[a])
                last_doc = d[z - 1]
                if opening:
                    yield out(2, rows.num_rows, list(rows.columns))
                elif docs >= min_docs:
                    for x in [*held, rows]:
                        yield from judged(x)
                    held = []
                else:
                    held.append(rows)
        if key is not None:
            yield summary()
            for x in held:
                yield out(2, x.num_rows, list(x.columns))

    return run


def repeated_lines(docs: DataFrame, text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, th, pos) of every line to drop: its key has min_chars code points, is found in min_docs documents and
    another document with a larger doc_id holds it. Rows with equal doc_id are one document; a null doc_id is the smallest.

    Hashes (128 bits) are range-partitioned with document (largest first) and position as secondary keys. The range key holds
    the document too, so one line found everywhere spreads over many partitions. Each partition is streamed once; only its
    first and last key may reach beyond it, and these counts, two rows a partition, are summed and sent back.
    """
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t"), text_hash(F.col(text)).alias("th")).mapInArrow(_hash_lines(min_chars), _LINES)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last()]
    ranged = lines.repartitionByRange(n, *order).sortWithinPartitions(*order, "th", "pos")
    found = materialize(ranged.mapInArrow(_stream(min_docs), _FOUND), "line-dedup")
    edges = found.where("kind = 1").groupBy("h1", "h2").agg(F.sum("n_docs").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).drop("n")
    open_lines = found.where("kind = 2").drop("n_docs").join(F.broadcast(edges), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return found.where("kind = 0").select("doc_id", "th", "pos").union(open_lines.select("doc_id", "th", "pos"))


def _bitmaps(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps, dropped = [], []
            for n, p in zip(b.column(at).to_pylist(), b.column(at + 1).to_pylist(), strict=True):
                bits = np.ones(n, np.uint8)
                if p:
                    bits[p] = 0
                dropped.append(int(n - bits.sum()))
                maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*b.columns[: at + 1], pa.array(dropped, pa.int64()), pa.array(maps, pa.binary())], [*b.schema.names[: at + 1], "n_dropped", "keep_bitmap"])

    return run


def keep_bitmaps(docs: DataFrame, text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Add n_lines, n_dropped and keep_bitmap (zlib-compressed bits, one a line, 1: stays) to every document.

    Null and empty texts are one empty line, which stays. Repeated rows (same doc_id and text) get the same bitmap. An
    empty input gives an empty result. A null doc_id is the smallest. Texts of any length are split whole. Other columns stay; columns with
    the added names are replaced, `_ld_` is reserved.
    """
    docs = docs.drop("n_lines", "n_dropped", "keep_bitmap")
    drops = repeated_lines(docs, text, min_chars, min_docs).groupBy("doc_id", "th").agg(F.collect_set("pos").alias("_ld_pos"))  # at most a document's lines
    drops = drops.select(F.col("doc_id").alias("_ld_doc"), F.col("th").alias("_ld_th"), "_ld_pos").hint("shuffle_hash")
    body = F.coalesce(F.col(text), F.lit(""))
    joined = docs.withColumn("_ld_key", text_hash(F.col(text))).join(drops, F.col("doc_id").eqNullSafe(F.col("_ld_doc")) & F.col("_ld_key").eqNullSafe(F.col("_ld_th")), "left")
    kept = docs.columns
    joined = joined.select(*kept, (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"), "_ld_pos")
    return joined.mapInArrow(_bitmaps(len(kept)), joined.drop("_ld_pos").schema.add("n_dropped", "long").add("keep_bitmap", "binary"))


def apply_bitmap(text: str | None, bitmap: bytes) -> str:
    """The kept lines of a text, joined by newline."""
    lines = (text or "").split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines))
    return "\n".join(line for line, b in zip(lines, bits, strict=True) if b)

"""Media columns as Ogg: pages with checksums, lacing, multiplexed logical streams and granule positions.

The stored form holds 8-bit samples. Data packets are dealt in turn to `streams` logical streams; each stream opens
with a header packet on a page of its own (beginning of stream) and ends with the end-of-stream flag.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 8000
UNIT = 64
PACKET = 4096
PAGE_LACINGS = 255
REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
HEADER = "<5sBBIIQ"  # magic, stream, streams, rate, packet bytes, payload bytes
PAGE = "<4sBBqIIIB"  # capture pattern, version, flags, granule, serial, sequence, checksum, lacings
PAGE_SIZE = struct.calcsize(PAGE)
CONTINUED, BEGIN, END = 1, 2, 4


def checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, not reflected, from 0: the bit-reversed twin of zlib's."""
    r = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(r.to_bytes(4, "little").translate(REVERSED), "big")


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    blank = struct.pack(PAGE, b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing + body
    return blank[:22] + struct.pack("<I", checksum(blank)) + blank[26:]


def _pages(serial: int, packets: list[tuple[bytes, int]], first: int, page_lacings: int) -> list[tuple[int, bytes]]:
    """Pages of one stream as (order, bytes); packets come with the granule position at their end."""
    lacing, ends, body = bytearray(), [], b"".join(p for p, _ in packets)
    for data, granule in packets:
        lacing += b"\xff" * (len(data) // 255) + bytes([len(data) % 255])
        ends.append((len(lacing), granule))
    out, at, e = [], 0, 0
    for k in range(0, len(lacing), page_lacings):
        part = bytes(lacing[k : k + page_lacings])
        granule = -1
        while e < len(ends) and ends[e][0] <= k + len(part):
            granule, e = ends[e][1], e + 1
        flags = (CONTINUED if k and lacing[k - 1] == 255 else 0) | (END if k + page_lacings >= len(lacing) else 0)
        size = sum(part)
        out.append((granule, _page(flags, granule, serial, first + len(out), part, body[at : at + size])))
        at += size
    return out


def encode(payload: bytes, streams: int = 2, packet: int = PACKET, page_lacings: int = PAGE_LACINGS) -> bytes:
    """Payload of 8-bit samples to an Ogg file; equal payloads give equal files."""
    packets = [(payload[i : i + packet], min(i + packet, len(payload))) for i in range(0, len(payload), packet)]
    heads, rest = [], []
    for s in range(streams):
        own = packets[s::streams]
        head = struct.pack(HEADER, b"\x01PCM8", s, streams, RATE, packet, len(payload))
        heads.append(_page(BEGIN | (0 if own else END), 0, s + 1, 0, bytes([len(head)]), head))
        last = 0
        for granule, page in _pages(s + 1, own, 1, page_lacings):
            last = granule if granule >= 0 else last
            rest.append((last, s, len(rest), page))
    return b"".join([*heads, *(p for *_, p in sorted(rest, key=lambda x: x[:3]))])


def decode(media: bytes) -> dict:
    """Demultiplex an Ogg file: {payload, pages, packets, streams: {serial: {packets, seconds, times}}}.

    times has (start, end) of each data packet in samples: a page's granule position is the end of the last packet that it completes, and
    packets completed before on that page end one packet of each other stream before the next starts.
    Raises ValueError on a bad capture pattern, checksum, page sequence, lacing, stream header or granule positions that don't rise.
    """
    at, pages, found = 0, 0, {}
    while at < len(media):
        pattern, version, flags, granule, serial, sequence, crc, n = struct.unpack_from(PAGE, media, at) if at + PAGE_SIZE <= len(media) else (b"",) * 8
        if pattern != b"OggS" or version:
            raise ValueError(f"no page at byte {at}")
        lacing = media[at + PAGE_SIZE : at + PAGE_SIZE + n]
        body = at + PAGE_SIZE + n
        end = body + sum(lacing)
        if end > len(media) or checksum(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError(f"bad checksum at byte {at}")
        s = found.setdefault(serial, {"packets": [], "open": [], "next": 0, "granule": 0, "ended": False, "marks": []})
        if s["next"] != sequence or bool(flags & BEGIN) != (sequence == 0) or bool(flags & CONTINUED) != bool(s["open"]) or s["ended"]:
            raise ValueError(f"page {sequence} of stream {serial} out of order")
        s["next"] += 1
        for v in lacing:
            s["open"].append((body, body + v))
            body += v
            if v < 255:
                s["packets"].append(media[s["open"][0][0] : s["open"][-1][1]] if s["open"][-1][1] - s["open"][0][0] == sum(b - a for a, b in s["open"]) else b"".join(media[a:b] for a, b in s["open"]))
                s["open"] = []
        if granule >= 0:
            s["granule"] = granule
            s["marks"].append((len(s["packets"]) - 1, granule))
        s["ended"] = bool(flags & END)
        at, pages = end, pages + 1
    if any(s["open"] or not s["ended"] for s in found.values()):
        raise ValueError("a stream isn't complete")
    heads = {k: struct.unpack(HEADER, s["packets"][0]) for k, s in found.items()}
    dealt = {heads[k][1]: s["packets"][1:] for k, s in found.items()}
    count = max((len(x) for x in dealt.values()), default=0)
    payload = b"".join(dealt[s][i] for i in range(count) for s in sorted(dealt) if i < len(dealt[s]))
    if any(h[0] != b"\x01PCM8" or h[2] != len(found) or h[5] != len(payload) for h in heads.values()):
        raise ValueError("bad stream header")

    def times(s: dict, head: tuple) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for last, end in s["marks"]:
            page = []
            for k in range(last, len(out), -1):  # packet 0 is the header
                page.append((end - len(s["packets"][k]), end))
                end = page[-1][0] - (head[2] - 1) * head[4]
            if page and page[-1][0] < (out[-1][1] if out else 0):
                raise ValueError("granule positions don't rise")
            out += page[::-1]
        return out

    return {
        "payload": payload, "pages": pages, "packets": sum(map(len, dealt.values())),
        "streams": {k: {"packets": len(s["packets"]) - 1, "seconds": s["granule"] / heads[k][3], "times": times(s, heads[k])} for k, s in found.items()},
    }


def features(found: dict) -> str:
    """Duration and a checksum of all packets' times, from the granule positions; mean, root mean square and mean crossings of the samples."""
    x = np.frombuffer(found["payload"], np.uint8).astype(np.float64)
    mean, rms = (float(x.mean()), float(np.sqrt(np.mean(x * x)))) if len(x) else (0.0, 0.0)
    crossings = int(np.count_nonzero(np.diff(x > mean))) if len(x) else 0
    seconds = max((s["seconds"] for s in found["streams"].values()), default=0.0)
    stamps = zlib.crc32(repr([found["streams"][k]["times"] for k in sorted(found["streams"])]).encode())
    return f"streams={len(found['streams'])};pages={found['pages']};packets={found['packets']};seconds={seconds:.6f};stamps={stamps};mean={mean:.6f};rms={rms:.6f};crossings={crossings}"


def pad(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of UNIT."""
    return data + b"\0" * (-len(data) % UNIT if data else UNIT)


def text_to_media(docs: DataFrame, text: str = "text", media: str = "media", n_bytes: str = "n_bytes") -> DataFrame:
    """Add a media column (binary, Ogg) that holds the text's padded UTF-8 bytes, and the unpadded length.

    Null and empty texts are stored as UNIT zero bytes. All rows, repeated ones too, and other columns stay, null doc_ids as well; the text
    column does not, and columns with the added names are replaced. Texts of any length are stored whole. An empty input gives an empty result.
    Works row by row in Arrow batches: no shuffle, memory bounded by a batch.
    """
    kept = [c for c in docs.columns if c not in (text, media, n_bytes)]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [(t or "").encode() for t in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([len(x) for x in raw], pa.int64()), pa.array([encode(pad(x)) for x in raw], pa.binary())], [*kept, n_bytes, media])

    added = [T.StructField(n_bytes, T.LongType()), T.StructField(media, T.BinaryType())]
    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], *added]))


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """Read an Ogg column back: payload_bytes, payload_sha256, tail_crc32 (last UNIT bytes), media_bytes, media_sha256, feature, and
    timestamps, the (stream, packet, start, end) of every packet in seconds.

    A null media value gives nulls; a damaged one raises, naming the byte. The media column is dropped; other columns and all rows stay,
    repeated ones too; columns with the added names are replaced. An empty input gives an empty result.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "timestamps"]
    stamp = pa.struct([("stream", pa.int32()), ("packet", pa.int32()), ("start", pa.float64()), ("end", pa.float64())])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(stamp)]
    kept = [c for c in df.columns if c not in (media, *names)]
    source = df.select(*[F.col(f"`{c}`") for c in kept], media)

    def row(m: bytes | None) -> tuple:
        if m is None:
            return (None,) * 7
        found = decode(m)
        p = found["payload"]
        return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-UNIT:]), len(m), hashlib.sha256(m).hexdigest(), features(found), [{"stream": k, "packet": i, "start": a / RATE, "end": z / RATE} for k, s in sorted(found["streams"].items()) for i, (a, z) in enumerate(s["times"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*(row(m.as_py()) for m in b.column(len(kept))), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*kept, *names])

    added = ["bigint", "string", "bigint", "bigint", "string", "string", "array<struct<stream:int,packet:int,start:double,end:double>>"]
    types = T.StructType([T.StructField(n, T.DataType.fromDDL(k)) for n, k in zip(names, added, strict=True)])
    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], *types.fields]))

"""Ogg media columns: write, verify, reassemble, demultiplex, time.

The container (RFC 3533): a page has a 27-byte header, a table of lacing values
and a body.  Lacing values below 255 end a packet, so packets of any length are
put together again from the segments of one or more pages.  Each page carries the
serial number of its logical stream, a sequence number, a checksum, and the
granule position at the end of the last packet that ends on it.

Everything is row by row in one Arrow pass: no shuffle, and a task holds one
slice of texts and one file at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import integral
from .flat import buffer, slices

HEAD = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1

#: Of the stored texts: samples a second, samples in a packet, segments on a page, logical streams.
RATE, PACKET, SEGMENTS, STREAMS = 8000, 4800, 16, 2
UNIT = 192

#: Each byte with its bits in reverse.
_REVERSED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))


def checksum(page: bytes) -> int:
    """Ogg's CRC-32: polynomial 0x04C11DB7, not reflected, starting at 0 and not inverted.

    zlib has the reflected form of the same polynomial, so it sees bytes with their
    bits reversed, and the result is reversed back.
    """
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Page:
    at: int
    flags: int
    granule: int
    serial: int
    sequence: int
    lacing: bytes
    body: bytes
    valid: bool


@dataclass
class Packet:
    serial: int
    number: int
    granule: int  # NO_GRANULE where the page tells that of a later packet
    data: bytes


@dataclass
class Stream:
    serial: int
    codec: str = "unknown"
    rate: int = 0
    preskip: int = 0
    pages: int = 0
    packets: list[Packet] = field(default_factory=list)

    def seconds(self, granule: int) -> float | None:
        """The time of a granule position, None where the codec or position tells none."""
        if granule < 0 or not self.rate:
            return None
        return max(0, granule - self.preskip) / self.rate


def page(serial: int, sequence: int, granule: int, flags: int, lacing: bytes, body: bytes) -> bytes:
    head = HEAD.pack(b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    whole = head + body
    return whole[:22] + checksum(whole).to_bytes(4, "little") + whole[26:]


def write_stream(serial: int, packets: list[tuple[bytes, int]], most: int = SEGMENTS) -> list[tuple[int, bytes]]:
    """Pages of one logical stream as (granule for order, bytes).

    Each packet ends a page; one with more than `most` segments goes on over
    further pages, which carry no granule position until it ends.
    """
    out, sequence = [], 0
    for number, (data, granule) in enumerate(packets):
        sizes = bytes([255]) * (len(data) // 255) + bytes([len(data) % 255])
        at = 0
        for k in range(0, len(sizes), most):
            lacing = sizes[k : k + most]
            size = sum(lacing)
            ends = k + most >= len(sizes)
            flags = CONTINUED * (k > 0) | FIRST * (sequence == 0) | LAST * (ends and number == len(packets) - 1)
            out.append((granule, page(serial, sequence, granule if ends else NO_GRANULE, flags, lacing, data[at : at + size])))
            at += size
            sequence += 1
    return out


def pages(data: bytes) -> Iterator[Page]:
    """The pages of a file in order; bytes that belong to no page are passed over.

    valid tells whether the checksum holds.  After a bad page the search goes on
    behind its first byte, so damage costs the pages that it touches and no more.
    """
    at = data.find(b"OggS")
    while at >= 0:
        following = at + 4
        if at + 27 <= len(data):
            _, version, flags, granule, serial, sequence, crc, n = HEAD.unpack_from(data, at)
            lacing = data[at + 27 : at + 27 + n]
            end = at + 27 + n + sum(lacing)
            if version == 0 and len(lacing) == n and end <= len(data):
                whole = data[at:end]
                valid = checksum(whole[:22] + bytes(4) + whole[26:]) == crc
                yield Page(at, flags, granule, serial, sequence, lacing, whole[27 + n :], valid)
                if valid:
                    following = end
        at = data.find(b"OggS", following)


def _codec(stream: Stream, first: bytes) -> None:
    """Codec and granule rate from a stream's first packet (fixed signatures)."""
    if first[:8] == b"PCM     " and len(first) >= 20:
        stream.codec, stream.rate = "pcm", int.from_bytes(first[16:20], "big")
    elif first[:8] == b"OpusHead" and len(first) >= 19:
        stream.codec, stream.rate, stream.preskip = "opus", 48000, int.from_bytes(first[10:12], "little")
    elif first[:7] == b"\x01vorbis" and len(first) >= 16:
        stream.codec, stream.rate = "vorbis", int.from_bytes(first[12:16], "little")
    elif first[:5] == b"\x7fFLAC" and len(first) >= 30:
        stream.codec, stream.rate = "flac", int.from_bytes(first[27:30], "big") >> 4
    elif first[:8] == b"Speex   " and len(first) >= 40:
        stream.codec, stream.rate = "speex", int.from_bytes(first[36:40], "little")


def demultiplex(data: bytes) -> tuple[dict[int, Stream], int, int]:
    """Logical streams by serial number; the number of pages, and of bad ones.

    A gap in a stream's sequence numbers drops the packet that was open there and
    the rest of it that a later page continues.
    """
    streams: dict[int, Stream] = {}
    open_: dict[int, tuple[list[bytes], int]] = {}
    total = bad = 0
    for p in pages(data):
        if not p.valid:
            bad += 1
            continue
        total += 1
        stream = streams.setdefault(p.serial, Stream(p.serial))
        parts, expected = open_.get(p.serial, ([], p.sequence if p.flags & FIRST else -1))
        stream.pages += 1
        skip = False
        if p.sequence != expected or not p.flags & CONTINUED:
            skip = bool(p.flags & CONTINUED)
            parts = []
        elif not parts:
            skip = True
        at, start, ended = 0, 0, []
        for size in p.lacing:
            at += size
            if size < 255:
                ended.append((start, at))
                start = at
        for k, (a, b) in enumerate(ended):
            if k == 0 and skip:
                continue
            whole = b"".join([*parts, p.body[a:b]])
            parts = []
            if not stream.packets:
                _codec(stream, whole)
            stream.packets.append(Packet(p.serial, len(stream.packets), p.granule if k == len(ended) - 1 else NO_GRANULE, whole))
        if start < at and not (skip and not ended):
            parts = [*parts, p.body[start:at]]
        open_[p.serial] = (parts, p.sequence + 1)
    return streams, total, bad


def header(rate: int = RATE, packet: int = PACKET) -> bytes:
    """First packet of a stream of unsigned 8-bit samples, one channel."""
    return b"PCM     " + struct.pack(">HHIIBBHI", 0, 0, 1, rate, 8, 1, packet, 0)


def store(payload: bytes, rate: int = RATE, packet: int = PACKET, streams: int = STREAMS) -> bytes:
    """The payload as 8-bit samples, its packets dealt to logical streams in turn.

    The granule position of a packet is that of its last sample in the whole, so
    the streams can be put together again by time alone.
    """
    dealt: list[list[tuple[bytes, int]]] = [[(header(rate, packet), 0)] for _ in range(streams)]
    for k, at in enumerate(range(0, len(payload), packet)):
        piece = payload[at : at + packet]
        dealt[k % streams].append((piece, at + len(piece)))
    out = [(granule, serial, k, data) for serial, own in enumerate(dealt, 1) for k, (granule, data) in enumerate(write_stream(serial, own))]
    return b"".join(x[-1] for x in sorted(out, key=lambda x: x[:3]))


def read(media: bytes) -> tuple[bytes, dict[int, Stream], int]:
    """What store() wrote: the payload, the streams, the number of pages."""
    streams, total, bad = demultiplex(media)
    if bad:
        raise ValueError(f"{bad} pages fail their checksum")
    own = sorted((p.granule, p.data) for s in streams.values() for p in s.packets[1:])
    return b"".join(x[1] for x in own), streams, total


def padded(text: bytes, unit: int = UNIT) -> bytes:
    """The bytes with spaces up to a positive multiple of unit."""
    return text.ljust(max(unit, -(-len(text) // unit) * unit), b" ")


def feature(payload: bytes, streams: dict[int, Stream], total: int) -> str:
    """Streams, pages, packets, last time in ms, and mean, deviation, peak and zero crossings of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    last = max((s.seconds(p.granule) or 0.0 for s in streams.values() for p in s.packets), default=0.0)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"streams={len(streams)};pages={total};packets={sum(len(s.packets) for s in streams.values())};ms={last * 1000:.0f};mean={x.mean():.3f};std={x.std():.3f};peak={int(np.abs(x).max())};crossings={crossings}"


def op4(docs: DataFrame) -> DataFrame:
    """The contract's result for every document: stored as Ogg, read back, measured.

    Null and empty texts are stored as 192 spaces; equal texts give equal values.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, off = buffer(batch["text"])
            whole = data.tobytes()
            rows = []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                media = store(padded(whole[a:b]))
                payload, streams, total = read(media)
                rows.append((b - a, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, streams, total)))
            cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    return integral(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def packets(media: DataFrame, key: str, column: str) -> DataFrame:
    """Rows (key, serial, codec, number, granule, seconds, bytes) of the packets of Ogg files in a binary column.

    Null and empty files, and files without a valid page, have no rows.
    """
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                streams, _, _ = demultiplex(batch[column][i].as_py() or b"")
                rows = [(s.serial, s.codec, p.number, p.granule, s.seconds(p.granule), p.data) for s in streams.values() for p in s.packets]
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch[key].slice(i, 1)] * len(rows)), *cols], [key, "serial", "codec", "number", "granule", "seconds", "data"])

    return media.select(key, column).mapInArrow(run, f"`{key}` {kind}, serial long, codec string, number long, granule long, seconds double, data binary")

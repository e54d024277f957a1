"""Media columns: payloads in Ogg, multiplexed with an index stream, and read back.

The writer stores a payload as 8-bit samples in one logical stream and a small
index (sample rate, payload length) in a second one. The reader trusts nothing:
it verifies the checksum of each page, rebuilds packets from lacing values across
pages, demultiplexes by serial number and turns granule positions into time.
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

from mnemograph.llm.common import col

#: Fixed values of the Ogg page format.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
MAX_SEGMENTS = 255
NO_GRANULE = -1
HEADER = struct.Struct("<4sBBqIIIB")

#: Our two streams: the samples and their index.
SAMPLES_SERIAL, INDEX_SERIAL = 1, 2
SAMPLES_MAGIC, INDEX_MAGIC = b"\x01pcm8\0\0\0", b"\x01index\0\0"
RATE = 8000
PACKET_SAMPLES = 4096
PAD = 64

_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 of a page: polynomial 0x04C11DB7, most significant bit first, start 0, no final inversion.

    It is the bit mirror of the common reflected CRC over mirrored bytes, which
    zlib computes natively.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = page_checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def stream_pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """Pages of one logical stream; ``packets`` are (bytes, granule position at its end).

    The first packet has the first page for itself. A page's granule position is
    that of the last packet that ends on it, or -1 if none does.
    """
    pages: list[bytes] = []
    lacing, body, granule, continued = bytearray(), bytearray(), NO_GRANULE, False

    def flush(last: bool, still_open: bool) -> None:
        nonlocal lacing, body, granule, continued
        flags = CONTINUED * continued | FIRST * (not pages) | LAST * last
        pages.append(_page(flags, granule, serial, len(pages), bytes(lacing), bytes(body)))
        lacing, body, granule, continued = bytearray(), bytearray(), NO_GRANULE, still_open

    for k, (packet, end) in enumerate(packets):
        at, final = 0, False
        while not final:
            if len(lacing) == MAX_SEGMENTS:
                flush(False, at > 0)
            piece = packet[at : at + 255]
            final = len(piece) < 255
            lacing.append(len(piece))
            body += piece
            at += len(piece)
        granule = end
        if k == 0 or k == len(packets) - 1:
            flush(k == len(packets) - 1, False)
    return pages


def write_ogg(payload: bytes, n_bytes: int, rate: int = RATE) -> bytes:
    """The stored form of a payload: samples and index, their pages interleaved, first pages first."""
    n = len(payload)
    packets = [(SAMPLES_MAGIC + struct.pack("<IQ", rate, n), 0)]
    packets += [(payload[i : i + PACKET_SAMPLES], min(n, i + PACKET_SAMPLES)) for i in range(0, n, PACKET_SAMPLES)]
    index = [(INDEX_MAGIC + struct.pack("<I", rate), 0), (struct.pack("<QQ", n_bytes, n), n)]
    samples, index_pages = stream_pages(SAMPLES_SERIAL, packets), stream_pages(INDEX_SERIAL, index)
    return b"".join([samples[0], index_pages[0], *samples[1:], *index_pages[1:]])


class OggError(ValueError):
    """The bytes are not a sound Ogg file."""


@dataclass
class Stream:
    """One logical stream as read."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    #: (granule position, packets that had ended by then), one for each page on which a packet ends.
    marks: list[tuple[int, int]] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    partial: bytearray | None = None

    def times(self, rate: int) -> list[float]:
        """Seconds at each mark."""
        return [g / rate for g, _ in self.marks]


def read_ogg(data: bytes) -> dict[int, Stream]:
    """The logical streams by serial number; raises :class:`OggError` on any fault."""
    streams: dict[int, Stream] = {}
    at, size = 0, len(data)
    while at < size:
        if size - at < HEADER.size:
            raise OggError(f"truncated page header at {at}")
        magic, version, flags, granule, serial, number, crc, segments = HEADER.unpack_from(data, at)
        if magic != CAPTURE or version != 0:
            raise OggError(f"no page at {at}")
        start = at + HEADER.size + segments
        lacing = data[at + HEADER.size : start]
        end = start + sum(lacing)
        if len(lacing) < segments or end > size:
            raise OggError(f"truncated page at {at}")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum at {at}")
        stream = streams.get(serial)
        if bool(flags & FIRST) != (stream is None):
            raise OggError(f"stream {serial} begins wrongly at {at}")
        if stream is None:
            stream = streams[serial] = Stream(serial)
        if stream.ended or number != stream.pages:
            raise OggError(f"page {number} of stream {serial} is out of order")
        if bool(flags & CONTINUED) != (stream.partial is not None):
            raise OggError(f"a packet of stream {serial} is broken at {at}")
        stream.pages += 1
        stream.ended = bool(flags & LAST)
        open_packet, done = stream.partial, 0
        for length in lacing:
            open_packet = bytearray() if open_packet is None else open_packet
            open_packet += data[start : start + length]
            start += length
            if length < 255:
                stream.packets.append(bytes(open_packet))
                open_packet, done = None, done + 1
        stream.partial = open_packet
        if bool(done) != (granule != NO_GRANULE):
            raise OggError(f"granule position of stream {serial} is wrong at {at}")
        if done:
            if stream.marks and granule < stream.marks[-1][0]:
                raise OggError(f"time runs back in stream {serial}")
            stream.marks.append((granule, len(stream.packets)))
        at = end
    for stream in streams.values():
        if not stream.ended or stream.partial is not None:
            raise OggError(f"stream {stream.serial} has no end")
    return streams


def read_samples(data: bytes) -> tuple[bytes, int, str]:
    """(payload, its length before padding, feature) of a stored form of :func:`write_ogg`.

    The feature is ``key=value`` pairs joined by semicolons: streams, pages and
    packets in all, milliseconds by the last granule position, then mean,
    standard deviation and root-mean-square step of the samples around 128,
    and the milliseconds of the loudest packet's end.
    """
    streams = read_ogg(data)
    if set(streams) != {SAMPLES_SERIAL, INDEX_SERIAL}:
        raise OggError("not the streams of a stored payload")
    samples, index = streams[SAMPLES_SERIAL], streams[INDEX_SERIAL]
    head, packets = samples.packets[0], samples.packets[1:]
    if head[:8] != SAMPLES_MAGIC or index.packets[0][:8] != INDEX_MAGIC:
        raise OggError("unknown stream kind")
    rate, n = struct.unpack("<IQ", head[8:])
    n_bytes, indexed = struct.unpack("<QQ", index.packets[1])
    payload = b"".join(packets)
    if not len(payload) == n == indexed == samples.marks[-1][0]:
        raise OggError("sample counts disagree")
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    loud = [int(v @ v) / len(v) for v in (np.frombuffer(p, np.uint8).astype(np.int64) - 128 for p in packets)]
    loudest = min(n, (max(range(len(loud)), key=loud.__getitem__) + 1) * len(packets[0]))
    step = np.diff(x)
    values = {
        "streams": len(streams),
        "pages": samples.pages + index.pages,
        "packets": len(samples.packets) + len(index.packets),
        "ms": f"{samples.times(rate)[-1] * 1000:.3f}",
        "mean": f"{x.sum() / n:.4f}",
        "std": f"{max(0.0, float(x @ x) / n - (x.sum() / n) ** 2) ** 0.5:.4f}",
        "step": f"{(float(step @ step) / max(1, n - 1)) ** 0.5:.4f}",
        "loudest_ms": f"{loudest / rate * 1000:.3f}",
    }
    return payload, n_bytes, ";".join(f"{k}={v}" for k, v in values.items())


def _rows(values: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    for v in values.to_pylist():
        yield b"" if v is None else v


#: About this many bytes of payload leave a task at once.
BATCH_BYTES = 16 << 20


def _in_batches(rows: Iterator[dict], schema: pa.Schema, weight: str) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or b"")
        if size >= BATCH_BYTES or len(held) >= 10_000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def to_media(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, media binary): each text as UTF-8, zero-padded to a positive multiple of 64, stored as Ogg.

    Defined cases: a null text counts as empty (64 zero bytes); equal texts give
    equal bytes; repeated rows and null keys pass through; other columns are not
    read; an empty table gives an empty table.
    """
    source = docs.select(col(key).alias("key"), col(text).cast("binary").alias("raw"))
    kind = source.schema["key"].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for k, raw in zip(batch["key"].to_pylist(), _rows(batch["raw"]), strict=True):
                    padded = raw + bytes(-len(raw) % PAD or (0 if raw else PAD))
                    yield {"key": k, "media": write_ogg(padded, len(raw))}

        return _in_batches(rows(), schema, "media")

    schema = pa.schema([("key", _arrow(kind)), ("media", pa.binary())])
    return source.mapInArrow(store, f"key {kind}, media binary").withColumnRenamed("key", key)


def read_media(media: DataFrame, key: str, stored: str = "media") -> DataFrame:
    """Read stored forms back: (key, n_bytes, payload, feature); a fault in the bytes fails the task.

    A null stored form is a fault as well: :func:`to_media` never makes one.
    """
    source = media.select(col(key).alias("key"), col(stored).alias("media"))
    kind = source.schema["key"].dataType.simpleString()

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for k, data in zip(batch["key"].to_pylist(), _rows(batch["media"]), strict=True):
                    payload, n_bytes, feature = read_samples(data)
                    yield {
                        "key": k,
                        "n_bytes": n_bytes,
                        "payload_bytes": len(payload),
                        "payload_sha256": hashlib.sha256(payload).hexdigest(),
                        "tail_crc32": zlib.crc32(payload[-PAD:]),
                        "media_bytes": len(data),
                        "media_sha256": hashlib.sha256(data).hexdigest(),
                        "feature": feature,
                    }

        return _in_batches(rows(), schema, "feature")

    fields = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([("key", _arrow(kind)), *((n, kinds[t]) for n, t in (f.split() for f in fields.split(", ")))])
    return source.mapInArrow(load, f"key {kind}, {fields}").withColumnRenamed("key", key)


def _arrow(kind: str) -> pa.DataType:
    """The Arrow type of a key column."""
    known = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "smallint": pa.int16()}
    if kind not in known:
        raise TypeError(f"a key of type {kind} is not supported; cast it to bigint or string")
    return known[kind]

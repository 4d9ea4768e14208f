"""Media columns: Ogg containers read and written in Arrow batches.

Reading verifies every page's checksum, reassembles packets from the lacing values
(over page borders too), demultiplexes logical streams by serial number and derives
each packet's time from the granule positions. A page that fails its checksum, or is
cut short, is skipped and reading goes on at the next capture pattern; a packet that
loses a part is dropped and counted, never glued.

Defined results: null media have no streams; null and empty texts are stored as 64
zero bytes; equal inputs give equal bytes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import slices, table, whole_text

CONTINUED, FIRST, LAST = 1, 2, 4
HEAD = struct.Struct("<4sBBqIIIB")
#: First packet of a track of 8-bit samples: mark, track, tracks, samples a second, samples.
TRACK = struct.Struct("<8sBBIQ")
MARK = b"pcm8\0\0\0\1"
BLOCK, PACKET, RATE, TRACKS = 64, 4096, 8000, 2
MIRRORED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """The container's CRC (polynomial 0x04C11DB7, most significant bit first, from 0,
    the checksum field as 0). It is zlib's on mirrored bytes, without its inversions."""
    low_first = zlib.crc32(page.translate(MIRRORED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low_first.to_bytes(4, "little").translate(MIRRORED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    page = HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return page[:22] + page_crc(page).to_bytes(4, "little") + page[26:]


def paginate(serial: int, packets: list[tuple[bytes, int]]) -> Iterator[tuple[int, bytes]]:
    """Pages of one logical stream as (granule position so far, page). packets: data and
    granule position at its end. The first packet has a page of its own."""
    lacing, body, flags, done, number, reached = bytearray(), bytearray(), FIRST, -1, 0, 0
    for k, (data, granule) in enumerate(packets):
        segments = bytes([255]) * (len(data) // 255) + bytes([len(data) % 255])
        at = 0
        while segments:
            room = 255 - len(lacing)
            now, segments = segments[:room], segments[room:]
            size = sum(now)
            lacing += now
            body += data[at : at + size]
            at += size
            if not segments:
                done = reached = granule
            final = not segments and k == len(packets) - 1
            if len(lacing) == 255 or final or k == 0:
                yield reached, _page(flags | LAST * final, done, serial, number, bytes(lacing), bytes(body))
                lacing, body, flags, done, number = bytearray(), bytearray(), CONTINUED * bool(segments), -1, number + 1
    if lacing:  # not reached: the last packet closes its page
        yield reached, _page(flags | LAST, done, serial, number, bytes(lacing), bytes(body))


def multiplex(streams: Iterable[list[tuple[int, bytes]]]) -> bytes:
    """All first pages, then the others in order of time; ties by stream."""
    streams = list(streams)
    rest = sorted((granule, k, i) for k, s in enumerate(streams) for i, (granule, _) in enumerate(s) if i)
    return b"".join([s[0][1] for s in streams] + [streams[k][i][1] for _, k, i in rest])


@dataclass
class Stream:
    """One logical stream as read: packets, and for each its end on the sample clock (-1: unknown)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    pages: int = 0
    lost: int = 0
    ended: bool = False
    _part: bytearray | None = None
    _next: int = 0

    def take(self, flags: int, granule: int, number: int, lacing: bytes, body: memoryview, length: Callable[[bytes], int]) -> None:
        gap = number != self._next
        if self._part is not None and (gap or not flags & CONTINUED):
            self.lost, self._part = self.lost + 1, None
        orphan = bool(flags & CONTINUED) and self._part is None
        self.pages, self._next, self.ended = self.pages + 1, number + 1, self.ended or bool(flags & LAST)
        at, start, first = 0, 0, len(self.packets)
        for size in lacing:
            at += size
            if size == 255:
                continue
            if orphan:
                orphan, self.lost = False, self.lost + 1
            else:
                self.packets.append(bytes(self._part or b"") + bytes(body[start:at]))
                self._part = None
            start = at
        if lacing and lacing[-1] == 255 and not orphan:
            self._part = (self._part or bytearray()) + bytes(body[start:at])
        # The position is that of the last packet that ends on the page; those before it end earlier by its length.
        ends, end = [], granule
        for data in reversed(self.packets[first:]):
            ends.append(end)
            end = end - length(data) if end >= 0 else -1
        self.ends += reversed(ends)


def pcm_length(packet: bytes) -> int:
    return 0 if packet.startswith(MARK) else len(packet)


def demultiplex(media: bytes, length: Callable[[bytes], int] = pcm_length) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and how many damaged pages were skipped.
    length: samples in a packet."""
    streams: dict[int, Stream] = {}
    view, at, bad = memoryview(media), 0, 0
    while (at := media.find(b"OggS", at)) >= 0:
        if at + HEAD.size > len(media):
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, segments = HEAD.unpack_from(media, at)
        lacing = media[at + HEAD.size : at + HEAD.size + segments]
        start = at + HEAD.size + segments
        stop = start + sum(lacing)
        page = media[at:stop]
        if version or len(lacing) < segments or stop > len(media) or page_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            bad, at = bad + 1, at + 4
            continue
        streams.setdefault(serial, Stream(serial)).take(flags, granule, number, lacing, view[start:stop], length)
        at = stop
    for s in streams.values():
        if s._part is not None:
            s.lost, s._part = s.lost + 1, None
    return streams, bad


def store(payload: bytes) -> bytes:
    """A payload (a positive multiple of 64 bytes) as two tracks of 8-bit samples:
    blocks of 64 go to the tracks in turn. Serial numbers derive from the content."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    seed, streams = zlib.crc32(payload), []
    for t in range(TRACKS):
        data = blocks[t::TRACKS].tobytes()
        packets = [(TRACK.pack(MARK, t, TRACKS, RATE, len(data)), 0)]
        packets += [(data[i : i + PACKET], min(i + PACKET, len(data))) for i in range(0, len(data), PACKET)]
        streams.append(list(paginate(seed + t & 0xFFFFFFFF, packets)))
    return multiplex(streams)


def restore(media: bytes) -> tuple[bytes, dict[str, int]]:
    """The payload read back, and what reading found. Raises ValueError if a part is missing."""
    streams, bad = demultiplex(media)
    tracks: dict[int, tuple[Stream, int, bytes]] = {}
    for s in streams.values():
        if s.packets and s.packets[0].startswith(MARK):
            _, t, _, _, samples = TRACK.unpack(s.packets[0])
            tracks[t] = s, samples, b"".join(s.packets[1:])
    if bad or sorted(tracks) != list(range(TRACKS)) or any(s.lost or not s.ended or len(d) != n for s, n, d in tracks.values()):
        raise ValueError("the stored media are damaged")
    for s, n, _ in tracks.values():
        steps = np.diff(np.array(s.ends))
        if s.ends[-1] != n or (steps != [len(p) for p in s.packets[1:]]).any():
            raise ValueError("the granule positions don't fit the packets")
    total = sum(n for _, n, _ in tracks.values())
    blocks = np.empty((total // BLOCK, BLOCK), np.uint8)
    for t in range(TRACKS):
        blocks[t::TRACKS] = np.frombuffer(tracks[t][2], np.uint8).reshape(-1, BLOCK)
    found = {
        "streams": len(streams),
        "pages": sum(s.pages for s in streams.values()),
        "packets": sum(len(s.packets) for s in streams.values()),
        "us": max(s.ends[-1] for s, _, _ in tracks.values()) * 1_000_000 // RATE,
    }
    return blocks.tobytes(), found


def features(payload: bytes) -> dict[str, int]:
    """Of unsigned 8-bit samples around 128: range, mean and power in thousandths, zero crossings, flattest and loudest block."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    loud = (x.reshape(-1, BLOCK) ** 2).sum(1)
    return {
        "n": len(x), "low": int(x.min()), "high": int(x.max()), "mean": int(x.sum() * 1000 // len(x)), "power": int((x**2).sum() * 1000 // len(x)),
        "crossings": int(((x[1:] < 0) != (x[:-1] < 0)).sum()), "quiet": int(loud.argmin()), "loud": int(loud.argmax()),
    }


def payload_of(text: bytes) -> bytes:
    """UTF-8 and zero bytes up to a positive multiple of 64."""
    return text + b"\0" * (-len(text) % BLOCK or (BLOCK if not text else 0))


def stored_texts(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), with_media: bool = False) -> DataFrame:
    """Store every text as Ogg, read it back and describe it. One pass, no shuffle.
    with_media adds the stored form (binary)."""
    kept = docs.select(*keys, F.encode(whole_text(), "UTF-8").alias("text"))
    fields = [kept.schema[k] for k in keys]
    schema = kept.select(
        *keys,
        *[F.lit(0).cast("long").alias(c) for c in ("n_bytes", "payload_bytes")], F.lit("").alias("payload_sha256"), F.lit(0).cast("long").alias("tail_crc32"),
        F.lit(0).cast("long").alias("media_bytes"), F.lit("").alias("media_sha256"), F.lit("").alias("feature"), *([F.col("text").alias("media")] if with_media else []),
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            rows = []
            for text in batch.column("text").to_pylist():
                media = store(payload_of(text))
                payload, found = restore(media)
                feature = ";".join(f"{k}={v}" for k, v in (found | features(payload)).items())
                row = len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature
                rows.append((*row, media) if with_media else row)
            columns = [batch.column(f.name) for f in fields] + [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return kept.mapInArrow(run, schema)


def logical_streams(df: DataFrame, media: str = "media", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per logical stream of a binary column: keys, serial, pages, packets,
    packet_bytes, lost_packets, ended, end_position (-1: unknown) and bad_pages of the
    whole. Null or unreadable media have no rows."""
    kept = df.select(*keys, F.col(media).alias("media"))
    fields = [kept.schema[k] for k in keys]
    schema = kept.select(*keys, *[F.lit(0).cast("long").alias(c) for c in ("serial", "pages", "packets", "packet_bytes", "lost_packets")], F.lit(True).alias("ended"), *[F.lit(0).cast("long").alias(c) for c in ("end_position", "bad_pages")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            of, rows = [], []
            for i, data in enumerate(batch.column("media").to_pylist()):
                streams, bad = demultiplex(data or b"")
                for s in streams.values():
                    of.append(i)
                    rows.append((s.serial, s.pages, len(s.packets), sum(map(len, s.packets)), s.lost, s.ended, s.ends[-1] if s.ends else -1, bad))
            if rows:
                columns = [batch.column(f.name).take(pa.array(of)) for f in fields] + [pa.array(c) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return kept.mapInArrow(run, schema)


def op4_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as Ogg, read back and described."""
    return stored_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op4_media_ogg": op4_media_ogg}
SQL: dict[str, str] = {}

"""Texts as sampled media in Ogg containers (operator 8).

A container holds two multiplexed logical streams. One carries the samples: a head packet, then
packets of 8-bit unsigned mono samples, whose granule position is the number of samples so far.
The other carries notes: a head packet and one packet of ``key=value`` lines that tells the true
length. Pages bear the checksum, sequence numbers and lacing values of the Ogg format (RFC 3533).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netloom.llm.text import by_batch

RATE = 8000
#: Samples of a packet, and packets of a page at most; a packet of 4,096 bytes takes 17 lacing values.
PACKET, PAGE_PACKETS = 4096, 15
_FIRST, _LAST, _CONTINUED = 2, 4, 1
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class BadMedia(ValueError):
    """Bytes that are no sound container."""


def checksum(data: bytes) -> int:
    """Ogg's checksum: polynomial 04c11db7, most significant bit first, from 0.

    zlib's has the same polynomial with all bits mirrored, so it runs on mirrored bytes.
    """
    x = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "little").translate(_REVERSED), "big")


def lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def page(serial: int, number: int, granule: int, flags: int, lace: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lace)) + lace
    crc = checksum(head + body)
    return head[:22] + struct.pack("<I", crc) + head[26:] + body


def write(samples: bytes, notes: dict[str, str], serial: int) -> bytes:
    """A container of these samples. Both streams' first pages come first, and the notes before the samples."""
    other = serial ^ 0x5EED
    text = "\n".join(f"{k}={v}" for k, v in sorted(notes.items())).encode()
    head = b"\x01pcm8" + struct.pack("<IBI", RATE, 1, PACKET)
    out = [page(serial, 0, 0, _FIRST, lacing(len(head)), head), page(other, 0, 0, _FIRST, lacing(6), b"\x01notes")]
    number, laces, at = 1, lacing(len(text)), 0
    while laces:  # a long packet goes on in further pages
        now, laces = laces[:255], laces[255:]
        body = text[at : at + sum(now)]
        ends = now[-1] < 255
        out.append(page(other, number, len(text) if ends else -1, _CONTINUED * (number > 1) | _LAST * (not laces), now, body))
        at, number = at + len(body), number + 1
    step = PACKET * PAGE_PACKETS
    for number, at in enumerate(range(0, max(len(samples), 1), step), 1):
        body = samples[at : at + step]
        lace = b"".join(lacing(len(body[k : k + PACKET])) for k in range(0, len(body), PACKET)) or b"\0"
        out.append(page(serial, number, at + len(body), _LAST * (at + step >= len(samples)), lace, body))
    return b"".join(out)


@dataclass
class Stream:
    """A logical stream: whole packets, and for those that end a page's timing (packets so far, granule position)."""

    packets: list[bytes] = field(default_factory=list)
    times: list[tuple[int, int]] = field(default_factory=list)
    part: bytes | None = None
    number: int = -1
    ended: bool = False


def demultiplex(data: bytes) -> dict[int, Stream]:
    """The logical streams of a container, by serial number in order of appearance.

    Every page must follow the one before it, bear a right checksum, and be the next of its stream;
    packets are put together from lacing values, over pages where they go on. Anything else raises
    ``BadMedia``, as do a stream without its first or last page and a packet without its end.
    """
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise BadMedia("a page head is cut off")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise BadMedia(f"no page at byte {at}")
        lace = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lace)
        if len(lace) < n or end > len(data):
            raise BadMedia("a page is cut off")
        whole = data[at:end]
        if checksum(whole[:22] + b"\0\0\0\0" + whole[26:]) != crc:
            raise BadMedia(f"the checksum of the page at byte {at} is wrong")
        s = streams.get(serial)
        if bool(flags & _FIRST) != (s is None):
            raise BadMedia("a stream must begin once, with its first page")
        s = streams.setdefault(serial, Stream())
        if number != s.number + 1 or s.ended:
            raise BadMedia("a page of a stream is missing, repeated or late")
        if bool(flags & _CONTINUED) != (s.part is not None):
            raise BadMedia("a packet isn't carried on where it should be")
        s.number, s.ended = number, bool(flags & _LAST)
        body, size, done = at + 27 + n, 0, 0
        for k in lace:
            size += k
            if k < 255:
                s.packets.append((s.part or b"") + data[body : body + size])
                s.part, body, size, done = None, body + size, 0, done + 1
        if size or lace and lace[-1] == 255:
            s.part = (s.part or b"") + data[body : body + size]
        if done:
            s.times.append((len(s.packets), granule))
        at = end
    if any(not s.ended or s.part is not None for s in streams.values()):
        raise BadMedia("a stream doesn't end")
    return streams


def read(data: bytes) -> tuple[bytes, dict[str, str], float]:
    """(samples, notes, seconds) of a container; the seconds follow from the last granule position."""
    samples, notes, seconds = None, {}, 0.0
    for s in demultiplex(data).values():
        if s.packets and s.packets[0].startswith(b"\x01pcm8"):
            rate, channels, _ = struct.unpack_from("<IBI", s.packets[0], 5)
            samples, done, before = b"".join(s.packets[1:]), 0, 1
            for n, granule in s.times:
                done += sum(map(len, s.packets[before:n]))
                before = max(n, 1)
                if granule * channels != done:
                    raise BadMedia("a granule position doesn't tell the samples so far")
            seconds = s.times[-1][1] / rate
        elif s.packets and s.packets[0].startswith(b"\x01notes"):
            notes = dict(x.split("=", 1) for x in b"".join(s.packets[1:]).decode().splitlines())
    if samples is None:
        raise BadMedia("no stream of samples")
    return samples, notes, seconds


def features(samples: bytes, seconds: float) -> str:
    """Length, mean, deviation, range, zero crossings about the middle and spectrum shares, as one string."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128
    sign = x >= 0
    power = np.abs(np.fft.rfft(x.reshape(-1, 64), axis=1)[:, 1:]) ** 2 if len(x) and len(x) % 64 == 0 else np.zeros((1, 32))
    bands = power.sum(0).reshape(4, -1).sum(1)
    share = bands / bands.sum() if bands.sum() > 0 else bands
    return f"s={seconds:.6f};mean={x.mean():.4f};sd={x.std():.4f};lo={int(x.min())};hi={int(x.max())};zc={int((sign[1:] != sign[:-1]).sum())};bands={','.join(f'{v:.4f}' for v in share)}"


def payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text in UTF-8, those bytes with zeros up to a positive multiple of 64); null is empty."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes(-len(data) % 64 if data else 64)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored(text: str | None) -> bytes:
    n, data = payload(text)
    return write(data, {"bytes": str(n), "rate": str(RATE)}, zlib.crc32(data))


def as_media(docs: DataFrame, keep: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text): what is read back from its container; ``keep`` adds the ``media`` itself.

    All values but doc_id depend on the text alone, which may be of any length. Repeated rows are told each
    by itself, an empty table gives no rows, and other columns are ignored.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, kept = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            media = stored(text)
            back, notes, seconds = read(media)
            rows.append((doc, int(notes["bytes"]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(back, seconds)))
            kept.append(media)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        if keep:
            cols.append(pa.array(kept, pa.binary()))
            names.append("media")
        return pa.RecordBatch.from_arrays(cols, names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(by_batch(fn, 256), SCHEMA + (", media binary" if keep else ""))

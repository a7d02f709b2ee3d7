import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from netloom.llm import ogg


def slow_crc(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
            c &= 0xFFFFFFFF
    return c


@given(st.binary(max_size=300))
@settings(deadline=None)
def test_checksum(data):
    assert ogg.checksum(data) == slow_crc(data)


@given(st.text(max_size=400))
@settings(max_examples=60, deadline=None)
def test_round_trip(text):
    n, data = ogg.payload(text)
    assert len(data) % 64 == 0 < len(data) and data[:n] == text.encode("utf-8", "surrogatepass") and not any(data[n:])
    back, notes, seconds = ogg.read(ogg.stored(text))
    assert back == data and notes["bytes"] == str(n) and seconds == len(data) / ogg.RATE


def test_many_pages_and_long_notes():
    samples = bytes(random.Random(1).randbytes(500_000))
    media = ogg.write(samples, {"a": "x" * 200_000}, 7)
    back, notes, _ = ogg.read(media)
    assert back == samples and len(notes["a"]) == 200_000
    streams = ogg.demultiplex(media)
    assert len(streams) == 2 and max(len(s.packets) for s in streams.values()) == 1 + -(-len(samples) // ogg.PACKET)


def test_any_damage_is_found():
    media = ogg.stored("hello world " * 6000)
    rng = random.Random(2)
    for _ in range(200):
        i = rng.randrange(len(media))
        with pytest.raises(ogg.BadMedia):
            ogg.read(media[:i] + bytes([media[i] ^ (1 << rng.randrange(8))]) + media[i + 1 :])
    for cut in (1, 30, len(media) // 2, len(media) - 1):
        with pytest.raises(ogg.BadMedia):
            ogg.read(media[:cut])
    pages = [b"OggS" + p for p in media.split(b"OggS")[1:]]
    assert len(pages) > 4
    with pytest.raises(ogg.BadMedia):
        ogg.read(b"".join(pages[:-2] + pages[-1:]))
    with pytest.raises(ogg.BadMedia):
        ogg.read(b"".join([*pages[:-1], pages[-1], pages[-1]]))


def test_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "é" * 40, "c"), (None, "é" * 40, "d"), (3, "x" * 200_000, "e")]
    got = ogg.as_media(spark.createDataFrame(rows, "doc_id long, text string, media string"), keep=True).collect()
    for (d, t, _), r in zip(rows, got):
        n, data = ogg.payload(t)
        assert (r.doc_id, r.n_bytes, r.payload_bytes) == (d, n, len(data))
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-64:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()
    assert got[2][2:] == got[3][2:] and got[0][1:] == got[1][1:]
    assert ogg.as_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0

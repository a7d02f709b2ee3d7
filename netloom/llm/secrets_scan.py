"""Secret scanning with a recursive decoding worklist (operator 3)."""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from netloom.llm.text import by_batch

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: One of these is in any text that has an assignment.
CUES = ("passw", "secret", "token", "api")
#: Bytes of a compressed layer that are scanned at once; a larger one is counted and scanned in windows.
INFLATED = 1 << 26
#: Bytes that go into a decompressor, or come out of it, at once.
PIECE = 1 << 16
#: Characters of the shortest span, ``token=`` and eight more.
SHORTEST = 14
#: Offsets from which a base64 run is decoded: whatever it is glued to, one of them is in step with it.
PHASES = 4

_URL = re.compile(r"[A-Za-z0-9._~+/=:&?@!$'*,;()%-]+")
_URL_CODE = re.compile(r"%[0-9A-Fa-f]{2}")
_URL_PART = re.compile(r"(?:%[0-9A-Fa-f]{2})+|[\s\S]")
_ESCAPES = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|%u([0-9A-Fa-f]{4})|&#([0-9]{1,7});")
#: The two bytes that a zlib stream begins with, by window size: method 8, a multiple of 31, no preset dictionary.
_ZLIB = {bytes([window << 4 | 8, flags]) for window in range(8) for flags in range(256) if ((window << 4 | 8) * 256 + flags) % 31 == 0 and not flags & 0x20}
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|" + b"|".join(re.escape(m) for m in sorted(_ZLIB)))
_HIGH = re.compile(r"\\x[89A-Fa-f]")
_BYTES = re.compile(r"""\\x([0-9A-Fa-f]{2})|\\([abfnrtv\\'"])""")
_PLAIN = dict(zip("abfnrtv\\'\"", b"\a\b\f\n\r\t\v\\'\""))
#: Text of two or four bytes a character: one byte, and as many nulls between each two.
_SPREAD = re.compile(rf"[^\0](?:\0[^\0]){{{SHORTEST - 1},}}|[^\0](?:\0{{3}}[^\0]){{{SHORTEST - 1},}}")
#: A run, over single line breaks.
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")

Span = tuple[int, int, str]


def base_spans(text: str) -> Iterator[Span]:
    """The leftmost non-overlapping matches of each kind, without those that are too short."""
    low = text.lower()
    if any(c in low for c in CUES):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                yield m.start(), m.end(), "assign"
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                yield m.start(), m.end(), "access"
    for m in HEX.finditer(text):
        yield m.start(), m.end(), "hex"


class Layer:
    """A decoded text; ``starts[i]``/``ends[i]`` bound its i-th character in the document itself."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts, ends):
        self.text, self.starts, self.ends = text, starts, ends

    def place(self, start: int, end: int) -> tuple[int, int]:
        return self.starts[start], self.ends[end - 1]


class Same:
    """The place of every character of an inflated text."""

    __slots__ = ("value",)

    def __init__(self, value: int):
        self.value = value

    def __getitem__(self, at: int) -> int:
        return self.value


def _inflate(raw: bytes, at: int, most: int, large: list[int]) -> Iterator[tuple[bytes, int]]:
    """(unwrapped bytes, end) of the gzip, zlib, bzip2, xz or zstandard members that lie one behind the other from ``at``.

    Of a broken or cut one, the bytes before the break, with ``at`` as the end; nothing if they are too
    few to hold anything. Over ``most`` bytes come in windows of that many, each half in the next one.
    """
    out, end, magic, over = bytearray(), at, raw[at : at + 2], False
    while raw[end : end + 2] == magic:
        kind = zlib.decompressobj(47) if magic == b"\x1f\x8b" or magic in _ZLIB else bz2.BZ2Decompressor() if magic == b"BZ" else lzma.LZMADecompressor() if magic == b"\xfd7" else zstandard.ZstdDecompressor().decompressobj()
        step = 256 if magic == b"\x28\xb5" else PIECE  # zstandard can't be told how much to give
        start, fed = end, end
        try:
            while not kind.eof and fed < len(raw):
                piece = raw[fed : fed + step]
                fed += len(piece)
                while True:
                    got = kind.decompress(piece) if step != PIECE else kind.decompress(piece, PIECE)
                    out += got
                    while len(out) > most:
                        large[0] += not over
                        over = True
                        yield bytes(out[:most]), at
                        del out[: (most + 1) // 2]
                    piece = getattr(kind, "unconsumed_tail", b"")
                    if kind.eof or step != PIECE or not piece and len(got) < PIECE and getattr(kind, "needs_input", True):
                        break
        except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError):
            break
        if not kind.eof:
            break
        end = fed - len(kind.unused_data)
        if end <= start:
            break
    if end > at or over or len(out) >= SHORTEST:
        yield bytes(out), end


def _raw(text: str) -> bytes:
    """The bytes of a layer: those that are no text are lone surrogates in it."""
    try:
        return text.encode("utf-8", "surrogateescape")
    except UnicodeEncodeError:
        return text.encode("utf-8", "surrogatepass")


def _readable(text: str) -> bool:
    return text.isprintable() or all(c.isprintable() or c in "\t\r\n" for c in text)


def _worth(text: str, raw: bytes) -> bool:
    """Whether bytes that aren't all readable hold a span or something wrapped."""
    return bool(_MAGIC.search(raw) or next(base_spans(text), None) or _BASE64.search(text) or _URL_CODE.search(text) or _ESCAPES.search(text) or _SPREAD.search(text))


def _placed(data: bytes, text: str, start, end) -> tuple[list[int], list[int]]:
    """Start and end of each character of a decoded text; ``start(i)`` and ``end(i)`` bound the i-th byte."""
    if len(text) == len(data):
        return [start(i) for i in range(len(data))], [end(i) for i in range(len(data))]
    starts, ends, at = [], [], 0
    for c in text:
        starts.append(start(at))
        at += 1 if "\udc80" <= c <= "\udcff" else len(c.encode())
        ends.append(end(at - 1))
    return starts, ends


def _unpacked(text: str, most: int, large: list[int]) -> Iterator[tuple[str, Same, Same]]:
    """(unwrapped text, start, end) of every compressed layer within a layer, wherever it begins."""
    raw, at = _raw(text), 0
    while m := _MAGIC.search(raw, at):
        at = m.start() + 1
        first = len(raw[: m.start()].decode("utf-8", "surrogateescape"))
        for plain, end in _inflate(raw, m.start(), most, large):
            last = len(raw[:end].decode("utf-8", "surrogateescape")) if end > m.start() else len(text)
            at = max(at, end)
            yield plain.decode("utf-8", "surrogateescape"), Same(first), Same(min(last, len(text)) - 1)


def _decoded(text: str) -> Iterator[tuple[str, Sequence[int], Sequence[int]]]:
    """(decoded text, start of each character, end of each character) of every wrapped run in a text."""
    if "%" in text:
        for m in _URL.finditer(text):
            if not _URL_CODE.search(text, m.start(), m.end()):
                continue
            out, starts, ends = [], [], []
            for part in _URL_PART.finditer(text, m.start(), m.end()):
                if len(part[0]) == 1:
                    out.append(part[0])
                    starts.append(part.start())
                    ends.append(part.end())
                    continue
                data = bytes.fromhex(part[0].replace("%", ""))
                inner = data.decode("utf-8", "surrogateescape")
                s, e = _placed(data, inner, lambda i: part.start() + 3 * i, lambda i: part.start() + 3 * i + 3)
                out.append(inner)
                starts += s
                ends += e
            yield "".join(out), starts, ends
            if "+" in m[0]:  # in a form a blank
                blank = [" " if text[i] == "+" and e == i + 1 else c for c, i, e in zip("".join(out), starts, ends)]
                yield "".join(blank), starts, ends
    if "\\" in text or "&#" in text or "%u" in text:
        out, starts, ends, at = [], [], [], 0
        for m in _ESCAPES.finditer(text):
            code = int(next(g for g in m.groups()[:6] if g), 16) if not m[7] else int(m[7])
            if code > 0x10FFFF or 0xD800 <= code < 0xE000:
                continue
            out += text[at : m.start()]
            starts += range(at, m.start())
            ends += range(at + 1, m.start() + 1)
            out.append(chr(code))
            starts.append(m.start())
            ends.append(m.end())
            at = m.end()
        if at:
            yield "".join(out) + text[at:], [*starts, *range(at, len(text))], [*ends, *range(at + 1, len(text) + 1)]
        if _HIGH.search(text):
            yield from _as_bytes(text)
    if "\0" in text:
        for m in _SPREAD.finditer(text):
            step = 2 if m[0][2] != "\0" else 4
            yield m[0][::step], range(m.start(), m.end(), step), range(m.start() + 1, m.end() + 1, step)
    for m in _BASE64.finditer(text):
        at = [i for i in range(m.start(), m.end()) if text[i] not in "=\t\r\n "] if "\n" in m[0] else range(m.start(), m.start() + len(m[0].rstrip("=")))
        run = (m[0] if isinstance(at, range) else "".join(text[i] for i in at)).rstrip("=").replace("-", "+").replace("_", "/")
        for k in range(PHASES):
            some = run[k : len(run) - ((len(run) - k) % 4 == 1)]
            data = binascii.a2b_base64(some + "=" * (-len(some) % 4))
            inner = data.decode("utf-8", "surrogateescape")
            if inner and (_readable(inner) or _worth(inner, data)):
                yield inner, *_placed(data, inner, lambda i: at[k + i * 4 // 3], lambda i: at[min(k - (-(i + 1) * 4 // 3), len(at)) - 1] + 1)


def _as_bytes(text: str) -> Iterator[tuple[str, list[int], list[int]]]:
    """The text with its escapes read as bytes, if something compressed is among them."""
    data, starts, ends, at = bytearray(), [], [], 0
    for m in (*_BYTES.finditer(text), None):
        for i in range(at, m.start() if m else len(text)):
            c = _raw(text[i])
            data += c
            starts += [i] * len(c)
            ends += [i + 1] * len(c)
        if m:
            data.append(int(m[1], 16) if m[1] else _PLAIN[m[2]])
            starts.append(m.start())
            ends.append(m.end())
            at = m.end()
    if _MAGIC.search(data):
        inner = bytes(data).decode("utf-8", "surrogateescape")
        yield inner, *_placed(data, inner, starts.__getitem__, ends.__getitem__)


def scan(text: str | None, most: int = INFLATED) -> tuple[list[Span], list[Span], int, int]:
    """(base spans, all spans, layers unwrapped, layers too large) of a text.

    A worklist holds layers to scan. Each layer is scanned with the base patterns; every run in
    it that URL, Unicode or base64 decoding turns into another text, every run of wide characters, and everything compressed in
    a decoded layer, is a further layer, until none is new. Layers keep bytes that are no text, so
    that what is beside them is scanned and what is compressed in them is unwrapped; those without
    anything readable aren't counted. A layer counts as seen by its bytes and its place in the
    document, so a run that decodes into itself, or round in a cycle, ends there. Spans found in
    a layer are those of the characters of the document that it came from.
    """
    text = text or ""
    base = sorted(base_spans(text), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    found, large, n = set(base), [0], 0
    seen: set[tuple[int, int, bytes]] = set()
    work = [map(lambda x: Layer(*x), _decoded(text))]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if not layer.text:
            continue
        seen = seen or {(0, len(text), hashlib.blake2b(_raw(text), digest_size=16).digest())}
        mark = (*layer.place(0, len(layer.text)), hashlib.blake2b(_raw(layer.text), digest_size=16).digest())
        if mark in seen:
            continue
        seen.add(mark)
        spans = {(*layer.place(a, b), kind) for a, b, kind in base_spans(layer.text)}
        found |= spans
        n += bool(spans) or _readable(layer.text)
        work.append(_within(layer, most, large))
    return base, sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1])), n, large[0]


def _within(layer: Layer, most: int, large: list[int]) -> Iterator[Layer]:
    for t, s, e in _decoded(layer.text):
        yield Layer(t, [layer.starts[i] for i in s], [layer.ends[i - 1] for i in e])
    for t, s, e in _unpacked(layer.text, most, large):
        yield Layer(t, Same(layer.starts[s.value]), Same(layer.ends[e.value]))


def told(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_too_large long"


def scan_secrets(docs: DataFrame, most: int = INFLATED) -> DataFrame:
    """One row per row of docs(doc_id, text); see ``scan``. A null text is empty, other columns are ignored.

    Texts of any length are scanned whole, repeated rows each by itself; an empty table gives no rows.

    n_assign, n_access, n_hex and base_sha256 tell of the base spans, ``spans`` of all. A
    compressed layer of over ``most`` bytes is scanned in windows, so that a bomb can't take a worker's
    memory; ``n_too_large`` counts those. What is wrapped in one and longer than half a window may
    be seen in parts.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan(t, most) for t in batch.column("text").to_pylist()]
        counts = [[sum(s[2] == k for s in r[0]) for r in rows] for k in KINDS]
        digests = [hashlib.sha256(told(r[0]).encode()).hexdigest() for r in rows]
        cols = [*map(pa.array, counts, [pa.int64()] * 3), pa.array(digests, pa.string()), pa.array([told(r[1]) for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], [c.split()[0] for c in SCHEMA.split(", ")])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(by_batch(fn), SCHEMA)

"""Personal data by anchor expansion: an Aho-Corasick pass and local parsers (operator 6)."""

from __future__ import annotations

import hashlib
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netloom.llm.text import by_batch

BASE = ("email", "ip", "card", "phone")
#: Spans beyond the base ones: sign-ins in addresses, bank accounts, numbers behind a cue.
MORE = ("login", "iban", "account")
KINDS = BASE + MORE
#: Fixed cues before an account number, and country codes with the length of their IBAN.
CUES = ("account no", "account number", "acct", "kontonummer", "konto-nr", "numéro de compte", "número de cuenta", "ssn", "passport no", "passport number")
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}

DIGIT = frozenset("0123456789")
ALNUM = DIGIT | frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL, LABEL = ALNUM | frozenset("._%+-"), ALNUM | {"-"}
DIALLED = DIGIT | frozenset(" ().-")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
LOGIN = ALNUM | frozenset("._~%!$&'*+,;=:-")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _run(text: str, at: int, chars: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at``, from ``floor`` on."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (to := _run(text, end + 1, LABEL)) > end + 1:
        end, dots = to, dots + 1
    return (start, end) if dots else None


def ip(text: str, at: int) -> tuple[int, int, bool] | None:
    """(start, end, valid) of four dotted numbers from the digit at ``at``."""
    end, parts = at, []
    for k in range(4):
        if k:
            if end >= len(text) or text[end] != ".":
                return None
            end += 1
        to = _run(text, end, DIGIT)
        if to == end:
            return None
        parts.append(text[end:to].lstrip("0"))
        end = to
    return at, end, all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts)


def card(text: str, at: int) -> tuple[int, int, bool] | None:
    end, n = at + 1, len(text)
    while end < n:
        if text[end] in DIGIT:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGIT:
            end += 2
        else:
            break
    if end == at + 1:
        return None
    digits = text[at:end].replace(" ", "").replace("-", "")
    return at, end, 12 <= len(digits) <= 19 and luhn(digits)


def phone(text: str, at: int) -> tuple[int, int, bool] | None:
    if at + 1 >= len(text) or text[at + 1] not in DIGIT:
        return None
    end = _run(text, at + 2, DIALLED)
    while end > at + 2 and text[end - 1] not in DIGIT:
        end -= 1
    if end < at + 4:
        return None
    return at, end, 9 <= sum(c in DIGIT for c in text[at:end]) <= 15


def login(text: str, at: int) -> tuple[int, int] | None:
    """``user:password`` before the at-sign of an address whose scheme ends at ``at``."""
    end = _run(text, at, LOGIN)
    return (at, end) if end > at and text[end : end + 1] == "@" and ":" in text[at:end] and _run(text, end + 1, LABEL) > end + 1 else None


def iban(text: str, at: int) -> tuple[int, int] | None:
    """A bank account with a right checksum, from its country code at ``at``, in groups or not."""
    if at and text[at - 1] in ALNUM or not (length := IBAN_LENGTHS.get(text[at : at + 2])):
        return None
    end, got = at, []
    while end < len(text) and len(got) < length:
        if text[end] in UPPER:
            got.append(text[end])
        elif text[end] != " " or not got or text[end - 1] == " ":
            return None
        end += 1
    if len(got) < length or end < len(text) and text[end] in ALNUM:
        return None
    code = "".join(got[4:] + got[:4])
    return (at, end) if int("".join(str(int(c, 36)) for c in code)) % 97 == 1 else None


def account(text: str, at: int) -> tuple[int, int] | None:
    """The number of 6 to 20 digits that follows a cue ending at ``at`` within a few marks."""
    start = at
    while start < len(text) and start - at < 8 and text[start] in " .:#-=":
        start += 1
    end = start
    while end < len(text) and (text[end] in DIGIT or text[end] in "- " and end > start and text[end - 1] in DIGIT and text[end + 1 : end + 2] in DIGIT and end + 1 < len(text)):
        end += 1
    return (start, end) if 6 <= sum(c in DIGIT for c in text[start:end]) <= 20 and text[end : end + 1] not in ALNUM else None


@cache
def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word in "@+":
        found.add_word(word, (word, 1))
    for d in sorted(DIGIT):
        found.add_word(d, ("0", 1))
    found.add_word("://", ("://", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, ("cue", len(form)))
    for land in IBAN_LENGTHS:
        for d in sorted(DIGIT):
            found.add_word(land + d, ("iban", 3))
    found.make_automaton()
    return found


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, by start and kind.

    One pass of the automaton finds the anchors: at-signs, plus signs, digits, schemes, country
    codes before a digit and cues. At each, the parser of its kind expands from there; within a
    kind spans do not overlap, the leftmost wins, and what a dropped match covers is not tried again.
    """
    text = text or ""
    base: list[Span] = []
    more: list[Span] = []
    after = dict.fromkeys(KINDS, 0)
    for last, (sort, width) in anchors().iter(text):
        at = last - width + 1
        if sort == "0":
            if at >= after["ip"]:
                if got := ip(text, at):
                    after["ip"] = got[1]
                    if got[2]:
                        base.append((at, got[1], "ip"))
                else:  # no start in this run of digits does better
                    after["ip"] = _run(text, at, DIGIT)
            if at >= after["card"] and (got := card(text, at)):
                after["card"] = got[1]
                if got[2]:
                    base.append((at, got[1], "card"))
        elif sort == "@":
            if at >= after["email"] and (got := email(text, at, after["email"])):
                after["email"] = got[1]
                base.append((*got, "email"))
        elif sort == "+":
            if at >= after["phone"] and (got := phone(text, at)):
                after["phone"] = got[1]
                if got[2]:
                    base.append((at, got[1], "phone"))
        elif sort == "://":
            if got := login(text, last + 1):
                more.append((*got, "login"))
        elif sort == "iban":
            if at >= after["iban"] and (got := iban(text, at)):
                after["iban"] = got[1]
                more.append((*got, "iban"))
        elif last + 1 >= after["account"] and (got := account(text, last + 1)):
            after["account"] = got[1]
            more.append((*got, "account"))
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base.sort(key=order)
    return base, sorted(base + more, key=order) if more else base


def told(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_personal(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text); see ``find``. A null text is empty, other columns are ignored.

    Texts of any length are read whole, repeated rows each by itself; an empty table gives no rows.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [find(t) for t in batch.column("text").to_pylist()]
        counts = [pa.array([sum(s[2] == k for s in r[0]) for r in rows], pa.int64()) for k in BASE]
        digests = [hashlib.sha256(told(r[0]).encode()).hexdigest() for r in rows]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digests, pa.string()), pa.array([told(r[1]) for r in rows], pa.string())], [c.split()[0] for c in SCHEMA.split(", ")])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(by_batch(fn), SCHEMA)


def masked(text: str | None) -> str | None:
    """The text with each stretch of personal data replaced by its kind in angle brackets.

    Spans that overlap are merged and named by the first. Masking is repeated on the result until
    nothing is found, as what stood on both sides of a span may meet; null stays null.
    """
    while text:
        spans = find(text)[1]
        if not spans:
            break
        out, end = [], 0
        for a, b, kind in spans:
            if a < end:
                end = max(end, b)
                continue
            out.append(text[end:a])
            out.append(f"<{kind.upper()}>")
            end = b
        out.append(text[end:])
        text = "".join(out)
    return text


def mask_personal(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with personal data in ``text`` masked, ``n_chars`` set to the new length where it is there.

    Texts may be of any length; null ones, repeated rows and all other columns stay as they are.
    """
    names = docs.columns

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = batch.column("text").to_pylist()
        new = [masked(t) for t in old]
        cols = {c: batch.column(c) for c in batch.schema.names}
        cols["text"] = pa.array(new, batch.schema.field("text").type)
        if "n_chars" in cols:
            was = cols["n_chars"].to_pylist()
            cols["n_chars"] = pa.array([k if a == b else len(b) for a, b, k in zip(old, new, was)], batch.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.select(*names).mapInArrow(by_batch(fn), docs.schema)

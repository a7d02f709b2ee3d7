"""Whole-text token ids of a word-level BPE tokenizer file, by a memo of its words."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import regex
from tokenizers import Tokenizer

from netloom.llm.text import forgettable

#: The tokenizer file's own splitting pattern (a fixed value of word_bpe_49k.json).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stretches that a worker keeps, in two generations.
KEPT = 800_000
#: Characters for which Python and the library agree on case, form and class; other texts go to the library whole.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-įĲ-ňŊ-ž‐-‧‰-⁞€]*")
SPECIAL = "<|"


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte of a byte-level vocabulary: itself if it prints, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return dict(zip(plain, plain)) | {b: 256 + k for k, b in enumerate(rest)}


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class _Words(dict):
    """The ids of each stretch without white space, found when asked; of the older half those in use come back."""

    def __init__(self, library: Tokenizer):
        super().__init__()
        self.model = library.model
        self.split = regex.compile(SPLIT).findall
        self.raw = [k.to_bytes(4, "little") for k in range(library.get_vocab_size())]
        self.letters = byte_letters()
        self.older: dict[str, bytes] = {}
        forgettable(self.forget)

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            parts = (word,) if word.isalpha() else self.split(word)
            ids = self._part(word) if len(parts) == 1 else b"".join([self[p] for p in parts])
        if len(self) >= KEPT // 2:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _part(self, part: str) -> bytes:
        spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.raw[t.id] for t in self.model.tokenize(spelt)])


class WordIds:
    """``batch(texts)`` as little-endian unsigned 32-bit bytes, equal to the library's ids without special tokens.

    White space is dropped and always parts what the library encodes on its own, so the answer of
    the library's model for each distinct stretch without white space is kept. Texts with a character
    outside ``PLAIN`` or with a special token's brackets are encoded by the library as a whole.
    """

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.words = _Words(self.library)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _text(self, text: str) -> bytes:
        if SPECIAL in text or not PLAIN.fullmatch(text):
            return self._whole(text)
        return b"".join(map(self.words.__getitem__, unicodedata.normalize("NFC", text).lower().split()))

    def batch(self, texts: list[str]) -> list[bytes]:
        return [self._text(t) for t in texts]


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)

"""Words, hashes and Arrow plumbing that the text operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Entries of a per-process memo before it is emptied.
MEMO = 200_000
WORD = re.compile(r"\w+")
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)


_forget: list[Callable[[], None]] = []
_owner = [""]


def owned(name: str) -> None:
    """Say whose work a Python worker does: memos that another operator's tasks left in it are emptied."""
    if _owner[0] != name:
        for forget in _forget:
            forget()
        _owner[0] = name


def forgettable(forget: Callable[[], None]) -> None:
    _forget.append(forget)


class Memo(dict):
    """A bounded memo of ``make(key)``; it only saves work, never changes a value."""

    def __init__(self, make: Callable, most: int = MEMO):
        super().__init__()
        self.make, self.most = make, most
        forgettable(self.forget)

    def forget(self) -> None:
        self.clear()

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value


class Lasting(Memo):
    """A memo for what is dear to make: when it is full it becomes the older half, from which what is asked for again comes back."""

    def __init__(self, make: Callable, most: int = 2 * MEMO):
        super().__init__(make, most)
        self.older: dict = {}

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def __missing__(self, key):
        value = self.older[key] if key in self.older else self.make(key)
        if len(self) >= self.most // 2:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


word_hash = Memo(lambda w: xxhash.xxh64_intdigest(w))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def hashed(words: list[str]) -> np.ndarray:
    return np.fromiter(map(word_hash.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text, in lower case.

    A text of fewer than n words, but at least one, is one shingle; an empty text has none.
    """
    words = hashed(WORD.findall((text or "").lower()))
    if not len(words):
        return words
    if len(words) <= n:
        out = words[:1] * np.uint64(1)
        for w in words[1:]:
            out = out * _STEP + w
        return mix(out + np.uint64(len(words)))
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = out * _STEP + words[k : len(words) - n + 1 + k]
    return np.unique(mix(out + np.uint64(n)))


def by_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 512) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function that hands ``fn`` slices of at most ``rows`` rows."""
    owner = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owned(owner)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return run


def by_group(keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None]) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function for input sorted by ``keys``: ``fn`` gets each group once, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            cut = np.zeros(batch.num_rows, bool)
            for c in cols:
                cut[1:] |= c[1:] != c[:-1]
            first = tuple(c[0] for c in cols)
            starts = [0, *np.flatnonzero(cut).tolist(), batch.num_rows]
            for a, b in zip(starts, starts[1:]):
                if a == 0 and last is not None and first != last or a:
                    if rest and (out := fn(pa.Table.from_batches(rest))) is not None:
                        yield out
                    rest = []
                rest.append(batch.slice(a, b - a))
            last = tuple(c[-1] for c in cols)
        if rest and (out := fn(pa.Table.from_batches(rest))) is not None:
            yield out

    return run


def fresh(df, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case of its letters."""
    taken = {c.casefold() for c in df.columns}
    while name.casefold() in taken:
        name += "_"
    return name

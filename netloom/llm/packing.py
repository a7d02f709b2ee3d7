"""Best-fit packing by patterns fitted with non-negative least squares (operator 4)."""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netloom.llm.text import by_batch
from netloom.llm.tokens import word_ids
from netloom.operators.components import checkpointed

MOST = 2048
#: Bins of the coarse histogram and documents of a pattern at most.
BINS, PARTS = 64, 4
#: Ranks of a length are counted in groups: about this many over all, and none above this many rows.
GROUPS, GROUP_ROWS = 1024, 1_000_000


def patterns(bins: int = BINS, parts: int = PARTS) -> list[tuple[int, ...]]:
    """All ways to fill ``bins`` exactly with 1 to ``parts`` lengths, each written from long to short."""
    out: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], room: int) -> None:
        if not room:
            out.append(head)
        elif len(head) < parts:
            for k in range(min(room, head[-1] if head else bins), 0, -1):
                extend((*head, k), room - k)

    extend((), bins)
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with the least ||a x - b||, by an active set (Lawson and Hanson)."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    eps = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[active] = -np.inf
        j = int(w.argmax())
        if w[j] <= eps:
            break
        active[j] = True
        while True:
            s = np.zeros(n)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            if s[active].min() > 0:
                x = s
                break
            low = active & (s <= 0)
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = x + step * (s - x)
            gone = active & (x <= 1e-12)
            x[gone] = 0
            active &= ~gone
            if not active.any():
                break
    return x


@dataclass
class Recipe:
    """``runs`` of sequences alike: [copies, lengths of their pieces]."""

    most: int
    runs: list[tuple[int, list[int]]] = field(default_factory=list)

    def slots(self) -> list[tuple[int, int, int, int, int]]:
        """(length, first rank, ranks, first sequence, offset) for each place of each run."""
        used: dict[int, int] = {}
        out, seq = [], 0
        for copies, lengths in self.runs:
            at = 0
            for length in lengths:
                out.append((length, used.get(length, 0), copies, seq, at))
                used[length] = used.get(length, 0) + copies
                at += length
            seq += copies
        return out


def pack(counts: dict[int, int], most: int = MOST, bins: int = BINS, parts: int = PARTS) -> Recipe:
    """Sequences of at most ``most`` tokens for a histogram of lengths, without a look at single pieces.

    Lengths are rounded up into ``bins`` bins. Non-negative least squares finds how often each
    pattern of a few bins should repeat to use up the histogram; the counts are rounded down. Each
    place of a pattern but the last gets the longest length at hand in its bin, and the last the
    length that fills the sequence to the token; a pattern for which none is at hand is left out,
    so rounding wastes nothing. What is left over is packed best-fit decreasing,
    into the gaps that the patterns left as well as into new sequences. The work depends on the
    number of different lengths, not of pieces.
    """
    if any(not 0 < k <= most for k in counts):
        raise ValueError(f"lengths must lie between 1 and {most}")
    left = {k: v for k, v in counts.items() if v > 0}
    recipe = Recipe(most)
    if left.get(most):
        recipe.runs.append((left.pop(most), [most]))
    width = -(-most // bins)
    b = np.zeros(bins)
    for k, v in left.items():
        b[-(-k // width) - 1] += v
    ways = [w for w in patterns(bins, parts) if all(b[k - 1] for k in w)]
    gaps: dict[int, list[tuple[int, list[int]]]] = {}
    if ways:
        a = np.zeros((bins, len(ways)))
        for j, w in enumerate(ways):
            for k in w:
                a[k - 1, j] += 1
        x = nnls(a / np.maximum(1, np.sqrt(b))[:, None], b / np.maximum(1, np.sqrt(b)))
        keys = sorted(left)  # lengths still at hand
        for j in np.argsort(-x, kind="stable"):
            want = int(x[j])
            while want > 0:
                take: list[int] = []
                for k in ways[j][:-1]:
                    i = bisect.bisect_right(keys, min(k * width, most)) - 1
                    if i < 0 or keys[i] <= (k - 1) * width:
                        break
                    take.append(keys[i])
                room = most - sum(take)
                i = bisect.bisect_right(keys, room) - 1
                if len(take) < len(ways[j]) - 1 or i < 0 or keys[i] < room:
                    break
                take.append(keys[i])
                n = min([want, *(left[k] // take.count(k) for k in set(take))])
                if not n:  # one length is rarer than the pattern has places for it: leave it to best fit
                    break
                for k in set(take):
                    left[k] -= n * take.count(k)
                    if not left[k]:
                        keys.pop(bisect.bisect_left(keys, k))
                gaps.setdefault(most - sum(take), []).append((n, take))
                want -= n
    open_ = sorted(g for g in gaps if g)
    for length in sorted((k for k, v in left.items() if v), reverse=True):
        todo = left[length]
        while todo:
            i = bisect.bisect_left(open_, length)
            if i == len(open_):
                fit = most // length  # new sequences, as many of this length in each as go in
                n, rest = divmod(todo, fit)
                for copies, each in ((n, fit), (1 if rest else 0, rest)):
                    if copies:
                        g = most - each * length
                        if g and g not in gaps:
                            bisect.insort(open_, g)
                        elif g and not gaps[g]:
                            bisect.insort(open_, g)
                        gaps.setdefault(g, []).append((copies, [length] * each))
                break
            g = open_[i]
            n, pieces = gaps[g].pop()
            if not gaps[g]:
                open_.pop(i)
            m = min(n, todo)
            if n > m:
                if not gaps[g]:
                    open_.insert(i, g)
                gaps[g].append((n - m, pieces))
            todo -= m
            h = g - length
            if h and not gaps.get(h):
                bisect.insort(open_, h)
            gaps.setdefault(h, []).append((m, [*pieces, length]))
    for g in sorted(gaps):
        recipe.runs += gaps[g]
    return recipe


def pieces(docs: DataFrame, path: str, most: int = MOST) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` for each piece of each row of docs(doc_id, text).

    A document is its ids by the tokenizer file at ``path``, without special tokens, and then id 0;
    only one longer than ``most`` is cut, into pieces of ``most``. A null text is empty: one piece, id 0.
    Repeated rows are pieces each of its own; other columns are ignored.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = word_ids(path).batch
        rows: list[tuple] = []
        for doc, ids in zip(batch.column("doc_id").to_pylist(), encode([t or "" for t in batch.column("text").to_pylist()])):
            ids += b"\0\0\0\0"
            for k, at in enumerate(range(0, len(ids), 4 * most)):
                part = ids[at : at + 4 * most]
                rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
        cols = zip(*rows) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(by_batch(fn), "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(docs: DataFrame, path: str, most: int = MOST) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``: all documents in sequences.

    Documents are encoded once and their pieces written to the checkpoint folder. The driver sees
    the histogram of lengths, of at most ``most`` rows, and makes the recipe from it. Each piece
    then gets its rank among those of its length, and the recipe says where a rank goes. Ranks are
    counted in groups, so that one common length is no single task's work: lengths are split by a
    hash of the piece into groups of about a 1024th of the rows, of a million at most.
    """
    parts = checkpointed(pieces(docs, path, most))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = sorted(pack(counts, most).slots())
    group = max(1, min(-(-sum(counts.values()) // GROUPS), GROUP_ROWS))
    salts = {k: -(-n // group) for k, n in counts.items()}
    spark = docs.sparkSession
    salted = parts.join(F.broadcast(spark.createDataFrame(sorted(salts.items()), "length long, salts int")), "length", "left")
    salted = salted.withColumn("salt", F.expr("cast(pmod(xxhash64(doc_id, piece, ids_crc32), salts) as int)"))
    sizes = {(r["length"], r["salt"]): r["n"] for r in salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()}
    before: dict[int, list[int]] = {}
    for length, n in salts.items():
        total, before[length] = 0, []
        for salt in range(n):
            before[length].append(total)
            total += sizes.get((length, salt), 0)
    firsts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for length in counts:
        own = [s for s in slots if s[0] == length]
        firsts[length] = tuple(np.array([s[k] for s in own], np.int64) for k in (1, 3, 4))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, salt, rank = (batch.column(c).to_numpy() for c in ("length", "salt", "rank"))
        seq, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length):
            at = np.flatnonzero(length == k)
            first, begin, place = firsts[int(k)]
            r = rank[at] + np.array(before[int(k)], np.int64)[salt[at]]
            i = np.searchsorted(first, r, "right") - 1
            seq[at], offset[at] = begin[i] + r - first[i], place[i]
        cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        return pa.RecordBatch.from_arrays([*cols, pa.array(seq), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = salted.selectExpr("*", "cast(row_number() over (partition by length, salt order by doc_id, piece, ids_crc32) - 1 as long) as rank")
    return ranked.mapInArrow(by_batch(fn, 8192), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

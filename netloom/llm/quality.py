"""Quality classifier: hashed word n-gram logistic regression trained by FTRL (operator 2)."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from netloom.llm.text import Lasting, Memo, by_batch, mix

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Labelled documents that training uses at most, the ones with the least hash of their id.
SAMPLE = 5000
BITS = 18
#: Tokens that a text counts as longer, so that one n-gram of a very short text doesn't decide.
SMOOTH = 20


def _shape(token: str) -> str:
    c = token[0]
    if c.isdigit():
        return "0"
    if not (c.isalpha() or c == "_"):
        return token[:4]
    case = "A" if len(token) > 1 and token.isupper() else "Aa" if c.isupper() else "a"
    return f"{case}{min(4, len(token) // 4)}"


_shapes = Memo(lambda s: xxhash.xxh64_intdigest(s, 1).to_bytes(8, "little"))
#: The hashes of a token and of its shape, one behind the other.
_codes = Lasting(lambda t: xxhash.xxh64_intdigest(t.lower()).to_bytes(8, "little") + _shapes[_shape(t)])


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a whole text: distinct hashed n-grams and their weights.

    Words give unigrams, and bigrams with a mark of their own where a word is repeated; word
    shapes (case, length class, punctuation itself) give unigrams to trigrams. A value is the
    square root of the n-gram's share of the text, SMOOTH tokens longer than it is, so that length
    alone moves little and a word or two prove nothing; an empty
    text has no n-grams but the constant one.
    """
    tokens = TOKEN.findall(text or "")
    mask = np.uint64((1 << bits) - 1)
    if not tokens:
        return np.zeros(1, np.int32), np.ones(1, np.float32)
    codes = np.frombuffer(b"".join(map(_codes.__getitem__, tokens)), "<u8").reshape(-1, 2)
    w, s = codes[:, 0].copy(), codes[:, 1].copy()
    two = mix(w[:-1] * np.uint64(3) + w[1:])
    two[w[:-1] == w[1:]] = np.uint64(7)
    s2 = mix(s[:-1] * np.uint64(5) + s[1:])
    grams = [w, two, s, s2, mix(s2[:-1] * np.uint64(7) + s[2:])]
    index, times = np.unique(np.concatenate([(g & mask).astype(np.uint32) for g in grams]), return_counts=True)
    keep = index > 0
    index, times = index[keep].astype(np.int64), times[keep]
    return np.concatenate([[0], index]).astype(np.int32), np.concatenate([[1], np.sqrt(times / (len(tokens) + SMOOTH))]).astype(np.float32)


@dataclass(frozen=True)
class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.5
    epochs: int = 6
    bits: int = BITS

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
        """Weights from ``(indices, values, label)`` rows in the order given; classes weigh alike."""
        z, n = np.zeros(1 << self.bits), np.zeros(1 << self.bits)
        if not rows:
            return z.astype(np.float32)
        share = sum(y for *_, y in rows) / len(rows)
        weigh = {0: 0.5 / max(1 - share, 1e-3), 1: 0.5 / max(share, 1e-3)}
        for _ in range(self.epochs):
            for i, x, y in rows:
                w = self._weights(z[i], n[i])
                p = 1 / (1 + np.exp(-np.clip(float(w @ x), -35, 35)))
                g = (p - y) * weigh[y] * x
                step = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / self.alpha
                z[i] += g - step * w
                n[i] += g * g
        return self._weights(z, n).astype(np.float32)

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)


def score(text: str | None, weights: np.ndarray, bits: int = BITS) -> float:
    i, x = features(text, bits)
    return float(1 / (1 + np.exp(-np.clip(float(weights[i] @ x), -35, 35))))


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from training: the remainder of its id's checksum by 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _trainer(model: Ftrl):
    def fn(batches):
        rows = [r for b in batches for r in zip(b.column("rank").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("y").to_pylist())]
        rows.sort(key=lambda r: (r[0], r[1], r[2]))
        weights = model.fit([(*features(text, model.bits), y) for *_, text, y in rows])
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    return fn


def train(docs: DataFrame, labels: DataFrame, model: Ftrl = Ftrl(), sample: int = SAMPLE) -> np.ndarray:
    """Weights learnt from ``labels(doc_id, quality)`` of the documents that aren't held out.

    At most ``sample`` labelled ids are used, those with the least hash of the id, so the one task
    that trains holds a bounded number of documents. Null labels and ids, and ids with labels that
    contradict each other, teach nothing. Without any usable label all weights are 0.
    """
    known = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.min("quality").cast("int").alias("y"), F.max("quality").alias("top"))
        .where("y = top")
        .where(~held_out(F.col("id")))
        .select("id", "y", F.xxhash64("id").alias("rank"))
        .orderBy("rank", "id")
        .limit(sample)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(known), rows.doc_id == known.id).select("rank", "doc_id", "text", "y").orderBy("rank", "doc_id", "text").limit(sample)
    found = rows.repartition(1).mapInArrow(_trainer(model), "weights binary").collect()
    return np.frombuffer(found[0]["weights"], np.float32) if found else np.zeros(1 << model.bits, np.float32)


def scored(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """``(doc_id, score)`` for each row of docs(doc_id, text), from the whole text alone, however long; null text is empty.

    Equal texts have equal scores, repeated rows one each; an empty table gives no rows, and other columns are ignored.
    """
    at = np.flatnonzero(weights)
    small = weights[at]

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        full = np.zeros(1 << bits, np.float32)
        full[at] = small
        out = [score(t, full, bits) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(by_batch(fn), "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, cut: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores ``cut`` or more; all columns are kept as they are, whatever their names.

    A null text is scored as an empty one, repeated rows have one score and stay or go together, rows without a doc_id are
    scored as well, and an empty table gives no rows. Without any usable label every score is a half, so all rows stay at the usual cut.
    """
    weights = train(docs, labels)
    at = np.flatnonzero(weights)
    small, text = weights[at], docs.columns.index("text")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        full = np.zeros(1 << BITS, np.float32)
        full[at] = small
        return batch.filter(pa.array([score(t, full) >= cut for t in batch.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(by_batch(fn), docs.schema)

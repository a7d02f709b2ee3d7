"""Line deduplication by a deletion-neighbourhood join (operator 9)."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from netloom.llm.text import by_batch, fresh, mix, word_hash
from netloom.operators.components import checkpointed, rekeyed

#: Words of a line from which on it can be dropped as a copy, and as one edit away.
LEAST, LEAST_NEAR = 5, 8

#: Scripts that put no blanks between words: each of their characters is one.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f"
_PARTS = re.compile(f"[{UNSPACED}]|[^{UNSPACED}]+")


def words(line: str) -> list[str]:
    """A line's words: lower case, parted by white space; of scripts without blanks the characters."""
    found = line.lower().split()
    return found if line.isascii() else [p for w in found for p in _PARTS.findall(w)]


def key(line: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(line))


def halves(line: list[str]) -> set[int]:
    """Keys of which two lines of one edit share at least one.

    What stands before the edit and what stands behind it are the same in both, and one of
    the two is at least half as long as the shorter line without a word. A line may be the
    shorter or the longer of the two, so both lengths of its start and of its end are keys.
    """
    n = len(line)
    out = set()
    for h in {n // 2, (n - 1) // 2}:
        out.add(xxhash.xxh3_64_intdigest(" ".join(line[:h]), h))
        out.add(xxhash.xxh3_64_intdigest(" ".join(line[n - h :]), h + (1 << 32)))
    return out


def variants(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of a line of word hashes and of all its variants with one word deleted; the whole has place -1."""
    n = len(codes)
    weight = np.empty(n, np.uint64)
    weight[0] = 1
    weight[1:] = np.uint64(0x9E3779B97F4A7C15)
    weight = np.cumprod(weight)
    terms = codes * weight
    head = np.concatenate([[np.uint64(0)], np.cumsum(terms)])
    shifted = np.concatenate([np.cumsum((codes[1:] * weight[:-1])[::-1])[::-1], [np.uint64(0)]]).astype(np.uint64)
    out = np.empty(n + 1, np.uint64)
    out[0], out[1:] = head[n] + np.uint64(n), head[:n] + shifted + np.uint64(n - 1)
    return mix(out), np.arange(-1, n, dtype=np.int32)


def one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two lines are at an edit distance of 1 at most, over words."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    differ = np.flatnonzero(a != b[: len(a)])
    k = int(differ[0]) if len(differ) else len(a)
    return np.array_equal(a[k + (len(a) == len(b)) :], b[k + 1 :])


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _lines(least: int, near: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        docs, lines, keys, parts = [], [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            for k, line in enumerate((text or "").split("\n")):
                w = words(line)
                if len(w) < least:
                    continue
                docs.append(doc)
                lines.append(k)
                keys.append(key(w))
                parts.append([_signed(h) for h in sorted(halves(w))] if len(w) >= near else [])
        cols = [pa.array(docs, pa.int64()), pa.array(lines, pa.int32()), pa.array(keys, pa.binary()), pa.array(parts, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "line", "key", "halves"])

    return by_batch(fn)


def _named(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The word hashes of the lines named; rows that share a doc_id may have other lines there, so names are held against keys."""
    found: dict[bytes, tuple[int, int, bytes]] = {}
    for doc, text, named in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "named"))):
        parts = (text or "").split("\n")
        for n in named:
            w = words(parts[n["line"]]) if n["line"] < len(parts) else []
            if w and key(w) == n["key"]:
                found[n["key"]] = doc, n["line"], np.fromiter(map(word_hash.__getitem__, w), np.uint64, len(w)).tobytes()
    cols = [pa.array([f[i] for f in found.values()], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary()))]
    return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *cols], ["key", "doc_id", "line", "codes"])


def _hashes(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The variants of each line alone."""
    got = [variants(np.frombuffer(c, np.uint64))[0] for c in batch.column("codes").to_pylist()]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *got]).view(np.int64))], ["variant"])


def _variants(batch: pa.RecordBatch) -> pa.RecordBatch:
    """All variants of each line."""
    codes = [np.frombuffer(c, np.uint64) for c in batch.column("codes").to_pylist()]
    got = [variants(c) for c in codes]
    at = pa.array(np.repeat(np.arange(len(codes)), [len(c) + 1 for c in codes]))
    h, place = (np.concatenate([g[i] for g in got]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("line").take(at), pa.array(h.view(np.int64)), pa.array(place)], ["doc_id", "line", "variant", "place"])


def _verified(batch: pa.RecordBatch) -> pa.RecordBatch:
    ok = [one_edit(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(batch.column("codes").to_pylist(), batch.column("codes2").to_pylist())]
    return batch.select(["doc_id", "line", "kept_doc_id", "kept_line"]).filter(pa.array(ok, pa.bool_()))


def _partnered(slim: DataFrame, firsts: DataFrame) -> DataFrame:
    """``(key, doc_id, line, codes)`` of the first lines that share a start or end of half the length with another one."""
    parts = firsts.select("key", "kept_doc_id", "kept_line", F.explode("halves").alias("half"))
    shared = parts.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    some = parts.join(rekeyed(shared, "half"), "half", "left_semi").select("key", F.col("kept_doc_id").alias("of"), F.col("kept_line").alias("line")).distinct()
    named = some.groupBy("of").agg(F.collect_list(F.struct("line", "key")).alias("named"))
    found = slim.join(named, slim["doc_id"] == named["of"]).select("doc_id", "text", "named").mapInArrow(by_batch(_named), "key binary, doc_id long, line int, codes binary")
    return found.groupBy("key").agg(F.min(F.struct("doc_id", "line", "codes")).alias("f")).select("key", "f.doc_id", "f.line", "f.codes")


def repeated_lines(docs: DataFrame, least: int = LEAST, near: int = LEAST_NEAR) -> DataFrame:
    """``(doc_id, line, kept_doc_id, kept_line, edits)`` for each line of docs(doc_id, text) that an earlier line repeats.

    Lines are parted by line feeds and numbered from 0; an earlier line has a smaller doc_id or,
    within a document, a smaller number. A line of ``least`` words or more (see
    ``words``) repeats an equal one, named by the earliest; the first of equal lines, if of
    ``near`` words or more, repeats an earlier first line of ``near`` or more words at an edit
    distance of one word. Whether that earlier line is itself dropped plays no part, so the
    result doesn't depend on any order of work.

    Every line with a possible partner gives its deletion variants, hashed; equal variants meet
    in an aggregate that keeps the earliest line of each place of deletion, so a bucket costs no
    pairs and a hot one is aggregated where it arises. What a line then points to is verified on
    the words. A possible partner is one that shares a start or end of half the length, which two
    lines of one edit always do; semi-joins with the halves and the variants that occur twice leave
    only lines and variants that can have one, so the cost follows the text and what is shared in it. Null texts have no lines; rows with a null doc_id take no part;
    rows that share a doc_id and a line count as one, for edits that with the least word hashes. A text or line may be of any length.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    lines = checkpointed(slim.mapInArrow(_lines(least, near), "doc_id long, line int, key binary, halves array<long>"))
    place = F.struct("doc_id", "line")
    firsts = lines.groupBy("key").agg(F.min(place).alias("f"), F.count("*").alias("n"), F.first("halves").alias("halves"))
    firsts = checkpointed(firsts.select("key", F.col("f.doc_id").alias("kept_doc_id"), F.col("f.line").alias("kept_line"), "n", "halves"))
    copies = (
        lines.select("doc_id", "line", "key")
        .join(firsts.where("n > 1").select("key", "kept_doc_id", "kept_line"), "key")
        .where("doc_id <> kept_doc_id or line <> kept_line")
        .select("doc_id", "line", "kept_doc_id", "kept_line", F.lit(0).alias("edits"))
    )
    codes = checkpointed(_partnered(slim, firsts).groupBy("doc_id", "line").agg(F.min("codes").alias("codes")))
    spelt = "doc_id long, line int, variant long, place int"
    twice = codes.mapInArrow(by_batch(_hashes, 2000), "variant long").groupBy("variant").agg(F.count("*").alias("n")).where("n > 1").select("variant")
    rows = checkpointed(codes.mapInArrow(by_batch(_variants, 2000), spelt).join(rekeyed(twice, "variant"), "variant", "left_semi").select("doc_id", "line", "variant", "place"))
    least_at = rows.groupBy("variant", "place").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    least_of = least_at.groupBy("variant").agg(
        F.sum("n").alias("all"), F.min(F.when(F.col("place") < 0, F.col("first"))).alias("whole"), F.min(F.when(F.col("place") >= 0, F.col("first"))).alias("part")
    )
    least_of = least_of.where("all > 1").select("variant", "whole", "part")
    met = rows.join(rekeyed(least_at.select("variant", "place", "first"), "variant"), ["variant", "place"]).join(rekeyed(least_of, "variant"), "variant")
    earlier = F.when(F.col("place") < 0, F.col("part")).otherwise(F.least("first", "whole"))
    pairs = met.select("doc_id", "line", earlier.alias("kept")).where("kept is not null and kept < struct(doc_id, line)").distinct()
    pairs = pairs.select("doc_id", "line", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line").alias("kept_line"))
    other = codes.select(F.col("doc_id").alias("kept_doc_id"), F.col("line").alias("kept_line"), F.col("codes").alias("codes2"))
    checked = pairs.join(codes, ["doc_id", "line"]).join(other, ["kept_doc_id", "kept_line"]).mapInArrow(by_batch(_verified), "doc_id long, line int, kept_doc_id long, kept_line int")
    edited = checked.groupBy("doc_id", "line").agg(F.min(F.struct("kept_doc_id", "kept_line")).alias("kept")).select("doc_id", "line", "kept.kept_doc_id", "kept.kept_line", F.lit(1).alias("edits"))
    return copies.distinct().union(edited)


def without(text: str, gone: list[int]) -> str:
    """A text without the lines of these numbers."""
    drop = set(gone)
    return "\n".join(line for k, line in enumerate(text.split("\n")) if k not in drop)


def _by_document(dropped: DataFrame, of: str = "_of", name: str = "_dropped") -> DataFrame:
    return dropped.groupBy(F.col("doc_id").alias(of)).agg(F.sort_array(F.collect_list(F.struct("line", "kept_doc_id", "kept_line", "edits"))).alias(name))


def told(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_lines, n_kept, kept_sha256, dropped.

    ``dropped`` lists ``line>kept_doc_id:kept_line/edits`` by line; kept_sha256 is of the text
    without those lines, of the empty text for a null one. Repeated rows are told each by itself, as one document whose
    lines count once, so neither drops the other's; rows without a doc_id keep all lines; an empty table gives no rows, other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = slim.join(_by_document(repeated_lines(docs, **options)), slim.doc_id == F.col("_of"), "left").select("doc_id", "text", "_dropped")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, text, gone in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_dropped"))):
            n = len(text.split("\n")) if text is not None else 0
            kept = without(text or "", [g["line"] for g in gone or []])
            rows.append((doc, n, n - len(gone or []), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), ",".join(f"{g['line']}>{g['kept_doc_id']}:{g['kept_line']}/{g['edits']}" for g in gone or [])))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        cols = zip(*rows) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "n_lines", "n_kept", "kept_sha256", "dropped"])

    return joined.mapInArrow(by_batch(fn), "doc_id long, n_lines long, n_kept long, kept_sha256 string, dropped string")


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` with the repeated lines taken out of ``text``, and ``n_chars`` set to the new length where there is one.

    A document all of whose words stood in repeated lines has nothing of its own: its row goes. A
    document that had no words before stays as it is, as do null texts and rows without a doc_id. Repeated rows lose the same lines, and stay or go
    together; further columns are kept, whatever their names; an empty table gives no rows.
    """
    names = docs.columns
    of, name = fresh(docs, "_of"), fresh(docs, "_dropped")
    joined = docs.join(_by_document(repeated_lines(docs, **options), of, name), docs["doc_id"] == F.col(of), "left").drop(of)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        old, gone = batch.column("text").to_pylist(), batch.column(name).to_pylist()
        new = [without(t, [g["line"] for g in d]) if d else t for t, d in zip(old, gone)]
        cols = {c: batch.column(c) for c in names}
        cols["text"] = pa.array(new, batch.schema.field("text").type)
        if "n_chars" in cols:
            cols["n_chars"] = pa.array([len(t) if d else n for t, d, n in zip(new, gone, cols["n_chars"].to_pylist())], batch.schema.field("n_chars").type)
        keep = pa.array([not d or bool(t.strip()) for t, d in zip(new, gone)], pa.bool_())
        return pa.RecordBatch.from_arrays(list(cols.values()), names=names).filter(keep)

    return joined.mapInArrow(by_batch(fn), docs.schema)

"""SimHash near-duplicate groups by anchor-point covering (operator 11)."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from netloom.llm.text import by_batch, by_group
from netloom.operators.components import checkpointed, components, rekeyed

#: Words of a shingle, seed of its hash, and bits in which linked fingerprints differ at most.
N, SEED, THRESHOLD = 4, 42, 4
#: Fingerprints of a unit of comparison: those at home and those visiting; comparisons held at once, visits made at once.
HOME, VISIT, CELLS, VISITS = 4096, 65536, 1 << 20, 2_000_000


def fingerprint(text: str | None, n: int = N, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a whole text.

    A-Z become a-z; words are what blanks and the characters 9 to 13 part. A bit is 1 if it is in
    more than half of the hashes of all n-word shingles, repeats included. Of fewer words the whole
    sequence is the one shingle; a text without words, or a null one, has fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes know only ASCII letters and these six blanks
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-n] + 1])
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[n - 1 :].tolist())), "<u8", len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@dataclass(frozen=True)
class Perfect:
    """A perfect cyclic code: each word of ``length`` bits lies within ``radius`` of exactly one codeword.

    A codeword is a multiple of the polynomial ``generator`` over two elements and is named by its
    leading bits. Words with the same remainder by the generator (syndrome) see all codewords alike.
    """

    length: int
    generator: int
    radius: int

    @property
    def check(self) -> int:
        return self.generator.bit_length() - 1

    @property
    def named(self) -> int:
        return self.length - self.check

    def syndromes(self, words: np.ndarray) -> np.ndarray:
        out, power = np.zeros(len(words), np.uint64), 1
        for i in range(self.length):
            out ^= ((words >> np.uint64(i)) & np.uint64(1)) * np.uint64(power)
            power <<= 1
            if power >> self.check:
                power ^= self.generator
        return out.astype(np.int64)

    def within(self, distance: int) -> float:
        """Codewords within a distance of a word, on average."""
        return sum(math.comb(self.length, d) for d in range(distance + 1)) / 2**self.check


#: The binary Golay code of 23 bits and the Hamming code of 7.
GOLAY, HAMMING = Perfect(23, 0b110001110101, 3), Perfect(7, 0b1011, 1)
#: Covering codes as products of perfect ones on neighbouring bits, by number of anchors.
CODES = ((GOLAY,), (GOLAY, HAMMING), (GOLAY, HAMMING, HAMMING), (GOLAY, GOLAY), (GOLAY, GOLAY, HAMMING), (GOLAY, GOLAY, HAMMING, HAMMING))


@functools.cache
def _table(code: Perfect, threshold: int):
    """(start, upto, name, cost): by syndrome, the differences from a word to the codewords within radius plus threshold.

    ``cost`` is what such a codeword is further away than the radius, ``upto[s, c]`` counts those of cost c at most.
    """
    z = np.arange(1 << code.length, dtype=np.uint32)
    z = z[np.bitwise_count(z) <= code.radius + threshold].astype(np.uint64)
    cost = np.maximum(np.bitwise_count(z).astype(np.int64) - code.radius, 0)
    s = code.syndromes(z)
    order = np.lexsort((cost, s))
    z, cost, s = z[order], cost[order], s[order]
    counts = np.zeros((1 << code.check, threshold + 1), np.int64)
    np.add.at(counts, (s, cost), 1)
    upto = counts.cumsum(1)
    return np.concatenate([[0], upto[:-1, -1].cumsum()]), upto, z >> np.uint64(code.check), cost


def replicas(codes: tuple[Perfect, ...], threshold: int) -> float:
    """Anchors that a fingerprint visits, on average over all fingerprints."""
    spread = np.array([1.0])
    for code in codes:
        rings = np.array([code.within(code.radius + j) for j in range(threshold + 1)])
        spread = np.convolve(spread, np.diff(rings, prepend=0))[: threshold + 1]
    return float(spread.sum())


def covering(prints: int, threshold: int = THRESHOLD) -> tuple[Perfect, ...]:
    """The code for a number of distinct fingerprints: the one with the least estimated work, in seconds.

    More anchors mean fewer comparisons for more replicas, and smaller rows. The links found are the same with every code.
    """

    def work(codes):
        copies, anchors = replicas(codes, threshold), 2 ** sum(c.named for c in codes)
        rows = prints * copies / max(1, VISITS / anchors)  # a batch makes one of all that it has at an anchor
        return prints * copies * 60e-9 + rows * 3e-6 + prints**2 * copies / anchors * 1.5e-9 + min(anchors, prints * copies) * 150e-6

    return min(CODES, key=work)


def visits(prints: np.ndarray, codes: tuple[Perfect, ...], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, anchor, home) of every anchor that a fingerprint goes to.

    An anchor is a codeword of the product. A fingerprint is at home at the anchor whose parts are
    nearest to its own, at most the covering radius (the sum of the parts') away. It visits every
    anchor at which a fingerprint within the threshold can be at home: those whose parts are, in
    all, no more than the threshold further away than their radii; all lie within radius plus threshold.
    """
    at = np.arange(len(prints))
    anchor, left, shift = np.zeros(len(prints), np.uint64), np.full(len(prints), threshold), 0
    for code in codes:
        word = (prints >> np.uint64(shift)) & np.uint64((1 << code.length) - 1)
        start, upto, name, cost = _table(code, threshold)
        s = code.syndromes(word)[at]
        n = upto[s, left]
        of = np.repeat(np.arange(len(at)), n)
        entry = np.repeat(start[s] - (np.cumsum(n) - n), n) + np.arange(len(of))
        anchor = (anchor[of] << np.uint64(code.named)) | ((word >> np.uint64(code.check))[at[of]] ^ name[entry])
        left, at, shift = left[of] - cost[entry], at[of], shift + code.length
    return at, anchor, left == threshold


def _prints(n: int, seed: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, n, seed) for t in batch.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "print"])

    return by_batch(fn)


def _at_anchors(codes: tuple[Perfect, ...], threshold: int, counted: bool):
    """Rows of (anchor, home, fingerprints), one for all that a batch has there; or only how many."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = batch.column("print").to_numpy().view(np.uint64)
        at, anchor, own = visits(prints, codes, threshold)
        out = []
        for home in (True, False):
            i, a = (at[own], anchor[own]) if home else (at, anchor)
            order = np.argsort(a, kind="stable")
            i, a = i[order], a[order]
            ends = np.append(np.flatnonzero(a[1:] != a[:-1]) + 1, len(a))
            starts = np.concatenate([[0], ends[:-1]])
            cols = [pa.array(a[starts].view(np.int64)), pa.array(np.full(len(starts), home))]
            if counted:
                cols.append(pa.array(ends - starts))
            else:
                offsets = pa.py_buffer(np.concatenate([[0], ends * 8]).astype(np.int32))
                cols.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(prints[i])]))
            out.append(pa.RecordBatch.from_arrays(cols, ["anchor", "home", "n" if counted else "prints"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return by_batch(fn, max(1, int(VISITS / replicas(codes, threshold))))


def united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let each a and b have the same root: the least of both trees; roots point to themselves."""
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root[:] = root[root]


def _links(threshold: int):
    def fn(group: pa.Table) -> pa.RecordBatch | None:
        home = group.column("home").to_numpy()
        data = group.column("prints").to_pylist()
        own, seen = (np.unique(np.frombuffer(b"".join(d for d, h in zip(data, home) if h == side), np.uint64)) for side in (True, False))
        if not len(own) or not len(seen):
            return None
        names = np.union1d(own, seen)
        root, i, j = np.arange(len(names)), np.searchsorted(names, own), np.searchsorted(names, seen)
        step = max(1, CELLS // len(seen))
        for k in range(0, len(own), step):
            some = own[k : k + step, None]
            a, b = np.nonzero((np.bitwise_count(some ^ seen) <= threshold) & (some < seen))
            united(root, i[k + a], j[b])
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([pa.array(names[moved].view(np.int64)), pa.array(names[root[moved]].view(np.int64))], ["src", "dst"])

    return by_group(["anchor", "i", "j"], fn)


def links(prints: DataFrame, threshold: int = THRESHOLD, codes: tuple[Perfect, ...] | None = None, home: int = HOME, visit: int = VISIT) -> DataFrame:
    """``(src, dst)`` of distinct ``prints(print)``: edges that join the fingerprints that differ in ``threshold`` bits or fewer, directly or by others.

    Every fingerprint goes to its anchors, packed by batch; an anchor's fingerprints at home are
    compared with its visitors. An anchor with more than ``home`` and ``visit`` of them is dealt
    in blocks, each pair of blocks a unit of its own, so a hot anchor is spread over many tasks. A
    unit returns a spanning forest of what it links, never its pairs.
    """
    prints = prints.select("print")
    codes = codes or covering(prints.count(), threshold)
    sizes = prints.mapInArrow(_at_anchors(codes, threshold, True), "anchor long, home boolean, n long")
    sizes = sizes.groupBy("anchor").agg(F.sum(F.when(F.col("home"), F.col("n"))).alias("homes"), F.sum(F.when(~F.col("home"), F.col("n"))).alias("visitors"))
    large = sizes.where((F.col("homes") > home) | (F.col("visitors") > visit) & F.col("homes").isNotNull())
    large = checkpointed(large.select("anchor", F.ceil(F.col("homes") / home).cast("int").alias("rows"), F.ceil(F.col("visitors") / visit).cast("int").alias("columns")))
    placed = prints.mapInArrow(_at_anchors(codes, threshold, False), "anchor long, home boolean, prints binary").join(large, "anchor", "left")
    rows, columns = F.coalesce("rows", F.lit(1)), F.coalesce("columns", F.lit(1))
    block = F.pmod(F.xxhash64("prints"), F.when(F.col("home"), rows).otherwise(columns)).cast("int")
    across = F.explode(F.sequence(F.lit(0), F.when(F.col("home"), columns).otherwise(rows) - 1))
    units = placed.select("anchor", "home", "prints", block.alias("block"), across.alias("other"))
    units = units.select("anchor", F.when(F.col("home"), F.col("block")).otherwise(F.col("other")).alias("i"), F.when(F.col("home"), F.col("other")).otherwise(F.col("block")).alias("j"), "home", "prints")
    units = units.repartition(F.col("anchor"), F.col("i"), F.col("j")).sortWithinPartitions("anchor", "i", "j")
    return units.mapInArrow(_links(threshold), "src long, dst long").distinct()


def near_groups(docs: DataFrame, n: int = N, seed: int = SEED, threshold: int = THRESHOLD, **options) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, fingerprint, component_id.

    ``fingerprint`` (see there) is told in 16 hexadecimal digits. Documents whose fingerprints
    differ in ``threshold`` bits or fewer are linked, those without words included (fingerprint
    zero); ``component_id`` is the least doc_id that links lead to. Equal fingerprints fold into one
    before any comparison, so copies cost nothing further; ``options`` go to ``links``.

    Null texts count as empty. Rows with a null doc_id keep their fingerprint, have a null
    component_id and link nothing. Rows that share a doc_id are one document: what any of its texts
    is linked to belongs together. Texts may be of any length, other columns are ignored, and an empty
    table gives no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = checkpointed(slim.mapInArrow(_prints(n, seed), "doc_id long, print long"))
    usable = rows.where("doc_id is not null")
    nodes = checkpointed(usable.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    bonds = links(nodes, threshold, **options)
    shared = usable.distinct().groupBy("doc_id").agg(F.min("print").alias("dst"), F.max("print").alias("top")).where("dst < top").select("doc_id", "dst")
    if shared.limit(1).count():
        bonds = bonds.union(usable.join(rekeyed(shared, "doc_id"), "doc_id").where("print <> dst").select(F.col("print").alias("src"), "dst"))
    linked = nodes.join(components(bonds, most=max(1, nodes.count())).select(F.col("node").alias("print"), "component"), "print")
    first = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    told = nodes.where("copies > 1").join(linked.select("print"), "print", "left_anti").select("print", F.col("least").alias("component_id"))
    told = told.union(linked.join(rekeyed(first, "component"), "component").select("print", "component_id"))
    found = rows.join(rekeyed(told, "print"), "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), component)

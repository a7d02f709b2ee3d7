"""SentencePiece encoding and decoding over a suffix array (operator 7).

The text is cut where no piece can reach across: before a word mark that follows another
character. The distinct stretches of a batch are laid out in one array, the array's suffixes are
sorted as deep as the longest piece, and each piece of the vocabulary finds all its occurrences as
one range by binary search. These occurrences are the edges of a lattice; sorted by where they end
they are relaxed from left to right, all stretches at once. A byte-pair model prefers no path by weight: of all paths the
right one is that in which every two neighbours are pieces that merging would have left side by
side, and there is just one way to reach each position so. Relaxing keeps that one. It depends on
nothing behind the position, so stretches that begin alike share their positions up to where they part.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from netloom.llm.text import Memo, forgettable, owned

MARK = "▁"
#: Characters of the array of one pass, and stretches that a worker keeps, in two generations.
PASS, KEPT = 400_000, 700_000
#: Positions of one depth below which they are relaxed one by one.
NARROW = 64
_START, _NONE = -1, -2
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Joints:
    """The rank of the piece that two tokens make together, for many pairs at once: a table of open addresses."""

    def __init__(self, found: dict[int, int], none: int):
        self.none, self.bits = none, max(4, (2 * len(found)).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, none, np.int64)
        keys, ranks = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        at = self._slot(keys)
        while len(keys):
            first = np.unique(at, return_index=True)[1]
            first = first[self.keys[at[first]] < 0]
            self.keys[at[first]], self.ranks[at[first]] = keys[first], ranks[first]
            rest = self.keys[at] != keys
            keys, ranks, at = keys[rest], ranks[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out, got = self.ranks[at], self.keys[at]
        todo = np.flatnonzero((got != keys) & (got >= 0))
        out[got != keys] = self.none
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            got = self.keys[at[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
        return out


class _Apart:
    """Whether merging leaves two neighbouring tokens side by side: none of the pairs that met at their border, back to the characters, came first.

    Asked for many pairs at once. Answers are kept in a table of a fixed size, where one answer may take another's place.
    """

    BITS = 19

    def __init__(self, model: "Pieces"):
        n, index = model.first_char, model.index
        ids = dict(index)
        for p in index:  # a character that is no piece, but is part of one, has a number here as well
            for c in p:
                ids.setdefault(c, n + len(ids))
        self.bare = {ord(c): i for c, i in ids.items() if i >= n}
        self.size = max(ids.values(), default=0) + 2
        self.other = self.size - 1  # a character that no piece has
        self.none = 1 << 40
        self.rank = np.full(self.size, -1, np.int64)
        self.first, self.second = np.full(self.size, self.other), np.full(self.size, self.other)
        for i, (a, b) in model.halves.items():
            self.rank[i], self.first[i], self.second[i] = model.rank[i], ids[a], ids[b]
        joints = {ids[p[:k]] * self.size + ids[p[k:]]: model.rank[i] for p, i in index.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.joint, self.joints, self.start = joints, _Joints(joints, self.none), n
        self.known = np.full(1 << self.BITS, -1, np.int64)
        forgettable(lambda: self.known.fill(-1))
        self.single = Memo(lambda pair: self.one(*pair))

    def numbers(self, tokens: np.ndarray) -> np.ndarray:
        """Tokens with single characters, told by ``first_char`` and more, turned into numbers of these tables."""
        if not len(tokens) or tokens.max() < self.start:
            return tokens
        return np.where(tokens < self.start, tokens, [self.bare.get(t - self.start, self.other) for t in tokens.tolist()])

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        left, right = self.numbers(left), self.numbers(right)
        keys = left * self.size + right
        at = ((keys.view(np.uint64) * _MIX) >> np.uint64(64 - self.BITS)).astype(np.int64)
        kept = self.known[at]
        out = (kept & 1).astype(bool)
        ask = np.flatnonzero(kept >> 1 != keys)
        if len(ask):
            out[ask] = found = self.found(left[ask], right[ask])
            self.known[at[ask]] = keys[ask] << 1 | found
        return out

    def one(self, left: int, right: int) -> bool:
        """The answer for a single pair, where an array would cost more than it saves."""
        left, right = (t if t < self.start else self.bare.get(t - self.start, self.other) for t in (left, right))
        limit, by_left = self.none - 1, False
        while True:
            joint = self.joint.get(left * self.size + right, self.none)
            if joint < limit or joint == limit and not by_left:
                return False
            r1, r2 = int(self.rank[left]), int(self.rank[right])
            if r1 < 0 and r2 < 0:
                return True
            limit, by_left = max(r1, r2), r1 > r2
            if by_left:
                left = int(self.second[left])
            else:
                right = int(self.first[right])

    def found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.zeros(len(left), bool)
        at = np.arange(len(left))
        limit, by_left = np.full(len(left), self.none - 1), np.zeros(len(left), bool)
        while len(at):
            joint = self.joints(left * self.size + right)
            stay = (joint > limit) | ((joint == limit) & by_left)
            r1, r2 = self.rank[left], self.rank[right]
            out[at[stay & (r1 < 0) & (r2 < 0)]] = True
            go = np.flatnonzero(stay & ((r1 >= 0) | (r2 >= 0)))
            at, left, right, r1, r2 = at[go], left[go], right[go], r1[go], r2[go]
            by_left = r1 > r2
            limit = np.maximum(r1, r2)
            left, right = np.where(by_left, self.second[left], left), np.where(by_left, right, self.first[right])
        return out


class Pieces:
    """A byte-pair SentencePiece model with byte fallback: whole-text ids, and text from ids."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.unknown, self.byte, scores = sp.unk_id(), {}, {}
        self.index: dict[str, int] = {}
        self.strings: list[str] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            self.strings.append(piece)
            if sp.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.index[piece] = i
                scores[i] = sp.get_score(i)
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {i: order[s] for i, s in scores.items()}
        self.longest = max(map(len, self.index))
        self.inner_mark = any(MARK in p.lstrip(MARK) for p in self.index)
        self.feed_alone = not any("\n" in p for p in self.index)
        self.first_char = n  # tokens from here on are single characters
        self.bound = {a for p in self.index for a, b in zip(p, p[1:]) if b in ".,"}
        self.halves: dict[int, tuple[str, str]] = {}
        self.sound = np.zeros(n, bool)
        for p, i in self.index.items():
            got, last = self._merge(p)
            self.sound[i] = len(got) == 1
            if last and len(got) == 1:
                self.halves[i] = last
        self.apart = _Apart(self)
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        forgettable(self.forget)
        listed = sorted(self.index.items(), key=lambda x: x[1])
        self.piece_ids = np.array([i for _, i in listed])
        self.piece_lens = np.array([len(p) for p, _ in listed])
        self.piece_codes = np.zeros((len(listed), self.longest), np.uint32)
        for k, (p, _) in enumerate(listed):
            self.piece_codes[k, : len(p)] = [ord(c) for c in p]
        self.plain: list[bytes | None] = [p.replace(MARK, " ").encode() for p in self.strings]
        for b, i in self.byte.items():
            self.plain[i] = bytes([b])
        for i in range(n):
            if sp.is_control(i):
                self.plain[i] = b""
            elif sp.is_unknown(i):
                self.plain[i] = " ⁇ ".encode()

    # merging as the model defines it: for pieces at load, and for runs of blanks, whose pieces all weigh the same

    def _token(self, s: str) -> int:
        return self.index.get(s) if s in self.index else self.first_char + ord(s)

    def _merge(self, s: str) -> tuple[list[str], tuple[str, str] | None]:
        """The pieces and single characters that merging leaves of a string, and the last two that merged."""
        part: list[str | None] = list(s)
        after, before = list(range(1, len(s) + 1)), list(range(-1, len(s) - 1))
        heap: list[tuple[int, int, str, str]] = []
        last = None

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(part) and (k := self.index.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (self.rank[k], i, part[i], part[j]))

        for i in range(len(s) - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if part[i] is not None else len(part)
            if part[i] != a or j >= len(part) or part[j] != b:
                continue
            last = (a, b)
            part[i], part[j] = a + b, None
            after[i] = after[j]
            if after[j] < len(part):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in part if p is not None], last

    def forget(self) -> None:
        self.ids, self.older = {}, {}

    # the lattice

    def occurrences(self, ids: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, token) of every piece in an array of character numbers, by a suffix array and binary search."""
        depth, n = self.longest, len(ids)
        bits = 8 if len(alphabet) < 255 else 16 if len(alphabet) < 65_535 else 21
        per = 64 // bits
        words = -(-depth // per)
        padded = np.concatenate([ids, np.zeros(words * per, np.uint64)])
        packed = []
        for j in range(words):
            w = np.zeros(n, np.uint64)
            for c in range(per):
                w = (w << np.uint64(bits)) | padded[j * per + c : j * per + c + n]
            packed.append(w)
        suffixes = np.lexsort(packed[::-1])
        packed = [w[suffixes] for w in packed]
        at = np.searchsorted(alphabet, self.piece_codes)
        at[at == len(alphabet)] = 0
        known = (alphabet[at] == self.piece_codes) | (self.piece_codes == 0) if len(alphabet) else np.zeros_like(self.piece_codes, bool)
        rows = np.flatnonzero(known.all(1) & self.sound[self.piece_ids])
        lens = self.piece_lens[rows]
        codes = np.where(np.arange(depth) < lens[:, None], at[rows] + 1, 0).astype(np.uint64)
        codes = np.pad(codes, ((0, 0), (0, words * per - depth)))
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), n, np.int64)
        top = np.uint64((1 << bits) - 1)
        for j in range(words):
            live = np.flatnonzero((lens > j * per) & (lo < hi))
            if not len(live):
                break
            low, high = np.zeros(len(live), np.uint64), np.zeros(len(live), np.uint64)
            for c in range(j * per, (j + 1) * per):
                x = codes[live, c]
                low = (low << np.uint64(bits)) | x
                high = (high << np.uint64(bits)) | np.where(lens[live] > c, x, top)
            lo[live], hi[live] = _between(packed[j], low, lo[live], hi[live], False), _between(packed[j], high, lo[live], hi[live], True)
        count = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(rows)), count)
        rank = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which]
        return suffixes[rank], lens[which], self.piece_ids[rows][which]

    def _learn(self, stretches: list[str]) -> None:
        """Put the ids of sorted distinct stretches into the memo."""
        joined = "\0".join(stretches) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.fromiter(map(len, stretches), np.int64, len(stretches))
        ends = np.cumsum(lens + 1) - 1
        begins = ends - lens
        inside = np.ones(len(codes), bool)
        inside[ends] = False
        alphabet = np.unique(codes[inside])
        ids = np.where(inside, np.searchsorted(alphabet, codes) + 1, 0).astype(np.uint64)
        start, length, token = self.occurrences(ids, alphabet)
        bare = np.ones(len(codes), bool)  # characters that are no piece
        bare[ends] = False
        bare[start[length == 1]] = False
        node, new, order, depth = _shared(ids, begins, lens)
        bare = np.flatnonzero(bare[:-1] & new[1:])
        place = np.empty(len(codes), np.int64)
        place[order] = np.arange(len(codes))
        keep = new[start + length]
        end = np.concatenate([(start + length)[keep], bare + 1])
        size = np.concatenate([length[keep], np.ones(len(bare), np.int64)])
        token = np.concatenate([token[keep], codes[bare].astype(np.int64) + self.first_char])
        by_end = np.argsort(place[end] * (self.longest + 1) + self.longest - size)  # no two edges have both in common
        end, size, token = end[by_end], size[by_end], token[by_end]
        best, come = self._relax(node[end - size], end, token, depth[end], np.full(len(codes), _NONE), begins)
        self._tell(stretches, node[ends], lens, best, come)

    def _relax(self, start: np.ndarray, end: np.ndarray, token: np.ndarray, depth: np.ndarray, best: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last token, where it begins) of each position that edges, sorted by depth, end and descending length, lead to."""
        come = np.zeros(len(best), np.int64)
        best[begins] = _START
        first = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]])) if len(end) else np.zeros(0, np.int64)
        waves = np.searchsorted(depth[first], np.arange(1, (int(depth[-1]) if len(depth) else 0) + 2))
        last = np.append(first, len(end))[1:]
        wide = np.flatnonzero(np.diff(waves) >= NARROW)
        broad = int(wide[-1]) + 1 if len(wide) else 0
        for a, b in zip(waves[:broad].tolist(), waves[1 : broad + 1].tolist()):
            at, stop = first[a:b], last[a:b]
            while len(at):
                left, right = best[start[at]], token[at]
                ok = left == _START
                ask = np.flatnonzero(left >= 0)
                ok[ask] = self.apart(left[ask], right[ask])
                hit = at[ok]
                best[end[hit]], come[end[hit]] = right[ok], start[hit]
                at, stop = at[~ok] + 1, stop[~ok]
                at, stop = at[at < stop], stop[at < stop]
        if broad + 1 < len(waves):  # only a few long stretches are left: one position after the other
            begin = int(first[waves[broad]])
            one, two = best.tolist(), come.tolist()
            for s, e, t in zip(start[begin:].tolist(), end[begin:].tolist(), token[begin:].tolist()):
                if one[e] == _NONE:
                    left = one[s]
                    if left == _START or left >= 0 and self.apart.single[left, t]:
                        one[e], two[e] = t, s
            best, come = np.array(one), np.array(two)
        return best, come

    def _tell(self, stretches: list[str], at: np.ndarray, lens: np.ndarray, best: np.ndarray, come: np.ndarray) -> None:
        """Follow each stretch's path back from its end and keep its ids."""
        lost = np.flatnonzero(best[at] == _NONE)
        if len(lost):
            raise AssertionError(f"no path through {stretches[lost[0]][:50]!r}")
        who, columns = np.arange(len(stretches)), []
        while len(who) >= NARROW:
            columns.append((who, best[at]))
            at = come[at]
            more = best[at] != _START
            who, at = who[more], at[more]
        for w, p in zip(who.tolist(), at.tolist()):
            tokens = []
            while best[p] != _START:
                tokens.append(int(best[p]))
                p = come[p]
            columns.append((np.full(len(tokens), w), np.array(tokens, np.int64)))
        owner = np.concatenate([c[0] for c in columns])[::-1]
        tokens = np.concatenate([c[1] for c in columns])[::-1]
        by_owner = np.argsort(owner, kind="stable")
        tokens = tokens[by_owner]
        cuts = np.searchsorted(owner[by_owner], np.arange(len(stretches) + 1))
        raw, cut = tokens.astype("<u4").tobytes(), (4 * cuts).tolist()
        self.ids.update(zip(stretches, [raw[a:b] for a, b in zip(cut, cut[1:])]))
        for w in np.unique(owner[by_owner][tokens >= self.first_char]).tolist():
            self.ids[stretches[w]] = self._bytes(tokens[cuts[w] : cuts[w + 1]].tolist())

    def _bytes(self, tokens: list[int]) -> bytes:
        out: list[int] = []
        for t in tokens:
            if t < self.first_char:
                out.append(t)
            elif self.byte:
                out += (self.byte[b] for b in chr(t - self.first_char).encode("utf-8", "surrogatepass"))
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, "<u4").tobytes()

    def stretches(self, text: str) -> list[str]:
        """What a text is cut into, with blanks turned into marks and one mark put before it."""
        if not text:
            return []
        if self.inner_mark:
            return [MARK + text.replace(" ", MARK)]
        if not self.feed_alone or MARK in text or "  " in text or text[0] == " ":
            return re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", MARK + text.replace(" ", MARK))
        return (MARK + text.replace(" ", " " + MARK).replace("\n", " \n ")).split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        if len(self.ids) > KEPT // 2:
            self.ids, self.older = {}, self.ids
        ids, older = self.ids, self.older
        ids[""] = b""
        cut = [self.stretches(t) for t in texts]
        new = set().union(*cut).difference(ids)
        if older:
            again = new.intersection(older)
            ids.update(zip(again, map(older.__getitem__, again)))
            new -= again
        # no piece reaches from a letter to a stop or comma behind it, but from those in bound
        marked = [s for s in new if s[-1] in ".," and len(s) > 2 and s[-2].isalpha() and s[-2] not in self.bound and s[:2] != MARK * 2]
        todo = sorted(new.difference(marked).union([s[:-1] for s in marked], ".,").difference(ids))
        part, room = [], PASS
        for s in todo:
            if s[:2] == MARK * 2:  # pieces of blanks alone all weigh the same: merged as defined
                ids[s] = self._bytes([self._token(p) for p in self._merge(s)[0]])
                continue
            room -= len(s) + 1
            if room < 0 and part:
                self._learn(part)
                part, room = [], PASS - len(s) - 1
            part.append(s)
        if part:
            self._learn(part)
        for s in marked:
            ids[s] = ids[s[:-1]] + ids[s[-1]]
        return [b"".join(map(ids.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces with marks as blanks, without the one put before; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.plain.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")


def _shared(ids: np.ndarray, begins: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(stands for, is first, order by depth, depth) of each position of sorted stretches: one for all that follow the same prefix."""
    n = len(ids)
    owner = np.repeat(np.arange(len(begins)), lens + 1)
    depth = np.arange(n) - begins[owner]
    before = np.concatenate([[begins[0]], begins[:-1]])  # the stretch before; the first one shares nothing
    differ = ids != ids[np.minimum(before[owner] + depth, n - 1)]
    common = np.minimum.reduceat(np.where(differ, depth, n), begins)
    common[0] = -1
    new = depth > common[owner]
    order = np.argsort(depth.astype(np.uint16) if int(lens.max()) < 1 << 16 else depth, kind="stable")
    first = np.maximum.accumulate(np.where(new[order], np.arange(n), 0))
    node = np.empty(n, np.int64)
    node[order] = order[first]
    return node, new, order, depth


def _between(words: np.ndarray, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """For each key its place in the sorted slice ``words[lo:hi]``, all keys at once."""
    lo, hi = lo.copy(), hi.copy()
    while (live := lo < hi).any():
        mid = (lo + hi) // 2
        v = words[np.minimum(mid, len(words) - 1)]
        up = live & ((v <= keys) if right else (v < keys))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(live & ~up, mid, hi)
    return lo


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


SCHEMA = "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_sha256 string, same boolean"


def encoded(docs: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text): the whole text's ids by the model file, told and decoded again.

    ids_crc32 is of the ids as little-endian unsigned 32-bit numbers, n_byte_tokens counts ids that
    stand for bytes, ``same`` says whether decoding gives the text back (it can't where a text has
    the mark itself). A null text is empty: no ids. ``keep`` adds the ``ids``. Other columns are ignored.
    Texts may be of any length, repeated rows are told each by itself, and an empty table gives no rows.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = pieces(path)
        spell = np.zeros(len(model.strings), bool)
        spell[list(model.byte.values())] = True
        texts = [t or "" for t in batch.column("text").to_pylist()]
        ids = model.encode(texts)
        numbers = [np.frombuffer(b, "<u4") for b in ids]
        back = [model.decode(b) for b in ids]
        cols = [
            pa.array([len(x) for x in numbers], pa.int64()),
            pa.array([int(spell[x].sum()) for x in numbers], pa.int64()),
            pa.array([zlib.crc32(b) for b in ids], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back], pa.string()),
            pa.array([a == b for a, b in zip(texts, back)], pa.bool_()),
        ]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        if keep:
            cols.append(pa.array([x.astype(np.int32).tolist() for x in numbers], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names)

    def run(batches):
        owned(__name__)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                yield rows(batch.slice(at, 1024))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, SCHEMA + (", ids array<int>" if keep else ""))

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from netloom.llm import simhash
from netloom.llm.simhash import CODES, GOLAY, HAMMING, covering, fingerprint, links, near_groups, replicas, visits

SCHEMA = "doc_id long, text string, PRINT string, Component int"


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_groups(rows):
    """(doc_id, fingerprint, component) of each row, by all pairs."""
    prints = [plain_print(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and ((prints[i] ^ prints[j]).bit_count() <= 4 or rows[i][0] == rows[j][0]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((repr(r[0]), f"{p:016x}", repr(least[find(i)] if r[0] is not None else None)) for i, (r, p) in enumerate(zip(rows, prints)))


def told(df):
    return sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in df.collect())


def documents(n, seed):
    """Texts with copies that differ in a word or two, among others that don't."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeéß") for _ in range(draw.randint(1, 6)))
    out = []
    for i in range(n):
        if out and draw.random() < 0.5:
            words = draw.choice(out)[1].split(" ")
            for _ in range(draw.randint(0, 2)):
                words[draw.randrange(len(words))] = word()
            text = " ".join(words)
        else:
            text = " ".join(word() for _ in range(draw.choice([1, 3, 4, 5, 40, 150])))
        out.append((i, text, "x", 1))
    draw.shuffle(out)
    return out


@pytest.mark.parametrize("code", [GOLAY, HAMMING])
def test_codes_are_perfect(code):
    """Every syndrome has one word of weight up to the radius, so every word one codeword within it."""
    z = np.arange(1 << code.length, dtype=np.uint32)
    z = z[np.bitwise_count(z) <= code.radius].astype(np.uint64)
    assert sorted(code.syndromes(z).tolist()) == list(range(1 << code.check))
    assert code.within(code.radius) == 1


@pytest.mark.parametrize("codes", CODES, ids=len)
def test_near_prints_meet(codes):
    """What differs in up to four bits visits the home of the other; an anchor's distance stays within radius plus threshold."""
    draw = np.random.default_rng(len(codes))
    a = draw.integers(0, 2**64, 40, dtype=np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for bit in draw.choice(64, draw.integers(0, 5), replace=False):
            b[k] ^= np.uint64(1) << np.uint64(bit)
    at, anchor, home = visits(a, codes, 4)
    assert sorted(at[home].tolist()) == list(range(40))
    at_b, anchor_b, _ = visits(b, codes, 4)
    seen = set(zip(at_b.tolist(), anchor_b.tolist()))
    assert all((i, c) in seen for i, c in zip(at[home].tolist(), anchor[home].tolist()))
    assert len(seen) == len(at_b)
    if len(codes) == 1:
        words = np.arange(1 << 23, dtype=np.uint64)
        words = words[GOLAY.syndromes(words) == 0]
        near = np.bitwise_count(words[words.searchsorted(anchor << np.uint64(11))] ^ (a[at] & np.uint64((1 << 23) - 1)))
        assert near.max() <= 7 and (near[home] <= 3).all()
        assert 0.9 < len(at) / 40 / replicas(codes, 4) < 1.1


def test_more_anchors_for_more_prints():
    assert covering(1000) == (GOLAY,)
    sizes = [sum(c.named for c in covering(10**k)) for k in range(3, 12)]
    assert sizes == sorted(sizes) and sizes[-1] > 20


def test_prints_against_the_plain_form_and_sparks_own_hash(spark):
    texts = ["", None, " \t\n", "A b", "a B c", "One two three four", "one two\x0bthree\x0cfour five six seven", "É é " * 9, "w " * 5000]
    texts += [t for _, t, *_ in documents(60, 3)]
    assert [fingerprint(t) for t in texts] == [plain_print(t) for t in texts]
    text = "the quick brown fox jumps over the lazy dog the quick brown fox"
    words = text.split()
    rows = spark.createDataFrame([(" ".join(words[i : i + 4]),) for i in range(len(words) - 3)], "g string").select(F.xxhash64("g").alias("h")).collect()
    assert fingerprint(text) == sum(1 << k for k in range(64) if 2 * sum((r.h >> k) & 1 for r in rows) > len(rows))


def test_against_all_pairs(spark):
    rows = documents(400, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain_groups(rows)
    for how in ({}, {"home": 3, "visit": 40}, {"codes": (GOLAY, HAMMING)}):
        assert told(near_groups(df, **how)) == want


def test_odd_rows(spark):
    rows = documents(40, 2) + [(None, "some words here and there", None, None), (None, None, None, None), (50, None, None, 1), (51, "", "x", 1), (52, "\t \n", "x", 1)]
    rows += [rows[3], rows[3], (rows[5][0], "another text under an id that is there", "x", 1), (60, "long " * 200_000, "x", 1), (61, "LONG " * 200_000, "x", 1), (-7, "x", "y", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = told(near_groups(df))
    assert got == plain_groups(rows)
    assert told(near_groups(df.limit(0))) == []
    assert near_groups(df).columns == ["doc_id", "fingerprint", "component_id"]


def test_a_hot_anchor_is_dealt_in_blocks(spark):
    """Thousands of different fingerprints around one, all of one component, and a chain that leaves them."""
    draw = np.random.default_rng(5)
    centre = int(draw.integers(0, 2**63))
    found = {centre}
    while len(found) < 3000:
        x = centre
        for bit in draw.choice(63, draw.integers(1, 5), replace=False):
            x ^= 1 << int(bit)
        found.add(x)
    chain = centre
    for bit in range(0, 40, 4):
        chain ^= 0b1111 << bit
        found.add(chain)
    other = [int(x) for x in draw.integers(0, 2**63, 200)]
    df = spark.createDataFrame([(x,) for x in [*found, *other]], "print long").distinct().repartition(4)
    assert df.count() == len({*found, *other})
    edges = [tuple(r) for r in links(df, home=100, visit=500).collect()]
    root = {x: x for x in [*found, *other]}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        assert a != b
        root[top(a)] = top(b)
    assert len({top(x) for x in found}) == 1 and len({top(x) for x in other} - {top(centre)}) == 200
    assert len(edges) < 40 * len(found)


def test_no_pairs_of_copies(spark):
    """A third of all rows alike is one fingerprint in the join."""
    rows = [(i, "the same text in very many rows of the table", "x", 1) for i in range(3000)] + [(5000 + i, f"other words {i} {i * 7} {i * 11} here {i}", "x", 1) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert told(near_groups(df)) == sorted((repr(i), f"{simhash.fingerprint(t):016x}", repr(0 if i < 3000 else i)) for i, t, *_ in rows)

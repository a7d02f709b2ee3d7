import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st

from netloom.llm.packing import nnls, pack, packed, patterns
from netloom.llm.tokens import WordIds, tokenizer

PATH = P.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"
CHARS = ["'", "s", "'s", "S", "É", "é", "ß", "ŉ", "İ", "1", "²", "_", "-", " ", "\n", "\t", "don't", "WE'LL", "...", ", ", ". ", ".\n", "!, ", "’", "€", "<|endoftext|>", "日本", "😀", "\xa0", "\x85", "ς Σ", "word", "Wörter"]


def plain(text):
    return np.array(tokenizer(PATH).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@given(st.lists(st.sampled_from(CHARS), max_size=14))
@settings(max_examples=500, deadline=None)
def test_ids_equal_the_library(parts):
    text = "".join(parts)
    assert WordIds(PATH).batch([text]) == [plain(text)]


def test_a_small_memo_changes_generations(monkeypatch):
    from netloom.llm import tokens

    monkeypatch.setattr(tokens, "KEPT", 20)
    draw = random.Random(2)
    ids = WordIds(PATH)
    for _ in range(300):
        text = " ".join("".join(draw.choices("abcé1'.,", k=draw.randrange(1, 4))) for _ in range(12))
        assert ids.batch([text]) == [plain(text)]
    assert len(ids.words) <= 10 and ids.words.older


def checked(counts, most):
    recipe = pack(counts, most)
    got = Counter()
    for copies, lengths in recipe.runs:
        assert copies > 0 and sum(lengths) <= most
        for x in lengths:
            got[x] += copies
    assert got == Counter({k: v for k, v in counts.items() if v})
    return sum(c for c, _ in recipe.runs)


@given(st.dictionaries(st.integers(1, 2048), st.integers(0, 500), max_size=60))
@settings(max_examples=60, deadline=None)
def test_every_length_is_packed_once(counts):
    checked(counts, 2048)


def test_close_to_the_lower_bound():
    random.seed(1)
    lengths = [min(2048, max(1, int(random.lognormvariate(6.3, 1)))) for _ in range(50_000)]
    n = checked(Counter(lengths), 2048)
    assert n <= 1.002 * -(-sum(lengths) // 2048)
    assert checked({700: 999}, 2048) == 500 and checked({2048: 3, 1: 1}, 2048) == 4 and checked({}, 2048) == 0


def test_against_the_optimum_of_small_cases():
    for seed in range(30):
        random.seed(seed)
        lengths = [random.randint(1, 16) for _ in range(9)]
        best = [len(lengths)]

        def place(i, bins, best=best, lengths=lengths):
            if len(bins) >= best[0]:
                return
            if i == len(lengths):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + lengths[i] <= 16:
                    place(i + 1, bins[:k] + [bins[k] + lengths[i]] + bins[k + 1 :])
            place(i + 1, [*bins, lengths[i]])

        place(0, [])
        assert checked(Counter(lengths), 16) <= best[0] + 1


def test_nnls_and_patterns():
    assert all(sum(p) == 12 and len(p) <= 3 and sorted(p, reverse=True) == list(p) for p in patterns(12, 3))
    assert len(patterns(12, 3)) == len(set(patterns(12, 3))) == 19
    draw = np.random.default_rng(0)
    a = draw.random((12, 20))
    x = nnls(a, a @ np.maximum(draw.standard_normal(20), 0))
    assert (x >= 0).all()
    g = a.T @ (a @ x - a @ x)
    assert np.abs(g[x > 0]).max(initial=0) < 1e-6
    with pytest.raises(ValueError):
        pack({0: 1})


def hold(rows, docs, most):
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id,), []).append(r)
    for seq in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == seq), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= most
    want = Counter()
    for d, t in docs:
        ids = plain(t or "") + b"\0\0\0\0"
        for k, at in enumerate(range(0, len(ids), 4 * most)):
            part = ids[at : at + 4 * most]
            want[d, k, at // 4, len(part) // 4, zlib.crc32(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packed(docs, PATH).collect()
    hold(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert len({r.sequence_id for r in rows}) <= 1.005 * -(-sum(r.length for r in rows) // 2048) + 1


def test_odd_rows(spark):
    docs = [(1, None, 5), (2, "", 6), (2, "", 7), (3, "word " * 700, 8), (None, "a b c", 9), (4, "x", 1), (4, "x", 1)] + [(k, "one two three", 0) for k in range(10, 200)]
    df = spark.createDataFrame(docs, "doc_id long, text string, length long")
    hold(packed(df, PATH, most=64).collect(), [d[:2] for d in docs], 64)
    assert packed(df.limit(0), PATH).count() == 0

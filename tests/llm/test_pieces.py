import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from netloom.llm.piece_lattice import Pieces, encoded

PATH = P.path("piece_bpe_32k.model")
POOL = [" ", "  ", "   ", "\n", "the", "ing", "é", "ß", "日本", "😀", "<s>", "\t", "a", "b", "Th", "ou", ".", ",", ", ", ". ", "²", "=", "==", "▁", "\0", "0", "é", "ﬁ", "　", "\xa0", "----", "____", "!!", "http://"]


@pytest.fixture(scope="module")
def model():
    return Pieces(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@given(parts=st.lists(st.sampled_from(POOL), max_size=16))
@settings(max_examples=300, deadline=None)
def test_equals_the_library(model, library, parts):
    text = "".join(parts)
    ids, = model.encode([text])
    want = library.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert model.decode(ids) == library.decode(want)


def test_every_piece_survives_alone_and_pairs_equal_the_library(model, library):
    random.seed(1)
    pieces = [p.replace("▁", " ") for p in random.sample(sorted(model.index), 3000)]
    texts = pieces + [a + b for a, b in zip(pieces, pieces[1:])]
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)] == library.encode(texts)


def test_occurrences_are_all_there_are(model):
    text = "then the thing hethe"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    alphabet = np.unique(codes)
    start, length, token = model.occurrences(np.searchsorted(alphabet, codes).astype(np.uint64) + np.uint64(1), alphabet)
    want = {(i, i + n, model.index[text[i : i + n]]) for i in range(len(text)) for n in range(1, 17) if i + n <= len(text) and text[i : i + n] in model.index}
    assert set(zip(start.tolist(), (start + length).tolist(), token.tolist())) == want


def test_whole_table_and_odd_rows(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: r for r in encoded(docs, PATH, keep=True).collect()}
    for d, t in docs.collect():
        assert rows[d].ids == library.encode(t) and rows[d].same and rows[d].n_tokens == len(rows[d].ids)
    odd = [(1, None, "x"), (2, "", "y"), (None, "▁ mark", "z"), (3, "long " * 30_000, "u"), (3, "a" * 5_000, "v")]
    got = encoded(spark.createDataFrame(odd, "doc_id long, text string, same string"), PATH).collect()
    assert [r.n_tokens for r in got[:2]] == [0, 0] and got[0].decoded_sha256 == hashlib.sha256(b"").hexdigest() and not got[2].same
    assert [r.n_tokens for r in got[3:]] == [len(library.encode(t)) for _, t, _ in odd[3:]]
    assert encoded(docs.limit(0), PATH).count() == 0


def test_long_stretches_and_a_small_memo(library, monkeypatch):
    from netloom.llm import piece_lattice

    monkeypatch.setattr(piece_lattice, "KEPT", 40)
    draw = random.Random(3)
    texts = ["".join(draw.choices("etaoinshrdlu", k=9000)), "".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(4000)), "日本語の漢字" * 900]
    texts += [" ".join("".join(draw.choices("etaoin.,", k=draw.randrange(1, 9))) for _ in range(60)) for _ in range(80)]
    model = Pieces(PATH)
    for at in range(0, len(texts), 7):  # the memo changes generations all the time
        part = texts[at : at + 7]
        assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(part)] == library.encode(part)


def test_one_pair_and_many_pairs_are_told_alike(model):
    draw = np.random.default_rng(4)
    left, right = draw.choice(model.piece_ids, (2, 20_000))
    got = model.apart(left, right)
    assert got.any() and not got.all()
    assert got.tolist() == [model.apart.one(a, b) for a, b in zip(left.tolist(), right.tolist())] == model.apart(left, right).tolist()

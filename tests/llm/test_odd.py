"""Very long texts, and columns whose names clash with an operator's own, in any case."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from netloom.llm import chat, filter_audit, line_dedup, ngram_join, ogg, packing, piece_lattice, pii, queries, quality, secrets_scan, simhash

CLASH = "PRINT Node KEY unit Bands SET block part Digest FIRST kept_line HALVES Spans MEDIA ids Payload PIECE Start sequence_ID of_ _gone _Dropped LINE n_links".split()
TEXTS = ["token=abcdefgh12345678 mail a.b@example.com and more words of this text, one by one", None, "", "some words that stand alone here, and no more than that", "\n\n"]


def table(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, TEXTS[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    return df, df.withColumns({c: F.lit(f"x{c}") for c in CLASH})


def told(df):
    return sorted(repr(tuple(r)) for r in df.collect())


WORD, PIECE = public_tokenizers.path(queries.WORD_FILE), public_tokenizers.path(queries.PIECE_FILE)
FORMS = {
    "op1": ngram_join.near_duplicates, "op3": secrets_scan.scan_secrets, "op6": pii.find_personal, "op7": lambda d: piece_lattice.encoded(d, PIECE), "op8": ogg.as_media,
    "op4": lambda d: packing.packed(d, WORD).select("doc_id", "piece", "start", "length", "ids_crc32"), "op9": line_dedup.told, "op11": simhash.near_groups,
    "op12": lambda d: filter_audit.audit(d, d.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))),
}


@pytest.mark.parametrize("name", FORMS)
def test_names_that_clash_change_nothing(spark, name):
    plain, clashing = table(spark)
    want = told(FORMS[name](plain))
    assert told(FORMS[name](clashing)) == want
    assert told(FORMS[name](clashing.limit(0))) == []


def test_filters_keep_clashing_columns(spark):
    _, clashing = table(spark)
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    for keep in (ngram_join.keep_one, line_dedup.drop_lines, pii.mask_personal, lambda d: quality.keep_good(d, labels.limit(0))):
        got = keep(clashing)
        assert got.columns == clashing.columns and keep(clashing.limit(0)).count() == 0
        assert all(r[c] == f"x{c}" for r in got.collect() for c in CLASH)
    assert quality.keep_good(clashing, labels.limit(0)).count() == 7


def test_a_very_long_text(spark):
    """300,000 words, alone, as an exact copy, and with a word of its own at the end."""
    words = [f"w{k * 7919 % 100_003}" for k in range(300_000)]
    lines = "\n".join(" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000))
    df = spark.createDataFrame([(1, lines), (2, lines), (3, lines + " end"), (4, "a short text of some words")], "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_join.near_duplicates(df).collect()}
    assert [got[k].class_id for k in (1, 2, 3, 4)] == [1, 1, 1, 4] and got[1].n_links == 2
    lost = {r.doc_id: r for r in line_dedup.told(df).collect()}
    assert (lost[1].n_kept, lost[2].n_kept, lost[3].n_kept) == (300, 0, 0) and lost[3].dropped.endswith("/1")
    assert {r.doc_id: r.component_id for r in simhash.near_groups(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_rejected_sides_of_odd_rows(spark):
    rows = [(1, 0, "user", "a", "x"), (1, 1, "assistant", None, "x"), (2, 0, "assistant", "b", "x"), (None, 0, "assistant", "c", "x"), (3, None, "user", "d", "x"), (1, 1, "assistant", None, "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, LAST string")
    assert told(chat.with_rejected(df)) == sorted(repr(t) for t in [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, 0, "assistant", "b")])
    assert told(chat.with_rejected(df.limit(0))) == []

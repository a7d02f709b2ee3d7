import math
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from netloom.llm import quality
from netloom.llm.queries import op2_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op2_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    out = [(got[r.doc_id].predicted, r.quality) for r in labels if got[r.doc_id].held_out]
    assert len(out) > 80 and np.mean([a == b for a, b in out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_weights_don_t_depend_on_held_out_labels_or_order(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    a = quality.train(docs, labels)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(a, quality.train(docs.repartition(7), flipped.orderBy(F.desc("doc_id"))))


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "", "x"), (2, None, "y"), (None, "THE!! END!!", "z"), (1, "plain words here", "u")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    weights = quality.train(docs, none)
    assert not weights.any()
    rows = quality.scored(docs, weights).collect()
    assert len(rows) == 4 and all(r.score == 0.5 for r in rows)
    mixed = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert not quality.train(docs, mixed).any()
    assert quality.keep_good(docs, none).columns == docs.columns
    assert quality.scored(docs.limit(0), weights).count() == 0


def test_ftrl_learns_a_separable_rule():
    draw = np.random.default_rng(0)
    rows = []
    for _ in range(300):
        y = int(draw.random() < 0.5)
        i = np.unique(np.concatenate([[0], draw.integers(10, 200, 20), [5 if y else 6]])).astype(np.int32)
        rows.append((i, np.ones(len(i), np.float32) * 0.5, y))
    w = quality.Ftrl(bits=8).fit(rows)
    assert w[5] > 0 > w[6]


@pytest.mark.parametrize("text", ["", None, "a", "!!", "x " * 50_000])
def test_features_of_any_text(text):
    i, x = quality.features(text)
    assert len(i) == len(x) == len(set(i.tolist())) and np.isfinite(x).all() and i[0] == 0


def plain_features(text, bits=18):
    """The same n-grams, one after the other in whole numbers."""
    top = 2**64 - 1

    def mixed(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & top
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & top
        return x ^ x >> 31

    tokens = quality.TOKEN.findall(text or "")
    words = [xxhash.xxh64_intdigest(t.lower()) for t in tokens]
    shapes = [xxhash.xxh64_intdigest(quality._shape(t), 1) for t in tokens]
    found = Counter(words) + Counter(shapes)
    for a, b in zip(words, words[1:]):
        found[7 if a == b else mixed((3 * a + b) & top)] += 1
    pairs = [mixed((5 * a + b) & top) for a, b in zip(shapes, shapes[1:])]
    found.update(pairs)
    found.update(mixed((7 * p + c) & top) for p, c in zip(pairs, shapes[2:]))
    slots = Counter()
    for gram, n in found.items():
        slots[gram % 2**bits] += n
    slots.pop(0, None)
    return {0: 1.0} | {i: math.sqrt(n / (len(tokens) + quality.SMOOTH)) for i, n in slots.items()}


def plain_fit(rows, m):
    """Follow the regularised leader, coordinate by coordinate."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= m.l1:
            return 0.0
        return -(z[i] - math.copysign(m.l1, z[i])) / ((m.beta + math.sqrt(n[i])) / m.alpha + m.l2)

    share = sum(y for _, y in rows) / len(rows)
    for _ in range(m.epochs):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * (0.5 / share if y else 0.5 / (1 - share)) * v
                step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / m.alpha
                z[i] += g - step * w[i]
                n[i] += g * g
    return weight


def test_training_and_scores_equal_a_plain_version(spark):
    """Documents of the table, learnt and scored coordinate by coordinate, against the query's operator."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    texts = dict(map(tuple, docs.collect()))
    order = {r.doc_id: r.h for r in labels.select("doc_id", F.xxhash64(F.col("doc_id").cast("long")).alias("h")).collect()}
    rows = sorted((order[r.doc_id], r.doc_id, r.quality) for r in labels.collect() if r.doc_id in texts and zlib.crc32(str(r.doc_id).encode()) % 3 != 1)
    assert len(rows) > 30
    weight = plain_fit([(plain_features(texts[d]), y) for _, d, y in rows], quality.Ftrl())
    got = {r.doc_id: r.score for r in quality.scored(docs, quality.train(docs, labels)).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        assert got[d] == pytest.approx(1 / (1 + math.exp(-sum(weight(i) * v for i, v in plain_features(t).items()))), abs=2e-4), d

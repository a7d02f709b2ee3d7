import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from netloom.llm.ngram_join import _units, banding, keep_one, near_duplicates
from netloom.llm.text import shingles


def brute(rows, threshold=0.8):
    """(links per row, class per row) by comparing all pairs."""
    sets = [set(shingles(t, 5).tolist()) if d is not None else set() for d, t in rows]
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None and (least[r] is None or d < least[r]):
            least[r] = d
    return links, [least[find(i)] if rows[i][0] is not None else None for i in range(len(rows))]


def texts(seed=1):
    random.seed(seed)
    word = lambda: random.choice("abcdefgh") + random.choice("xyz") + str(random.randint(0, 60))
    rows = []
    for base in range(12):
        text = [word() for _ in range(random.choice([3, 30, 80, 200]))]
        for _ in range(random.choice([1, 2, 5, 30])):
            copy = list(text)
            for _ in range(random.choice([0, 0, 1, 3, 9])):
                copy[random.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    random.shuffle(rows)
    return list(enumerate(rows))


def test_against_all_pairs(spark):
    rows = texts()
    rows += [(1000, ""), (1001, None), (1002, ""), (None, rows[0][1]), (1003, "one two"), (1004, "One, two!")]
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.99999).collect()}
    links, classes = brute([(d, t) for d, t in rows])
    assert sum(links) > 100
    for (d, _), n, c in zip(rows, links, classes):
        if d is not None:
            assert (got[d].n_links, got[d].class_id) == (n, c), d
    assert got[None].class_id is None and got[None].n_links == 0
    assert got[1003].class_id == got[1004].class_id == 1003 and got[1000].class_id == 1000


def test_one_of_each_class_stays_and_other_columns_are_kept(spark):
    rows = [(d, t, "s", "mine") for d, t in texts(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, component string").withColumn("_gone", F.lit(1))
    kept = keep_one(df, recall=0.99999).collect()
    _, classes = brute([(d, t) for d, t, *_ in rows])
    assert sorted(r.doc_id for r in kept) == sorted(set(classes))
    assert all(r.component == "mine" for r in kept)


def test_repeated_rows_and_empty_table(spark):
    long = " ".join(f"w{k}" for k in range(50))
    df = spark.createDataFrame([(1, long), (1, long), (2, long + " more"), (3, "other words that stand alone here")], "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id) for r in near_duplicates(df).collect())
    assert got == {(1, 1): 2, (2, 1): 1, (3, 3): 1}
    assert near_duplicates(df.limit(0)).count() == 0


def test_large_group_in_blocks(spark):
    random.seed(3)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for d in range(150):
        copy = list(base)
        copy[random.randrange(300)] = f"n{d}"
        rows.append((d, " ".join(copy)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.class_id == 0 and r.n_links == 149 for r in got)


def test_banding_reaches_its_recall():
    for threshold in (0.6, 0.8, 0.9):
        bands, rows = banding(threshold, 0.999)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 > 1 - (1 - threshold**rows) ** (bands - 1)
    with pytest.raises(ValueError):
        banding(1.5)


def test_one_of_repeated_rows_stays_and_texts_of_one_id_are_told_apart(spark):
    long, other, third = (" ".join(f"{c}{k}" for k in range(50)) for c in "wvu")
    rows = [(1, long), (1, long), (2, long + " more"), (2, other), (3, third), (3, third), (3, third + " more"), (4, "!"), (4, "!"), (None, long), (None, long), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit("x"))
    got = keep_one(df, recall=0.99999)
    assert got.columns == df.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    (text,) = {t for d, t in kept if d == 3}
    assert text in (third, third + " more") and kept.pop((3, text)) == 1
    assert kept == {(1, long): 1, (2, other): 1, (4, "!"): 2, (None, long): 2, (5, None): 1}


def chain(links, words=40, step=12):
    """Texts of which each shares most words with the next one alone."""
    stream = [f"w{k}" for k in range(words + step * links)]
    return [" ".join(stream[step * k : step * k + words]) for k in range(links)]


def test_components_of_any_shape_by_bucket(spark, monkeypatch):
    """Chains of unlike texts, near groups and copies, with components cut at a few members; rows that share an id too."""
    from netloom.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_MOST", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    used = []
    monkeypatch.setattr(ngram_join, "_unit", lambda key, by, f=ngram_join._unit: used.append(by) or f(key, by))
    rows = list(enumerate(chain(60, 60, 6) + [t for _, t in texts(4)] + chain(20, 80, 4)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), recall=0.9999999).collect()
    assert set(used) == {True, False}
    links, classes = brute(rows)
    assert sum(links) > 100
    assert sorted((r.doc_id, r.n_links, r.class_id) for r in got) == [(d, n, c) for (d, _), n, c in zip(rows, links, classes)]
    more = [*rows, (rows[5][0], rows[5][1] + " x"), (rows[5][0], rows[5][1] + " x"), (rows[70][0], "other words that are linked to no text at all")]
    got = near_duplicates(spark.createDataFrame(more, "doc_id long, text string"), recall=0.9999999).collect()
    assert sorted({(r.doc_id, r.class_id) for r in got}) == [(d, c) for (d, _), c in zip(rows, classes)]


def test_a_chain_of_unlike_texts_costs_in_proportion(monkeypatch, spark):
    """The rows that verification gets grow with the chain, not with its square."""
    from netloom.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_MOST", 16)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    cost = {}
    for links in (150, 600):
        docs = spark.createDataFrame(list(enumerate(chain(links, step=6))), "doc_id long, text string")
        seen = []
        monkeypatch.setattr(ngram_join, "_units", lambda m, met, f=_units: seen.append(f(m, met)) or seen[0])
        near_duplicates(docs).count()
        cost[links] = seen[0].select(F.explode("units").alias("u"), "node").agg(F.sum("u.blocks")).first()[0]
        assert seen[0].count() > 0.9 * links  # most of it is one candidate component, though hardly two texts are near
    assert cost[600] < 6 * cost[150]


def test_recall_at_the_default_setting(spark):
    """Pairs just above the threshold: as many as the bands promise are found."""
    draw = random.Random(8)
    rows, want = [], 0
    while want < 400:
        base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
        other = list(base)
        for _ in range(draw.choice([2, 3])):
            other[draw.randrange(len(other))] = f"n{draw.randrange(10**6)}"
        a, b = (set(shingles(" ".join(x), 5).tolist()) for x in (base, other))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
            want += 1
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("n_links > 0").count()
    assert got >= 2 * 0.995 * want

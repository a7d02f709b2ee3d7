import random

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from netloom.llm import line_dedup as ld


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, least=5, near=8):
    lines = sorted((d, k, ld.words(x)) for d, t in rows if d is not None for k, x in enumerate((t or "").split("\n")) if len(ld.words(x)) >= least)
    first, out = {}, {}
    for d, k, w in lines:
        at = first.setdefault(tuple(w), (d, k))
        if at != (d, k):
            out[d, k] = (*at, 0)
    seen = sorted((p, w) for w, p in first.items() if len(w) >= near)
    for i, (p, w) in enumerate(seen):
        if c := [q for q, v in seen[:i] if within_one(list(v), list(w))]:
            out[p] = (*min(c), 1)
    return out


def rows(seed):
    rng = random.Random(seed)
    pool = [[rng.choice("abcde") for _ in range(rng.choice([4, 5, 7, 8, 9, 12]))] for _ in range(40)]
    out = []
    for d in range(150):
        text = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(pool))
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = rng.choice(["q1", "q2", "q3", "a", "A"])
            if rng.random() < 0.2:
                w.pop(rng.randrange(len(w)))
            if rng.random() < 0.2:
                w.insert(rng.randrange(len(w) + 1), "b")
            text.append("  ".join(w))
        out.append((d, "\n".join(text)))
    return out


def found(df):
    return {(r.doc_id, r.line): (r.kept_doc_id, r.kept_line, r.edits) for r in ld.repeated_lines(df).collect()}


def test_against_all_pairs(spark):
    for seed in (1, 2):
        data = rows(seed) + [(500, None), (501, ""), (None, "a b c d e f g h i")]
        got, want = found(spark.createDataFrame(data, "doc_id long, text string").repartition(5)), brute(data)
        assert got == want and sum(v[2] for v in want.values()) > 20


def test_a_hot_half_and_lines_of_one_id(spark):
    """One start that many unlike lines share, and rows of one doc_id with unlike texts."""
    start = "one two three four five six"
    data = [(d, f"{start} w{d} x{d} y{d} z{d}") for d in range(300)] + [(400 + d, f"{start} w{d} x{d} y{d} other") for d in range(0, 300, 7)]
    assert found(spark.createDataFrame(data, "doc_id long, text string")) == brute(data)
    more = [*data, (5, "another text of the same number here one two three"), (900, "another text of the same number here one two four")]
    got = found(spark.createDataFrame(more, "doc_id long, text string"))
    assert {k: v for k, v in got.items() if k[0] not in (5, 900, 405)} == {k: v for k, v in brute(data).items() if k[0] not in (5, 900, 405)}


def test_repeated_rows_and_empty_table(spark):
    line = "one two three four five six seven eight"
    df = spark.createDataFrame([(1, line), (1, line), (2, line), (3, line + " nine")], "doc_id long, text string")
    assert found(df) == {(2, 0): (1, 0, 0), (3, 0): (1, 0, 1)}
    assert found(df.limit(0)) == {} and ld.told(df.limit(0)).count() == 0


def test_documents_keep_their_columns(spark):
    line = "a licence line that stands in many documents"
    data = [(1, f"first own words\n{line}", 9, "x"), (2, f"{line}\nsecond own words", 9, "y"), (3, line, 9, "z"), (4, "short", 5, "u"), (5, None, None, "v")]
    df = spark.createDataFrame(data, "doc_id long, text string, n_chars long, _dropped string").withColumn("_of", F.lit(1)).withColumn("line", F.lit("x"))
    got = {r.doc_id: r for r in ld.drop_lines(df).collect()}
    assert set(got) == {1, 2, 4, 5} and got[2].text == "second own words" and got[2].n_chars == 16 and got[1].n_chars == 9 and got[5].text is None
    clash = df.withColumnRenamed("_of", "_OF").withColumnRenamed("_dropped", "_Dropped").withColumn("Named", F.lit(1)).withColumn("KEY", F.lit(2))
    assert {r.doc_id: r.text for r in ld.drop_lines(clash).collect()} == {k: r.text for k, r in got.items()} and ld.drop_lines(clash).columns == clash.columns
    told = {r.doc_id: r for r in ld.told(df).collect()}
    assert told[3].n_kept == 0 and told[2].dropped == "0>1:1/0" and told[1].dropped == ""


@given(st.lists(st.sampled_from("abc"), min_size=8, max_size=14), st.data())
@settings(max_examples=300, deadline=None)
def test_one_edit_shares_a_half_and_a_variant(a, data):
    b = list(a)
    k = data.draw(st.integers(0, len(b) - 1))
    how = data.draw(st.sampled_from(["swap", "drop", "add"]))
    if how == "swap":
        b[k] = "z"
    elif how == "drop":
        b.pop(k)
    else:
        b.insert(k, "z")
    code = lambda w: np.array([ld.word_hash[x] for x in w], np.uint64)
    assert ld.halves(a) & ld.halves(b)
    va, vb = ({*zip(*map(lambda x: x.tolist(), ld.variants(code(w))))} for w in (a, b))
    assert {(h, p) for h, p in va if p >= 0} & {(h, p) for h, p in vb if p >= 0} or {h for h, p in va if p < 0} & {h for h, p in vb} or {h for h, p in vb if p < 0} & {h for h, p in va}
    assert ld.one_edit(code(a), code(b)) == within_one(a, b) == ld.one_edit(code(b), code(a))


def test_variants_are_the_hashes_of_shorter_lines():
    code = np.array([5, 7, 9, 11], np.uint64)
    h, p = ld.variants(code)
    for k in range(4):
        assert h[k + 1] == ld.variants(np.delete(code, k))[0][0] and p[k + 1] == k


def test_lines_without_blanks_and_short_lines(spark, tmp_path):
    from netloom.llm import queries

    zh, thai, token = "床前明月光疑是地上霜", "ภาษาไทยไม่มีช่องว่าง", "x" * 80
    data = [(1, f"{zh}\n{thai}\n{token}\nThe end"), (2, f"{zh}\n{thai}\n{token}\nthe  end\n\n"), (3, zh[:-1] + "雪")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert found(df) == brute(data) == {(2, 0): (1, 0, 0), (2, 1): (1, 1, 0), (3, 0): (1, 0, 1)}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got[2].dropped == "0>1:0/0,1>1:1/0,2>1:2/0,3>1:3/0" and got[2].n_kept == 2 and got[3].dropped == "0>1:0/1"

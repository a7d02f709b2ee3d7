from collections import Counter
from itertools import permutations

import duckdb

from netloom.llm import queries
from netloom.llm.filter_audit import audit, failed

DOCS = "doc_id long, text string, lang string, N long, PART string, chosen int"
LABELS = "doc_id long, quality int, toxic int, text string"


def fails(rows):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, *_ in rows:
        t = t or ""
        flat = t
        for c in "\t\n\x0b\x0c\r":
            flat = flat.replace(c, " ")
        w = [x for x in flat.split(" ") if x]
        upper = sum("A" <= c <= "Z" for c in t)
        out.append((len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * upper > 10 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least[t]))
    return out


def brute(rows, labels):
    """The filters applied to the rows of each part, one order after the other."""
    flags = fails(rows)
    good = {i for i, q, *_ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x, *_ in labels if x == 1 and i is not None}
    out, shapley = [], Counter()
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, flags) if (r[2] or "") == part]
        for order in permutations(range(5)):
            left = mine
            for step, k in enumerate(order, 1):
                gone = [(i, f) for i, f in left if f[k]]
                left = [(i, f) for i, f in left if not f[k]]
                total = sum(f[k] for _, f in mine)
                out.append([part, "".join("ABCDE"[j] for j in order), step, len(left), len(gone), total - len(gone), sum(f[k] and sum(f) == 1 for _, f in mine), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone), k])
                shapley[part, k] += len(gone)
    return sorted((*r[:-1], shapley[r[0], r[-1]]) for r in out)


def told(df):
    return sorted(tuple(r) for r in df.collect())


def rows_and_labels():
    many = [" ".join(f"w{i}_{j}" for j in range(120)) for i in range(6)]
    rows = [(i, many[i % 6], "de" if i % 3 else "en", 1, "x", 2) for i in range(20)]
    rows += [(30, None, None, 1, "x", 2), (31, "", "", 1, "x", 2), (29, "\t\n ", None, 1, "x", 2), (32, "A B C # d", "en", 1, "x", 2), (33, "word " * 150, "en", 1, "x", 2), (34, "WORD " * 150 + "|", "fr", 1, "x", 2)]
    rows += [(35, "x y " * 120, "fr", 1, "x", 2), (36, " ".join(f"É{k}" for k in range(100)), "fr", 1, "x", 2), (37, " ".join(f"É{k}" for k in range(99)), "fr", 1, "x", 2), (38, "Ab" + "c" * 17, "en", 1, "x", 2), (39, "Ab" + "c" * 18, "en", 1, "x", 2)]
    rows += [rows[2], rows[2], (None, many[0], "en", 1, "x", 2), (None, None, "en", 1, "x", 2), (40, "one two\x0bthree\x0cfour\rfive " * 60_000, "zz", 1, "x", 2), (41, "a 'quoted' \\x20 text", "zz", None, None, None)]
    labels = [(i, i % 2, i % 5 == 0, "x") for i in range(0, 42, 2)] + [(None, 1, 1, "x"), (3, None, None, "x"), (5, 1, 0, "x"), (5, 0, 1, "x"), (999, 1, 1, "x")]
    return rows, [(a, b, None if c is None else int(c), d) for a, b, c, d in labels]


def test_against_brute_force(spark):
    rows, labels = rows_and_labels()
    got = audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    want = brute(rows, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert told(got) == want and len(want) == 600 * 5


def test_flags_of_each_row(spark):
    rows, _ = rows_and_labels()
    got = sorted((repr(r.doc_id), *(bool(r[k]) for k in "ABCDE")) for r in failed(spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted((repr(r[0]), *f) for r, f in zip(rows, fails(rows)))


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert told(audit(docs, labels)) == []
    rows = [(1, "a b", "de", 1, "x", 2), (2, "a b", None, 1, "x", 2)]
    assert told(audit(spark.createDataFrame(rows, DOCS), labels)) == brute(rows, [])


def test_copies_of_a_third_of_all_rows(spark):
    rows = [(i, "one text that very many rows share" if i % 3 == 0 else f"text {i} of its own", "de", 1, "x", 2) for i in range(3000)]
    assert told(audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(0, 1, 0, "x")], LABELS))) == brute(rows, [(0, 1, 0)])


def test_against_sql(spark):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.op12_filter_audit(spark, sf)
    assert told(got) == sorted(con.sql(queries.oracle_sql()["op12_filter_audit"]).project(", ".join(got.columns)).fetchall())

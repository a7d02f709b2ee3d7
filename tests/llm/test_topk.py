import math
import random
from fractions import Fraction

import numpy as np

from netloom.llm.topk import floored, leads, scored, search, told, top_k

SCHEMA = "vec_id long, embedding array<double>, score long"


def quantized(v):
    if not v or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(256 * Fraction(x)) for x in v]


def brute(rows, k=5, every=50):
    ok = [(i, q) for i, v, *_ in rows if i is not None and (q := quantized(v)) is not None]
    out = []
    queries = {}
    for i, q in ok:
        if i % every == 0:
            key = (i, len(q))
            queries[key] = min(queries.get(key, q), q, key=lambda v: v) if key in queries else q
    for (i, d), q in queries.items():
        scores = sorted(((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == d))
        out += [(i, r, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def got(df, **how):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, **how).collect())


def vectors(n, dim, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [round(rng.gauss(0, spread), 1) for _ in range(dim)], 0) for i in range(n)]


def test_against_all_pairs_with_ties(spark):
    rows = vectors(700, 4, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    for how in ({}, {"shard": 64, "chunk": 3, "block": 16}, {"every": 7, "k": 3, "block": 8}):
        assert got(df, **how) == brute(rows, how.get("k", 5), how.get("every", 50))


def test_odd_rows(spark):
    rows = vectors(120, 3, 2) + [(200, None, 0), (201, [], 0), (202, [1.0, None, 2.0], 0), (203, [math.nan, 1.0, 1.0], 0), (204, [math.inf, 0.0, 0.0], 0), (None, [1.0, 1.0, 1.0], 0), (250, [1.0, 2.0], 0), (251, [1.0, 2.0], 0), (300, [0.5], 0)]
    rows += [(7, rows[7][1], 1), (120, [1e9, -1e9, 3.0], 0), (150, [1e8, 1e8, 1e8], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []


def test_components_of_any_size(spark):
    """Scores beyond 64 bits are ranked exactly, across shards too, and told as the nearest 64-bit number."""
    draw = random.Random(5)
    rows = [(i, [draw.choice([1.0, -1.0]) * 10 ** draw.choice([0, 3, 9, 15, 18, 30, 300]) * draw.random() for _ in range(3)], 0) for i in range(260)]
    rows += [(300, [1e308, -1e308, 1.7e308], 0), (301, [3e15, 3e15, 3e15], 0), (350, [5e-324, 0.0, -0.0], 0), (400, [2.0**31 / 256, 1.0, -(2.0**31) / 256], 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for how in ({}, {"shard": 32, "chunk": 2, "block": 8}):
        assert got(df, **how) == brute(rows)
    assert floored(1.7e308) == 256 * int(1.7e308) and floored(-1e-9) == -1
    edge = [-(2**200), -(2**64), -(2**63) - 1, -(2**63), 2**63 - 1, 2**63, 2**64, 2**200]
    keys = [told(x) for x in edge]
    assert keys == sorted(keys) and all(k for _, k in keys) and told(5) == (5, None)


def test_blocks_are_skipped():
    draw = np.random.default_rng(0)
    x = np.floor(256 * np.repeat(draw.standard_normal((40, 16)), 64, axis=0) + draw.integers(-3, 3, (2560, 16)))
    ids = np.arange(2560)
    rows, done = search(ids, x, ids[::50], x[::50], 5, 64)
    full = x[::50] @ x.T
    for n, i in enumerate(ids[::50]):
        full[n, i] = -np.inf
        want = np.lexsort((ids, -full[n]))[:5].tolist()
        assert [j for q, j, _ in rows if q == i] == want
    assert done < 0.6 * full.size


def clustered(n, dim, kinds, seed):
    """Vectors close to some centres of different largest components, ids in no order."""
    draw = np.random.default_rng(seed)
    centres = 0.05 * draw.standard_normal((kinds, dim))
    centres[np.arange(kinds), draw.permutation(dim)[:kinds]] = 1.0
    x = centres[draw.integers(0, kinds, n)] + 0.02 * draw.standard_normal((n, dim))
    return [(int(i), [round(float(v), 4) for v in row], 0) for i, row in zip(draw.permutation(n), x)]


def test_shards_and_blocks_are_skipped_where_vectors_lie_in_groups(spark):
    """Pairs of a chunk and a shard that can't matter are never sent; results are those of all pairs."""
    rows = clustered(3000, 16, 12, 3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows)
    how = {"shard": 200, "chunk": 4, "block": 32}
    assert got(df, **how) == want
    done = scored(df, **how).agg({"scored": "sum"}).first()[0]
    assert 0 < done < 0.2 * 3000 * 60
    plain = vectors(3000, 16, 4)
    assert got(spark.createDataFrame(plain, SCHEMA), **how) == brute(plain)


def test_a_vector_that_a_third_of_all_rows_have(spark):
    rows = clustered(900, 8, 5, 7) + [(10_000 + i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 0.25], 0) for i in range(450)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df, shard=64, chunk=3, block=16) == brute(rows)


def test_leads():
    x = np.array([[1, -5, 3], [0, 0, 0], [-2, 2, 2]])
    assert leads(x, 2).tolist() == [[3, 0, 1], [4, 2, 2]] and leads(x[:, :1], 3)[0].tolist() == [0, 0, 1]

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.operators import estimator as est
from netloom.operators import gin


def problem(spark, n=40, layers=2, k=2, hidden=5, clip=5.0, spectral=False, seed=0):
    """A random graph with a hub, its features, parameters, and the same on arrays."""
    draw = np.random.default_rng(seed)
    pairs = {(i, (i + 1) % n) for i in range(n)} | {tuple(sorted(p)) for p in draw.integers(0, n, (n // 3, 2)).tolist() if p[0] != p[1]} | {(0, i) for i in range(5, 15)}
    edges = sorted({(a, b) for p in pairs for a, b in (p, p[::-1])})
    x, y = draw.standard_normal(n), draw.standard_normal(n)
    net = est.LocalNetwork(np.array([a for a, _ in edges]), np.array([b for _, b in edges]), x, k)
    test = est.RootedGin(3, hidden, layers, clip, spectral=spectral, seed=seed)
    for key in test.p:
        test.p[key] = test.p[key] + 0.3 * draw.standard_normal(test.p[key].shape)
    batch = net.batch(np.arange(n), y, 0.0, 1.0)
    e = spark.createDataFrame(edges, "src long, dst long")
    nodes = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(zip(batch.features[batch.root_rows, 0], y))], "id long, f array<double>")
    return e, nodes, test, batch, net, y


@pytest.mark.parametrize("layers, k, clip, spectral", [(2, 2, 5.0, False), (2, 2, None, True), (1, 2, 3.0, False), (3, 2, 5.0, False), (2, 1, 5.0, False), (3, 3, 2.0, True)])
def test_scores_are_those_of_the_array_form(spark, layers, k, clip, spectral):
    e, nodes, test, batch, *_ = problem(spark, layers=layers, k=k, clip=clip, spectral=spectral, seed=layers)
    want, _ = test.forward(batch)
    got = {r.root: r.logit for r in gin.scores(gin.Weights.of(test), e, nodes, k).collect()}
    assert sorted(got) == list(range(40)) and np.allclose([got[i] for i in range(40)], want, atol=1e-10)
    some = spark.createDataFrame([(3,), (7,), (3,)], "root long")
    few = {r.root: r.logit for r in gin.scores(gin.Weights.of(test), e, nodes, k, some).collect()}
    assert sorted(few) == [3, 7] and all(abs(few[i] - got[i]) < 1e-12 for i in few)


def slope(x):
    return -1 / (1 + np.exp(x))


def as_arrays(df, weights):
    out = {k: np.full(v.size, np.nan) for k, v in weights.p.items()}
    for r in df.collect():
        out[r.param][r.cell] = r.value
    return {k: v.reshape(weights.p[k].shape) for k, v in out.items()}


@pytest.mark.parametrize("layers, k, clip", [(2, 2, 5.0), (1, 1, None), (3, 2, 4.0), (2, 3, 5.0)])
def test_gradients_are_those_of_the_array_form(spark, layers, k, clip):
    e, nodes, test, batch, *_ = problem(spark, n=24, layers=layers, k=k, clip=clip, hidden=4, seed=5 + layers)
    weights = gin.Weights.of(test)
    out, kept = test.forward(batch)
    want, _ = test.backward(batch, kept, slope(out))
    got = as_arrays(gin.gradients(weights, e, nodes, k, slope), weights)
    assert set(got) == set(want)
    for name in want:
        assert np.allclose(got[name], want[name], atol=1e-9), name


def test_gradients_add_up_over_roots_and_follow_differences(spark):
    """All roots together give the sum of each alone, and the slope of the summed loss."""
    e, nodes, test, batch, net, y = problem(spark, n=16, hidden=3, seed=9)
    weights = gin.Weights.of(test)
    whole = as_arrays(gin.gradients(weights, e, nodes, 2, slope), weights)
    total = {k: np.zeros_like(v) for k, v in whole.items()}
    for root in range(4):
        one = as_arrays(gin.gradients(weights, e, nodes, 2, slope, spark.createDataFrame([(root,)], "root long")), weights)
        for k in total:
            total[k] += one[k]
    first = as_arrays(gin.gradients(weights, e, nodes, 2, slope, spark.range(4).select(F.col("id").alias("root"))), weights)
    assert all(np.allclose(first[k], total[k], atol=1e-10) for k in total)
    loss = lambda: float(np.logaddexp(0, -test.forward(batch)[0]).sum())
    for name, at in (("0.a.w", (1, 2)), ("1.c.w", (0, 1)), ("0.eps", (0,)), ("1.g", (2,)), ("h.c.b", (0,)), ("h.a.w", (2, 0))):
        old = test.p[name][at]
        test.p[name][at] = old + 1e-5
        up = loss()
        test.p[name][at] = old - 1e-5
        down = loss()
        test.p[name][at] = old
        assert abs((up - down) / 2e-5 - whole[name][at]) < 1e-5, name


def test_scores_stay_in_their_band(spark):
    """However large the head's weights, a clipped score lies between sigmoid(-c) and sigmoid(c); without a clip it needn't, and an even score stays even."""
    e, nodes, test, *_ = problem(spark, clip=5.0, seed=4)
    weights = gin.Weights.of(test)
    for k in ("h.a.w", "h.c.w"):
        weights.p[k] = weights.p[k] * 40
    free = gin.Weights(weights.p, weights.layers, None)
    clipped, raw = ({r.root: r.logit for r in gin.scores(w, e, nodes, 2).collect()} for w in (weights, free))
    eta = 1 / (1 + math.exp(5.0))
    assert max(abs(v) for v in raw.values()) > 5
    assert all(abs(v) <= 5 and eta - 1e-9 <= 1 / (1 + math.exp(-v)) <= 1 - eta + 1e-9 for v in clipped.values())
    assert all(abs(clipped[k] - 5 * math.tanh(raw[k] / 5)) < 1e-9 for k in raw)


def test_a_hub_costs_its_edges(spark):
    """A star of 2,000 leaves: no rows by pairs of leaves in the two-layer form."""
    n = 2000
    e = spark.range(1, n + 1).selectExpr("0L as src", "id as dst").union(spark.range(1, n + 1).selectExpr("id as src", "0L as dst"))
    nodes = spark.range(n + 1).select("id", F.array((F.col("id") % 7) / 7, (F.col("id") % 5) / 5).alias("f"))
    w = gin.Weights.of(est.RootedGin(3, 4, 2, seed=1))
    tables = gin.passed(w, e, nodes, 2)
    assert tables[0].count() == 3 * n + 1 and gin.scores(w, e, nodes, 2).count() == n + 1


def test_layers_read_again_are_worked_out_once(spark):
    """In batches a layer gives what its expressions give; what the gradient reads again is a table, not worked out anew."""
    edges = spark.createDataFrame([(a, b) for k in range(12) for a, b in ((k, (k + 1) % 12), ((k + 1) % 12, k))], "src long, dst long")
    nodes = spark.range(12).select("id", F.array(F.sin("id"), F.cos(3 * F.col("id"))).alias("f"))
    weights = gin.Weights.of(est.RootedGin(3, 8, 2, 4.0, seed=5))
    plain, kept = gin.passed(weights, edges, nodes, 2), gin.passed(weights, edges, nodes, 2, keep=True)
    assert "Join" not in kept[0]._jdf.queryExecution().toString()
    for a, b in zip(plain, kept):
        want, got = ({(r.root, r.node): (r.dist, r.z, r.h) for r in t.collect()} for t in (a, b))
        assert want.keys() == got.keys() and len(want) in (12, 36)
        for k, (dist, z, h) in want.items():
            assert got[k][0] == dist and np.allclose(got[k][1], z) and np.allclose(got[k][2], h)

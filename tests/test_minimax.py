import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions.scalar import gaussian_hash
from netloom.operators import estimator as est
from netloom.operators import games, gin
from netloom.operators.minimax import TableMinimax

TRUE = {"beta": 0.4, "gamma": 1.5, "sigma_sq": 1.0}
START = {"beta": 0.1, "gamma": 0.8, "sigma_sq": 1.3}


def problem(spark, n=36, k=2, layers=2, spectral=False, seed=2, game=None, **config):
    """The same graph, outcome and test function as tables and as arrays."""
    draw = np.random.default_rng(seed)
    pairs = {(i, (i + 1) % n) for i in range(n)} | {tuple(sorted(p)) for p in draw.integers(0, n, (n // 2, 2)).tolist() if p[0] != p[1]}
    both = sorted({(a, b) for p in pairs for a, b in (p, p[::-1])})
    x = draw.standard_normal(n)
    net = est.LocalNetwork(np.array([a for a, _ in both]), np.array([b for _, b in both]), x, k)
    y = est.LocalGame(games.LinearInMeans(TRUE, beta_cap=0.85), net).solve(draw.standard_normal(n), TRUE)[0]
    edges = spark.createDataFrame(both, "src long, dst long")
    nodes = spark.createDataFrame([(i, float(x[i]), float(y[i])) for i in range(n)], "id long, x double, y double")
    test = lambda: est.RootedGin(3, 5, layers, 5.0, spectral=spectral, seed=seed)
    table = TableMinimax(edges, nodes, game or games.LinearInMeans(START, beta_cap=0.85), test(), est.EstimatorConfig(max_steps=2, seed=5, window=2, stability_window=2, **config), k=k, steps=60)
    return table, net, y, test()


def noise(spark, table, *key):
    rows = spark.range(table.stats["n"]).select("id", gaussian_hash(table.config.seed, "eps", *key, F.col("id")).alias("e")).orderBy("id").collect()
    return np.array([r.e for r in rows])


@pytest.mark.parametrize("how", [{}, {"spectral": True}, {"layers": 3}])
def test_a_step_is_that_of_the_array_form(spark, how):
    """All nodes as roots: losses, the test function after its update, and the structural gradient."""
    table, net, y, disc = problem(spark, **how)
    roots, mu, sigma = np.arange(net.n), y.mean(), y.std()
    game = games.LinearInMeans(START, beta_cap=0.85, picard_tol=1e-13)
    local = est.LocalGame(game, net)
    fake = local.solve(noise(spark, table, 1, "d"), START)[0]
    real_b, fake_b = net.batch(roots, y, mu, sigma), net.batch(roots, fake, mu, sigma)
    lr, kr = disc.forward(real_b)
    gr, _ = disc.backward(real_b, kr, -est.expit(-lr) / net.n)
    lf, kf = disc.forward(fake_b)
    gf, _ = disc.backward(fake_b, kf, est.expit(lf) / net.n)
    loss_d = float(est.softplus(-lr).mean() + est.softplus(lf).mean())
    est.Adam(table.config.lr_d).step(disc.p, {k: gr[k] + gf[k] for k in gr})
    assert table.learn_test(1, 0.0) == pytest.approx(loss_d, abs=1e-9)
    for name in disc.p:
        assert np.allclose(table.disc.p[name], disc.p[name], atol=1e-7), name
    eps = noise(spark, table, 1, "g")
    y2, tangents, *_ = local.solve(eps, START, True)
    b = net.batch(roots, y2, mu, sigma)
    logits, kept = disc.forward(b)
    _, by_feature = disc.backward(b, kept, -est.expit(-logits) / net.n)
    by_node = np.bincount(b.nodes, by_feature[:, 1] / sigma, net.n)
    loss_g, slopes = table.structural(1, 0.0)
    assert loss_g == pytest.approx(float(est.softplus(-logits).mean()), abs=1e-7)
    for name, t in tangents.items():
        assert slopes[name] == pytest.approx(float(by_node @ t), abs=1e-6), name


def test_a_fit_on_tables(spark):
    """Two steps with drawn roots and a blur: parameters move, records are whole, and another run is the same."""
    runs = []
    for _ in range(2):
        table, *_ = problem(spark, lr_g=0.05, n_disc=1)
        table.batch, table.blur = 9, est.Blur(tau_y0=0.5, anneal_steps=2)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            runs.append(table.fit())
    a, b = runs
    assert a.status == "ok" and a.final_step == 2 and a.params_final != START and set(a.params) == set(START)
    assert [r["params"] for r in a.history] == [r["params"] for r in b.history] and all(np.isfinite(r["loss_d"]) and r["grad_norm_g"] > 0 for r in a.history)


def test_gradients_by_the_features(spark):
    """Against differences, where egos share all messages and where they are cut at their border."""
    for layers, k in ((2, 2), (2, 1)):
        table, net, y, disc = problem(spark, n=14, layers=layers, k=k)
        value, slope = (lambda x: est.softplus(-x)), (lambda x: -est.expit(-x))
        features = table.features(table.nodes, 0.0)
        w = gin.Weights.of(disc)
        total, by_weight, by_node = gin.pulled(w, table.edges, features, k, value, slope)
        got = {r.id: r.g for r in by_node.collect()}
        b = net.batch(np.arange(net.n), y, y.mean(), y.std())
        logits, kept = disc.forward(b)
        want, by_feature = disc.backward(b, kept, slope(logits))
        assert total == pytest.approx(float(value(logits).sum()), abs=1e-9)
        for c in range(2):
            assert np.allclose([got[i][c] for i in range(net.n)], np.bincount(b.nodes, by_feature[:, c], net.n), atol=1e-9)
        assert all(np.allclose(by_weight[n], want[n], atol=1e-9) for n in want)


def test_scores_of_both_sides(spark):
    table, net, y, disc = problem(spark, n=20)
    got = {r.root: (r.real, r.fake) for r in table.scores().collect()}
    fake = est.LocalGame(games.LinearInMeans(START, beta_cap=0.85, picard_tol=1e-13), net).solve(noise(spark, table, 0, "s"), START)[0]
    for side, values in enumerate((y, fake)):
        want, _ = disc.forward(net.batch(np.arange(net.n), values, y.mean(), y.std()))
        assert np.allclose([got[i][side] for i in range(net.n)], want, atol=1e-8)


def test_what_tables_must_have(spark):
    table, *_ = problem(spark)
    with pytest.raises(ValueError, match="layers"):
        TableMinimax(table.edges, table.nodes, table.game, est.RootedGin(3, 4, 1), table.config, k=2)
    with pytest.raises(ValueError, match="features"):
        TableMinimax(table.edges, table.nodes, table.game, est.RootedGin(4, 4, 2), table.config, k=2)
    with pytest.raises(ValueError, match="constant"):
        TableMinimax(table.edges, table.nodes.withColumn("y", F.lit(1.0)), table.game, est.RootedGin(3, 4, 2), table.config)

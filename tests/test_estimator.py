import math
import warnings

import numpy as np
import pytest

from netloom.operators import estimator as est
from netloom.operators.games import LinearInMeans
from netloom.sources import graphs as gen

TRUE = {"beta": 0.4, "gamma": 1.5, "sigma_sq": 1.0}


def network(n=700, seed=0, k=2):
    p = gen.barabasi_albert_pairs(n, 2, seed)
    both = np.unique(np.concatenate([p, p[:, ::-1]]), axis=0)
    return est.LocalNetwork(both[:, 0], both[:, 1], np.random.default_rng(seed + 1).standard_normal(n), k)


def outcome(net, seed=2):
    return est.LocalGame(LinearInMeans(TRUE, beta_cap=0.85), net).solve(np.random.default_rng(seed).standard_normal(net.n), TRUE)[0]


def recipe(seed=0, **over):
    return est.EstimatorConfig(**(dict(max_steps=280, batch=16, window=35, stability_window=18, lr_g=8e-3, lr_d=4e-4, lr_g_decay_factor=0.5, lr_g_decay_milestones=(160, 220), seed=seed) | over))


def start():
    return LinearInMeans({"beta": 0.0, "gamma": 0.0, "sigma_sq": 1.0}, beta_cap=0.85)


def test_recovery():
    net = network()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        fit = est.AdversarialEstimator(start(), est.RootedGin(3, 12, 2, 4.0), recipe(), est.Blur(tau_y0=1.0, anneal_steps=170)).fit(net, outcome(net))
    assert 0.15 < fit.params_["beta"] < 0.70 and 1.0 < fit.params_["gamma"] < 2.0
    assert fit.estimates()["path_sd"].notna().all() and len(fit.simulate()) == 700
    real, fake = fit.scores(64)
    assert real.shape == fake.shape == (64,) and ((real > 0) & (real < 1)).all()


@pytest.mark.parametrize("spectral", [False, True])
def test_gradients_of_the_test_function(spectral):
    net = network(60)
    y, draw = outcome(net), np.random.default_rng(3)
    d = est.RootedGin(3, 7, 2, 5.0, spectral, 1)
    b = net.batch(np.array([1, 5, 5, 9]), y, y.mean(), y.std())
    _, kept = d.forward(b, train=True)
    w = draw.standard_normal(4)
    out, kept = d.forward(b)
    grads, feats = d.backward(b, kept, w)
    frozen = {k: v.copy() for k, v in d.u.items()}
    for name in d.p:
        i = tuple(draw.integers(0, s) for s in d.p[name].shape)
        v, f = d.p[name][i], []
        for h in (1e-6, -1e-6):
            d.p[name][i] = v + h
            d.u = {k: u.copy() for k, u in frozen.items()}
            f.append(d.forward(b)[0] @ w)
        d.p[name][i] = v
        tol = 1e-5 if not spectral else 0.5 + abs(grads[name][i])
        assert abs((f[0] - f[1]) / 2e-6 - grads[name][i]) < tol, name
    for i in ((0, 0), (b.root_rows[1], 1)):
        v, f = b.features[i], []
        for h in (1e-6, -1e-6):
            b.features[i] = v + h
            f.append(d.forward(b)[0] @ w)
        b.features[i] = v
        assert abs((f[0] - f[1]) / 2e-6 - feats[i]) < 1e-5


def test_a_score_depends_on_its_object_alone():
    net = network(80)
    y, d = outcome(net), est.RootedGin(3, 8, 2)
    score = lambda roots: d.forward(net.batch(np.array(roots), y, y.mean(), y.std()))[0]
    assert score([3, 7, 7, 30]) == pytest.approx([score([3])[0], score([7])[0], score([7])[0], score([30])[0]])


def test_optima_and_losses():
    z = np.zeros(5)
    assert est.softplus(-z).mean() + est.softplus(z).mean() == pytest.approx(2 * math.log(2))
    assert est.softplus(np.array([800.0, -800.0])) == pytest.approx([800.0, 0.0])


def test_guards():
    net = network(60)
    y = outcome(net)
    with pytest.raises(ValueError, match="layers"):
        est.run_minimax(net, y, start(), est.RootedGin(3, 8, 1), recipe())
    with pytest.raises(ValueError, match="features"):
        est.run_minimax(net, y, start(), est.RootedGin(4, 8, 2), recipe())
    with pytest.raises(ValueError, match="finite"):
        est.run_minimax(net, np.full(60, np.nan), start(), est.RootedGin(3, 8, 2), recipe())
    with pytest.warns(UserWarning, match="blur"):
        est.run_minimax(net, y, start(), est.RootedGin(3, 8, 2), recipe(max_steps=40, window=30, stability_window=20), est.Blur(anneal_steps=35))
    with pytest.warns(UserWarning, match="clipped"):
        est.run_minimax(net, y, start(), est.RootedGin(3, 8, 2, None), recipe(max_steps=2))
    with pytest.raises(est.NotFitted):
        est.AdversarialEstimator(start(), est.RootedGin()).result_
    with pytest.raises(ValueError):
        est.EstimatorConfig(loss="x")
    for loss in ("nonsaturating", "saturating"):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            assert est.run_minimax(net, y, start(), est.RootedGin(3, 8, 2), recipe(max_steps=3, loss=loss)).status == "ok"


def test_hooks():
    net = network(60)
    y, seen = outcome(net), []

    class Broken:
        def run_start(self, c): seen.append("start")
        def step(self, r): raise OSError("disk")
        def run_end(self, r): seen.append("end")

    with pytest.warns(RuntimeWarning, match="disk"):
        got = est.run_minimax(net, y, start(), est.RootedGin(3, 8, 2), recipe(max_steps=2), observers=(Broken(),), gradient_transform=lambda c: dict.fromkeys(c.gradients, 0.0))
    assert seen == ["start", "end"] and got.params["beta"] == 0
    with pytest.raises(ValueError, match="transform"):
        est.run_minimax(net, y, start(), est.RootedGin(3, 8, 2), recipe(max_steps=2), gradient_transform=lambda c: {})


def test_schedules():
    assert est.Blur(True, 0.2, "linear", 100, 0.02).tau(50) == pytest.approx(0.1)
    assert est.Blur(True, 0.15, "exp", 100, 0.01).tau(20) == pytest.approx(0.15 / math.e)
    assert est.Blur(True, 1.0, "exp", 50, 0.0).tau(49) > 0 == est.Blur(True, 1.0, "exp", 50, 0.0).tau(50)
    assert est.Blur(True, 0.08, "constant").tau(9999) == 0.08


def test_egos_are_balls():
    net = network(40)
    for r in (0, 5, 39):
        ball, a, b = net.ego(r)
        reach = {r} | {int(v) for v in net.dst[net.ptr[r] : net.ptr[r + 1]]}
        reach |= {int(v) for u in set(reach) for v in net.dst[net.ptr[u] : net.ptr[u + 1]]}
        assert set(ball.tolist()) == reach and (np.diff(ball) > 0).all()
        assert len(a) == sum(1 for s, d in zip(net.src, net.dst) if s in reach and d in reach)


def test_monte_carlo_resumes(spark):
    net = network(60)

    def make(spec):
        return est.AdversarialEstimator(start(), est.RootedGin(3, 6, 2, seed=spec.index), recipe(max_steps=3))

    def observed(n, seed):
        return est.LocalGame(LinearInMeans(TRUE, beta_cap=0.85), n).solve(np.random.default_rng(seed).standard_normal(n.n), TRUE)[0]

    done = spark.createDataFrame([(1, "failed:x")], "realization long, status string")
    a = est.monte_carlo(spark, 4, net, observed, make, done=done, params=("beta", "gamma", "sigma_sq")).drop("elapsed_seconds").toPandas()
    b = est.monte_carlo(spark, 4, net, observed, make, done=done, params=("beta", "gamma", "sigma_sq")).drop("elapsed_seconds").toPandas()
    assert sorted(a.realization) == [0, 2, 3]
    assert a.sort_values("realization").reset_index(drop=True).equals(b.sort_values("realization").reset_index(drop=True))
    assert len({est.derive_seed(0, i, s) for i in range(20) for s in range(4)}) == 80

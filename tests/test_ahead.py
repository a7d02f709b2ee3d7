"""Equilibria worked out ahead of a run against the loop that solves each on the whole graph."""

import numpy as np
import pytest

from netloom.operators import ahead
from netloom.operators import estimator as est
from netloom.operators.games import EffortGame, LinearInMeans

pytestmark = pytest.mark.filterwarnings("ignore")
TRUE = {"beta": 0.4, "gamma": 1.5, "sigma_sq": 1.0}


def small(n: int = 300) -> est.LocalNetwork:
    """A ring with random chords, and a hub of 90 more neighbours."""
    draw = np.random.default_rng(0)
    a = np.concatenate([np.arange(n), draw.integers(0, n, n), np.zeros(90, int)])
    b = np.concatenate([(np.arange(n) + 1) % n, draw.integers(0, n, n), np.arange(100, 190)])
    pairs = np.unique(np.concatenate([np.column_stack([a, b]), np.column_stack([b, a])]), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    return est.LocalNetwork(pairs[:, 0], pairs[:, 1], draw.standard_normal(n))


def observed(net: est.LocalNetwork, seed: int) -> np.ndarray:
    return est.LocalGame(LinearInMeans(TRUE), net).solve(np.random.default_rng(seed).standard_normal(net.n), TRUE)[0]


def fitted(spec: est.Realization | None = None, beta: float = 0.1, mode: str = "implicit", n_disc: int = 1, **hooks) -> est.AdversarialEstimator:
    config = est.EstimatorConfig(max_steps=12, batch=6, n_disc=n_disc, differentiation=mode, window=3, stability_window=3, stability_tol=1e-9, seed=5)
    return est.AdversarialEstimator(LinearInMeans({"beta": beta, "gamma": 0.8, "sigma_sq": 1.0}), est.RootedGin(3, 6, 2, seed=2), config, est.Blur(tau_y0=1.0, anneal_steps=8), **hooks)


def records(net: est.LocalNetwork, e: est.AdversarialEstimator) -> list[dict]:
    return ahead.with_terms(net, ahead.Means(net), list(ahead.rehearsed(net, e)), ahead.levels(e.game.picard_tol))


def test_means_are_those_of_neighbours():
    net = small()
    means, v = ahead.Means(net), np.random.default_rng(1).standard_normal((net.n, 4))
    got = means(v[means.order])[means.place]
    assert np.allclose(got, np.column_stack([net.mean(v[:, k]) for k in range(4)]), atol=1e-12)
    assert np.diff(net.ptr).max() > 64


@pytest.mark.parametrize("shape", ["cloud", "line", "uniform", "negative"])
def test_extremes_tell_the_largest_of_every_combination(shape):
    draw = np.random.default_rng(3)
    p, q = draw.standard_normal((2, 2000))
    if shape == "line":
        q = 2 * p
    if shape == "uniform":
        p = draw.uniform(-1, 1, 2000)
    if shape == "negative":
        p[7] = -40
    corners = ahead.extremes(p, q)
    assert len(corners) < 100
    for g, s in draw.standard_normal((50, 2)):
        assert np.isclose(np.abs(corners @ (g, s)).max(), np.abs(g * p + s * q).max(), rtol=1e-12)


@pytest.mark.parametrize("how", [{}, {"mode": "unroll"}, {"n_disc": 2}, {"sample": est.LocalSampler("disjoint_relax", relax=(4, 3), restarts=2, min_batch=2, fallback="best")}, {"beta": 0.75}])
def test_a_run_is_that_of_the_whole_graph(how):
    net = small()
    y, e = observed(net, 1), fitted(**how)
    made, found = [], records(net, e)

    def solver(game, net):
        made.append(ahead.SeriesGame(game, net, found))
        return made[-1]

    a, b = fitted(**how).set_params(solver=solver).fit(net, y).result_.history, fitted(**how).fit(net, y).result_.history
    assert len(a) == len(b) == 12
    for s, t in zip(a, b):
        for c in ("beta", "gamma", "sigma_sq", "loss_d", "loss_g", "picard_residual"):
            assert s[c] == pytest.approx(t[c], abs=1e-6)
        assert (s["picard_iterations"], s["picard_converged"], s["roots_achieved"]) == (t["picard_iterations"], t["picard_converged"], t["roots_achieved"])
    assert made[0].solved_whole == (24 if how.get("beta") else 0)  # beyond the reach of the terms every draw is solved whole


def test_only_linear_games_with_known_draws_are_worked_out_ahead():
    assert ahead.applies(fitted())
    assert not ahead.applies(fitted(sample=lambda draw, size: draw.integers(0, 9, size)))
    e = fitted()
    e.game = EffortGame()
    assert not ahead.applies(e)


def test_a_fit_on_spark_works_its_draws_out_in_many_tasks(spark, monkeypatch):
    net = small()
    make = lambda spec: fitted()
    read = lambda e: e.estimates()
    schema = "param string, coef double, final double, path_sd double"
    rows = est.fit_in_task(spark, net, observed, make, read, schema, master=7)
    want = fitted().fit(net, observed(net, est.seed_streams(7, 0)["gt"])).estimates().set_index("param")
    got = rows.toPandas().set_index("param")
    assert np.allclose(got.loc[want.index].to_numpy(), want.to_numpy(), atol=1e-6)
    runs = spark.createDataFrame([(0,), (1,)], "realization long")
    units = ahead.terms(runs, spark.sparkContext.broadcast(net), lambda k: fitted()).groupBy("realization").count().collect()
    assert {r["realization"]: r["count"] for r in units} == {0: 3, 1: 3}  # 24 draws, 15 to a row, and a row of its own


def test_monte_carlo_rows_are_those_of_runs_one_by_one(spark):
    net = small()
    rows = est.monte_carlo(spark, 3, net, observed, fitted, master=11, params=("beta", "gamma", "sigma_sq")).toPandas().set_index("realization")
    for k in range(3):
        seeds = est.seed_streams(11, k)
        r = fitted().set_params(seed=seeds["train"]).fit(net, observed(net, seeds["gt"])).result_
        assert rows.loc[k, "status"] == "ok" and rows.loc[k, "final_step"] == 12
        assert rows.loc[k, "beta_hat"] == pytest.approx(r.params["beta"], abs=1e-6)
        assert rows.loc[k, "picard_cap_hits"] == r.picard_cap_hits


@pytest.mark.parametrize("how", [{}, {"mode": "unroll"}, {"n_disc": 2}, {"sample": est.LocalSampler("disjoint_relax", relax=(4, 3), restarts=2, min_batch=2, fallback="best")}, {"beta": 0.75}, {"beta": -0.7}])
@pytest.mark.parametrize("known", [True, False])
def test_a_run_of_polynomials_is_that_of_the_whole_graph(how, known):
    """Wherever beta goes, and whether or not it was predicted, no draw is solved on the whole graph."""
    net = small()
    y, around, made = observed(net, 1), ahead.Around(net), []
    found = ahead.with_polynomials(around, ahead.predicted(around, fitted(**how), y if known else None, False), 1e-6)

    def solver(game, net):
        made.append(ahead.SeriesGame(game, net, found))
        return made[-1]

    a, b = fitted(**how).set_params(solver=solver).fit(net, y).result_, fitted(**how).fit(net, y).result_
    assert len(a.history) == len(b.history) == 12 and a.picard_cap_hits == b.picard_cap_hits == 0
    for s, t in zip(a.history, b.history):
        for c in ("beta", "gamma", "sigma_sq", "loss_d", "loss_g"):
            assert s[c] == pytest.approx(t[c], abs=1e-6)
        assert s["picard_iterations"] >= t["picard_iterations"] and s["picard_residual"] < 1e-6
    assert made[0].solved_whole == 0
    assert made[0].deepened == (0 if known or abs(how.get("beta", 0)) < 0.6 else 24)


def test_polynomials_are_worked_out_near_the_roots_alone():
    """A ring of a million nodes: what six roots look at needs some hundred nodes, not all."""
    n = 1_000_000
    at = np.arange(n)
    net = est.LocalNetwork(np.concatenate([at, at]), np.concatenate([(at + 1) % n, (at - 1) % n]), np.sin(at))
    around, nodes = ahead.Around(net), np.arange(10, n, 200_000)
    noise = np.random.default_rng(1).standard_normal(n)
    cone = around.cone(nodes, around.degrees(1e-6, 0.6)[1])
    assert around.mutual and len(cone.nodes) < 40 * len(nodes) and (around.number == -1).all()
    want = est.LocalGame(LinearInMeans(TRUE, picard_tol=1e-12), net).solve(noise, {"beta": 0.6, "gamma": 0.0, "sigma_sq": 1.0})[0][nodes]
    q = cone.polynomials(noise)
    assert np.allclose(ahead.coefficients(0.6, len(q))[0] @ q, want, atol=5e-7)
    slope = (ahead.coefficients(0.6 + 1e-5, len(q))[0] - ahead.coefficients(0.6 - 1e-5, len(q))[0]) / 2e-5
    assert np.allclose(ahead.coefficients(0.6, len(q))[1], slope, atol=1e-7)


def test_edges_that_go_one_way_are_left_to_powers(spark):
    """Polynomials are for real eigenvalues; the terms of such a graph are powers, with the same result."""
    n = 60
    at = np.arange(n)
    net = est.LocalNetwork(np.concatenate([at, at]), np.concatenate([(at + 1) % n, (at + 7) % n]), np.sin(at))
    assert not ahead.mutual(net) and ahead.mutual(small())
    runs = spark.createDataFrame([(0,)], "realization long")
    rows = ahead.terms(runs, spark.sparkContext.broadcast(net), lambda k: fitted(), lambda k: observed(net, 1), False).toPandas()
    assert all("p" in r and "most" not in r for r in ahead.records_of(rows))


def test_what_is_told_has_the_steps_of_the_whole_graph(spark):
    net = small()
    rows = est.monte_carlo(spark, 1, net, observed, fitted, master=11, params=("beta", "gamma", "sigma_sq"), histories=True)
    seeds = est.seed_streams(11, 0)
    want = fitted().set_params(seed=seeds["train"]).fit(net, observed(net, seeds["gt"])).result_.history
    got = est.histories_of(rows).orderBy("step").collect()
    assert [r["picard_iterations"] for r in got] == [r["picard_iterations"] for r in want]
    assert all(r["beta"] == pytest.approx(t["beta"], abs=1e-6) and r["picard_residual"] == pytest.approx(t["picard_residual"], abs=1e-6) for r, t in zip(got, want))

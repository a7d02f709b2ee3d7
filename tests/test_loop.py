"""The minimax loop's parts: strategies, roots, guards, stopping, contracts."""

import math
import warnings

import numpy as np
import pytest

from netloom.functions.expr import Var
from netloom.operators import contracts, estimator as est, games, graph, sampling, series
from netloom.sources import graphs as gen
from tests.test_estimator import TRUE, network, outcome, recipe, start


def run(net, y, **how):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return est.run_minimax(net, y, how.pop("game", start()), est.RootedGin(3, 8, 2), recipe(**({"max_steps": 6} | how.pop("config", {}))), **how)


def test_both_strategies_give_the_same_gradients():
    net = network(80)
    y, seen = outcome(net), {}
    for kind in ("unroll", "implicit"):
        got = []
        run(net, y, config={"differentiation": kind, "max_steps": 3}, gradient_transform=lambda c: got.append(dict(c.gradients)) or c.gradients)
        seen[kind] = got
    for a, b in zip(*seen.values()):
        assert a == pytest.approx(b, rel=1e-4, abs=1e-7)
    game = games.EffortGame({"gamma": 1.0, "lambda_": 0.6, "mu": 0.4, "r": 1.2, "sigma_sq": 0.8})
    local, noise = est.LocalGame(game, net), np.random.default_rng(2).standard_normal(net.n)
    c = np.random.default_rng(3).standard_normal(net.n)
    y, tangents, *_ = local.solve(noise, game.params, True)
    back = local.pulled_back(y, noise, game.params, c)
    for name, t in tangents.items():
        h = 1e-5
        up, down = (local.solve(noise, game.params | {name: game.params[name] + s})[0] for s in (h, -h))
        assert back[name] == pytest.approx(float(c @ t), rel=1e-4) == pytest.approx(float(c @ (up - down)) / (2 * h), rel=1e-2, abs=1e-3)


def test_packings_follow_the_order_given(spark):
    net = network(120)
    draw = np.random.default_rng(1)
    orders = [draw.permutation(net.n) for _ in range(3)]
    edges = spark.createDataFrame(list(zip(net.src.tolist(), net.dst.tolist())), "src long, dst long")
    tables = [spark.createDataFrame([(int(v), k) for k, v in enumerate(o)], "id long, place long") for o in orders]
    for o, t in zip(orders, tables):
        want = est.pack(net, o, 2, net.n)
        assert {r.root for r in sampling.packed_in_order(edges, 2, t).collect()} == set(want.tolist())
        assert {r.root for r in sampling.packed_in_order(edges, 2, t, 5).collect()} == set(est.pack(net, o, 2, 5).tolist())
    best, tries = est.best_pack(net, orders, 2, net.n)
    table, again = sampling.best_packed_in_orders(edges, 2, tables)
    assert (tries, {r.root for r in table.collect()}) == (again, set(best.tolist())) and again == 3
    for f in (lambda: est.best_pack(net, [], 2, 5), lambda: sampling.best_packed_in_orders(edges, 2, [])):
        with pytest.raises(ValueError):
            f()


def test_samplers_keep_roots_apart_and_say_what_they_lack():
    net = network(150)
    draw = np.random.default_rng(0)
    apart = lambda roots, r: all(b not in set(net.ball(int(a), r).tolist()) for a in roots for b in roots if a != b)
    for mode in ("disjoint_once", "disjoint_best_of_k", "disjoint_relax"):
        got = est.LocalSampler(mode, exclusion_r=2, restarts=3, relax=(2, 1), min_batch=1, fallback="best")(net, draw, 6)
        assert apart(got.roots, got.radius_used) and got.achieved == len(got.roots) <= 6
    tight = est.LocalSampler("disjoint_relax", relax=(9, 8), min_batch=5, fallback="uniform")(net, draw, 5)
    assert tight.mode == "uniform" and "uniform_fallback" in tight.fallback_reason and len(tight.roots) == 5
    with pytest.raises(RuntimeError):
        est.LocalSampler("disjoint_relax", relax=(9,), min_batch=5, fallback="raise")(net, draw, 5)
    with pytest.raises(ValueError):
        est.LocalSampler("some")
    y = outcome(net)
    with pytest.warns(est.RootsShort) as told:
        est.run_minimax(net, y, start(), est.RootedGin(3, 8, 2), recipe(max_steps=3), sample=est.LocalSampler("disjoint_once", exclusion_r=3))
    said = [str(w.message) for w in told if w.category is est.RootsShort]
    assert sum("discriminator phase got" in s for s in said) == sum("structural phase got" in s for s in said) == 1 and sum("twice the ego radius" in s for s in said) == 2


def test_capped_solvers_are_told_once_and_counted():
    net = network(80)
    y = outcome(net)
    capped = games.LinearInMeans({"beta": 0.7, "gamma": 1.0}, beta_cap=0.85, picard_max=3)
    with pytest.warns(est.SolverCapped) as told:
        got = est.run_minimax(net, y, capped, est.RootedGin(3, 8, 2), recipe(max_steps=4))
    assert sum(w.category is est.SolverCapped for w in told) == 1 and got.picard_cap_hits == 4 and got.newton_cap_hits == 0
    hasty = games.EffortGame({"gamma": 1.0}, newton_steps=1, fix_r=1.0, fix_sigma_sq=1.0)
    with pytest.warns(est.SolverCapped, match="Newton"):
        got = est.run_minimax(net, y, hasty, est.RootedGin(3, 8, 2), recipe(max_steps=3))
    assert got.newton_cap_hits == 3 and set(got.params) == {"gamma", "lambda_", "mu"}


def test_failures_name_their_phase():
    net = network(60)
    y = outcome(net)

    class Blows(games.LinearInMeans):
        calls = 0

    for phase, bad in (("discriminator", 1), ("structural", 2)):
        real = est.LocalGame.solve
        count = [0]

        def solve(self, *a, **k):
            count[0] += 1
            out = real(self, *a, **k)
            return (np.full(net.n, np.nan), *out[1:]) if count[0] == bad else out

        with pytest.MonkeyPatch.context() as m, warnings.catch_warnings():
            warnings.simplefilter("ignore")
            m.setattr(est.LocalGame, "solve", solve)
            got = est.run_minimax(net, y, Blows(TRUE, beta_cap=0.85), est.RootedGin(3, 8, 2), recipe(max_steps=3))
        assert got.status == f"failed:non_finite_y_{phase}" and math.isnan(got.params["beta"])


def test_stopping_rule_equals_the_table(spark):
    draw = np.random.default_rng(4)
    c = est.EstimatorConfig(window=5, stability_window=4, min_steps=6, delta_d=0.03, delta_g=0.03, stability_tol=0.1, stability_overrides=(("gamma", 0.3),))
    ld, lg = (2 * math.log(2) + 0.03 * draw.standard_normal(60)).tolist(), (math.log(2) + 0.03 * draw.standard_normal(60)).tolist()
    path = [{"beta": 0.4 + 0.04 * a, "gamma": 1.5 + 0.1 * b} for a, b in draw.standard_normal((60, 2)).tolist()]
    rule = est.StoppingRule(c)
    first = next((k for k in range(1, 61) if rule.evaluate(ld[:k], lg[:k], path[:k]).converged), None)
    df = spark.createDataFrame([(0, k, a, b, p["beta"], p["gamma"]) for k, (a, b, p) in enumerate(zip(ld, lg, path), 1)], "realization long, step int, loss_d double, loss_g double, beta double, gamma double")
    got = series.stopping(df, ["beta", "gamma"], window=5, stability_window=4, tol=0.1, min_steps=6, overrides={"gamma": 0.3}, delta_d=0.03, delta_g=0.03).first()
    assert first is not None and got.first_step == first


@pytest.mark.parametrize("bad", [dict(min_steps=9, max_steps=5), dict(lr_g_decay_milestones=(5, 3)), dict(lr_g_decay_milestones=(0,)), dict(lr_g_decay_factor=1.5), dict(std_d_max=0.0), dict(differentiation="x"), dict(stability_overrides=(("a", 0.0),)), dict(delta_g=0.0)])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        est.EstimatorConfig(**bad)


def test_contracts(spark):
    assert isinstance(start(), contracts.StructuralModel) and isinstance(est.RootedGin(3, 4, 2), contracts.TestFunction) and isinstance(est.Blur(), contracts.BlurLike)
    for bad in (np.zeros((2, 2)), np.zeros(0), np.zeros(3, int)):
        with pytest.raises(ValueError):
            contracts.check_logits("scores", bad)
    for bad in (np.zeros(3), np.array([1.0, np.inf])):
        with pytest.raises(ValueError, match="best_response"):
            contracts.check_map_output(bad, 2, "best_response")
    w = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "src long, dst long, w double")
    vector = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "id long, x array<double>")
    with pytest.raises(ValueError, match="single numbers"):
        contracts.check_inputs(w, vector, ("x",))
    with pytest.raises(ValueError, match="lacks"):
        contracts.check_inputs(w.drop("src"), vector, ("x",))
    assert contracts.whole_or_none(None) is contracts.whole_or_none(math.nan) is None and contracts.whole_or_none(3.0) == 3
    with pytest.raises(TypeError):
        contracts.network_parts(3)

    class Column(games.LinearInMeans):
        def best_response(self): return 3.0

    class Unknown(games.LinearInMeans):
        def best_response(self): return Var("beta") * Var("z")

    with pytest.raises(TypeError, match="best_response"):
        Column()
    with pytest.raises(ValueError, match="z"):
        Unknown()


def test_a_two_hop_game_has_all_six_checks(spark):
    both = np.unique(np.concatenate([p := gen.barabasi_albert_pairs(40, 2, 1), p[:, ::-1]]), axis=0)
    edges = spark.createDataFrame(both.tolist(), "src long, dst long")
    nodes = spark.createDataFrame([(k, math.sin(k)) for k in range(40)], "id long, x double")
    w = graph.row_stochastic(edges)
    told = games.check_model(games.TwoHop({"beta": 0.4, "gamma": 1.0, "sigma_sq": 1.0}), w, nodes, radius=2, balls=graph.balls(edges, 2))
    assert [c.name for c in told] == ["equilibrium_residual", "contraction_modulus", "locality_A2", "shock_monotone_U4", "uniqueness", "gradients"] and told["gradients"].value == 3 and bool(told)
    game = games.TwoHop({"beta": 0.4, "gamma": 1.0, "sigma_sq": 1.0})
    drawn = game.shocks(nodes, 0)
    got = {r.id: r.dy_beta for r in game.tangents(w, drawn, ("beta",), 40).collect()}
    h = 1e-4
    up, down = ({r.id: r.y for r in games.TwoHop(game.params | {"beta": 0.4 + s}, picard_tol=1e-12).solve(w, drawn).nodes.collect()} for s in (h, -h))
    assert all(got[k] == pytest.approx((up[k] - down[k]) / (2 * h), abs=1e-3) for k in got)


def test_a_two_hop_game_on_arrays(spark):
    """The solution of the table form; tangents and the adjoint agree with differences; a fit runs."""
    net = network(60)
    truth = {"beta": 0.5, "gamma": 1.0, "sigma_sq": 1.0}
    game = games.TwoHop(truth, picard_tol=1e-12)
    local, noise = est.LocalGame(game, net), np.random.default_rng(3).standard_normal(net.n)
    y, tangents, *_ = local.solve(noise, truth, True)
    edges = spark.createDataFrame(list(zip(net.src.tolist(), net.dst.tolist())), "src long, dst long")
    nodes = spark.createDataFrame([(k, float(net.x[k, 0]), float(noise[k])) for k in range(net.n)], "id long, x double, eps double")
    table = {r.id: r.y for r in games.TwoHop(truth, picard_tol=1e-10).solve(graph.row_stochastic(edges), nodes).nodes.collect()}
    assert max(abs(table[k] - y[k]) for k in range(net.n)) < 1e-8
    cotangent = np.random.default_rng(4).standard_normal(net.n)
    back = local.pulled_back(y, noise, truth, cotangent)
    for name in truth:
        up, down = (local.solve(noise, truth | {name: truth[name] + h})[0] for h in (1e-6, -1e-6))
        slope = (up - down) / 2e-6
        assert np.allclose(tangents[name], slope, atol=1e-5) and back[name] == pytest.approx(cotangent @ slope, abs=1e-4)
    with pytest.warns(est.NotStationary):
        got = est.run_minimax(net, y, games.TwoHop({"beta": 0.1, "gamma": 0.5, "sigma_sq": 1.0}), est.RootedGin(3, 8, 2), recipe(max_steps=3))
    assert got.status == "ok" and got.final_step == 3


def test_histories_of_monte_carlo_runs(spark):
    net = network(60)

    def make(spec):
        return est.AdversarialEstimator(start(), est.RootedGin(3, 6, 2, seed=spec.index), recipe(max_steps=3 + spec.index))

    rows = est.monte_carlo(spark, 3, net, lambda n, s: est.LocalGame(games.LinearInMeans(TRUE, beta_cap=0.85), n).solve(np.random.default_rng(s).standard_normal(n.n), TRUE)[0], make, params=tuple(TRUE), histories=True)
    assert rows.rdd.getNumPartitions() == 3
    steps = est.histories_of(rows)
    assert {(r.realization, r["count"]) for r in steps.groupBy("realization").count().collect()} == {(0, 3), (1, 4), (2, 5)}
    assert series.padded(steps, series.horizon(steps), ["beta"]).count() == 3 * 6

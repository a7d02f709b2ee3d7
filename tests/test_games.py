import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import expr as ex
from netloom.operators import equilibrium as eq
from netloom.operators import games, graph
from netloom.operators.estimator import LocalGame, LocalNetwork
from netloom.sources import graphs as gen

TRUE = {"beta": 0.5, "gamma": 1.3, "sigma_sq": 1.0}
EFFORT = {"gamma": 1.5, "lambda_": 0.8, "mu": 0.4, "r": 1.0, "sigma_sq": 1.0}


@pytest.fixture(scope="module")
def small(spark):
    pairs = gen.barabasi_albert_pairs(40, 2, 1)
    edges = gen.from_pairs(spark, pairs)
    draw = np.random.default_rng(0)
    x, eps = draw.standard_normal(40), draw.standard_normal(40)
    nodes = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, eps))], "id long, x double, eps double")
    both = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0)
    w = np.zeros((40, 40))
    for a, b in both:
        w[a, b] = 1
    return graph.row_stochastic(edges), nodes, w / w.sum(1, keepdims=True), x, eps, LocalNetwork(both[:, 0], both[:, 1], x)


def values(df, c="y"):
    return np.array([r[c] for r in df.orderBy("id").collect()])


def test_linear_game_solves_the_system(small):
    w, nodes, dense, x, eps, _ = small
    got = games.LinearInMeans(TRUE, picard_tol=1e-12).solve(w, nodes)
    want = np.linalg.solve(np.eye(40) - 0.5 * dense, 1.3 * x + eps)
    assert got.converged and np.abs(values(got.nodes) - want).max() < 1e-9
    foc = games.LinearFoc(TRUE, picard_tol=1e-12).solve(w, nodes)
    assert np.abs(values(foc.nodes) - want).max() < 1e-9
    two = games.TwoHop(TRUE, picard_tol=1e-12).solve(w, nodes)
    assert np.abs(values(two.nodes) - np.linalg.solve(np.eye(40) - 0.5 * dense @ dense, 1.3 * x + eps)).max() < 1e-9


def test_effort_condition_holds_and_local_tier_agrees(small):
    w, nodes, dense, x, eps, net = small
    g = games.EffortGame(EFFORT, picard_tol=1e-11)
    y = values(g.solve(w, nodes).nodes)
    assert np.abs(1.8 * y - 0.4 * np.exp(-y) - 0.8 * dense @ y - 1.5 * x - eps).max() < 1e-8
    local, t, _, _ = LocalGame(g, net).solve(eps, g.params, True)
    assert np.abs(local - y).max() < 1e-8
    far = g.tangents(w, nodes, tuple(g.params), 60)
    for k in g.params:
        assert np.abs(values(far, f"dy_{k}") - t[k]).max() < 1e-7, k


@pytest.mark.parametrize("game", [games.LinearInMeans(TRUE), games.SaturatingPeer(TRUE), games.RawSum(TRUE | {"beta": 0.02})])
def test_tangents_against_differences(small, game):
    *_, eps, net = small
    game.picard_tol = 1e-12
    local = LocalGame(game, net)
    _, t, _, _ = local.solve(eps, game.params, True)
    for k, v in game.params.items():
        a, b = (local.solve(eps, game.params | {k: v + h})[0] for h in (1e-5, -1e-5))
        assert np.abs((a - b) / 2e-5 - t[k]).max() < 1e-5


def scalar(spark, slope, **how):
    start = spark.createDataFrame([(0, 0.0)], "id long, y double")
    return eq.picard(lambda df: df.withColumn("y", slope * F.col("y") + 1), start, **how)


def test_stopping_of_the_iteration(spark):
    got = scalar(spark, 0.5, tol=2.861e-6, max_iter=20)
    assert (got.iters, got.converged) == (20, True) and got.nodes.first()["y"] == pytest.approx(2, abs=1e-5)
    late = scalar(spark, 0.95, tol=1e-6, max_iter=50)
    assert (late.iters, late.converged) == (50, False) and late.residual >= 1e-6
    nodes, iters = got
    assert iters == 20
    fixed = scalar(spark, 0.5, max_iter=7, fixed=True)
    assert (fixed.iters, fixed.residual, fixed.converged) == (7, 0.0, False) and fixed.nodes.first()["y"] == 2 - 2 * 0.5**7
    with pytest.raises(eq.NotConverged) as e:
        scalar(spark, 0.95, tol=1e-6, max_iter=10, strict=True)
    assert e.value.cap == 10 and e.value.residual > e.value.tol


def test_newton_is_traced_over_a_sweep(spark):
    """The worst last change and most steps of any node in any Picard step, as a local run counts them; too few steps are told."""
    edges = gen.from_pairs(spark, gen.barabasi_albert_pairs(40, 2, 1))
    w = graph.row_stochastic(edges)
    nodes = spark.range(40).select("id", (F.col("id") % 7 / 3.0).alias("x"), (F.col("id") % 5 / 4.0 - 0.4).alias("eps"))
    values = {"gamma": 1.5, "lambda_": 2 / 3, "mu": 0.5, "r": 1.0, "sigma_sq": 1.0}
    whole = games.EffortGame(values).solve(w, nodes, fixed=6, traced=True)
    plain = games.EffortGame(values).solve(w, nodes, fixed=6)
    same = whole.nodes.alias("a").join(plain.nodes.alias("b"), "id").agg(F.max(F.abs(F.col("a.y") - F.col("b.y"))).alias("off")).first().off
    assert same < 1e-9 and whole.newton_residual < 1e-10 and 3 <= whole.newton_iters <= 8 and plain.newton_iters is None
    assert whole.nodes.columns == plain.nodes.columns
    hasty = games.EffortGame(values, newton_steps=1).solve(w, nodes, fixed=6, traced=True)
    assert hasty.newton_iters == 1 and hasty.newton_residual > 1e-3
    cube = lambda tol: spark.createDataFrame([(1.0,), (2.0,)], "z double").select(eq.newton_traced(F.col("z"), lambda z: z * z * z - 2, lambda z: 3 * z * z, 20, tol).alias("n")).select("n.*").collect()
    for r in cube(1e-10):
        assert abs(r.z**3 - 2) < 1e-12 and r.change < 1e-10 and 4 <= r.iters < 20
    assert all(a.iters < b.iters for a, b in zip(cube(1e-2), cube(1e-10)))


def test_newton_column(spark):
    df = spark.createDataFrame([(50.0,), (1.0,)], "z double")
    cube = lambda steps: eq.newton_column(F.col("z"), lambda z: z * z * z - 2, lambda z: 3 * z * z, steps)
    assert [r[0] for r in df.select(cube(40)).collect()] == [pytest.approx(2 ** (1 / 3))] * 2
    with pytest.raises(Exception, match="check_model"):
        spark.range(1).select(eq.newton_column(F.lit(1.0), lambda z: z, lambda z: z * 0.0)).collect()


def test_adjoint_of_a_scaled_identity(spark):
    jac = spark.range(5).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.9).alias("v"))
    c = spark.range(5).withColumn("c", F.lit(1.0))
    assert np.abs(values(eq.neumann(jac, c, 1e-9, 300).nodes) - 10).max() < 1e-6
    assert np.abs(values(eq.neumann(jac, c, 1e-9, 5).nodes) - 10).max() > 1e-3


def test_check_model(spark):
    edges = gen.ring_lattice(spark, 30, 1)
    w, nodes = graph.row_stochastic(edges), spark.range(30).withColumn("x", F.sin("id"))
    good = games.check_model(games.LinearInMeans({"beta": 0.4, "gamma": 1.0}), w, nodes)
    assert good and good["contraction_modulus"].value == pytest.approx(0.4, abs=1e-3) and len(list(good)) == 6
    flat = games.check_model(games.LinearInMeans({"beta": 0.0, "gamma": 1.0}), w, nodes)
    assert "DEGENERATE" in flat["contraction_modulus"].detail and flat["contraction_modulus"].passed

    class Wild(games.LinearFoc):
        transforms = {"beta": ex.Real(), "gamma": ex.Real(), "sigma_sq": ex.Positive()}

    assert not games.check_model(Wild({"beta": 1.5, "gamma": 1.0}, picard_max=10), w, nodes)["contraction_modulus"].passed
    two = games.TwoHop({"beta": 0.5, "gamma": 1.0})
    assert not games.check_model(two, w, nodes)["locality_A2"].passed
    assert games.check_model(two, w, nodes, radius=2, balls=graph.balls(edges, 2))["locality_A2"].passed
    with pytest.raises(KeyError):
        good["nothing"]


def test_game_contract():
    class Neither(games.Game):
        transforms = {}

    with pytest.raises(TypeError):
        Neither()
    with pytest.raises(KeyError):
        games.LinearInMeans({"zeta": 1})
    with pytest.raises(ValueError):
        games.LinearInMeans(beta_cap=1.0)
    assert list(games.VectorCovariates().params) == ["beta", "gamma[0]", "gamma[1]", "gamma[2]", "sigma_sq"]
    assert games.EffortGame({"lambda_": 0.5}).contraction_rate == pytest.approx(0.5 / 1.5)
    g = games.EffortGame(EFFORT)
    assert g.with_raw(g.raw()) == pytest.approx(EFFORT)


@pytest.mark.parametrize("t, v", [(ex.Real(), -3.0), (ex.Positive(), 0.2), (ex.Interval(-0.85, 0.85), 0.5), (ex.Interval(0, 4), 3.9), (games.Scaled(4.0), 1.0)])
def test_transforms(t, v):
    assert float(t.forward(ex.Const(t.inverse(v))).value({})) == pytest.approx(v, abs=1e-4)


def test_transform_ends():
    assert math.isfinite(ex.Interval(-0.85, 0.85).inverse(0.85)) and ex.Interval(0, 4).default == 2
    with pytest.raises(ValueError):
        ex.Positive().inverse(0)
    with pytest.raises(ValueError):
        ex.Interval(1, 1)


@pytest.mark.parametrize("fn", ["exp", "log", "tanh", "sigmoid", "softplus", "sqrt"])
def test_derivatives(fn, spark):
    e = ex.Fn(fn, ex.Var("a") * ex.Var("a") + 0.5) / (1 + ex.Var("b")) - ex.Var("a") * ex.Var("b")
    at = {"a": 0.7, "b": 0.3}
    for k in at:
        hi, lo = (float(e.value(at | {k: at[k] + h})) for h in (1e-6, -1e-6))
        assert float(ex.wrap(e.diff(k)).value(at)) == pytest.approx((hi - lo) / 2e-6, abs=1e-6)
    row = spark.createDataFrame([(0.7, 0.3)], "a double, b double").select(e.column({}).alias("v"), ex.wrap(e.diff("a")).column({}).alias("d")).first()
    assert row.v == pytest.approx(float(e.value(at))) and row.d == pytest.approx(float(ex.wrap(e.diff("a")).value(at)))
    with pytest.raises(ValueError):
        ex.Fn("gamma", 1)

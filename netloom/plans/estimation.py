"""Queries over generated data sets, the test function, estimation and Monte Carlo."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from netloom.functions.scalar import rounded
from netloom.operators import datasets, gin, graph
from netloom.operators import estimator as est
from netloom.operators.components import checkpointed
from netloom.operators.games import LinearInMeans
from netloom.operators.minimax import TableMinimax
from netloom.plans import sqltext as sql
from netloom.plans.graphs import XY, g45, parts, xy
from netloom.plans.registry import query
from netloom.sources import fixtures as fx

TRUE = {"beta": 0.4, "gamma": 1.5, "sigma_sq": 1.0}


def network(spark, d) -> est.LocalNetwork:
    """The largest component of the parts' graph, x standardised."""
    clean = graph.sanitize(checkpointed(g45(spark, d), slim=True))
    x = graph.reindexed(fx.price(spark, d), clean.ids)
    s = x.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    return est.LocalNetwork.collect(checkpointed(clean.edges, slim=True), x.select("id", ((F.col("x") - s["m"]) / s["s"]).alias("x")))


def observed(net: est.LocalNetwork, seed: int) -> np.ndarray:
    return est.LocalGame(LinearInMeans(TRUE, beta_cap=0.85), net).solve(np.random.default_rng(seed).standard_normal(net.n), TRUE)[0]


def estimator(spec: est.Realization, steps: int = 280) -> est.AdversarialEstimator:
    start = dict(zip(("beta", "gamma"), np.random.default_rng(spec.seeds["init"]).uniform((-0.2, 0.5), (0.2, 1.0)).tolist()))
    config = est.EstimatorConfig(max_steps=steps, batch=16, differentiation="implicit", window=35, stability_window=18, lr_g=8e-3, lr_d=4e-4, lr_g_decay_factor=0.5, lr_g_decay_milestones=(160, 220), seed=spec.seeds["train"])
    return est.AdversarialEstimator(LinearInMeans(start | {"sigma_sq": 1.0}, beta_cap=0.85), est.RootedGin(3, 12, 2, 4.0, seed=spec.seeds["train"]), config, est.Blur(tau_y0=1.0, anneal_steps=170))


@query()
def make_linear_in_means(spark, d):
    return datasets.linear_in_means(spark, n=parts(spark, d), seed=0).outcome


@query()
def make_effort_game(spark, d):
    return datasets.effort_game(spark, n=parts(spark, d), seed=0).outcome


def _seeded(batches):
    for batch in batches:
        rows = [est.seed_streams(42, int(k)) for k in batch["realization"]]
        yield batch.assign(**{s: [r[s] for r in rows] for s in ("gt", "train", "sampler", "init")})


@query()
def seed_streams(spark, d):
    """The seeds of each run that has events."""
    runs = fx.table(spark, d, "events").select(F.col("user_id").alias("realization")).distinct()
    return runs.mapInPandas(_seeded, "realization long, gt long, train long, sampler long, init long")


GIN = est.RootedGin(3, 16, 2, seed=3)


def _standardised(spark, d, edges):
    """(id, f): x and y of the nodes, standardised, as the features that a root's marker is added to."""
    n = graph.standardized(xy(spark, d, edges), graph.norm_stats(xy(spark, d, edges)))
    return n.select("id", F.array("xt", "yt").alias("f"))


def _dense(z: str, w: np.ndarray, b: np.ndarray) -> str:
    columns = ", ".join(f"{{'w': {w[:, j].tolist()}::double[], 'b': {float(b[j])!r}::double}}" for j in range(w.shape[1]))
    return f"list_transform([{columns}], lambda c: list_dot_product({z}, c.w) + c.b)"


def _relu(h: str) -> str:
    return f"list_transform({h}, lambda v: greatest(v, 0::double))"


def _gin_sql(weights: gin.Weights) -> str:
    """The plain form: every layer on every node of every ego of radius 2."""
    p, parts, width = weights.p, [], 3
    for k in range(weights.layers):
        own, sums = 1 + weights.eps(k), ", ".join(f"sum(m[{i + 1}])" for i in range(width))
        parts += [
            f"z{k} as (select root, node, [{sums}] as z from (select root, node, list_transform(h, lambda v: v * {own!r}::double) as m from h{k} union all select t.root, t.src, u.h from t join h{k} u on u.root = t.root and u.node = t.dst) group by root, node)",
            f"c{k} as (select root, node, {_dense(_relu(_dense('z', p[f'{k}.a.w'], p[f'{k}.a.b'])), p[f'{k}.c.w'], p[f'{k}.c.b'])} as c from z{k})",
            f"n{k} as (select root, node, list_transform(c, lambda v: (v - list_avg(c)) / sqrt(list_var_pop(c) + 1e-5::double)) as n from c{k})",
            f"h{k + 1} as (select root, node, list_transform(list_zip(n, {p[f'{k}.g'].tolist()}::double[], {p[f'{k}.o'].tolist()}::double[]), lambda v: greatest(v[1] * v[2] + v[3], 0::double)) as h from n{k})",
        ]
        width = len(p[f"{k}.g"])
    raw = _dense(_relu(_dense("h", p["h.a.w"], p["h.a.b"])), p["h.c.w"], p["h.c.b"]) + "[1]"
    c = f"{weights.clip!r}::double"
    return f"""with {sql.edges(45)}, {XY}, st as (select avg(x) as mx, stddev_pop(x) as sx, avg(y) as my, stddev_pop(y) as sy from xy), {sql.balls(2)},
t as (select a.root, e.src, e.dst from b a join e on e.src = a.node join b c on c.root = a.root and c.node = e.dst),
h0 as (select root, node, [(x - mx) / sx, (y - my) / sy, (root = node)::int::double] as h from b join xy on id = node, st),
{(chr(10) + ', ').join(parts).replace(chr(10) + ', ', ',' + chr(10))}
select root, {sql.rnd(f'{c} * tanh({raw} / {c})')} as logit from h{weights.layers} where root = node"""


@query(_gin_sql(gin.Weights.of(GIN)))
def gin_forward(spark, d):
    """A logit for the ego of every node, by joins."""
    e = g45(spark, d)
    return gin.scores(gin.Weights.of(GIN), e, _standardised(spark, d, e), 2).select("root", rounded(F.col("logit")).alias("logit"))


def real_slope(logit: np.ndarray) -> np.ndarray:
    """The derivative of softplus(-logit), a real object's loss."""
    return -1 / (1 + np.exp(logit))


@query()
def gin_gradients(spark, d):
    """The gradient of the summed loss of all egos, taken as real, by every parameter."""
    e = g45(spark, d)
    return gin.gradients(gin.Weights.of(GIN), e, _standardised(spark, d, e), 2, real_slope).withColumn("value", rounded(F.col("value")))


@query()
def minimax_step(spark, d):
    """One outer step of adversarial estimation on tables, every node a root: losses, gradients, and where the parameters go."""
    e = g45(spark, d)
    n = fx.shocked(fx.nodes(e, fx.price(spark, d)))
    seen = LinearInMeans(TRUE, beta_cap=0.85).solve(graph.row_stochastic(e), n, fixed=20).nodes
    config = est.EstimatorConfig(max_steps=1, n_disc=1, seed=3, window=1, stability_window=1)
    loop = TableMinimax(e, seen, LinearInMeans({"beta": 0.1, "gamma": 0.8, "sigma_sq": 1.0}, beta_cap=0.85), est.RootedGin(3, 8, 2, seed=3), config, steps=20)
    r = loop.step(1, config.lr_g)
    rows = [(k, r[k]) for k in ("loss_d", "loss_g", "grad_norm_g")] + [(f"gradient {k}", v) for k, v in r["param_grads"].items()] + [(k, v) for k, v in r["params"].items()]
    return spark.createDataFrame([(k, round(float(v), 6)) for k, v in rows], "name string, value double")


def _observed_seven(net: est.LocalNetwork, _: int) -> np.ndarray:
    return observed(net, 7)


def _estimates(fit: est.AdversarialEstimator) -> pd.DataFrame:
    return fit.estimates()


def _scores(fit: est.AdversarialEstimator) -> pd.DataFrame:
    real, fake = fit.scores(128)
    return pd.DataFrame({"slot": np.arange(len(real)), "real": real, "fake": fake})


def packed_estimator(spec: est.Realization) -> est.AdversarialEstimator:
    """Roots packed four steps apart, so that no two ego objects of a batch share a node."""
    return estimator(spec).set_params(sample=est.LocalSampler("disjoint_relax", relax=(4, 3), restarts=2, min_batch=12, fallback="best"))


_ESTIMATES = "param string, coef double, final double, path_sd double"


@query()
def fit_lim(spark, d):
    return est.fit_in_task(spark, network(spark, d), _observed_seven, estimator, _estimates, _ESTIMATES, master=7, told=False)


@query()
def fit_lim_packed(spark, d):
    return est.fit_in_task(spark, network(spark, d), _observed_seven, packed_estimator, _estimates, _ESTIMATES, master=7, told=False)


@query()
def discriminator_scores(spark, d):
    return est.fit_in_task(spark, network(spark, d), _observed_seven, estimator, _scores, "slot long, real double, fake double", master=7, told=False)


PARAMS = ("beta", "gamma", "sigma_sq")


@query()
def mc_run(spark, d):
    return est.monte_carlo(spark, 8, network(spark, d), observed, estimator, master=11, params=PARAMS).drop("elapsed_seconds")  # which no two runs share


def short_estimator(spec: est.Realization) -> est.AdversarialEstimator:
    return estimator(spec, steps=60)


@query()
def mc_histories(spark, d):
    """All steps of four short runs."""
    return est.histories_of(est.monte_carlo(spark, 4, network(spark, d), observed, short_estimator, master=11, params=PARAMS, histories=True)).drop("params", "param_grads", "extras")

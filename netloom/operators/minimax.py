"""Adversarial estimation on tables, for graphs that no worker holds.

The steps are those of ``estimator.run_minimax``; what is as large as the graph stays in DataFrames, and only losses,
parameters and their gradients come to the driver. A step costs some tens of jobs, so this pays where the arrays don't fit.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from netloom.functions.expr import Var
from netloom.functions.scalar import gaussian_hash
from netloom.operators import gin, sampling
from netloom.operators.components import checkpointed
from netloom.operators.estimator import Adam, Blur, EstimatorConfig, RootedGin, Result, StoppingRule, expit, softplus
from netloom.operators.games import Game
from netloom.operators.graph import row_stochastic


class TableMinimax:
    """A game's parameters learnt against a test function on ``edges(src, dst)``, both directions, and nodes(id, covariates, y).

    ``batch`` roots are drawn for each phase of a step, uniformly with replacement, a root that is drawn twice counting
    once; None takes every node, which makes a step exact. The blur of a step is one draw per node and role, as the
    first layer's messages are shared by all egos. Everything drawn is a hash of the seed, the step, the phase and the node's id.
    """

    def __init__(self, edges: DataFrame, nodes: DataFrame, game: Game, disc: RootedGin, config: EstimatorConfig, *, k: int = 2, blur: Blur | None = None, batch: int | None = None, steps: int = 30):
        if disc.layers < k:
            raise ValueError("the test function must have as many layers as the ego radius")
        if disc.in_dim != len(game.covariates) + 2:
            raise ValueError(f"the test function must take {len(game.covariates) + 2} features")
        self.game, self.disc, self.config, self.k, self.blur, self.batch, self.steps = game, disc, config, k, blur or Blur(enabled=False), batch, steps
        self.edges = checkpointed(edges.select("src", "dst").where("src <> dst").distinct())
        self.weights = checkpointed(row_stochastic(self.edges))
        self.nodes = checkpointed(nodes.select("id", *game.covariates, "y"))
        one = self.nodes.agg(F.count("*").alias("n"), F.avg("y").alias("mu_y"), F.stddev_pop("y").alias("sigma_y"), *(f(c).alias(f"{s}_{c}") for c in game.covariates for s, f in (("mu", F.avg), ("sigma", F.stddev_pop)))).first()
        self.stats = one.asDict()
        if not self.stats["n"] or not self.stats["sigma_y"] > 1e-10 or any(not self.stats[f"sigma_{c}"] > 1e-12 for c in game.covariates):
            raise ValueError("y or a covariate is constant: nothing to standardise")
        self.raw = {k: np.float64(v) for k, v in game.raw().items()}
        self.adam_d, self.adam_g = Adam(config.lr_d), Adam(config.lr_g)

    @property
    def params(self) -> dict[str, float]:
        return self.game.with_raw(self.raw)

    def features(self, y: DataFrame, tau: float, *key) -> DataFrame:
        """``(id, f)`` of nodes(id, covariates, y): standardised, y blurred by ``tau`` deviations."""
        s = self.stats
        x = [(F.col(c) - s[f"mu_{c}"]) / s[f"sigma_{c}"] for c in self.game.covariates]
        out = (F.col("y") - s["mu_y"]) / s["sigma_y"]
        if tau > 0:
            out = out + tau * gaussian_hash(self.config.seed, "blur", *key, F.col("id"))
        return y.select("id", F.array(*x, out).alias("f"))

    def simulated(self, params: dict[str, float], *key, tangents: bool = False) -> DataFrame:
        """nodes(id, covariates, eps, y) at an equilibrium with shocks of their own, with ``dy_<parameter>`` if asked for."""
        game = self.game
        game.params = dict(params)
        sigma = math.sqrt(game.values.get("sigma_sq", 1.0))
        begun = self.nodes.drop("y").withColumn("eps", sigma * gaussian_hash(self.config.seed, "eps", *key, F.col("id")))
        if tangents:
            return checkpointed(game.tangents(self.weights, begun, tuple(params), self.steps))
        return checkpointed(game.solve(self.weights, begun, fixed=self.steps).nodes)

    def roots(self, *key) -> tuple[DataFrame | None, int]:
        """(roots of a phase, their number); None for all nodes."""
        if self.batch is None:
            return None, self.stats["n"]
        picks = checkpointed(sampling.uniform(self.nodes.select("id"), self.batch, self.config.seed, hash_of(key)).select("root").distinct(), slim=True)
        return picks, picks.count()

    def against(self, features: DataFrame, value: Callable, slope: Callable, roots: DataFrame | None, n: int):
        """(mean of a loss over roots, its gradient by the test function's effective weights, its gradient by the features)."""
        return gin.pulled(gin.Weights.of(self.disc), self.edges, features, self.k, lambda x: value(x) / n, lambda x: slope(x) / n, roots)

    def scores(self, *key) -> DataFrame:
        """``(root, real, fake)``: the test function's logits for the ego of every node, of the outcome and of a simulated one."""
        sides = {"real": self.nodes, "fake": self.simulated(self.params, *(key or (0, "s")))}
        real, fake = (gin.scores(gin.Weights.of(self.disc), self.edges, self.features(rows, 0.0), self.k).withColumnRenamed("logit", side) for side, rows in sides.items())
        return real.join(fake, "root")

    def learn_test(self, step: int, tau: float) -> float:
        """One update of the test function: its loss before."""
        loss = 0.0
        fake = self.simulated(self.params, step, "d")
        roots, n = self.roots(step, "d")
        gradient: dict[str, np.ndarray] = {}
        sides = ((self.nodes, "real", lambda x: softplus(-x), lambda x: -expit(-x)), (fake, "fake", softplus, expit))
        for rows, role, value, slope in sides:
            part, g, _ = self.against(self.features(rows, tau, step, role), value, slope, roots, n)
            loss += part
            for name, v in g.items():
                gradient[name] = gradient.get(name, 0.0) + self.disc._gw(name, v) if name.endswith(".w") else gradient.get(name, 0.0) + v
        self.adam_d.step(self.disc.p, gradient)
        return loss

    def structural(self, step: int, tau: float) -> tuple[float, dict[str, float]]:
        """(the game's loss, its gradient by each parameter): the scores' gradient by y, joined to the solution's tangents."""
        solved = self.simulated(self.params, step, "g", tangents=True)
        roots, n = self.roots(step, "g")
        if self.config.loss == "nonsaturating":
            value, slope = (lambda x: softplus(-x)), (lambda x: -expit(-x))
        else:
            value, slope = (lambda x: -softplus(x)), (lambda x: -expit(x))
        loss, _, by_node = self.against(self.features(solved, tau, step, "g"), value, slope, roots, n)
        y = len(self.game.covariates)  # where y stands among the features
        joined = solved.join(by_node.select("id", (F.col("g")[y] / self.stats["sigma_y"]).alias("_g")), "id")
        sums = joined.agg(*(F.sum(F.col("_g") * F.col(f"dy_{p}")).alias(p) for p in self.params)).first()
        return loss, {p: float(sums[p] or 0.0) for p in self.params}

    def step(self, step: int, lr: float) -> dict:
        """One outer step: updates of the test function, then of the game's parameters; its record."""
        tau = self.blur.tau(step)
        loss_d = math.nan
        for _ in range(self.config.n_disc):
            loss_d = self.learn_test(step, tau)
        loss_g, slopes = self.structural(step, tau)
        raw = Var("raw")
        grads = {k: slopes[k] * float(t.forward(raw).diff("raw").value({"raw": self.raw[k]})) for k, t in self.game.transforms.items()}
        norm = math.sqrt(sum(v * v for v in grads.values()))
        scale = min(1.0, self.config.grad_clip / max(norm, 1e-12))
        self.adam_g.lr = lr
        self.adam_g.step(self.raw, {k: np.float64(v * scale) for k, v in grads.items()})
        return {"step": step, "params": self.params, "loss_d": loss_d, "loss_g": loss_g, "grad_norm_g": norm, "tau_y": tau, "lr_g": lr, "param_grads": grads, **self.params}

    def fit(self) -> Result:
        """Steps until losses settle and parameters stand still, or ``max_steps``; tail averages as in the array form."""
        c, rule, history, lr, converged = self.config, StoppingRule(self.config), [], self.config.lr_g, False
        for step in range(1, c.max_steps + 1):
            lr *= c.lr_g_decay_factor if step in c.lr_g_decay_milestones else 1.0
            record = self.step(step, lr)
            history.append(record)
            if not (math.isfinite(record["loss_d"]) and math.isfinite(record["loss_g"])):
                nan = dict.fromkeys(self.params, math.nan)
                return Result("failed:nan_loss", False, step, nan, nan, nan, math.nan, math.nan, history)
            path = [r["params"] for r in history]
            if rule.evaluate([r["loss_d"] for r in history], [r["loss_g"] for r in history], path).converged:
                converged = True
                break
        last = path[-max(c.window, c.stability_window) :]
        mean = {k: float(np.mean([p[k] for p in last])) for k in path[-1]}
        sd = {k: float(np.std([p[k] for p in last])) for k in path[-1]}
        losses = [np.mean([r[n] for r in history[-c.window :]]) for n in ("loss_d", "loss_g")]
        return Result("ok", converged, len(path), mean, path[-1], sd, *map(float, losses), history)


def hash_of(key: tuple) -> int:
    """A number for the call of a sampler: of the step and the phase."""
    step, phase = key
    return 2 * int(step) + (phase == "g")

"""A Monte Carlo experiment from a configuration: ``python -m netloom.plans.experiment OUT --realizations 20``."""

from __future__ import annotations

import argparse
from functools import partial

import numpy as np
from pyspark.sql import SparkSession, functions as F

from netloom.functions.config import EffortExperimentConfig, ExperimentConfig, MonteCarloConfig, with_overrides
from netloom.functions.constants import MANIFEST
from netloom.functions.scalar import gaussian_hash
from netloom.operators import datasets
from netloom.operators import estimator as est
from netloom.operators.games import EffortGame, LinearInMeans
from netloom.operators.observers import MonteCarloRunner
from netloom.sources import files


def substrate(spark: SparkSession, config: ExperimentConfig) -> datasets.Substrate:
    g = config.graph
    x = spark.range(g.n).withColumn("x", gaussian_hash(g.seed + 1, "x", F.col("id")))
    return datasets.Substrate.from_graph(datasets.generated(spark, g.kind, g.n, g.seed, **g.generator()), x, k=config.model.k)


def is_effort(config) -> bool:
    return isinstance(config, EffortExperimentConfig)


def initial(config, seed: int) -> dict[str, float]:
    """Starting values: uniform in the ranges given, else those of the configuration."""
    draw = np.random.default_rng(seed)
    mc = config.monte_carlo
    ranges = {name: (low, high) for name, low, high in mc.init_ranges} if mc else {}
    out = {k: float(draw.uniform(*ranges[k])) if k in ranges else v for k, v in config.init.values}
    if mc and not mc.init_sigma_sq_one:
        out["sigma_sq"] = float(np.exp(draw.uniform(*mc.init_log_sigma_sq)))
    return out


def game(config, values: dict[str, float]):
    """The configured game at some values; fixed ones are left to the configuration."""
    m = config.model
    if not is_effort(config):
        return LinearInMeans(values, beta_cap=m.beta_cap, picard_tol=m.picard_tol, picard_max=m.picard_max)
    fixed = {"r": m.fix_r, "sigma_sq": m.fix_sigma_sq}
    return EffortGame({k: v for k, v in values.items() if fixed.get(k) is None}, lambda_max=m.lambda_max, fix_r=m.fix_r, fix_sigma_sq=m.fix_sigma_sq, picard_tol=m.picard_tol, picard_max=m.picard_max, newton_steps=m.newton_max, newton_tol=m.newton_tol)


def truth(config) -> dict[str, float]:
    """The true values of what is estimated."""
    return {k: v for k, v in config.truth.values if k in game(config, dict(config.truth.values)).params}


def observed(config, net: est.LocalNetwork, seed: int) -> np.ndarray:
    at = game(config, dict(config.truth.values))
    at.picard_max = max(at.picard_max, 200)
    return est.LocalGame(at, net).solve(np.random.default_rng(seed).standard_normal(net.n), at.params)[0]


def estimator(config, spec: est.Realization) -> est.AdversarialEstimator:
    m, t = config.model, config.training
    layers = m.resolved_layers() if is_effort(config) else m.layers
    settings = est.EstimatorConfig.from_configs(config, seed=spec.seeds["train"])
    return est.AdversarialEstimator(game(config, initial(config, spec.seeds["init"])), est.RootedGin(3, m.hidden, layers, m.clip, seed=spec.seeds["train"]), settings, t.blur, sample=t.sampler())


def run(spark: SparkSession, config: ExperimentConfig | EffortExperimentConfig, out: str, realizations: int | None = None, visualize=None) -> dict:
    """Rows with histories and the manifest of an experiment under ``out``; what is there already is not run again."""
    if config.monte_carlo is None:
        raise ValueError("the configuration has no Monte Carlo part")
    sub = substrate(spark, config)
    sub.warn_if_overlapping(config.training.sampler().effective_r)
    net = est.LocalNetwork.collect(sub.edges, sub.covariates, k=config.model.k)
    runner = MonteCarloRunner(spark, out, config, truth(config), master=config.monte_carlo.seed, visualize=visualize, plot_every=config.monte_carlo.plot_every, progress_every=config.monte_carlo.progress_every)
    manifest = runner.run(realizations or config.monte_carlo.realizations, net, partial(observed, config), partial(estimator, config))
    if "://" not in out:
        files.save_manifest(f"{out}/{MANIFEST}", manifest)
    return manifest


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("out")
    p.add_argument("--game", choices=["linear", "effort"], default="linear")
    p.add_argument("--realizations", type=int)
    p.add_argument("--nodes", type=int)
    p.add_argument("--seed", type=int)
    a = p.parse_args(argv)
    config = ExperimentConfig.mc_default()
    if a.game == "effort":
        small = EffortExperimentConfig.default()
        config = with_overrides(small, graph=config.graph, training=with_overrides(small.training, roots="uniform"), monte_carlo=MonteCarloConfig(init_ranges=()))
    if a.nodes:
        config = with_overrides(config, graph=with_overrides(config.graph, n=a.nodes))
    if a.seed is not None:
        config = with_overrides(config, monte_carlo=with_overrides(config.monte_carlo, seed=a.seed))
    run(SparkSession.builder.getOrCreate(), config, a.out, a.realizations)


if __name__ == "__main__":
    main()

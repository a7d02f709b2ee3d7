import contextlib
import json
from pathlib import Path

import numpy as np
import pytest

from netloom.functions import config as cf
from netloom.operators import estimator as est
from netloom.plans import experiment


def test_runs_from_a_configuration(spark, tmp_path):
    config = cf.ExperimentConfig(
        graph=cf.GraphConfig(kind="ba", n=80), model=cf.ModelConfig(beta_cap=0.85, hidden=6, clip=4.0),
        training=cf.TrainingConfig(n_steps=12, batch=8, n_disc=1, roots="uniform", min_batch=8, least_roots=8, blur=cf.BlurConfig(anneal_steps=4)),
        monte_carlo=cf.MonteCarloConfig(realizations=2, min_steps=0, max_steps=None, window=4, stability_window=3),
    )
    told = experiment.run(spark, config, str(tmp_path))
    assert told["completed"] == 2 and told["config_hash"] == cf.config_hash(config)
    assert json.load(open(tmp_path / "run_manifest.json"))["completed"] == 2
    assert experiment.run(spark, config, str(tmp_path))["completed"] == 0
    low, high = config.monte_carlo.init_ranges[0][1:]
    assert all(low <= experiment.initial(config, s)["beta"] <= high for s in range(9))
    with pytest.raises(ValueError):
        experiment.run(spark, cf.ExperimentConfig(), str(tmp_path))


def small(**training):
    return dict(
        graph=cf.GraphConfig(kind="ba", n=90), training=cf.TrainingConfig(**(dict(n_steps=10, batch=6, n_disc=1, min_batch=2, least_roots=2, blur=cf.BlurConfig(anneal_steps=3)) | training)),
        monte_carlo=cf.MonteCarloConfig(realizations=2, min_steps=None, max_steps=None, window=4, stability_window=3, init_ranges=()),
    )


def test_effort_games_histories_and_pictures(spark, tmp_path):
    seen = []
    config = cf.EffortExperimentConfig(model=cf.EffortModelConfig(hidden=6), **small(roots="disjoint_best_of_k", restarts=2))
    assert experiment.truth(config) == {"gamma": 1.5, "lambda_": 2 / 3, "mu": 0.5}
    with pytest.warns(UserWarning, match="overlap") if config.training.exclusion_r < 4 else contextlib.nullcontext():
        told = experiment.run(spark, config, str(tmp_path), visualize=lambda rows, steps: seen.append((rows.count(), steps.count(), steps.columns)))
    assert told["completed"] == 2 and {s["param"] for s in told["summary"]} == {"gamma", "lambda_", "mu"}
    (rows, steps, columns), = seen
    assert rows == 2 and steps == 20 and {"realization", "step", "loss_d", "loss_g", "mu"} <= set(columns)


def test_settings_of_roots_reach_the_sampler():
    t = cf.TrainingConfig(roots="disjoint_relax", relax=(5, 2), restarts=4, min_batch=3, fallback="raise")
    assert t.sampler() == est.LocalSampler("disjoint_relax", 4, 4, (5, 2), 3, "raise")
    old = cf.TrainingConfig(roots=None, restarts=None, min_batch=None, relax=None, relax_to_r2=True, least_roots=9)
    assert (old.resolved_mode(), old.resolved_restarts(), old.resolved_min_batch(), old.resolved_relax()) == ("disjoint_relax", 1, 9, (4, 2))
    assert cf.TrainingConfig(roots=None, scheme="uniform").resolved_mode() == "uniform" and cf.TrainingConfig(restarts=None).resolved_restarts() == 3
    for bad in (dict(roots="x"), dict(fallback="x"), dict(min_batch=65), dict(relax=()), dict(exclusion_r=-1), dict(scheme="x")):
        with pytest.raises(ValueError):
            cf.TrainingConfig(**bad)


def test_experiments_by_default():
    big, cheap, effort = cf.ExperimentConfig.default(), cf.ExperimentConfig.mc_default(), cf.EffortExperimentConfig.default()
    assert big.graph.n == 250_000 and big.training.resolved_mode() == "disjoint_best_of_k" and big.training.blur.anneal_steps == 700
    assert cheap.training.sampler().mode == "uniform" and effort.model.resolved_layers() == 2
    got = est.EstimatorConfig.from_configs(cheap, seed=5)
    assert (got.max_steps, got.min_steps, got.batch, got.seed, got.grad_clip, got.lr_g_decay_milestones) == (2000, 700, 17, 5, 10.0, (220, 420, 620, 780))
    with pytest.raises(ValueError, match="Monte Carlo"):
        est.EstimatorConfig.from_configs(big)
    with pytest.raises(ValueError, match="blur"):
        cf.ExperimentConfig(monte_carlo=cf.MonteCarloConfig(max_steps=705))
    for bad in (dict(mu=-1.0), dict(r=0.0)):
        with pytest.raises(ValueError):
            cf.EffortExperimentConfig(truth=cf.Params(tuple((dict(effort.truth.values) | bad).items())))
    for bad in (dict(lr_g_decay_factor=0.0), dict(min_steps=9, max_steps=5), dict(lr_g_decay_milestones=(5, 3)), dict(init_ranges=(("beta", 1.0, 0.0),))):
        with pytest.raises(ValueError):
            cf.MonteCarloConfig(**bad)


def test_anything_becomes_json():
    odd = {"a": np.float32(1.5), 3: {2, 1}, "n": float("nan"), "p": Path("x"), "c": cf.BlurConfig(), "z": np.arange(2), "t": (1, None)}
    got = json.loads(json.dumps(cf.jsonable(odd), allow_nan=False))
    assert got["a"] == 1.5 and got["3"] == [1, 2] and got["n"] == "nan" and got["p"] == "x" and got["c"]["tau_y0"] == 1.2 and got["z"] == [0, 1] and got["t"] == [1, None]

"""Configurations of experiments, with the checks that belong to them."""

from __future__ import annotations

import datetime
import hashlib
import json
import math
import platform
import subprocess
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, is_dataclass, replace
from typing import Any

from netloom.functions.constants import TAIL_WINDOW


def _positive(o: Any, *names: str) -> None:
    for n in names:
        if getattr(o, n) is not None and getattr(o, n) <= 0:
            raise ValueError(f"{n} must be positive")


@dataclass(frozen=True)
class GraphConfig:
    kind: str = "lfr"
    n: int = 250_000
    tau1: float = 2.5
    tau2: float = 1.5
    mu: float = 0.3
    average_degree: float | None = 6
    min_degree: int | None = None
    min_community: int = 20
    max_community: int = 100
    max_degree: int | None = 100
    m: int = 2
    seed: int = 42

    def __post_init__(self):
        _positive(self, "n", "m", "min_community", "max_community", "max_degree")
        if self.kind not in ("ba", "lfr"):
            raise ValueError("kind must be ba or lfr")
        if self.kind == "lfr" and (self.average_degree is None) == (self.min_degree is None):
            raise ValueError("give exactly one of average_degree and min_degree")
        if self.tau1 <= 1 or self.tau2 <= 1 or not 0 <= self.mu <= 1:
            raise ValueError("exponents must exceed 1 and mu lie in [0, 1]")

    def generator(self) -> dict[str, Any]:
        """What the generator takes; settings that are None are left out."""
        names = ("m",) if self.kind == "ba" else ("tau1", "tau2", "mu", "average_degree", "min_degree", "max_degree", "min_community", "max_community")
        return {k: getattr(self, k) for k in names if getattr(self, k) is not None}


@dataclass(frozen=True)
class ModelConfig:
    k: int = 2
    beta_cap: float = 1.0
    picard_tol: float = 1e-6
    picard_max: int = 100
    hidden: int = 64
    layers: int = 2
    clip: float | None = 5.0

    def __post_init__(self):
        _positive(self, "k", "beta_cap", "picard_tol", "picard_max", "hidden", "layers", "clip")
        if self.layers < self.k:
            raise ValueError("the test function needs as many layers as the ego radius")


@dataclass(frozen=True)
class BlurConfig:
    enabled: bool = True
    tau_y0: float = 1.2
    schedule: str = "linear"
    anneal_steps: int = 2000
    min_tau: float = 0.0

    def __post_init__(self):
        if self.schedule not in ("constant", "linear", "exp"):
            raise ValueError(f"unknown schedule {self.schedule!r}")
        if min(self.tau_y0, self.anneal_steps, self.min_tau) < 0:
            raise ValueError("blur settings must not be negative")


MODES = ("uniform", "disjoint_once", "disjoint_best_of_k", "disjoint_relax")


@dataclass(frozen=True)
class TrainingConfig:
    """How a run trains and draws its roots. Settings that are None follow the older ones: ``scheme``, ``least_roots``, ``relax_to_r2``."""

    n_steps: int = 800
    batch: int = 64
    n_disc: int = 5
    lr_d: float = 1e-3
    lr_g: float = 5e-3
    grad_clip: float = 5.0
    roots: str | None = "disjoint_best_of_k"
    exclusion_r: int = 4
    restarts: int | None = 50
    min_batch: int | None = 64
    relax: tuple[int, ...] | None = (3, 2)
    fallback: str = "best"
    scheme: str = "greedy_packing"
    least_roots: int = 64
    relax_to_r2: bool = False
    blur: BlurConfig = field(default_factory=BlurConfig)

    def __post_init__(self):
        _positive(self, "n_steps", "batch", "n_disc", "lr_d", "lr_g", "grad_clip", "restarts", "min_batch", "least_roots")
        if self.roots not in (None, *MODES):
            raise ValueError(f"roots must be None or one of {MODES}")
        if self.scheme not in ("uniform", "greedy_packing"):
            raise ValueError("scheme must be uniform or greedy_packing")
        if self.fallback not in ("uniform", "best", "raise"):
            raise ValueError("fallback must be best, uniform or raise")
        if self.exclusion_r < 0 or self.relax is not None and (not self.relax or min(self.relax) < 0):
            raise ValueError("radii must not be negative, and a ladder has one at least")
        if max(self.least_roots, self.resolved_min_batch()) > self.batch:
            raise ValueError("the least number of roots must not exceed the batch")

    def resolved_mode(self) -> str:
        return self.roots or ("uniform" if self.scheme == "uniform" else "disjoint_relax")

    def resolved_restarts(self) -> int:
        return self.restarts or (1 if self.roots is None and self.scheme == "greedy_packing" else 3)

    def resolved_min_batch(self) -> int:
        return self.min_batch or self.least_roots

    def resolved_relax(self) -> tuple[int, ...]:
        if self.relax is not None:
            return tuple(self.relax)
        return (self.exclusion_r, 2) if self.relax_to_r2 and self.exclusion_r != 2 else (self.exclusion_r,)

    def sampler(self):
        """The sampler of the local tier that these settings describe."""
        from netloom.operators.estimator import LocalSampler

        return LocalSampler(self.resolved_mode(), self.exclusion_r, self.resolved_restarts(), self.resolved_relax(), self.resolved_min_batch(), self.fallback)


@dataclass(frozen=True)
class Params:
    """True or initial values of a game's parameters."""

    values: tuple[tuple[str, float], ...] = (("beta", 0.4), ("gamma", 1.5), ("sigma_sq", 1.0))


#: What ends a run by the blur's own length, of the steps before the averaged tail.
def _blur(steps: int, tau: float = 1.2) -> BlurConfig:
    return BlurConfig(tau_y0=tau, anneal_steps=steps - TAIL_WINDOW, min_tau=0.0)


@dataclass(frozen=True)
class MonteCarloConfig:
    realizations: int = 50_000
    plot_every: int = 10
    progress_every: int | None = None
    min_steps: int | None = 700
    max_steps: int | None = 2000
    window: int = 100
    delta_d: float = 0.01
    delta_g: float = 0.01
    std_d_max: float = 0.1
    std_g_max: float = 0.1
    stability_window: int = 30
    stability_tols: tuple[tuple[str, float], ...] = (("beta", 0.01), ("gamma", 0.01), ("sigma_sq", 0.1))
    init_ranges: tuple[tuple[str, float, float], ...] = (("beta", 0.0, 0.5), ("gamma", 0.0, 0.5))
    init_sigma_sq_one: bool = True
    init_log_sigma_sq: tuple[float, float] = (-0.8, 0.8)
    lr_g_decay_milestones: tuple[int, ...] = (220, 420, 620, 780)
    lr_g_decay_factor: float = 1.0
    grad_clip: float = 10.0
    seed: int = 42

    def __post_init__(self):
        _positive(self, "realizations", "plot_every", "progress_every", "max_steps", "window", "delta_d", "delta_g", "std_d_max", "std_g_max", "stability_window", "grad_clip")
        if any(not tol > 0 for _, tol in self.stability_tols):
            raise ValueError("tolerances must be positive")
        if any(low > high for _, low, high in self.init_ranges) or self.init_log_sigma_sq[0] > self.init_log_sigma_sq[1]:
            raise ValueError("a range begins at its lower end")
        if self.min_steps is not None and (self.min_steps < 0 or self.max_steps is not None and self.min_steps > self.max_steps):
            raise ValueError("min_steps must lie between 0 and max_steps")
        if not 0 < self.lr_g_decay_factor <= 1 or list(self.lr_g_decay_milestones) != sorted(self.lr_g_decay_milestones) or any(m <= 0 for m in self.lr_g_decay_milestones):
            raise ValueError("the decay factor must lie in (0, 1], and milestones be positive and ascend")

    def horizon(self, training: TrainingConfig) -> int:
        return self.max_steps or training.n_steps


@dataclass(frozen=True)
class ExperimentConfig:
    """A linear-in-means experiment."""

    graph: GraphConfig = field(default_factory=GraphConfig)
    model: ModelConfig = field(default_factory=ModelConfig)
    training: TrainingConfig = field(default_factory=lambda: TrainingConfig(blur=_blur(800)))
    truth: Params = field(default_factory=Params)
    init: Params = field(default_factory=lambda: Params((("beta", 0.0), ("gamma", 0.0), ("sigma_sq", 1.0))))
    monte_carlo: MonteCarloConfig | None = None

    def __post_init__(self):
        _checked(self)

    @classmethod
    def default(cls) -> "ExperimentConfig":
        """The scale of a paper: a network of 250,000 nodes with communities, packed roots."""
        return cls()

    @classmethod
    def mc_default(cls) -> "ExperimentConfig":
        """The cheaper study: a preferential-attachment network of 10,000 nodes, uniform roots."""
        return cls(
            graph=GraphConfig(kind="ba", n=10_000, m=2), model=ModelConfig(beta_cap=0.85, picard_max=20, hidden=12, clip=4.0),
            training=TrainingConfig(n_steps=900, batch=17, n_disc=1, lr_d=2e-4, lr_g=3e-3, roots="uniform", exclusion_r=0, restarts=1, min_batch=17, relax=(0,), least_roots=17, blur=_blur(900, 1.0)),
            monte_carlo=MonteCarloConfig(),
        )


@dataclass(frozen=True)
class EffortModelConfig:
    k: int = 2
    lambda_max: float = 4.0
    picard_tol: float = 1e-7
    picard_max: int = 100
    newton_tol: float = 1e-10
    newton_max: int = 8
    fix_r: float | None = 1.0
    fix_sigma_sq: float | None = 1.0
    hidden: int = 64
    layers: int | None = None
    clip: float | None = 5.0

    def __post_init__(self):
        _positive(self, "k", "lambda_max", "picard_tol", "picard_max", "newton_tol", "newton_max", "fix_r", "fix_sigma_sq", "hidden", "layers", "clip")
        if self.resolved_layers() < self.k:
            raise ValueError("the test function needs as many layers as the ego radius")

    def resolved_layers(self) -> int:
        return self.layers or self.k


def _effort_values(values: Params) -> Params:
    known = dict(values.values)
    if not min(known["lambda_"], known["r"], known["sigma_sq"]) > 0 or known["mu"] < 0:
        raise ValueError("lambda_, r and sigma_sq must be positive, and mu not negative")
    return values


@dataclass(frozen=True)
class EffortExperimentConfig:
    """An effort-game experiment."""

    graph: GraphConfig = field(default_factory=GraphConfig)
    model: EffortModelConfig = field(default_factory=EffortModelConfig)
    training: TrainingConfig = field(default_factory=lambda: TrainingConfig(n_steps=2000, n_disc=1, lr_d=2e-4, lr_g=7e-3, grad_clip=25.0, blur=_blur(2000, 1.5)))
    truth: Params = Params((("gamma", 1.5), ("lambda_", 2 / 3), ("mu", 0.5), ("r", 1.0), ("sigma_sq", 1.0)))
    init: Params = Params((("gamma", 0.0), ("lambda_", 0.5), ("mu", 0.1), ("r", 1.0), ("sigma_sq", 1.0)))
    monte_carlo: MonteCarloConfig | None = None

    def __post_init__(self):
        _effort_values(self.truth)
        if not dict(_effort_values(self.init).values)["mu"] > 0:
            raise ValueError("mu must start above 0")
        _checked(self)

    @classmethod
    def default(cls) -> "EffortExperimentConfig":
        return cls()


def _checked(config: ExperimentConfig | EffortExperimentConfig) -> None:
    """The blur must be gone at the end of training, and before the tail that the estimates average where the run is known."""
    t, mc = config.training, config.monte_carlo
    assert_blur_ends(t.blur, t.n_steps, 1)
    if mc is not None:
        assert_blur_ends(t.blur, mc.horizon(t), max(mc.window, mc.stability_window))


def assert_blur_ends(blur: BlurConfig, horizon: int, window: int) -> None:
    """The blur must be gone when the tail that is averaged begins."""
    from netloom.operators.estimator import Blur

    if Blur(**asdict(blur)).tau(max(1, horizon - window + 1)) > 0:
        raise ValueError("the blur has not ended when the averaged tail begins; shorten anneal_steps")


def jsonable(value: Any) -> Any:
    """The nearest thing that JSON can hold: containers and records by their parts, arrays as lists, paths and the rest as text."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else repr(value)
    if is_dataclass(value) and not isinstance(value, type):
        return jsonable(asdict(value))
    if isinstance(value, Mapping):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [jsonable(v) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted((jsonable(v) for v in value), key=repr)
    if hasattr(value, "tolist"):  # arrays and their scalars
        return jsonable(value.tolist())
    return str(value)


def plain(o: Any) -> Any:
    return asdict(o) if is_dataclass(o) else o


def config_hash(config: Any) -> str:
    """SHA-256 of a configuration's canonical JSON."""
    return hashlib.sha256(json.dumps(plain(config), sort_keys=True, default=str).encode()).hexdigest()


def git_sha(cwd: str | None = None) -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=cwd, capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def provenance(config: Any, *, cwd: str | None = None, **extra: Any) -> dict[str, Any]:
    import numpy
    import pyspark

    versions = {"python": platform.python_version(), "pyspark": pyspark.__version__, "numpy": numpy.__version__}
    return {"time": datetime.datetime.now(datetime.UTC).isoformat(), "versions": versions, "git_sha": git_sha(cwd), "config_hash": config_hash(config), "config": plain(config), **extra}


def with_overrides(config: Any, **over: Any) -> Any:
    return replace(config, **over)

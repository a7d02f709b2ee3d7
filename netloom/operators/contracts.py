"""What the estimator asks of its parts: protocols, and checks of what they are given and return."""

from __future__ import annotations

import math
from typing import Any, Protocol, runtime_checkable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType


#: The fields of a step record in their order, with the types they have in every table, file and stream.
STEP_FIELDS = {
    "step": "int", "params": "map<string, double>", "loss_d": "double", "loss_g": "double", "loss_d_rolling": "double", "loss_g_rolling": "double", "grad_norm_g": "double",
    "picard_iterations": "int", "roots_requested": "int", "roots_achieved": "int", "tau_y": "double", "in_equilibrium": "boolean", "lr_g": "double", "newton_iterations": "int",
    "sampler_radius": "int", "picard_residual": "double", "picard_converged": "boolean", "sampler_met_target": "boolean", "sampler_fallback_reason": "string",
    "param_grads": "map<string, double>", "extras": "map<string, double>",
}
STEP_SCHEMA = ", ".join(f"{k} {t}" for k, t in STEP_FIELDS.items())


@runtime_checkable
class StructuralModel(Protocol):
    """A game as the estimator uses it: named values, their unconstrained form and a way back."""

    params: dict[str, float]

    def raw(self) -> dict[str, float]: ...
    def with_raw(self, raw: dict[str, float]) -> dict[str, float]: ...


@runtime_checkable
class TestFunction(Protocol):
    """A function that scores ego objects, with the gradients of its scores."""

    p: dict[str, np.ndarray]

    def forward(self, b: Any, train: bool = False) -> tuple[np.ndarray, Any]: ...
    def backward(self, b: Any, kept: Any, dout: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]: ...


@runtime_checkable
class BlurLike(Protocol):
    """Anything with the settings of a blur."""

    enabled: bool
    tau_y0: float
    schedule: str
    anneal_steps: int
    min_tau: float


def check_logits(name: str, logits: np.ndarray) -> np.ndarray:
    """Scores must be a vector of floating numbers with an entry at least."""
    found = np.asarray(logits)
    if found.ndim != 1 or not found.size or not np.issubdtype(found.dtype, np.floating):
        raise ValueError(f"{name} must be a non-empty vector of floating numbers; it has shape {found.shape} and type {found.dtype}")
    return found


def check_map_output(value: np.ndarray, n: int, hook: str) -> np.ndarray:
    """What a game's hook gives on arrays must be a finite value per node."""
    found = np.asarray(value)
    if found.shape != (n,):
        raise ValueError(f"{hook} must give one value per node: shape {(n,)}, not {found.shape}")
    if not np.isfinite(found).all():
        raise ValueError(f"{hook} gave {int((~np.isfinite(found)).sum())} values that aren't finite on the first iterate")
    return found


def check_inputs(weights: DataFrame, nodes: DataFrame, covariates: tuple[str, ...]) -> None:
    """Weights must be (src, dst, w) of numbers, w 1 if there is none, and nodes have an id and each covariate as a single number."""
    edge = ("src", "dst", *(["w"] if "w" in weights.columns else []))
    for name, df, wanted in (("weights", weights, edge), ("nodes", nodes, ("id", *covariates))):
        kinds = {f.name: f.dataType for f in df.schema.fields}
        if missing := [c for c in wanted if c not in kinds]:
            raise ValueError(f"{name} lacks {missing}")
        if bad := [c for c in wanted if not isinstance(kinds[c], NumericType)]:
            raise ValueError(f"{name} must have single numbers in {bad}; a vector covariate is a column for each entry")


def network_parts(network: Any) -> tuple[DataFrame, DataFrame]:
    """(weights, nodes) of a data set, of its substrate, or of anything that has both."""
    for of in (network, getattr(network, "substrate", None)):
        if of is not None and hasattr(of, "weights"):
            for name in ("covariates", "nodes"):
                if hasattr(of, name):
                    return of.weights, getattr(of, name)
    raise TypeError("a network has weights and covariates")


def whole_or_none(value: Any) -> int | None:
    """A setting that counts something, or None where there is none."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return int(value)

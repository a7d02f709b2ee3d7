"""Scalar functions of the estimator as Columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Losses where the test function can tell nothing apart.
OPTIMA = {"loss_d": 2 * math.log(2), "loss_g_nonsaturating": math.log(2), "loss_g_saturating": -math.log(2)}


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def uniform_hash(*key) -> Column:
    """A uniform draw in (0, 1) that depends on the key alone: 48 bits of the key's md5."""
    text = F.concat_ws("|", *(col(k).cast("string") for k in key))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def gaussian_hash(*key) -> Column:
    """A standard normal draw that depends on the key alone (Box and Muller on two uniform draws)."""
    return F.sqrt(-2.0 * F.log(uniform_hash("u1", *key))) * F.cos(2 * math.pi * uniform_hash("u2", *key))


def softplus(x: Column) -> Column:
    """log(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def soft_clip(x: Column, bound: float) -> Column:
    """bound * tanh(x / bound)."""
    if bound <= 0:
        raise ValueError("the bound must be positive")
    return bound * F.tanh(x / bound)


def rounded(x: Column, digits: int = 6) -> Column:
    """For comparison: rounded, and without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def noise_tau(step: Column, tau0: float, schedule: str = "linear", anneal_steps: int = 2000, min_tau: float = 0.0, enabled: bool = True) -> Column:
    """The blur's scale at a step: constant, linear, or exponential towards ``min_tau``; exactly there from ``anneal_steps`` on."""
    if schedule not in ("constant", "linear", "exp"):
        raise ValueError(f"unknown schedule {schedule!r}")
    if not enabled:
        return F.lit(0.0)
    if anneal_steps < 0 or min_tau < 0 or tau0 < 0:
        raise ValueError("scales and steps must not be negative")
    step = F.greatest(step, F.lit(0))
    if schedule == "constant" or anneal_steps == 0:
        return F.lit(max(float(tau0), float(min_tau)))
    if schedule == "linear":
        return F.greatest(F.lit(float(min_tau)), float(tau0) * (1 - step / float(anneal_steps)))
    decayed = F.greatest(F.lit(float(min_tau)), float(tau0) * F.exp(-step / max(1.0, anneal_steps / 5.0)))
    return F.when(step >= anneal_steps, F.lit(float(min_tau))).otherwise(decayed)


def effective_lr(lr: Column | float, factor: float, milestones: list[int], step: Column) -> Column:
    """A rate after a factor for every milestone reached."""
    passed = sum((F.when(step >= m, 1).otherwise(0) for m in milestones), F.lit(0))
    return col(lr) * F.pow(F.lit(float(factor)), passed)


def heavy_tail_exponent(tau1: Column) -> Column:
    """Whether a degree exponent gives a finite mean without a finite variance."""
    return (tau1 > 2) & (tau1 < 3)


def degree_cap_is_heavy(cap: Column, n: Column, factor: float = 3.0, floor: int = 1000) -> Column:
    """Whether a largest degree (null: none set) lets hubs grow faster than ``factor`` sqrt(n)."""
    return F.when(cap.isNull(), n >= floor).otherwise(cap > factor * F.sqrt(n))


def moment_eta(rho: Column, branching: Column, p: float) -> tuple[Column, Column, Column]:
    """(rho^p lambda, whether it is below 1, the implied rate exponent; NaN where undefined)."""
    value = F.pow(rho, F.lit(float(p))) * branching
    log_eta = F.abs(F.log(rho * F.pow(branching, F.lit(1.0 / p))))
    rate = F.when((value < 1) & (branching > 1), log_eta / (2 * F.log(branching) + log_eta)).otherwise(float("nan"))
    return value, value < 1, rate

"""Adversarial estimation: a rooted message-passing test function, the minimax loop and Monte Carlo.

Two tiers share the games' expressions. DataFrames simulate, check and score graphs of any size;
the loop itself, which makes over a thousand small steps, runs on NumPy arrays of the graph
(``LocalNetwork``), in one task of an executor by ``fit_in_task``, and Monte Carlo deals the realisations to tasks. The
equilibria of a linear game are made before the loop, in tasks of their own (``ahead``).
"""

from __future__ import annotations

import math
import time
import warnings
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from netloom.functions.constants import OPTIMUM_D, OPTIMUM_G, OPTIMUM_G_SATURATING
from netloom.functions.expr import Var
from netloom.operators.contracts import STEP_FIELDS, BlurLike, check_logits, check_map_output
from netloom.operators.games import Game
from netloom.operators.sampling import Roots
from netloom.operators.series import override_tol


_RAW = Var("raw")


class NotFitted(RuntimeError):
    """An attribute that fitting learns was asked for before."""


class EstimationFailed(UserWarning):
    pass


class NotStationary(UserWarning):
    """A run that used up its steps."""


class SolverCapped(RuntimeWarning):
    """A solver inside a run that used up its steps."""


class RootsShort(RuntimeWarning):
    """Roots that are fewer, or closer together, than was asked for."""


def scatter(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of values summed into n rows by index."""
    width = values.shape[1]
    at = (index[:, None] * width + np.arange(width)).ravel()
    return np.bincount(at, values.ravel(), n * width).reshape(n, width)


# ---------------------------------------------------------------- the graph as arrays


class LocalNetwork:
    """A graph as arrays: edges sorted by source, weights, covariates; ego objects on demand."""

    #: Ego objects that are kept.
    EGOS = 100_000

    def __init__(self, src: np.ndarray, dst: np.ndarray, x: np.ndarray, k: int = 2):
        self.n, self.k, self.x = len(x), k, np.asarray(x, float).reshape(len(x), -1)
        order = np.lexsort((dst, src))
        self.src, self.dst = src[order].astype(np.int64), dst[order].astype(np.int64)
        self.ptr = np.searchsorted(self.src, np.arange(self.n + 1))
        degree = np.diff(self.ptr)
        if (degree == 0).any():
            raise ValueError("every node needs a neighbour")
        self.w = 1.0 / degree[self.src]
        self.mu_x, self.sigma_x = self.x.mean(0), self.x.std(0)
        if (self.sigma_x <= 1e-12).any():
            raise ValueError("a covariate is constant")
        self._egos: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    @classmethod
    def collect(cls, edges: DataFrame, nodes: DataFrame, columns: tuple[str, ...] = ("x",), k: int = 2, most: int = 20_000_000) -> "LocalNetwork":
        """The arrays of a graph labelled 0..n-1; only for graphs of at most ``most`` edges, which is checked first.

        A limit of this tier alone: larger graphs are simulated, checked and cut into ego objects as DataFrames, and raise ``most`` where
        a worker has the memory (24 bytes an edge).
        """
        if (m := edges.count()) > most:
            raise ValueError(f"{m} edges are more than the {most} that the local tier is told to hold")
        e = edges.select("src", "dst").toArrow()
        v = nodes.select("id", *columns).toArrow().sort_by("id")
        return cls(e.column("src").to_numpy(), e.column("dst").to_numpy(), np.column_stack([v.column(c).to_numpy() for c in columns]), k)

    def mean(self, y: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        """Sums over neighbours of weight times y; of ``values`` per edge, if given."""
        per = self.w * y[self.dst] if values is None else values
        return np.add.reduceat(per, self.ptr[:-1])

    def ball(self, root: int, radius: int) -> np.ndarray:
        """The nodes within a radius of a root, in ascending order."""
        ball = ring = np.array([root])
        for _ in range(radius):
            near = np.concatenate([self.dst[self.ptr[v] : self.ptr[v + 1]] for v in ring])
            ring = np.setdiff1d(near, ball)
            ball = np.union1d(ball, ring)
            if not len(ring):
                break
        return ball

    def ego(self, root: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(members in ascending order, source and target positions of the inner edges)."""
        if root not in self._egos:
            if len(self._egos) >= self.EGOS:
                self._egos.clear()
            ball = self.ball(root, self.k)
            counts = self.ptr[ball + 1] - self.ptr[ball]
            a = np.repeat(np.arange(len(ball)), counts)
            b = np.concatenate([self.dst[self.ptr[v] : self.ptr[v + 1]] for v in ball])
            at = np.minimum(np.searchsorted(ball, b), len(ball) - 1)
            inside = ball[at] == b
            self._egos[root] = ball, a[inside], at[inside]
        return self._egos[root]

    def batch(self, roots: np.ndarray, y: np.ndarray, mu_y: float, sigma_y: float, tau: float = 0.0, draw: np.random.Generator | None = None) -> "Batch":
        """Ego objects of roots: standardised features (x, y, root mark), blurred by tau deviations of y."""
        feats, src, dst, row, nodes, at = [], [], [], [], [], 0
        for r in roots:
            ball, a, b = self.ego(int(r))
            yy = (y[ball] - mu_y) / sigma_y
            if tau > 0:
                yy = yy + tau * draw.standard_normal(len(ball))
            feats.append(np.column_stack([(self.x[ball] - self.mu_x) / self.sigma_x, yy, ball == r]))
            src.append(a + at)
            dst.append(b + at)
            row.append(at + int(np.searchsorted(ball, r)))
            nodes.append(ball)
            at += len(ball)
        return Batch(np.concatenate(feats), np.concatenate(src), np.concatenate(dst), np.array(row), np.concatenate(nodes))


@dataclass
class Batch:
    features: np.ndarray
    src: np.ndarray
    dst: np.ndarray
    root_rows: np.ndarray
    nodes: np.ndarray


class LocalGame:
    """A game's expressions on arrays: solution and tangents by the same iteration."""

    def __init__(self, game: Game, net: LocalNetwork):
        self.game, self.net = game, net
        self.cov = {c: net.x[:, k] for k, c in enumerate(game.covariates)}
        self.value, self.dvalue = game.peer_value(), game.peer_value().diff("y")
        self.expr = game.foc() if game.implicit else game.best_response()
        self.dexpr = game.foc().diff("y") if game.implicit else None
        self.start = game.newton_start()
        self.slopes = {k: game.partial(k) for k in game.params}
        self.along, self.by_eps = game.partial("peer"), game.partial("eps")
        self.newton_residual, self.newton_steps, self.checked = 0.0, 0, False

    def env(self, params: dict[str, float], **more) -> dict:
        return self.cov | self.game.constants | params | more

    def peer(self, y: np.ndarray, coef: np.ndarray | None = None) -> np.ndarray:
        env = {"y": y[self.net.dst], "w": self.net.w}
        per = np.asarray(self.value.value(env)) if coef is None else np.asarray(self.dvalue.value(env)) * coef[self.net.dst]
        once = np.add.reduceat(np.broadcast_to(per, self.net.dst.shape), self.net.ptr[:-1])
        return self.net.mean(once) if self.game.two_hop else once

    def noise(self, draw: np.random.Generator):
        """The shocks of a simulation, in units of their deviation."""
        return draw.standard_normal(self.net.n)

    def step(self, y, eps, params) -> np.ndarray:
        env = self.env(params, peer=self.peer(y), eps=eps, y=y)
        if not self.game.implicit:
            new = np.asarray(self.expr.value(env))
        else:
            new = self._newton(env)
        if not self.checked:
            check_map_output(new, self.net.n, "foc" if self.game.implicit else "best_response")
            self.checked = True
        return new

    def _newton(self, env: dict) -> np.ndarray:
        """The root of the condition of each node; the worst last change and the steps are kept for the run's guards."""
        z = np.asarray(self.start.value(env), float) + np.zeros(self.net.n)
        if self.game.newton_bound() is not None:
            bound = 50.0 / env["r"]
            z = np.clip(z, -bound, bound)
        change = math.inf
        for k in range(1, self.game.newton_steps + 1):
            d = np.asarray(self.dexpr.value(env | {"y": z}))
            if not np.isfinite(d).all() or (d == 0).any():
                raise FloatingPointError("non-finite or zero derivative in Newton; see check_model")
            move = self.expr.value(env | {"y": z}) / d
            z, change = z - move, float(np.abs(move).max(initial=0.0))
            if change < self.game.newton_tol:
                break
        self.newton_residual, self.newton_steps = max(self.newton_residual, change), max(self.newton_steps, k)
        return z

    def scatter(self, y: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The transpose of ``peer`` in y: sums over the edges into a node of what it contributes, times u at their sources."""
        env = {"y": y[self.net.dst], "w": self.net.w}
        if self.game.two_hop:
            u = np.bincount(self.net.dst, self.net.w * u[self.net.src], self.net.n)
        return np.bincount(self.net.dst, np.broadcast_to(self.dvalue.value(env), self.net.dst.shape) * u[self.net.src], self.net.n)

    def _direct(self, env: dict, eps: np.ndarray, params: dict[str, float]) -> dict[str, np.ndarray]:
        """What each parameter changes in the response itself."""
        out = {}
        for name, slope in self.slopes.items():
            v = np.asarray(self.by_eps.value(env)) * eps / (2 * params["sigma_sq"]) if name == "sigma_sq" else np.asarray(slope.value(env))
            out[name] = np.broadcast_to(v, (self.net.n,))
        return out

    def pulled_back(self, y: np.ndarray, noise: np.ndarray, params: dict[str, float], cotangent: np.ndarray) -> dict[str, float]:
        """The gradient of a scalar by the parameters, for its gradient by y: one adjoint iteration ``u = c + J' u``, whatever their number."""
        eps = self.sigma(params) * noise
        env = self.env(params, peer=self.peer(y), eps=eps, y=y)
        along, u = np.broadcast_to(np.asarray(self.along.value(env)), (self.net.n,)), cotangent
        for _ in range(max(self.game.picard_max, 200)):
            new = cotangent + self.scatter(y, along * u)
            done = np.abs(new - u).max() < self.game.picard_tol * max(1e-12, np.abs(new).max())
            u = new
            if done:
                break
        return {k: float(u @ v) for k, v in self._direct(env, eps, params).items()}

    def sigma(self, params: dict[str, float]) -> float:
        return math.sqrt((self.game.constants | params).get("sigma_sq", 1.0))

    def solve(self, noise: np.ndarray, params: dict[str, float], tangents: bool = False):
        """(y, {parameter: dy/dparameter}, steps, residual) at shocks sqrt(sigma_sq) * noise."""
        eps = self.sigma(params) * noise
        y, residual, k = np.zeros(self.net.n), math.inf, 0
        self.newton_residual, self.newton_steps = 0.0, 0
        for k in range(1, self.game.picard_max + 1):
            new = self.step(y, eps, params)
            residual, y = float(np.abs(new - y).max()), new
            if not residual >= self.game.picard_tol:
                break
        if not tangents:
            return y, {}, k, residual
        env = self.env(params, peer=self.peer(y), eps=eps, y=y)
        along, out = np.asarray(self.along.value(env)), {}
        for name, direct in self._direct(env, eps, params).items():
            t = direct.copy()
            for _ in range(max(self.game.picard_max, 200)):
                new = direct + along * self.peer(y, t)
                done = np.abs(new - t).max() < self.game.picard_tol * max(1.0, np.abs(new).max())
                t = new
                if done:
                    break
            out[name] = t
        return y, out, k, residual


# ---------------------------------------------------------------- the test function


def softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def expit(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class RootedGin:
    """Scores of ego objects: graph isomorphism layers, the root's state, a small head, a soft clip.

    Every layer is ``relu(norm(mlp((1 + eps) h + sum over neighbours of h)))`` with a trained eps;
    gradients by hand. An object's score depends on it alone, not on the batch around it.
    """

    def __init__(self, in_dim: int = 3, hidden: int = 64, layers: int = 2, clip: float | None = 5.0, spectral: bool = False, seed: int = 0):
        if hidden < 1 or layers < 1 or in_dim < 1 or clip is not None and clip <= 0:
            raise ValueError("sizes and clip must be positive")
        draw = np.random.default_rng(seed)
        self.layers, self.clip, self.in_dim, self.spectral = layers, clip, in_dim, spectral
        self.p: dict[str, np.ndarray] = {}
        self.u = {}

        def linear(name: str, a: int, b: int) -> None:
            lim = 1 / math.sqrt(a)
            self.p[f"{name}.w"], self.p[f"{name}.b"] = draw.uniform(-lim, lim, (a, b)), draw.uniform(-lim, lim, b)
            self.u[f"{name}.w"] = draw.standard_normal(b)

        for k in range(layers):
            linear(f"{k}.a", in_dim if k == 0 else hidden, hidden)
            linear(f"{k}.c", hidden, hidden)
            self.p[f"{k}.eps"] = np.zeros(1)
            self.p[f"{k}.g"], self.p[f"{k}.o"] = np.ones(hidden), np.zeros(hidden)
        linear("h.a", hidden, hidden)
        linear("h.c", hidden, 1)

    def _weight(self, name: str, train: bool):
        """A weight and its scale: divided by its largest singular value where that is asked for."""
        w = self.p[name]
        if not self.spectral:
            return w, 1.0
        u = self.u[name]
        if train:
            v = w @ u
            v /= np.linalg.norm(v) + 1e-12
            u = w.T @ v
            self.u[name] = u = u / (np.linalg.norm(u) + 1e-12)
        v = w @ u
        v /= np.linalg.norm(v) + 1e-12
        s = float(v @ w @ u) or 1.0
        self._sv = getattr(self, "_sv", {}) | {name: (u, v, s)}
        return w / s, s

    def forward(self, b: Batch, train: bool = False):
        """(logits, what ``backward`` needs)."""
        h, kept = b.features, []
        for k in range(self.layers):
            z = (1 + self.p[f"{k}.eps"]) * h + scatter(b.src, h[b.dst], len(h))
            wa, _ = self._weight(f"{k}.a.w", train)
            wc, _ = self._weight(f"{k}.c.w", train)
            a = z @ wa + self.p[f"{k}.a.b"]
            r = np.maximum(a, 0)
            c = r @ wc + self.p[f"{k}.c.b"]
            mean, sd = c.mean(1, keepdims=True), np.sqrt(c.var(1, keepdims=True) + 1e-5)
            nrm = (c - mean) / sd
            o = nrm * self.p[f"{k}.g"] + self.p[f"{k}.o"]
            kept.append((h, z, a, r, nrm, sd, o, wa, wc))
            h = np.maximum(o, 0)
        root = h[b.root_rows]
        wa, _ = self._weight("h.a.w", train)
        wc, _ = self._weight("h.c.w", train)
        a = root @ wa + self.p["h.a.b"]
        r = np.maximum(a, 0)
        raw = (r @ wc + self.p["h.c.b"])[:, 0]
        out = raw if self.clip is None else self.clip * np.tanh(raw / self.clip)
        return out, (kept, h, root, a, r, raw, wa, wc)

    def _gw(self, name: str, g: np.ndarray) -> np.ndarray:
        if not self.spectral:
            return g
        u, v, s = self._sv[name]
        w = self.p[name] / s
        return (g - (g * w).sum() * np.outer(v, u)) / s

    def backward(self, b: Batch, kept, dout: np.ndarray):
        """(gradients of the parameters, gradient of the features) for the gradient of the logits."""
        layers, h, root, a, r, raw, wa, wc = kept
        g: dict[str, np.ndarray] = {}
        d = dout if self.clip is None else dout * (1 - np.tanh(raw / self.clip) ** 2)
        d = d[:, None]
        g["h.c.w"], g["h.c.b"] = self._gw("h.c.w", r.T @ d), d.sum(0)
        da = (d @ wc.T) * (a > 0)
        g["h.a.w"], g["h.a.b"] = self._gw("h.a.w", root.T @ da), da.sum(0)
        dh = scatter(b.root_rows, da @ wa.T, len(h))
        for k in reversed(range(self.layers)):
            h0, z, a, r, nrm, sd, o, wa, wc = layers[k]
            do = dh * (o > 0)
            g[f"{k}.g"], g[f"{k}.o"] = (do * nrm).sum(0), do.sum(0)
            dn = do * self.p[f"{k}.g"]
            dc = (dn - dn.mean(1, keepdims=True) - nrm * (dn * nrm).mean(1, keepdims=True)) / sd
            g[f"{k}.c.w"], g[f"{k}.c.b"] = self._gw(f"{k}.c.w", r.T @ dc), dc.sum(0)
            da = (dc @ wc.T) * (a > 0)
            g[f"{k}.a.w"], g[f"{k}.a.b"] = self._gw(f"{k}.a.w", z.T @ da), da.sum(0)
            dz = da @ wa.T
            g[f"{k}.eps"] = np.array([(dz * h0).sum()])
            dh = (1 + self.p[f"{k}.eps"]) * dz + scatter(b.dst, dz[b.src], len(dz))
        return g, dh


class Adam:
    def __init__(self, lr: float, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8):
        self.lr, self.b1, self.b2, self.eps, self.t = lr, b1, b2, eps, 0
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}

    def step(self, params: dict, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = self.b1 * self.m.get(k, 0.0) + (1 - self.b1) * g
            self.v[k] = self.b2 * self.v.get(k, 0.0) + (1 - self.b2) * g * g
            params[k] = params[k] - self.lr * (self.m[k] / (1 - self.b1**self.t)) / (np.sqrt(self.v[k] / (1 - self.b2**self.t)) + self.eps)


# ---------------------------------------------------------------- roots


def pack(net: LocalNetwork, order: np.ndarray, radius: int, target: int) -> np.ndarray:
    """The roots that a pass in the order given takes: each node that no root before it has within ``radius``, ``target`` at most."""
    free, out = np.ones(net.n, bool), []
    for v in order:
        if free[v]:
            out.append(int(v))
            if len(out) >= target:
                break
            free[net.ball(int(v), radius)] = False
    return np.array(out, np.int64)


def best_pack(net: LocalNetwork, orders: Iterable[np.ndarray], radius: int, target: int) -> tuple[np.ndarray, int]:
    """(the largest packing over some orders, the first of equals; orders tried). Ends with the first that meets the target."""
    best, k = np.zeros(0, np.int64), 0
    for k, order in enumerate(orders, 1):
        now = pack(net, order, radius, target)
        best = now if len(now) > len(best) else best
        if len(best) >= target:
            break
    if not k:
        raise ValueError("there must be an order")
    return best, k


@dataclass(frozen=True)
class LocalSampler:
    """``RootSampler``'s four modes on arrays: a call gives ``Roots`` with an array of roots."""

    mode: str = "uniform"
    exclusion_r: int = 3
    restarts: int = 3
    relax: tuple[int, ...] = (3, 2)
    min_batch: int | None = None
    fallback: str = "uniform"

    def __post_init__(self):
        from netloom.operators.sampling import RootSampler

        RootSampler(self.mode, exclusion_r=self.exclusion_r, restarts=self.restarts, relax=self.relax, min_batch=self.min_batch, fallback=self.fallback)  # its checks

    @property
    def effective_r(self) -> int | None:
        return None if self.mode == "uniform" else max(self.relax) if self.mode == "disjoint_relax" else self.exclusion_r

    def __call__(self, net: LocalNetwork, draw: np.random.Generator, size: int) -> Roots:
        uniform = lambda **how: Roots(draw.integers(0, net.n, size), size, size, "uniform", **how)
        if self.mode == "uniform":
            return uniform()
        orders = lambda n: (draw.permutation(net.n) for _ in range(n))
        if self.mode != "disjoint_relax":
            got, tries = best_pack(net, orders(1 if self.mode == "disjoint_once" else self.restarts), self.exclusion_r, size)
            return Roots(got, size, len(got), self.mode, self.exclusion_r, tries, len(got) >= size, None if len(got) >= size else "target_not_met")
        least, best, radius, tries = min(self.min_batch or size, size), np.zeros(0, np.int64), None, 0
        for r in self.relax:
            got, k = best_pack(net, orders(self.restarts), r, size)
            tries += k
            if len(got) > len(best):
                best, radius = got, r
            if len(got) >= least:
                return Roots(got, size, len(got), self.mode, r, tries, len(got) >= size)
        if self.fallback == "raise":
            raise RuntimeError(f"no radius of {self.relax} gave {least} roots; the best gave {len(best)}")
        if self.fallback == "uniform":
            return uniform(attempts_used=tries, fallback_reason=f"uniform_fallback_below_min_batch:{len(best)}<{least}")
        return Roots(best, size, len(best), self.mode, radius, tries, len(best) >= size, f"best_below_min_batch:{len(best)}<{least}")


# ---------------------------------------------------------------- the loop


@dataclass(frozen=True)
class Blur:
    """The outcome blur of both sides: scale, schedule, and where it ends."""

    enabled: bool = True
    tau_y0: float = 1.2
    schedule: str = "linear"
    anneal_steps: int = 2000
    min_tau: float = 0.0

    def tau(self, step: int) -> float:
        if not self.enabled:
            return 0.0
        if self.schedule == "constant" or self.anneal_steps == 0:
            return max(self.min_tau, self.tau_y0)
        if step >= self.anneal_steps:
            return self.min_tau
        if self.schedule == "linear":
            return max(self.min_tau, self.tau_y0 * (1 - step / self.anneal_steps))
        return max(self.min_tau, self.tau_y0 * math.exp(-step / max(1.0, self.anneal_steps / 5)))


@dataclass(frozen=True)
class EstimatorConfig:
    max_steps: int = 2000
    min_steps: int = 0
    batch: int = 64
    n_disc: int = 1
    lr_d: float = 2e-4
    lr_g: float = 3e-3
    grad_clip: float = 10.0
    lr_g_decay_factor: float = 1.0
    lr_g_decay_milestones: tuple[int, ...] = ()
    window: int = 100
    delta_d: float = 0.01
    delta_g: float = 0.01
    std_d_max: float = 0.1
    std_g_max: float = 0.1
    stability_window: int = 30
    stability_tol: float = 0.01
    stability_overrides: tuple[tuple[str, float], ...] = ()
    loss: str = "nonsaturating"
    #: How gradients pass the equilibrium: "unroll" carries a tangent per parameter, "implicit" solves one adjoint; None leaves it to the game.
    differentiation: str | None = None
    seed: int = 0

    def __post_init__(self):
        if self.loss not in ("nonsaturating", "saturating"):
            raise ValueError("loss must be nonsaturating or saturating")
        if self.differentiation not in (None, "unroll", "implicit"):
            raise ValueError("differentiation must be None, unroll or implicit")
        for f in ("max_steps", "batch", "n_disc", "window", "stability_window", "lr_d", "lr_g", "grad_clip", "delta_d", "delta_g", "std_d_max", "std_g_max", "stability_tol"):
            if not getattr(self, f) > 0:
                raise ValueError(f"{f} must be positive")
        if not 0 <= self.min_steps <= self.max_steps:
            raise ValueError("min_steps must lie between 0 and max_steps")
        if any(m <= 0 for m in self.lr_g_decay_milestones) or list(self.lr_g_decay_milestones) != sorted(self.lr_g_decay_milestones):
            raise ValueError("milestones must be positive and ascend")
        if not 0 < self.lr_g_decay_factor <= 1:
            raise ValueError("lr_g_decay_factor must lie in (0, 1]")
        if any(not tol > 0 for _, tol in self.stability_overrides):
            raise ValueError("overrides of the tolerance must be positive")

    def override_tol_for(self, param: str) -> float:
        return override_tol(param, self.stability_tol, dict(reversed(self.stability_overrides)))

    @classmethod
    def from_configs(cls, experiment, monte_carlo=None, *, seed: int | None = None) -> "EstimatorConfig":
        """The settings of a run from an experiment's training and Monte Carlo parts; the blur must end before the averaged tail of this run begins."""
        from netloom.functions.config import assert_blur_ends

        t, mc = experiment.training, monte_carlo or experiment.monte_carlo
        if mc is None:
            raise ValueError("the experiment has no Monte Carlo part")
        horizon = mc.horizon(t)
        assert_blur_ends(t.blur, horizon, max(mc.window, mc.stability_window))
        return cls(
            max_steps=horizon, min_steps=min(mc.min_steps or 0, horizon), batch=t.batch, n_disc=t.n_disc, lr_d=t.lr_d, lr_g=t.lr_g, grad_clip=mc.grad_clip,
            lr_g_decay_factor=mc.lr_g_decay_factor, lr_g_decay_milestones=mc.lr_g_decay_milestones, window=mc.window, delta_d=mc.delta_d, delta_g=mc.delta_g,
            std_d_max=mc.std_d_max, std_g_max=mc.std_g_max, stability_window=mc.stability_window, stability_overrides=mc.stability_tols, seed=mc.seed if seed is None else seed,
        )

    @classmethod
    def recovery_default(cls, **over) -> "EstimatorConfig":
        base = dict(max_steps=1200, min_steps=700, batch=17, lr_g_decay_factor=0.5, lr_g_decay_milestones=(220, 420, 620, 780), stability_overrides=(("gamma", 0.01), ("sigma_sq", 0.1), ("mu", 0.05)), seed=0)
        return cls(**(base | over))


@dataclass(frozen=True)
class StepContext:
    """What a ``gradient_transform`` sees of a step."""

    step: int
    params: dict[str, float]
    gradients: dict[str, float]
    network: LocalNetwork


@dataclass
class Result:
    status: str
    converged: bool
    final_step: int
    params: dict[str, float]
    params_final: dict[str, float]
    path_sd: dict[str, float]
    loss_d_rolling: float
    loss_g_rolling: float
    history: list[dict] = field(default_factory=list)
    picard_cap_hits: int = 0
    newton_cap_hits: int = 0

    def row(self, realization: int, **more) -> dict:
        out = {"realization": realization, "converged": self.converged, "final_step": self.final_step, "status": self.status}
        out |= {f"{k}_hat": v for k, v in self.params.items()} | {f"{k}_final": v for k, v in self.params_final.items()}
        out |= {"picard_cap_hits": self.picard_cap_hits, "newton_cap_hits": self.newton_cap_hits}
        return out | {"loss_d_rolling_final": self.loss_d_rolling, "loss_g_rolling_final": self.loss_g_rolling} | more


def run_minimax(
    net: LocalNetwork, y: np.ndarray, game: Game, disc: RootedGin, config: EstimatorConfig, blur: BlurLike | None = None,
    *, gradient_transform: Callable[[StepContext], dict[str, float]] | None = None, observers: tuple = (), sample: LocalSampler | Callable[[np.random.Generator, int], np.ndarray] | None = None,
    solver: Callable[[Game, LocalNetwork], LocalGame] = LocalGame,
) -> Result:
    """Alternate steps of the test function and of the structural parameters until losses settle and parameters stand still.

    ``sample`` draws the roots: a ``LocalSampler``, or a function of a generator and a number; uniformly without one.
    Warnings say, once a run, that a solver used up its steps, that roots were short in a phase, or that they
    lay closer than twice the ego radius. ``solver`` makes what solves the game on the network; it need hold at the nodes that a step looks at alone.
    """
    blur = blur if isinstance(blur, Blur) else Blur(enabled=False) if blur is None else Blur(blur.enabled, blur.tau_y0, blur.schedule, blur.anneal_steps, blur.min_tau)
    if disc.layers < net.k:
        raise ValueError("the test function must have as many layers as the ego radius")
    if disc.in_dim != net.x.shape[1] + 2:
        raise ValueError(f"the test function must take {net.x.shape[1] + 2} features")
    y = np.asarray(y, float)
    if y.shape != (net.n,) or not np.isfinite(y).all():
        raise ValueError("y must be one finite value per node")
    mu_y, sigma_y = float(y.mean()), float(y.std())
    if sigma_y <= 1e-10:
        raise ValueError("y is constant")
    if disc.clip is None:
        warnings.warn("the test function's scores are not clipped", UserWarning, stacklevel=2)
    tail_start = config.max_steps - max(config.window, config.stability_window) + 1
    if blur.tau(max(tail_start, 1)) > 0:
        warnings.warn("the blur has not ended when the tail that is averaged begins", UserWarning, stacklevel=2)
    draw = np.random.default_rng(config.seed)
    sampler = sample or LocalSampler()
    if isinstance(sampler, LocalSampler) and (radius := sampler.effective_r) is not None and radius < 2 * net.k:
        warnings.warn(f"roots are {radius} apart at most, less than twice the ego radius {net.k}: ego objects may share nodes", RootsShort, stacklevel=2)
    implicit = (config.differentiation or game.differentiation) == "implicit"
    told, capped, drawn = set(), {"picard": 0, "newton": 0}, {}
    local, raw = solver(game, net), {k: np.float64(v) for k, v in game.raw().items()}
    dforward = {k: t.forward(_RAW).diff("raw") for k, t in game.transforms.items()}
    rule = StoppingRule(config)
    opt_d, opt_g, history, tell = Adam(config.lr_d), Adam(config.lr_g), [], list(observers)
    losses_d, losses_g, path, lr, status, converged = [], [], [], config.lr_g, "ok", False

    def emit(name: str, *args) -> None:
        for o in tell:
            try:
                getattr(o, name)(*args)
            except Exception as e:  # an observer's trouble isn't the run's
                warnings.warn(f"observer {type(o).__name__}.{name} failed: {e}", RuntimeWarning, stacklevel=2)

    def once(key: str, kind: type, text: str) -> None:
        if key not in told:
            told.add(key)
            warnings.warn(f"{text} (step {step})", kind, stacklevel=3)

    def pick(phase: str) -> np.ndarray:
        if not isinstance(sampler, LocalSampler):
            roots = sampler(draw, config.batch)
            drawn.update(roots_requested=config.batch, roots_achieved=len(roots), sampler_radius=None, sampler_met_target=len(roots) >= config.batch, sampler_fallback_reason="")
            return roots
        got = sampler(net, draw, config.batch)
        drawn.update(roots_requested=got.requested, roots_achieved=got.achieved, sampler_radius=got.radius_used, sampler_met_target=bool(got.met_target), sampler_fallback_reason=got.fallback_reason or "")
        if not got.met_target or got.fallback_reason:
            once(f"short:{phase}", RootsShort, f"the {phase} phase got {got.achieved} of {got.requested} roots by {got.mode}: {got.fallback_reason or 'too few lie apart'}")
        if got.radius_used is not None and got.radius_used < 2 * net.k:
            once("near", RootsShort, f"roots of the {phase} phase lie {got.radius_used} apart, less than twice the ego radius {net.k}: ego objects may share nodes")
        return got.roots

    def guard(residual: float) -> None:
        """Count and tell what the equilibrium that goes into the gradients lacks."""
        if not residual < game.picard_tol:
            capped["picard"] += 1
            once("picard", SolverCapped, f"the equilibrium is off by {residual:.3g} after {game.picard_max} steps, the tolerance is {game.picard_tol:.3g}")
        if local.newton_steps and not local.newton_residual < game.newton_tol:
            capped["newton"] += 1
            once("newton", SolverCapped, f"Newton's last change is {local.newton_residual:.3g} after {game.newton_steps} steps, the tolerance is {game.newton_tol:.3g}")

    emit("run_start", config)
    params = game.with_raw(raw)
    for step in range(1, config.max_steps + 1):
        if step in config.lr_g_decay_milestones:
            lr *= config.lr_g_decay_factor
        tau = blur.tau(step)
        fake_y, _, iters, residual = local.solve(local.noise(draw), params)
        if not np.isfinite(fake_y).all():
            status = "failed:non_finite_y_discriminator"
            break
        loss_d = math.nan
        for _ in range(config.n_disc):
            roots = pick("discriminator")
            real, fake = net.batch(roots, y, mu_y, sigma_y, tau, draw), net.batch(roots, fake_y, mu_y, sigma_y, tau, draw)
            lr_, kr = disc.forward(real, True)
            gr, _ = disc.backward(real, kr, -expit(-lr_) / len(roots))
            lf, kf = disc.forward(fake, True)
            if step == 1:
                check_logits("real scores", lr_)
                check_logits("simulated scores", lf)
            gf, _ = disc.backward(fake, kf, expit(lf) / len(roots))
            loss_d = float(softplus(-lr_).mean() + softplus(lf).mean())
            opt_d.step(disc.p, {k: gr[k] + gf[k] for k in gr})
        noise = local.noise(draw)
        y_fake, tangents, iters, residual = local.solve(noise, params, not implicit)
        if not np.isfinite(y_fake).all():
            status = "failed:non_finite_y_structural"
            break
        guard(residual)
        roots = pick("structural")
        fake = net.batch(roots, y_fake, mu_y, sigma_y, tau, draw)
        lf, kf = disc.forward(fake)
        if config.loss == "nonsaturating":
            loss_g, dl = float(softplus(-lf).mean()), -expit(-lf) / len(roots)
        else:
            loss_g, dl = float(-softplus(lf).mean()), -expit(lf) / len(roots)
        if not (math.isfinite(loss_d) and math.isfinite(loss_g)):
            status = "failed:nan_loss"
            break
        _, dfeat = disc.backward(fake, kf, dl)
        by_node = np.bincount(fake.nodes, dfeat[:, net.x.shape[1]] / sigma_y, net.n)
        slopes = local.pulled_back(y_fake, noise, params, by_node) if implicit else {k: float(by_node @ t) for k, t in tangents.items()}
        grads = {k: v * float(dforward[k].value({"raw": raw[k]})) for k, v in slopes.items()}
        if gradient_transform is not None:
            new = gradient_transform(StepContext(step, dict(params), dict(grads), net))
            if set(new) != set(grads) or not all(math.isfinite(v) for v in new.values()):
                raise ValueError("a gradient transform must return a finite value for each parameter")
            grads = dict(new)
        norm = math.sqrt(sum(v * v for v in grads.values()))
        scale = min(1.0, config.grad_clip / max(norm, 1e-12))
        opt_g.lr = lr
        opt_g.step(raw, {k: np.float64(v * scale) for k, v in grads.items()})
        params = game.with_raw(raw)
        losses_d.append(loss_d)
        losses_g.append(loss_g)
        path.append(params)
        decision = rule.evaluate(losses_d, losses_g, path)
        record = {
            "step": step, "params": dict(params), "loss_d": loss_d, "loss_g": loss_g, "loss_d_rolling": decision.loss_d_rolling, "loss_g_rolling": decision.loss_g_rolling, "grad_norm_g": norm,
            "picard_iterations": iters, **drawn, "tau_y": tau, "in_equilibrium": decision.in_equilibrium, "lr_g": lr, "newton_iterations": local.newton_steps or None,
            "picard_residual": float(residual), "picard_converged": bool(residual < game.picard_tol), "param_grads": {k: float(v) for k, v in grads.items()},
            "extras": {"newton_residual": float(local.newton_residual)} if local.newton_steps else {}, **params,
        }
        history.append(record)
        emit("step", record)
        if decision.converged:
            converged = True
            break
    nan = dict.fromkeys(game.params, math.nan)
    if not path or status != "ok":
        warnings.warn(f"the estimation failed: {status}", EstimationFailed, stacklevel=2)
        result = Result(status, False, len(path), nan, nan, nan, math.nan, math.nan, history, capped["picard"], capped["newton"])
    else:
        if not converged:
            warnings.warn("the run used up its steps", NotStationary, stacklevel=2)
        last = path[-max(config.window, config.stability_window) :]
        mean = {k: float(np.mean([p[k] for p in last])) for k in params}
        sd = {k: float(np.std([p[k] for p in last])) if len(last) > 1 else 0.0 for k in params}
        result = Result(status, converged, len(path), mean, path[-1], sd, float(np.mean(losses_d[-config.window :])), float(np.mean(losses_g[-config.window :])), history, capped["picard"], capped["newton"])
    emit("run_end", result)
    return result


@dataclass(frozen=True)
class StoppingDecision:
    """Whether a run may stop, and by what."""

    converged: bool
    in_equilibrium: bool
    loss_d_rolling: float
    loss_g_rolling: float
    params_stable: bool


class StoppingRule:
    """Losses in their band and parameters that stand still, of any model's histories.

    ``series.loss_band`` and ``series.param_stability`` say the same of tables of steps.
    """

    def __init__(self, config: EstimatorConfig):
        self.config = config

    def in_equilibrium(self, losses_d: list[float], losses_g: list[float]) -> tuple[bool, float, float]:
        """(whether both losses are in their band, their means over the window; NaN until it is full)."""
        c = self.config
        if len(losses_d) < max(c.window, c.min_steps):
            return False, math.nan, math.nan
        d, g = np.array(losses_d[-c.window :]), np.array(losses_g[-c.window :])
        target = OPTIMUM_G if c.loss == "nonsaturating" else OPTIMUM_G_SATURATING
        inside = abs(d.mean() - OPTIMUM_D) < c.delta_d and abs(g.mean() - target) < c.delta_g and d.std() <= c.std_d_max and g.std() <= c.std_g_max
        return bool(inside), float(d.mean()), float(g.mean())

    def stable(self, path: list[dict[str, float]]) -> bool:
        c = self.config
        last = path[-c.stability_window :]
        if len(last) < c.stability_window or not last[-1]:
            return False
        return all(max(p[k] for p in last) - min(p[k] for p in last) <= c.override_tol_for(k) for k in last[-1])

    def evaluate(self, losses_d: list[float], losses_g: list[float], path: list[dict[str, float]]) -> StoppingDecision:
        inside, d, g = self.in_equilibrium(losses_d, losses_g)
        stable = self.stable(path)
        return StoppingDecision(inside and stable and len(path) >= self.config.min_steps, inside, d, g, stable)


class AdversarialEstimator:
    """``fit(network, y)`` a game against a test function; what is learnt has a trailing underscore."""

    def __init__(self, game: Game, disc: RootedGin, config: EstimatorConfig = EstimatorConfig(), blur: BlurLike | None = None, **hooks):
        self.game, self.disc, self.config, self.blur, self.hooks = game, disc, config, blur, hooks

    def get_params(self) -> dict:
        return {"game": self.game, "disc": self.disc, "config": self.config, "blur": self.blur, **self.hooks}

    def set_params(self, **given) -> "AdversarialEstimator":
        names = {f.name for f in fields(self.config)}
        for k, v in given.items():
            if k in names:
                self.config = replace(self.config, **{k: v})
            elif k in ("game", "disc", "config", "blur"):
                setattr(self, k, v)
            elif k in ("gradient_transform", "observers", "sample", "solver"):
                self.hooks = self.hooks | {k: v}
            else:
                raise ValueError(f"no parameter {k!r}")
        return self

    def fit(self, network: LocalNetwork, y: np.ndarray) -> "AdversarialEstimator":
        import copy

        self.disc_ = copy.deepcopy(self.disc)
        self.result_ = run_minimax(network, y, copy.deepcopy(self.game), self.disc_, self.config, self.blur, **self.hooks)
        self.network_, self.y_ = network, np.asarray(y, float)
        return self

    def __getattr__(self, name: str):
        if name.endswith("_") and not name.startswith("__"):
            raise NotFitted(f"{name} is known after fit")
        raise AttributeError(name)

    @property
    def params_(self) -> dict[str, float]:
        return self.result_.params

    def estimates(self) -> pd.DataFrame:
        r = self.result_
        return pd.DataFrame([(k, r.params[k], r.params_final[k], r.path_sd[k]) for k in r.params], columns=["param", "coef", "final", "path_sd"])

    def simulate(self, seed: int = 0) -> np.ndarray:
        noise = np.random.default_rng(seed).standard_normal(self.network_.n)
        return LocalGame(self.game, self.network_).solve(noise, self.params_)[0]

    def scores(self, size: int = 256, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Scores of real and of simulated objects at the same roots."""
        roots = np.random.default_rng(seed).integers(0, self.network_.n, size)
        mu, sd = self.y_.mean(), self.y_.std()
        return tuple(expit(self.disc_.forward(self.network_.batch(roots, v, mu, sd))[0]) for v in (self.y_, self.simulate(seed)))


# ---------------------------------------------------------------- Monte Carlo


def derive_seed(master: int, index: int, stream: int) -> int:
    return int(np.random.SeedSequence([master, index, stream]).generate_state(1)[0])


def seed_streams(master: int, index: int) -> dict[str, int]:
    return {name: derive_seed(master, index, k) for k, name in enumerate(("gt", "train", "sampler", "init"))}


@dataclass(frozen=True)
class Realization:
    """What a run is made of: the seeds and the factories' products."""

    index: int
    seeds: dict[str, int]


def _sent(spark: SparkSession, network: LocalNetwork):
    """A broadcast of the arrays of a network; ``LocalNetwork.collect`` has checked their size."""
    return spark.sparkContext.broadcast(network)


def fit_in_task(
    spark: SparkSession, network: LocalNetwork, observed: Callable[[LocalNetwork, int], np.ndarray], estimator: Callable[["Realization"], AdversarialEstimator],
    read: Callable[[AdversarialEstimator], pd.DataFrame], schema: str, *, master: int = 0, index: int = 0, told: bool = True,
) -> DataFrame:
    """One fit, whose loop is a task of an executor; ``read`` turns the fitted estimator into the rows that come back.

    The equilibria of a linear game are worked out before, in tasks of their own (see ``ahead``); without ``told`` with upper bounds of the steps and
    residuals in the history, which takes less.
    """
    from netloom.operators import ahead

    shared = _sent(spark, network)
    prepared = lambda k: estimator(Realization(k, seed_streams(master, k)))

    def fitted(k: int, records: list[dict]) -> pd.DataFrame:
        est = prepared(k)
        if records:
            est.set_params(solver=lambda game, net: ahead.SeriesGame(game, net, records))
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return read(est.fit(shared.value, observed(shared.value, seed_streams(master, k)["gt"])))

    runs = spark.range(index, index + 1, 1, 1).select(F.col("id").alias("realization"))
    outcome = lambda k: observed(shared.value, seed_streams(master, k)["gt"])
    return ahead.terms(runs, shared, prepared, outcome, told).groupBy("realization").applyInPandas(lambda key, rows: fitted(int(key[0]), ahead.records_of(rows)), schema)


def _realization(spec: Realization, network: LocalNetwork, observed: Callable, estimator: Callable, records: list[dict] = []) -> tuple[dict, list[dict]]:  # noqa: B006
    """(row, history) of a run, with the equilibria that ``records`` have; one that raises an error is a failed run with its name, and what it warned of is told."""
    from netloom.operators import ahead

    began, init = time.monotonic(), {}
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        try:
            est = estimator(spec)
            init = dict(est.game.params)
            if records:
                est.set_params(solver=lambda game, net: ahead.SeriesGame(game, net, records))
            est.set_params(seed=spec.seeds["train"]).fit(network, observed(network, spec.seeds["gt"]))
            result, error = est.result_, []
        except Exception as e:  # noqa: BLE001  one run's trouble isn't the others'
            nan = dict.fromkeys(init, math.nan)
            result, error = Result(f"failed:{type(e).__name__}", False, 0, nan, nan, nan, math.nan, math.nan), [f"{type(e).__name__}: {e}"]
    text = "; ".join(dict.fromkeys([*error, *(str(w.message) for w in said if not issubclass(w.category, DeprecationWarning))]))
    more = {f"{p}_init": v for p, v in init.items()} | {f"{s}_seed": v for s, v in spec.seeds.items()}
    return result.row(spec.index, elapsed_seconds=time.monotonic() - began, warnings=text, **more), result.history


def monte_carlo(
    spark: SparkSession, n: int, network: LocalNetwork, observed: Callable[[LocalNetwork, int], np.ndarray], estimator: Callable[[Realization], AdversarialEstimator],
    *, master: int = 0, done: DataFrame | None = None, params: tuple[str, ...] = (), histories: bool = False, ids: list[int] | None = None,
) -> DataFrame:
    """One row per realisation 0..n-1 (or of ``ids``) that ``done`` doesn't have.

    Runs of the linear game have their equilibria worked out before, in tasks over all draws of all runs (see ``ahead``), and
    are then short loops, dealt by run; others are a task each.
    The arrays of the network travel once, as a broadcast; ``LocalNetwork.collect`` has checked their size.
    A run that raises an error is a row whose status is ``failed:`` and the error's name. A row tells how often solvers used up
    their steps, how long the run took, and its warnings.
    ``histories`` adds the column ``history``, an array of all step records (``contracts.STEP_FIELDS``, then each parameter by its
    own name), which ``histories_of`` turns into rows.
    """
    from netloom.operators import ahead

    shared = _sent(spark, network)
    cols = ["converged boolean", "final_step int", "status string", *(f"`{p}_{s}` double" for p in params for s in ("hat", "final", "init")), "loss_d_rolling_final double", "loss_g_rolling_final double", *(f"{s}_seed long" for s in ("gt", "train", "sampler", "init"))]
    cols += ["picard_cap_hits int", "newton_cap_hits int", "elapsed_seconds double", "warnings string"]
    if histories:
        cols.append("history array<struct<" + ", ".join([*(f"{c}: {t}" for c, t in STEP_FIELDS.items()), *(f"`{p}`: double" for p in params)]) + ">>")
    schema = "realization long, " + ", ".join(cols)
    names = ["realization", *(c.split()[0].strip("`") for c in cols)]

    def one(k: int, records: list[dict]) -> pd.DataFrame:
        row, steps = _realization(Realization(k, seed_streams(master, k)), shared.value, observed, estimator, records)
        if histories:
            row["history"] = [{c: r.get(c) for c in (*STEP_FIELDS, *params)} for r in steps]
        return pd.DataFrame([row]).reindex(columns=names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in batch["realization"]:
                yield one(int(k), [])

    def prepared(k: int) -> AdversarialEstimator:
        seeds = seed_streams(master, k)
        return estimator(Realization(k, seeds)).set_params(seed=seeds["train"])

    count = max(1, len(ids) if ids is not None else n)
    if ids is None:
        places = spark.range(0, n, 1, count).select(F.col("id").alias("realization"), F.col("id").cast("int").alias("place"))  # a partition each, which a broadcast join leaves so
    else:
        places = spark.range(0, len(ids), 1, count).select(F.lit([int(k) for k in ids] or [0])[F.col("id").cast("int")].cast("long").alias("realization"), F.col("id").cast("int").alias("place"))
    todo = places.select("realization")
    if done is not None:
        todo = todo.join(F.broadcast(done.where(F.col("realization").between(0, n - 1)).select("realization").distinct()), "realization", "left_anti")  # n ids at most
    first = ids[0] if ids else 0
    try:
        linear = ahead.applies(prepared(int(first)))
    except Exception:  # noqa: BLE001  the run meets it and tells it in its row
        linear = False
    if not linear:
        return todo.mapInPandas(run, schema)
    found = ahead.terms(todo, shared, prepared, lambda k: observed(shared.value, seed_streams(master, k)["gt"]), told=histories)

    def looped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if parts := list(batches):
            for k, rows in pd.concat(parts).groupby("realization"):
                yield one(int(k), ahead.records_of(rows))

    placed = found.join(F.broadcast(places), "realization").repartitionById(count, F.col("place"))  # n ids at most; no two runs are put together in one task
    return placed.mapInPandas(looped, schema)


def histories_of(rows: DataFrame) -> DataFrame:
    """``(realization, step, params, loss_d, loss_g, ..., parameters)`` of Monte Carlo rows with histories: what the operators on series take."""
    return rows.select("realization", F.explode("history").alias("h")).select("realization", "h.*")

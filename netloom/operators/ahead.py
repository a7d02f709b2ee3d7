"""Equilibria of the linear game worked out ahead of a run, in tasks of their own.

What a run draws (shocks, roots, blur) depends on its seed alone, and the equilibrium of the linear game is a series in beta,
``y = sum over j of beta^j W^j (gamma x + sigma e)``. So a task can make the terms ``W^j x`` and ``W^j e`` of many draws
at the few nodes that a step looks at, before the parameters of that step are known; the loop itself then only sums them.

The terms come in two bases. Powers of W, made on the whole graph, tell at which step an iteration there ends, as the largest change of all nodes is known;
structural draws have them where that is told (in histories, or to observers). The other draws have Chebyshev polynomials of W, which take half as many for
the same error, and only around the nodes that are looked at. How many depends on beta, so the run is made once with few of them, roughly, which tells where
beta is at each step.
"""

from __future__ import annotations

import math
import pickle
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from netloom.operators.estimator import AdversarialEstimator, Blur, LocalGame, LocalNetwork, LocalSampler
from netloom.operators.games import LinearInMeans

#: The series reaches its tolerance for |beta| up to about this; a step beyond solves on the whole graph.
REACH = 0.6
#: Nodes of a draw whose terms are kept at most; a draw that looks at more is solved on the whole graph.
MOST_NODES = 20_000
#: Nodes of draws that a task works on between two passes over x, about.
TOGETHER = 100_000
#: Polynomials of the rough run; how far beta may be from where that run had it; where it is taken to be without one.
ROUGH, MARGIN, GUESS = 9, 0.02, 0.5
#: Deviations that no shock goes beyond, but once in 10^18.
FAR = 9.0


class Means:
    """Means over neighbours of many columns at once; nodes are ordered by degree, so that a block of rows is a few gathers."""

    BLOCK = 8192

    def __init__(self, net: LocalNetwork):
        degree = np.diff(net.ptr)
        self.order = np.argsort(degree, kind="stable")
        self.place = np.empty(net.n, np.int64)
        self.place[self.order] = np.arange(net.n)
        sizes, starts = np.unique(degree[self.order], return_index=True)
        self.groups = []
        for k, a, b in zip(sizes, starts, [*starts[1:], net.n]):
            rows = net.ptr[self.order[a:b]]
            near = np.empty((k, b - a), np.int64)
            for j in range(k):
                near[j] = self.place[net.dst[rows + j]]
            self.groups.append((int(a), int(b), near))

    def __call__(self, v: np.ndarray) -> np.ndarray:
        out = np.empty_like(v)
        for a, b, near in self.groups:
            if len(near) > 64:  # few nodes: one by one
                for i in range(b - a):
                    out[a + i] = v.take(near[:, i], 0).mean(0)
                continue
            for c in range(a, b, self.BLOCK):
                e = min(b, c + self.BLOCK)
                now = out[c:e]
                np.take(v, near[0, c - a : e - a], 0, out=now, mode="clip")
                for j in range(1, len(near)):
                    now += v.take(near[j, c - a : e - a], 0, mode="clip")
                now /= len(near)
        return out


def extremes(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Points whose greatest |g p + s q| is that of all, for every g and s: corners of the hull of the points and their negatives."""
    i = int(np.abs(p).argmax())
    a = np.array([p[i], q[i]])
    if a[0] < 0:
        a = -a
    up = a[0] * q - a[1] * p
    j = int(np.abs(up).argmax())
    b = np.array([p[j], q[j]])
    area = abs(up[j])
    if not area > 0:  # all on a line
        return a[None]
    far = np.abs(up) + np.abs(b[0] * q - b[1] * p) > area * (1 - 1e-12)  # not inside the parallelogram of a and b
    sign = np.where(up[far] < 0, -1.0, 1.0)
    points, out = np.column_stack([p[far] * sign, q[far] * sign]), [a, b]
    stack = [(points, -a, a)]
    while stack:
        points, left, right = stack.pop()
        above = (right[0] - left[0]) * (points[:, 1] - left[1]) - (right[1] - left[1]) * (points[:, 0] - left[0])
        keep = above > 1e-14 * area
        if keep.any():
            top = points[above.argmax()]
            out.append(top)
            stack += [(points[keep], left, top), (points[keep], top, right)]
    return np.array(out)


def applies(est: AdversarialEstimator) -> bool:
    """Whether a run is one whose draws don't depend on its parameters and whose equilibrium is such a series."""
    sample = est.hooks.get("sample")
    return type(est.game) is LinearInMeans and (sample is None or type(sample) is LocalSampler) and "solver" not in est.hooks


def levels(tol: float) -> int:
    return max(12, math.ceil(math.log(min(tol, 0.1)) / math.log(REACH)) + 8)


def rehearsed(net: LocalNetwork, est: AdversarialEstimator, heard: Callable[[dict, np.ndarray], None] | None = None) -> Iterator[dict]:
    """Each draw of shocks that ``run_minimax`` makes, in its order: the generator's states before and after, and the nodes that the step looks at.

    ``heard`` is told each of them with its shocks.
    """
    config, blur, sampler = est.config, est.blur, est.hooks.get("sample") or LocalSampler()
    blur = blur or Blur(enabled=False)
    draw = np.random.default_rng(config.seed)

    def looked(tau: float, sides: int) -> np.ndarray:
        balls = [net.ego(int(r))[0] for r in sampler(net, draw, config.batch).roots]
        if tau > 0:
            for _ in range(sides):
                for ball in balls:
                    draw.standard_normal(len(ball))
        return np.unique(np.concatenate(balls)) if balls else np.zeros(0, np.int64)

    for step in range(1, config.max_steps + 1):
        tau = blur.tau(step)
        for structural in (False, True):
            before = draw.bit_generator.state
            noise = draw.standard_normal(net.n)
            after = draw.bit_generator.state
            seen = [looked(tau, 1)] if structural else [looked(tau, 2) for _ in range(config.n_disc)]
            record = {"before": before, "after": after, "structural": structural, "nodes": np.unique(np.concatenate(seen))}
            if heard is not None:
                heard(record, noise)
            yield record


def noise_of(record: dict, n: int) -> np.ndarray:
    draw = np.random.default_rng()
    draw.bit_generator.state = record["before"]
    return draw.standard_normal(n)


def with_terms(net: LocalNetwork, means: Means, records: list[dict], count: int) -> list[dict]:
    """The records with ``p`` and ``q``, the terms of x and of the shocks at their nodes by level, and of structural ones the ``corners`` of each level."""
    v = np.empty((net.n, 1 + len(records)))
    v[:, 0] = net.x[means.order, 0]
    for k, r in enumerate(records, 1):
        v[:, k] = noise_of(r, net.n)[means.order]
    kept = [means.place[r["nodes"]] for r in records]
    for r, at in zip(records, kept):
        r.update(p=np.empty((count, len(at))), q=np.empty((count, len(at))), corners=[])
    for j in range(count):
        v = means(v) if j else v
        x = np.ascontiguousarray(v[:, 0])
        for k, (r, at) in enumerate(zip(records, kept), 1):
            r["p"][j], r["q"][j] = x[at], v[at, k]
            if r["structural"]:
                r["corners"].append(extremes(x, np.ascontiguousarray(v[:, k])))
    return records


# ---------------------------------------------------------------- polynomials around the nodes


def mutual(net: LocalNetwork) -> bool:
    """Whether every edge goes both ways, equally often; W has real eigenvalues then, within -1 and 1."""
    return bool((net.src * net.n + net.dst == np.sort(net.dst * net.n + net.src)).all())


def coefficients(beta: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``1 / (1 - beta t)`` in Chebyshev polynomials of t, and their derivatives by beta."""
    s, j = math.sqrt(1 - beta * beta), np.arange(count)
    rho, double = beta / (1 + s), np.where(j == 0, 1.0, 2.0)
    value = double * rho**j / s
    return value, double * j * rho ** np.maximum(j - 1, 0) / (s * s * (1 + s)) + value * beta / (s * s)


def degree(tol: float, size: float, beta: float) -> int:
    """Polynomials after which the rest is below half of ``tol``, of values up to ``size`` each."""
    beta = min(abs(beta), 0.99)
    if beta < 1e-6:
        return 4
    s = math.sqrt(1 - beta * beta)
    rho = beta / (1 + s)
    return max(4, math.ceil(math.log(min(tol, 0.1) / 2 * s * (1 - rho) / (2 * max(size, 1.0))) / math.log(rho)))


@dataclass
class Around:
    """A network with what polynomials on it need: how large they may be, of x and of shocks, and numbers of nodes while a cone is made.

    With k_i neighbours of node i, a polynomial bounded by 1 takes no v beyond ``sqrt(sum of k v^2 / k_i)`` at i, and a standard normal one to a
    deviation of ``sqrt(largest k / k_i)`` at most.
    """

    net: LocalNetwork
    sizes: tuple[float, float] = field(init=False)
    mutual: bool = field(init=False)

    def __post_init__(self):
        k = np.diff(self.net.ptr)
        self.sizes = math.sqrt(float((k * self.net.x[:, 0] ** 2).sum()) / k.min()), FAR * math.sqrt(k.max() / k.min())
        self.mutual = mutual(self.net)
        self.number = np.full(self.net.n, -1, np.int64)
        self.top = float(np.abs(self.net.x[:, 0]).max())

    def degrees(self, tol: float, beta: float) -> tuple[int, int]:
        """Polynomials of x and of the shocks that a beta needs."""
        return degree(tol, self.sizes[0], beta), degree(tol, self.sizes[1], beta)

    def cone(self, nodes: np.ndarray, count: int) -> "Cone":
        """What the first ``count`` polynomials at the nodes need: the nodes within ``count - 2`` steps, nearest first, and their neighbours."""
        ptr, number = self.net.ptr, self.number
        ring, size, rings, counts, near, inner = nodes, len(nodes), [], [], [], []
        number[nodes] = np.arange(size)
        for left in range(count - 2, -1, -1):
            rings.append(ring)
            counts.append(ptr[ring + 1] - ptr[ring])
            total = int(counts[-1].sum())
            edges = np.repeat(ptr[ring] - (np.cumsum(counts[-1]) - counts[-1]), counts[-1])
            edges += np.arange(total)
            near.append(self.net.dst.take(edges))
            if left:
                at = number.take(near[-1])
                new = near[-1][at < 0]
                number[new[::-1]] = np.arange(size + len(new) - 1, size - 1, -1)  # where a node comes first
                ring = new[number.take(new) == np.arange(size, size + len(new))]
                number[ring] = np.arange(size, size + len(ring))
                size += len(ring)
                inner.append(number.take(near[-1]))
        every = np.concatenate(rings)
        number[every] = -1
        return Cone(every, [len(r) for r in rings], np.concatenate(counts), np.concatenate(near), np.concatenate(inner) if inner else near[0][:0])


@dataclass
class Cone:
    """Nodes by their distance, the sizes of the rings, the numbers of their neighbours, these, and of all but the last ring's their places among the nodes."""

    nodes: np.ndarray
    sizes: list[int]
    counts: np.ndarray
    near: np.ndarray
    inner: np.ndarray

    def polynomials(self, v: np.ndarray) -> np.ndarray:
        """Chebyshev polynomials of the means over neighbours, of v (of all nodes), at the innermost nodes by degree; each is made as far out as the next needs it."""
        count, ends = len(self.sizes) + 1, np.cumsum(self.sizes)
        out, starts = np.empty((count, self.sizes[0])), np.concatenate([[0], np.cumsum(self.counts)])
        last, now = v.take(self.nodes), np.add.reduceat(v.take(self.near), starts[:-1]) / self.counts
        out[0], out[1] = last[: out.shape[1]], now[: out.shape[1]]
        double = 2 / self.counts
        for j in range(2, count):
            n = ends[count - 1 - j]
            total = np.add.reduceat(now.take(self.inner[: starts[n]]), starts[:n])
            total *= double[:n]
            total -= last[:n]
            last, now = now, total
            out[j] = now[: out.shape[1]]
        return out


def with_polynomials(around: Around, records: list[dict], tol: float) -> list[dict]:
    """The records with ``p`` and ``q``, the polynomials of x and of the shocks at their nodes by degree, and ``most``, the largest of both.

    There are as many as |beta| up to ``reach`` of a record needs. x is the same for all records and is done once, on the whole graph.
    """
    net = around.net
    for r in records:
        noise = noise_of(r, net.n)
        r.update(q=around.cone(r["nodes"], around.degrees(tol, r["reach"])[1]).polynomials(noise), most=(around.top, max(float(noise.max()), -float(noise.min()))))
    every, ends = np.concatenate([r["nodes"] for r in records]), np.cumsum([len(r["nodes"]) for r in records])[:-1]
    last, now = np.zeros(net.n), net.x[:, 0]
    lines = [now[every]]
    for j in range(1, max(around.degrees(tol, r["reach"])[0] for r in records)):
        last, now = now, net.mean(now) if j == 1 else 2 * net.mean(now) - last
        lines.append(now[every])
    for r, p in zip(records, np.split(np.array(lines), ends, axis=1)):
        r["p"] = p[: around.degrees(tol, r["reach"])[0]].copy()
    return records


def predicted(around: Around, est: AdversarialEstimator, y: np.ndarray | None, told: bool) -> list[dict]:
    """The draws of a run with the ``reach`` that beta is expected to have, from a rough run against y, and whether their steps are ``told``."""
    rough: list[dict] = []

    def heard(record: dict, noise: np.ndarray) -> None:
        if len(record["nodes"]) > MOST_NODES:
            raise ValueError("a draw looks at too many nodes")
        cone = around.cone(record["nodes"], ROUGH)
        rough.append(record | {"p": cone.polynomials(around.net.x[:, 0]), "q": cone.polynomials(noise), "most": (0.0, 0.0), "rough": True})

    records = None
    if y is not None and around.mutual:
        try:
            records = list(rehearsed(around.net, est, heard))
        except ValueError:
            rough = []
    if records is None:
        records = list(rehearsed(around.net, est))
    path: list[float] = []
    if rough:
        hooks = {k: v for k, v in est.hooks.items() if k == "sample"}
        game = lambda game, net: _Heard(game, net, rough, path)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                AdversarialEstimator(est.game, est.disc, est.config, est.blur, solver=game, **hooks).fit(around.net, y)
            except Exception:  # noqa: BLE001  the run itself meets the error and tells it
                pass
    for k, r in enumerate(records):
        r.update(reach=path[k] + MARGIN if k < len(path) else GUESS, told=told and r["structural"])
    return records


@dataclass
class Drawn:
    """A draw of shocks with its terms; ``noise`` once the whole graph had to be solved."""

    record: dict
    noise: np.ndarray | None = None


class SeriesGame(LocalGame):
    """``LocalGame`` of the linear game whose solutions are summed from terms that are there, and hold at the nodes that a step looks at (0 elsewhere)."""

    def __init__(self, game: LinearInMeans, net: LocalNetwork, records: list[dict]):
        super().__init__(game, net)
        self.records, self.solved_whole, self.deepened = iter(records), 0, 0

    def noise(self, draw: np.random.Generator) -> Drawn:
        record = next(self.records)
        if draw.bit_generator.state != record["before"]:
            raise RuntimeError("a draw came in another order than was rehearsed")
        draw.bit_generator.state = record["after"]
        return Drawn(record)

    def _whole(self, drawn: Drawn, params: dict[str, float], tangents: bool):
        self.solved_whole += 1
        drawn.noise = noise_of(drawn.record, self.net.n)
        return super().solve(drawn.noise, params, tangents)

    def _slopes(self, record: dict, params: dict[str, float]) -> dict[str, np.ndarray]:
        """dy by each parameter at the record's nodes."""
        beta, gamma, sigma, p, q = params["beta"], params["gamma"], self.sigma(params), record["p"], record["q"]
        if "most" in record:
            of_x, of_e = coefficients(float(beta), len(p)), coefficients(float(beta), len(q))
            return {"beta": gamma * (of_x[1] @ p) + sigma * (of_e[1] @ q), "gamma": of_x[0] @ p, "sigma_sq": of_e[0] @ q / (2 * sigma)}
        j = np.arange(len(p))
        power = float(beta) ** j
        return {"beta": (j[1:] * power[:-1]) @ (gamma * p[1:] + sigma * q[1:]), "gamma": power @ p, "sigma_sq": power @ q / (2 * sigma)}

    def _summed(self, noise: Drawn, params: dict[str, float], tangents: bool):
        """Of polynomials; the steps are the first after which no node's change can reach the tolerance."""
        r, tol, most = noise.record, self.game.picard_tol, self.game.picard_max
        beta, gamma, sigma = float(params["beta"]), params["gamma"], self.sigma(params)
        change = lambda j: abs(beta) ** j * (abs(gamma) * r["most"][0] + sigma * r["most"][1])
        if not (abs(beta) < 1 and change(most - 1) < tol):
            return self._whole(noise, params, tangents)
        if "rough" not in r:
            around = _around(self.net)
            if any(len(r[k]) < d for k, d in zip("pq", around.degrees(tol, beta))):  # beta is farther than was expected
                self.deepened += 1
                r["reach"] = min(abs(beta) + MARGIN, 0.99)
                cone = around.cone(r["nodes"], max(around.degrees(tol, r["reach"])))
                r.update(p=cone.polynomials(self.net.x[:, 0]), q=cone.polynomials(noise_of(r, self.net.n)))
        steps = next(j + 1 for j in range(most) if change(j) < tol)
        at = gamma * (coefficients(beta, len(r["p"]))[0] @ r["p"]) + sigma * (coefficients(beta, len(r["q"]))[0] @ r["q"])
        return self._at(r, at, params, tangents, steps, change(steps - 1))

    def solve(self, noise, params: dict[str, float], tangents: bool = False):
        if not isinstance(noise, Drawn):
            return super().solve(noise, params, tangents)
        r = noise.record
        if "p" not in r:
            return self._whole(noise, params, tangents)
        if "most" in r:
            return self._summed(noise, params, tangents)
        beta, gamma, sigma, tol = float(params["beta"]), params["gamma"], self.sigma(params), self.game.picard_tol
        count, steps, residual = len(r["p"]), len(r["p"]), 0.0
        if count > self.game.picard_max or abs(beta) > REACH or not np.isfinite([beta, gamma, sigma]).all():
            return self._whole(noise, params, tangents)
        if r["structural"]:
            change = lambda j: abs(beta) ** j * float(np.abs(r["corners"][j] @ (gamma, sigma)).max())
            if not count * change(count - 1) < tol * max(1.0, abs(gamma), sigma):
                return self._whole(noise, params, tangents)
            steps = next(j + 1 for j in range(count) if change(j) < tol or j == count - 1)
            residual = change(steps - 1)
        at = float(beta) ** np.arange(steps) @ (gamma * r["p"][:steps] + sigma * r["q"][:steps])
        return self._at(r, at, params, tangents, steps, residual)

    def _at(self, r: dict, at: np.ndarray, params: dict[str, float], tangents: bool, steps: int, residual: float):
        """What ``solve`` returns, of values at the record's nodes."""
        y = np.zeros(self.net.n)
        y[r["nodes"]] = at
        out = {}
        if tangents:
            for name, slope in self._slopes(r, params).items():
                out[name] = np.zeros(self.net.n)
                out[name][r["nodes"]] = slope
        return y, out, steps, residual

    def pulled_back(self, y, noise, params, cotangent):
        if not isinstance(noise, Drawn) or noise.noise is not None:
            return super().pulled_back(y, noise.noise if isinstance(noise, Drawn) else noise, params, cotangent)
        c = cotangent[noise.record["nodes"]]
        return {name: float(c @ slope) for name, slope in self._slopes(noise.record, params).items()}


class _Heard(SeriesGame):
    """Keeps |beta| of every draw."""

    def __init__(self, game: LinearInMeans, net: LocalNetwork, records: list[dict], path: list[float]):
        super().__init__(game, net, records)
        self.path = path

    def solve(self, noise, params: dict[str, float], tangents: bool = False):
        self.path.append(abs(float(params["beta"])))
        return super().solve(noise, params, tangents)


def _means(net: LocalNetwork) -> Means:
    if not hasattr(net, "_ahead"):
        net._ahead = Means(net)
    return net._ahead


def _around(net: LocalNetwork) -> Around:
    if not hasattr(net, "_cones"):
        net._cones = Around(net)
    return net._cones


def columns_of(n: int) -> int:
    """Draws that a task works on at once: 16 numbers a node, 8 on large graphs."""
    return 15 if n <= 1_000_000 else 7


def terms(runs: DataFrame, shared, prepared: Callable[[int], AdversarialEstimator], outcome: Callable[[int], np.ndarray] | None = None, told: bool = True) -> DataFrame:
    """``(realization, unit, records)`` for runs(realization): their draws with terms, some to a row; one row more a run, without any.

    ``shared`` is a broadcast of the network, ``prepared`` gives a run's estimator, ``outcome`` what it is fitted to, where beta is to be predicted. The rows of a
    run without a plan (see ``applies``; or whose estimator can't be made) are that one alone. ``told`` says that the steps and residuals of structural draws are
    looked at, as observers do in any case.
    """

    def plans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for run in batch["realization"]:
                row = lambda unit, found: pd.DataFrame({"realization": [run], "unit": [unit], "tol": [tol], "records": [found]})  # noqa: B023, E731
                tol = 0.0
                yield row(-1, None)
                try:
                    est = prepared(int(run))
                    if not applies(est):
                        continue
                    tol, wide = est.game.picard_tol, columns_of(shared.value.n)
                    records = predicted(_around(shared.value), est, outcome and outcome(int(run)), told or bool(est.hooks.get("observers")))
                    for k in range(0, len(records), wide):
                        yield row(k // wide, pickle.dumps(records[k : k + wide]))
                except Exception:  # noqa: BLE001  the run itself meets the error and tells it
                    continue

    def finished(units: list[tuple]) -> Iterator[pd.DataFrame]:
        small = [(r.tol, x) for r, records in units for x in records if len(x["nodes"]) <= MOST_NODES]
        for tol in {tol for tol, _ in small}:
            if brief := [x for t, x in small if t == tol and not x["told"]] if _around(shared.value).mutual else []:
                with_polynomials(_around(shared.value), brief, tol)
        for r, records in units:
            if rest := [x for x in records if len(x["nodes"]) <= MOST_NODES and "p" not in x]:
                with_terms(shared.value, _means(shared.value), rest, levels(r.tol))
            yield pd.DataFrame({"realization": [r.realization], "unit": [r.unit], "records": [pickle.dumps(records) if r.unit >= 0 else None]})

    def worked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units, size = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                units.append((r, pickle.loads(r.records) if r.unit >= 0 else []))
                size += sum(len(x["nodes"]) for x in units[-1][1])
                if size >= TOGETHER:
                    yield from finished(units)
                    units, size = [], 0
        yield from finished(units)

    schema = "realization long, unit int, tol double, records binary"
    dealt = runs.mapInPandas(plans, schema).repartition(4 * runs.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInPandas(worked, "realization long, unit int, records binary")


def records_of(rows: pd.DataFrame) -> list[dict]:
    """The records of one run, in the order of its draws; none for a run without a plan."""
    rows = rows[rows["unit"] >= 0].sort_values("unit")
    return [r for found in rows["records"] for r in pickle.loads(found)]

"""Root sampling: uniform draws and packings of roots that lie apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from netloom.functions.scalar import uniform_hash
from netloom.operators.components import checkpointed, rekeyed
from netloom.operators.graph import node_ids


@dataclass
class Roots:
    """Sampled ``roots(slot, root)`` and how they came about."""

    roots: DataFrame
    requested: int
    achieved: int
    mode: str
    radius_used: int | None = None
    attempts_used: int = 1
    met_target: bool = True
    fallback_reason: str | None = None


def priority(seed: int, id_: Column) -> Column:
    """The place of a node in the random order of a seed: a hash, ties by id."""
    return F.struct(uniform_hash(seed, "pack", id_).alias("u"), id_.alias("id"))


def uniform(nodes: DataFrame, size: int, seed: int = 0, call: int = 0) -> DataFrame:
    """``(slot, root)``: ``size`` independent draws from nodes(id) labelled 0..n-1, with replacement."""
    n = nodes.agg(F.max("id").alias("top")).first()["top"] + 1
    slots = nodes.sparkSession.range(size).select(F.col("id").cast("int").alias("slot"))
    return slots.select("slot", F.floor(uniform_hash(seed, "root", call, F.col("slot")) * n).cast("long").alias("root"))


def packed(edges: DataFrame, radius: int, target: int | None = None, seed: int = 0, max_rounds: int = 200) -> DataFrame:
    """``(root, u)``: a maximal set of roots with pairwise distance above ``radius``, the first ``target`` by priority.

    It is the set that a greedy pass in order of priority would take: in each round every node
    that comes first among the live ones within ``radius`` is taken, and what lies within
    ``radius`` of those taken dies. Both are found by ``radius`` steps along ``edges(src, dst)`` (both
    directions): a minimum of priorities that is passed on, and a mark. So no ball is ever written out: a step costs the
    edges that its rows touch, a hub no more than its own, whatever the radius.
    """
    return _packed(edges, radius, None, target, seed, max_rounds)


def _packed(edges: DataFrame, radius: int, order: DataFrame | None, target: int | None, seed: int = 0, max_rounds: int = 200) -> DataFrame:
    ids = node_ids(edges)
    near = edges.select("src", "dst").where("src <> dst").union(ids.select(F.col("id").alias("src"), F.col("id").alias("dst"))).distinct()
    near = checkpointed(near)  # a node is its own neighbour: it passes on what it has
    live = ids.select("id", priority(seed, F.col("id")).alias("p")) if order is None else order.join(ids, "id").select("id", F.struct("u", "id").alias("p"))
    live, taken = checkpointed(live), None

    def step(df: DataFrame, *carried) -> DataFrame:
        return near.join(rekeyed(df.withColumnRenamed("id", "dst"), "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*carried)

    for _ in range(max_rounds):
        first = live
        for _ in range(radius):
            first = step(first, F.min("p").alias("p"))
        won = checkpointed(first.where(F.col("p.id") == F.col("id")).select(F.col("id").alias("root"), F.col("p.u").alias("u")))
        taken = won if taken is None else taken.union(won)
        dead = won.select(F.col("root").alias("id"), F.lit(True).alias("hit"))
        for _ in range(radius):
            dead = step(dead, F.first("hit").alias("hit"))
        live = checkpointed(live.join(dead, "id", "left_anti"))
        if live.isEmpty():
            break
    else:
        raise RuntimeError("packing did not end")
    return taken if target is None else taken.orderBy("u", "root").limit(target)


def packed_in_order(edges: DataFrame, radius: int, order: DataFrame, target: int | None = None) -> DataFrame:
    """``packed`` for a given order(id, place) of the nodes, places being distinct, in place of a seed's random one."""
    return _packed(edges, radius, order.select("id", F.col("place").cast("double").alias("u")), target)


def best_packed_in_orders(edges: DataFrame, radius: int, orders: list[DataFrame], target: int | None = None) -> tuple[DataFrame, int]:
    """(roots of the largest packing over some orders, the first one among equals; orders tried). Stops at the first that meets the target."""
    if not orders:
        raise ValueError("there must be an order")
    best, size, k = None, -1, 0
    for k, order in enumerate(orders, 1):
        now = packed_in_order(edges, radius, order, target)
        n = now.count()
        if n > size:
            best, size = now, n
        if target is not None and n >= target:
            break
    return best, k


def best_packed(edges: DataFrame, radius: int, target: int | None, restarts: int, seed: int = 0) -> tuple[DataFrame, int]:
    """(roots of the largest of several packings, the first one among equals; packings made). Stops at the first that meets the target."""
    best, size, k = None, -1, 0
    for k in range(restarts):
        now = packed(edges, radius, target, seed + k)
        n = now.count()
        if n > size:
            best, size = now, n
        if target is not None and n >= target:
            break
    return best, k + 1


class RootSampler:
    """Sampling in one of four modes: uniform, disjoint_once, disjoint_best_of_k, disjoint_relax."""

    MODES = ("uniform", "disjoint_once", "disjoint_best_of_k", "disjoint_relax")

    def __init__(self, mode: str = "uniform", *, exclusion_r: int = 3, restarts: int = 3, relax: tuple[int, ...] = (3, 2), min_batch: int | None = None, fallback: str = "uniform", seed: int = 0):
        if mode not in self.MODES:
            raise ValueError(f"mode must be one of {self.MODES}")
        if fallback not in ("best", "uniform", "raise"):
            raise ValueError("fallback must be best, uniform or raise")
        if exclusion_r < 0 or restarts < 1 or any(r < 0 for r in relax) or mode == "disjoint_relax" and not relax:
            raise ValueError("radii must not be negative, and there must be a restart and a radius at least")
        self.mode, self.exclusion_r, self.restarts, self.relax, self.min_batch, self.fallback, self.seed = mode, exclusion_r, restarts, tuple(relax), min_batch, fallback, seed
        self.calls = 0

    @property
    def effective_r(self) -> int | None:
        return None if self.mode == "uniform" else max(self.relax) if self.mode == "disjoint_relax" else self.exclusion_r

    def sample(self, nodes: DataFrame, edges: DataFrame | None, size: int) -> Roots:
        """``size`` roots of nodes(id); the disjoint modes need the edges."""
        if size < 1:
            raise ValueError("size must be positive")
        self.calls += 1
        seed = self.seed * 1000 + self.calls
        slotted = lambda df: df.select((F.row_number().over(Window.orderBy("u", "root")) - 1).cast("int").alias("slot"), "root")  # noqa: E731  a batch of roots
        plain = lambda **how: Roots(uniform(nodes, size, self.seed, self.calls), size, size, "uniform", **how)
        if self.mode == "uniform":
            return plain()
        if self.mode == "disjoint_once":
            got, tries = packed(edges, self.exclusion_r, size, seed), 1
        elif self.mode == "disjoint_best_of_k":
            got, tries = best_packed(edges, self.exclusion_r, size, self.restarts, seed)
        else:
            return self._relaxed(edges, size, seed, slotted, plain)
        n = got.count()
        return Roots(slotted(got), size, n, self.mode, self.exclusion_r, tries, n >= size, None if n >= size else "target_not_met")

    def _relaxed(self, edges, size, seed, slotted, plain) -> Roots:
        least = min(self.min_batch or size, size)
        best, best_n, best_r, tries = None, -1, None, 0
        for r in self.relax:
            got, k = best_packed(edges, r, size, self.restarts, seed)
            tries, n = tries + k, got.count()
            if n > best_n:
                best, best_n, best_r = got, n, r
            if n >= least:
                return Roots(slotted(got), size, n, self.mode, r, tries, n >= size)
        if self.fallback == "raise":
            raise RuntimeError(f"no radius of {self.relax} gave {least} roots; the best gave {best_n}")
        if self.fallback == "uniform":
            return plain(attempts_used=tries, fallback_reason=f"uniform_fallback_below_min_batch:{best_n}<{least}")
        return Roots(slotted(best), size, best_n, self.mode, best_r, tries, best_n >= size, f"best_below_min_batch:{best_n}<{least}")


def probe_nodes(degree: DataFrame, n_probe: int, seed: int = 0) -> DataFrame:
    """``(id)``: the nodes of highest degree and a random sample, ``n_probe`` together; a top node is not drawn twice."""
    top = degree.orderBy(F.desc("degree"), "id").limit(n_probe // 2 + 1).select("id", F.lit(0).alias("kind"), (-F.col("degree")).cast("double").alias("k"))
    rand = degree.select("id", F.lit(1).alias("kind"), uniform_hash(seed, "probe", F.col("id")).alias("k")).orderBy("k", "id").limit(n_probe)
    first = top.union(rand).groupBy("id").agg(F.min(F.struct("kind", "k")).alias("at"))
    return first.orderBy("at", "id").limit(n_probe).select("id")


def violations(roots: DataFrame, found: DataFrame, radius: int) -> DataFrame:
    """``(a, b, dist)``: pairs of sampled roots that lie within ``radius`` after all."""
    near = found.where(F.col("dist") <= radius).join(roots.select("root"), "root", "left_semi")
    other = roots.select(F.col("root").alias("node"))
    return near.join(other, "node", "left_semi").where("root < node").select(F.col("root").alias("a"), F.col("node").alias("b"), "dist")

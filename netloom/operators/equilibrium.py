"""Fixed points of best responses as DataFrame iterations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from netloom.operators.components import checkpointed, rekeyed


class NotConverged(RuntimeError):
    """A solve that used up its steps; carries residual, tol and cap."""

    def __init__(self, residual: float, tol: float, cap: int):
        super().__init__(f"residual {residual:.3g} after {cap} steps; the tolerance is {tol:.3g}")
        self.residual, self.tol, self.cap = residual, tol, cap


@dataclass
class Solved:
    """A solution, the steps it took, its last change and whether that is below the tolerance; of traced Newton iterations the worst last change and most steps."""

    nodes: DataFrame
    iters: int
    residual: float
    converged: bool
    newton_residual: float | None = None
    newton_iters: int | None = None

    def __iter__(self):
        return iter((self.nodes, self.iters))


#: Edges of a node that go in one row at most, about.
LIST = 1024


def with_self(weights: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(dst, near)``: for each node the list of (src, w) of the edges into it, and once a null that only carries its own columns.

    A list has some LIST edges at most, dealt by a hash, so that a hub is many rows; an edge costs 16 bytes in it
    where it would cost a row.
    """
    w = F.col("w") if "w" in weights.columns else F.lit(1.0)
    edges = weights.where("dst is not null").select("dst", F.struct(F.col("src").alias("src"), w.cast("double").alias("w")).alias("e"))
    into = edges.groupBy("dst").agg(F.count("*").alias("_n"))
    hubs = into.where(F.col("_n") > LIST).select(F.col("dst").alias("_hub"), F.ceil(F.col("_n") / LIST).cast("int").alias("_parts"))
    dealt = edges.join(F.broadcast(hubs), F.col("dst") == F.col("_hub"), "left")  # one row for every LIST edges at most
    part = F.pmod(F.xxhash64("e"), F.coalesce("_parts", F.lit(1)))
    lists = dealt.groupBy("dst", part.alias("part")).agg(F.collect_list("e").alias("near")).select("dst", "near")
    none = F.lit(None).cast(lists.schema["near"].dataType)
    return lists.union(nodes.select(F.col("id").alias("dst"), none.alias("near")))


def aggregated(weights: DataFrame, nodes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """nodes with ``name = sum over neighbours of a value``, 0 without neighbours.

    ``values`` maps names to Columns over the neighbour's columns and the edge's weight ``w``. A
    node's own columns come along an edge to itself, so that nodes are read once and a chain of
    steps is a plan of linear size; ``weights`` made by ``with_self`` has these edges already. The
    join deals both sides anew, so that the edges into a hub can be split.
    """
    edges = weights if "near" in weights.columns else with_self(weights, nodes)
    kept = [c for c in nodes.columns if c != "id" and c not in values]
    joined = edges.join(rekeyed(nodes.withColumnRenamed("id", "dst"), "dst"), "dst")
    rows = joined.select("*", F.explode_outer("near").alias("_e")).withColumns({"w": F.col("_e.w"), "_own": F.col("near").isNull()})
    to = F.when(F.col("_own"), F.col("dst")).otherwise(F.col("_e.src"))
    own = [F.max(F.when(F.col("_own"), F.col(c))).alias(c) for c in kept]
    sums = [F.coalesce(F.sum(F.when(~F.col("_own"), v)), F.lit(0.0)).alias(k) for k, v in values.items()]
    return rows.groupBy(to.alias("id")).agg(*own, *sums)


def peer_mean(weights: DataFrame, nodes: DataFrame, value: Column | None = None, name: str = "peer") -> DataFrame:
    """nodes with the weighted mean of the neighbours' y (or another Column of theirs)."""
    return aggregated(weights, nodes, {name: F.col("w") * (F.col("y") if value is None else value)})


def peer_sum(weights: DataFrame, nodes: DataFrame, value: Column | None = None, name: str = "peer") -> DataFrame:
    """nodes with the plain sum over neighbours."""
    return aggregated(weights, nodes, {name: F.col("y") if value is None else value})


def _stepped(step: Callable[[DataFrame], DataFrame], nodes: DataFrame, k: int, seen: list[Observation] | None = None) -> DataFrame:
    """The nodes after k steps, written; the largest change of y in each step goes to its observation ``r``."""
    for i in range(k):
        if seen is None:
            nodes = step(nodes)
            continue
        moved = step(nodes.withColumn("_before", F.col("y")))
        nodes = moved.observe(seen[i], F.max(F.abs(F.col("y") - F.col("_before"))).alias("r")).drop("_before")
    return checkpointed(nodes)


def picard(
    step: Callable[[DataFrame], DataFrame], start: DataFrame, tol: float = 1e-6, max_iter: int = 200, fixed: bool = False, block: int = 10, strict: bool = False
) -> Solved:
    """Iterate ``nodes(id, y, ...) -> step(nodes)`` until no y changes by ``tol`` or more, or ``max_iter`` steps are done.

    A step must carry columns that it doesn't know along. Steps are planned in blocks of ``block``
    and written at the end of each, so plans stay small and one job does several steps. The change in each step is observed as the block is
    made, so that only one earlier y goes with a step; the solution is that of the first step below the tolerance, to which
    a block that went on is made again. ``fixed`` makes exactly
    ``max_iter`` steps; its residual is 0 and it doesn't count as converged. ``strict`` raises
    ``NotConverged`` where the tolerance isn't met.
    """
    if max_iter < 1 or tol <= 0:
        raise ValueError("there must be a step and a positive tolerance")
    now, done, residual = start, 0, float("inf")
    while done < max_iter:
        k = min(block, max_iter - done)
        if fixed:
            now, done = _stepped(step, now, k), done + k
            continue
        seen = [Observation() for _ in range(k)]
        work = _stepped(step, now, k, seen)
        changes = [o.get["r"] for o in seen]
        found = next((i for i in range(k) if changes[i] is not None and changes[i] < tol), None)
        last = k - 1 if found is None else found
        residual, done = changes[last], done + last + 1
        if found is not None:  # the few steps of this block that count are made again where it went on
            return Solved(work if last == k - 1 else _stepped(step, now, last + 1), done, residual, True)
        now = work
    if fixed:
        return Solved(now, done, 0.0, False)
    if strict:
        raise NotConverged(residual, tol, max_iter)
    return Solved(now, done, residual, False)


def newton_column(z0: Column, residual: Callable[[Column], Column], derivative: Callable[[Column], Column], steps: int = 8) -> Column:
    """A Newton iteration of each row on its own, as one expression: no join, no state.

    A derivative that is 0 or not finite raises an error.
    """

    def one(z: Column, _: Column) -> Column:
        d = derivative(z)
        bad = (d == 0) | F.isnan(d) | (F.abs(d) == float("inf"))
        return F.when(bad, F.raise_error(F.lit("non-finite or zero derivative in Newton; see check_model")).cast("double")).otherwise(z - residual(z) / d)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), z0, one)


def newton_traced(z0: Column, residual: Callable[[Column], Column], derivative: Callable[[Column], Column], steps: int = 8, tol: float = 1e-10) -> Column:
    """``newton_column`` as a struct (z, change, iters): a row stops once its change is below ``tol``; change is its last, iters its steps."""
    start = F.struct(z0.cast("double").alias("z"), F.lit(float("inf")).alias("change"), F.lit(0).alias("iters"))

    def one(s: Column, _: Column) -> Column:
        d = derivative(s["z"])
        bad = (d == 0) | F.isnan(d) | (F.abs(d) == float("inf"))
        move = F.when(bad, F.raise_error(F.lit("non-finite or zero derivative in Newton; see check_model")).cast("double")).otherwise(residual(s["z"]) / d)
        moved = F.struct((s["z"] - move).alias("z"), F.abs(move).alias("change"), (s["iters"] + 1).alias("iters"))
        return F.when(s["change"] < tol, s).otherwise(moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, one)


def neumann(jacobian: DataFrame, cotangent: DataFrame, tol: float = 1e-10, max_iter: int = 200, fixed: bool = False, block: int = 10) -> Solved:
    """The adjoint ``u = c + J' u`` of a fixed point, for jacobian(i, j, v) and cotangent(id, c); ``u`` is column y."""
    weights = jacobian.select(F.col("j").alias("src"), F.col("i").alias("dst"), F.col("v").alias("w"))

    weights = checkpointed(with_self(weights, cotangent))

    def step(df: DataFrame) -> DataFrame:
        return aggregated(weights, df, {"s": F.col("w") * F.col("y")}).withColumn("y", F.col("c") + F.col("s")).drop("s")

    return picard(step, cotangent.select("id", "c", F.col("c").alias("y")), tol, max_iter, fixed, block)

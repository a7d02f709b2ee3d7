"""The test function on whole graphs: message passing over ego objects as joins, and its gradients as one job.

``estimator.RootedGin`` holds the parameters and does the same on arrays of one worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from netloom.operators.components import checkpointed, rekeyed
from netloom.operators.graph import balls


@dataclass(frozen=True)
class Weights:
    """Effective parameters by name, spectral scaling included: layer k has k.a.w, k.a.b, k.c.w, k.c.b, k.eps, k.g, k.o; the head h.a.* and h.c.*."""

    p: dict[str, np.ndarray]
    layers: int
    clip: float | None

    @classmethod
    def of(cls, gin) -> "Weights":
        """Those of a ``RootedGin``."""
        return cls({k: gin._weight(k, False)[0] if k.endswith(".w") else v for k, v in gin.p.items()}, gin.layers, gin.clip)

    def eps(self, k: int) -> float:
        return float(self.p[f"{k}.eps"][0])


def _zero() -> Column:
    return F.lit(0.0)


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once a row, though ``of`` uses it in a lambda, into which the optimiser would copy its expression."""
    return F.transform(F.array(value), of)[0]


def dense(h: Column, w: np.ndarray, b: np.ndarray) -> Column:
    """h w + b for an array column."""
    columns = F.array(*(F.struct(F.lit([float(v) for v in w[:, j]]).alias("w"), F.lit(float(b[j])).alias("b")) for j in range(w.shape[1])))
    return bound(h, lambda x: F.transform(columns, lambda c: F.aggregate(F.zip_with(x, c["w"], lambda p, q: p * q), c["b"], lambda s, v: s + v)))


def relu(h: Column) -> Column:
    return F.transform(h, lambda v: F.greatest(v, F.lit(0.0)))


def _mean(h: Column) -> Column:
    return F.aggregate(h, _zero(), lambda s, v: s + v) / F.size(h)


def layer(df: DataFrame, weights: Weights, k: int) -> DataFrame:
    """``h`` from the messages ``z``: two dense layers, layer norm, the positive part. Each step is a column of its own, so none is computed twice."""
    p = weights.p
    out = df.withColumn("_a", relu(dense(F.col("z"), p[f"{k}.a.w"], p[f"{k}.a.b"])))
    out = out.withColumn("_c", dense(F.col("_a"), p[f"{k}.c.w"], p[f"{k}.c.b"])).withColumn("_m", _mean(F.col("_c")))
    out = out.withColumn("_s", F.sqrt(_mean(F.transform("_c", lambda v: (v - F.col("_m")) * (v - F.col("_m")))) + 1e-5))
    scale, shift = (F.lit([float(v) for v in p[f"{k}.{n}"]]) for n in "go")
    normed = F.transform("_c", lambda v: (v - F.col("_m")) / F.col("_s"))
    return out.withColumn("h", relu(F.zip_with(F.zip_with(normed, scale, lambda v, g: v * g), shift, lambda v, o: v + o))).drop("_a", "_c", "_m", "_s")


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def layer_batches(df: DataFrame, weights: Weights, k: int) -> DataFrame:
    """``layer`` of (root, node, dist, z) in Arrow batches: array expressions cost some ten times as much a row."""
    p = weights.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = np.maximum(_matrix(b.column("z")) @ p[f"{k}.a.w"] + p[f"{k}.a.b"], 0) @ p[f"{k}.c.w"] + p[f"{k}.c.b"]
                n = (c - c.mean(1, keepdims=True)) / np.sqrt(c.var(1, keepdims=True) + 1e-5)
                yield pa.RecordBatch.from_arrays([*b.columns, _lists(np.maximum(n * p[f"{k}.g"] + p[f"{k}.o"], 0))], [*b.schema.names, "h"])

    return df.select("root", "node", "dist", "z").mapInArrow(run, "root long, node long, dist int, z array<double>, h array<double>")


def head(df: DataFrame, weights: Weights) -> DataFrame:
    """``logit`` from ``h``, within the clip where there is one."""
    p = weights.p
    raw = df.withColumn("_r", relu(dense(F.col("h"), p["h.a.w"], p["h.a.b"]))).withColumn("_raw", dense(F.col("_r"), p["h.c.w"], p["h.c.b"])[0])
    c = weights.clip
    return raw.withColumn("logit", F.col("_raw") if c is None else c * F.tanh(F.col("_raw") / c)).drop("_r", "_raw")


def _summed(df: DataFrame, keys: list[str], width: int, *more: Column) -> DataFrame:
    """The sums of the array column ``m`` by some keys, element by element: partial sums before any shuffle."""
    sums = df.groupBy(*keys).agg(*(F.sum(F.col("m")[i]).alias(f"_{i}") for i in range(width)), *more)
    return sums.withColumn("m", F.array(*(f"_{i}" for i in range(width)))).drop(*(f"_{i}" for i in range(width)))


def _scaled(h: Column, by: float | Column) -> Column:
    return F.transform(h, lambda v: v * by)


def _messages(state: DataFrame, near: DataFrame, bound: int, width: int, own: float) -> DataFrame:
    """``(root, node, dist, z)``: ``own`` times a node's h and its neighbours' h within the ego, for nodes up to a distance."""
    if bound == 0:  # the root alone: its messages are the rows one step away
        m = F.when(F.col("dist") == 0, _scaled(F.col("h"), own)).otherwise(F.col("h"))
        rows = state.where("dist <= 1").select("root", m.alias("m"))
        return _summed(rows, ["root"], width).select("root", F.col("root").alias("node"), F.lit(0).alias("dist"), F.col("m").alias("z"))
    targets = state.where(F.col("dist") <= bound).select("root", "node", "dist")
    pairs = targets.join(rekeyed(near, "src"), targets["node"] == F.col("src")).select("root", "node", "dist", F.col("dst").alias("from"), F.lit(1.0).alias("by"))
    pairs = pairs.union(targets.select("root", "node", "dist", F.col("node"), F.lit(own)))
    joined = pairs.join(state.select(F.col("root").alias("_root"), F.col("node").alias("_node"), "h"), (F.col("root") == F.col("_root")) & (F.col("from") == F.col("_node")))
    rows = joined.select("root", "node", "dist", F.transform("h", lambda v: v * F.col("by")).alias("m"))
    return _summed(rows, ["root", "node", "dist"], width).withColumnRenamed("m", "z")


def passed(weights: Weights, edges: DataFrame, nodes: DataFrame, k: int, roots: DataFrame | None = None, keep: bool = False) -> list[DataFrame]:
    """``(root, node, dist, z, h)`` after each layer, for the nodes of each ego that can still reach its root.

    ``edges(src, dst)`` has both directions; ``nodes(id, f)`` has the features as an array of
    doubles, to which the root's marker is added. Layer l of L needs nodes up to L - l steps from the
    root. With L <= k all their neighbours lie in the ego of radius k, so the first layer's messages are
    the same for every root but for the marker, and are summed once a node; beyond, messages
    are kept to the ego by a join with its members. ``keep`` writes every layer but the last down, for those who
    read them again, and works them out in Arrow batches.
    """
    layers = weights.layers
    near = edges.select("src", "dst").where("src <> dst").distinct()
    features = nodes.select("id", "f")
    width = len(weights.p["0.a.w"])
    reach = min(k, layers - 1)
    own = 1 + weights.eps(0)
    if reach < k:
        found = balls(near, reach, roots)
        one = near.join(rekeyed(features.withColumnRenamed("id", "dst"), "dst"), "dst").select(F.col("src").alias("id"), F.col("f").alias("m"))
        both = _summed(one.union(features.select("id", _scaled(F.col("f"), own))), ["id"], width - 1)
        mark = F.when(F.col("dist") == 0, own).when(F.col("dist") == 1, 1.0).otherwise(0.0)
        z = found.join(both, found["node"] == both["id"]).select("root", "node", "dist", F.concat("m", F.array(mark)).alias("z"))
    else:
        found = balls(near, k, roots)
        mark = F.when(F.col("dist") == 0, 1.0).otherwise(0.0)
        start = found.join(features, found["node"] == features["id"]).select("root", "node", "dist", F.concat("f", F.array(mark)).alias("h"))
        z = _messages(checkpointed(start), near, k, width, own)
    layered = layer_batches if keep else layer
    out = [layered(z, weights, 0)]
    for at in range(1, layers):
        state = checkpointed(out[-1]) if keep or min(k, layers - 1 - at) else out[-1]
        out[-1] = state
        wide = len(weights.p[f"{at}.a.w"])
        out.append(layered(_messages(state, near, min(k, layers - 1 - at), wide, 1 + weights.eps(at)), weights, at))
    return out


def scores(weights: Weights, edges: DataFrame, nodes: DataFrame, k: int, roots: DataFrame | None = None) -> DataFrame:
    """``(root, logit)`` for every node of the graph, or for ``roots(root)``: the test function on the ego of radius k around each; see ``passed``."""
    return head(passed(weights, edges, nodes, k, roots)[-1], weights).select("root", "logit")


def _names(weights: Weights, at: int) -> list[str]:
    return [n for n in weights.p if n.startswith(f"{at}.") or at == weights.layers - 1 and n.startswith("h.")]


def _pulled_back(weights: Weights, at: int, slope: Callable[[np.ndarray], np.ndarray] | None, value: Callable[[np.ndarray], np.ndarray] | None = None):
    """A mapInArrow function over (root, node, z, own, dh): ``dz`` a row, and at a task's end one row with the summed gradients of the layer's parameters.

    With a ``slope`` the head comes first, and the sums end with that of ``value``.
    """
    p, names = weights.p, _names(weights, at)

    def batch_of(z, own, dh):
        a = z @ p[f"{at}.a.w"] + p[f"{at}.a.b"]
        r = np.maximum(a, 0)
        c = r @ p[f"{at}.c.w"] + p[f"{at}.c.b"]
        sd = np.sqrt(c.var(1, keepdims=True) + 1e-5)
        n = (c - c.mean(1, keepdims=True)) / sd
        o = n * p[f"{at}.g"] + p[f"{at}.o"]
        g = {}
        if slope is not None:  # the last layer: the head first
            h = np.maximum(o, 0)
            ha = h @ p["h.a.w"] + p["h.a.b"]
            hr = np.maximum(ha, 0)
            raw = (hr @ p["h.c.w"] + p["h.c.b"])[:, 0]
            flat = raw if weights.clip is None else weights.clip * np.tanh(raw / weights.clip)
            d = slope(flat) * (1 if weights.clip is None else 1 - (flat / weights.clip) ** 2)
            g["h.c.w"], g["h.c.b"] = hr.T @ d[:, None], np.array([d.sum()])
            da = (d[:, None] * p["h.c.w"].T) * (ha > 0)
            g["h.a.w"], g["h.a.b"] = h.T @ da, da.sum(0)
            dh = da @ p["h.a.w"].T
        do = dh * (o > 0)
        g[f"{at}.g"], g[f"{at}.o"] = (do * n).sum(0), do.sum(0)
        dn = do * p[f"{at}.g"]
        dc = (dn - dn.mean(1, keepdims=True) - n * (dn * n).mean(1, keepdims=True)) / sd
        g[f"{at}.c.w"], g[f"{at}.c.b"] = r.T @ dc, dc.sum(0)
        da = (dc @ p[f"{at}.c.w"].T) * (a > 0)
        g[f"{at}.a.w"], g[f"{at}.a.b"] = z.T @ da, da.sum(0)
        dz = da @ p[f"{at}.a.w"].T
        g[f"{at}.eps"] = np.array([(dz * own).sum()])
        sums = [g[k].ravel() for k in names]
        return dz, np.concatenate(sums if slope is None else [*sums, [value(flat).sum() if value else 0.0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(sum(p[k].size for k in names) + (slope is not None))
        kinds = pa.schema([("root", pa.int64()), ("node", pa.int64()), ("dz", pa.list_(pa.float64())), ("part", pa.list_(pa.float64()))])
        for b in batches:
            if not b.num_rows:
                continue
            dz, part = batch_of(_matrix(b.column("z")), _matrix(b.column("own")), None if slope is not None else _matrix(b.column("dh")))
            total += part
            yield pa.RecordBatch.from_arrays([b.column("root"), b.column("node"), _lists(dz), pa.nulls(len(dz), pa.list_(pa.float64()))], schema=kinds)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.float64())), pa.array([total.tolist()], pa.list_(pa.float64()))], schema=kinds)

    return run


def _backward(
    weights: Weights, edges: DataFrame, nodes: DataFrame, k: int, slope: Callable[[np.ndarray], np.ndarray], roots: DataFrame | None, value: Callable[[np.ndarray], np.ndarray] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells(param, cell, value), messages(root, node, dz) of the first layer with their gradients, neighbours)."""
    near = edges.select("src", "dst").where("src <> dst").distinct()
    tables = passed(weights, edges, nodes, k, roots, keep=True)
    parts, after = [], None
    for at in reversed(range(weights.layers)):
        mine = tables[at].select("root", "node", "dist", "z")
        eps = weights.eps(at)
        if at:
            own = tables[at - 1].select(F.col("root").alias("_root"), F.col("node").alias("_node"), F.col("h").alias("own"))
        else:
            mark = F.when(F.col("root") == F.col("node"), 1.0).otherwise(0.0)
            base = nodes.select("id", "f")
            own = mine.join(base, mine["node"] == base["id"]).select(F.col("root").alias("_root"), F.col("node").alias("_node"), F.concat("f", F.array(mark)).alias("own"))
        rows = mine.join(own, (F.col("root") == F.col("_root")) & (F.col("node") == F.col("_node"))).drop("_root", "_node")
        top = after is None
        if top:
            rows = rows.select("root", "node", "z", "own", F.col("own").alias("dh"))  # the head's gradient takes its place
        else:
            rows = rows.join(after, ["root", "node"]).select("root", "node", "z", "own", "dh")
        done = checkpointed(rows.mapInArrow(_pulled_back(weights, at, slope if top else None, value), "root long, node long, dz array<double>, part array<double>"))
        sizes = [(n, i) for n in _names(weights, at) for i in range(weights.p[n].size)] + [("value", 0)] * top
        cells = done.where("part is not null").select(F.posexplode("part").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
        names = F.array(*(F.struct(F.lit(n).alias("param"), F.lit(i).alias("cell")) for n, i in sizes))
        parts.append(cells.select(names[F.col("at")].alias("c"), "value").select("c.param", "c.cell", "value"))
        back = done.where("part is null").select("root", "node", "dz")
        if at:
            wide = len(weights.p[f"{at}.a.w"])
            to = back.join(rekeyed(near, "src"), back["node"] == F.col("src")).select("root", F.col("dst").alias("node"), F.col("dz").alias("m"))
            after = _summed(to.union(back.select("root", "node", _scaled(F.col("dz"), 1 + eps))), ["root", "node"], wide).withColumnRenamed("m", "dh")
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out, back, near


def gradients(weights: Weights, edges: DataFrame, nodes: DataFrame, k: int, slope: Callable[[np.ndarray], np.ndarray], roots: DataFrame | None = None) -> DataFrame:
    """``(param, cell, value)``: the gradient of a sum over roots of a function of each logit, for all roots in one pass.

    ``slope`` gives the function's derivative for an array of logits. Each layer's rows give their
    share in Arrow batches; a task sums what its rows give and returns one row, and those few are
    summed by parameter and cell. What a layer's messages get back goes along the transposed joins. Gradients are with
    respect to the effective weights, a cell is the place in the parameter's array, row by row.
    """
    return _backward(weights, edges, nodes, k, slope, roots)[0].where("param <> 'value'")


def pulled(
    weights: Weights, edges: DataFrame, nodes: DataFrame, k: int, value: Callable[[np.ndarray], np.ndarray], slope: Callable[[np.ndarray], np.ndarray], roots: DataFrame | None = None
) -> tuple[float, dict[str, np.ndarray], DataFrame]:
    """(sum of ``value`` over the roots' logits, its gradient by each parameter, ``(id, g)`` its gradient by the nodes' features).

    The first two are as small as the test function; the third is a table, an array of as many numbers as ``f`` has a node that any ego reaches.
    """
    cells, back, near = _backward(weights, edges, nodes, k, slope, roots, value)
    arrays = {n: np.zeros(v.size) for n, v in weights.p.items()} | {"value": np.zeros(1)}
    for r in cells.collect():  # a row per number of the test function
        arrays[r["param"]][r["cell"]] = r["value"]
    total = float(arrays.pop("value")[0])
    width, own = len(weights.p["0.a.w"]) - 1, 1 + weights.eps(0)  # without the mark
    if min(k, weights.layers - 1) < k:  # all neighbours of a message's node are in its ego: roots are summed first
        at = checkpointed(_summed(back.select(F.col("node").alias("id"), F.col("dz").alias("m")), ["id"], width))
        to = near.join(rekeyed(at, "id"), F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "m")
        both = to.union(at.select("id", _scaled(F.col("m"), own)))
    else:
        members = back.select(F.col("root").alias("_root"), F.col("node").alias("_node"))
        to = back.join(rekeyed(near, "src"), back["node"] == F.col("src")).select("root", F.col("dst").alias("to"), F.col("dz").alias("m"))
        to = to.join(members, (F.col("root") == F.col("_root")) & (F.col("to") == F.col("_node")), "left_semi")
        both = to.select(F.col("to").alias("id"), "m").union(back.select(F.col("node").alias("id"), _scaled(F.col("dz"), own)))
    return total, {n: v.reshape(weights.p[n].shape) for n, v in arrays.items()}, _summed(both, ["id"], width).withColumnRenamed("m", "g")

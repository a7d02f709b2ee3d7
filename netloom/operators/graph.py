"""Graph preparation: edges, interaction weights, components, balls and ego objects."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from netloom.operators.components import checkpointed, components, rekeyed


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once each."""
    return edges.select("src", "dst").union(reverse(edges)).distinct()


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge of a simple graph once, from the smaller to the larger end."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).where("src <> dst").distinct()


def node_ids(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``(id, degree)``: outgoing edges, with multiplicity; nodes without any get 0."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    nodes = node_ids(edges) if nodes is None else nodes.select("id")
    return nodes.join(out, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def validated(edges: DataFrame, n: int | None = None) -> DataFrame:
    """One row: n_edges, lowest, highest, nulls, loops, duplicates, dead_ends and ok.

    ``ok`` says that there are edges, none has a null or an end outside 0..n-1 (with ``n``
    given), and every node has an outgoing edge.
    """
    one = edges.agg(
        F.count("*").alias("n_edges"),
        F.least(F.min("src"), F.min("dst")).alias("lowest"),
        F.greatest(F.max("src"), F.max("dst")).alias("highest"),
        F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("nulls"),
        F.count_if(F.col("src") == F.col("dst")).alias("loops"),
    )
    times = edges.groupBy("src", "dst").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).cast("long").alias("duplicates"))
    dead = edges.select(F.col("dst").alias("src")).distinct().join(edges.select("src").distinct(), "src", "left_anti").agg(F.count("*").alias("dead_ends"))
    ok = (F.col("n_edges") > 0) & (F.col("nulls") == 0) & (F.col("dead_ends") == 0)
    if n is not None:
        ok = ok & (F.col("lowest") >= 0) & (F.col("highest") < n)
    return one.crossJoin(times).crossJoin(dead).withColumn("ok", F.coalesce(ok, F.lit(False)))  # three one-row tables


def invalid_values(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, invalid)``: how many values are null or not finite."""
    bad = [F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in columns]
    return nodes.agg(*bad).unpivot([], columns, "column", "invalid")


def row_stochastic(edges: DataFrame) -> DataFrame:
    """``(src, dst, w)``: one over the degree of src; an edge that occurs k times weighs k over the degree.

    Degrees are partial sums that are joined back, so a hub's edges are never one task's sort. Edges
    with a null end count and stay.
    """
    pairs = edges.groupBy("src", "dst").agg(F.count("*").alias("k"))
    total = edges.groupBy(F.col("src").alias("of")).agg(F.count("*").alias("total"))
    total = rekeyed(total, "of")
    return pairs.join(total, pairs["src"].eqNullSafe(total["of"])).select("src", "dst", (F.col("k") / F.col("total")).alias("w"))


def adjacency(edges: DataFrame) -> DataFrame:
    """``(id, neighbors)``: sorted distinct neighbours in either direction, without the node itself; all nodes."""
    near = drop_self_loops(symmetrize(edges)).groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbors"))
    return node_ids(edges).join(near, "id", "left").select("id", F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))


def normalized_lists(lists: DataFrame) -> DataFrame:
    """``(id, neighbors)`` with each list sorted, distinct and without the node itself."""
    return lists.select("id", F.array_sort(F.array_distinct(F.filter("neighbors", lambda x: x != F.col("id")))).alias("neighbors"))


@dataclass
class Sanitized:
    """A graph relabelled to 0..m-1, the map from old ids, and what was taken out."""

    edges: DataFrame
    ids: DataFrame
    report: DataFrame


def kept_component(edges: DataFrame) -> DataFrame:
    """``(id)`` of the largest component; of equal ones, that with the smallest member."""
    members = components(edges)
    top = members.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(1)
    return members.join(F.broadcast(top.select("component")), "component").select(F.col("node").alias("id"))


def relabeled(ids: DataFrame, ranges: int | None = None) -> DataFrame:
    """``(id, label)``: labels 0..m-1 by ascending id.

    Ids are dealt into ranges, which are written down, numbered within each, and moved on by the
    sizes of the ranges before; only one count per range reaches a single task.
    """
    spark = ids.sparkSession
    n = ranges or max(2, spark.sparkContext.defaultParallelism)
    dealt = checkpointed(ids.select("id").distinct().repartitionByRange(n, "id").withColumn("range", F.spark_partition_id()))
    local = dealt.withColumn("k", F.row_number().over(Window.partitionBy("range").orderBy("id")) - 1)
    sizes = dealt.groupBy("range").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(before.select("range", "before")), "range").select("id", (F.col("k") + F.col("before")).cast("long").alias("label"))


def sanitize(edges: DataFrame, nodes: DataFrame | None = None) -> Sanitized:
    """Without self-loops, in both directions, the largest component alone, relabelled 0..m-1 by id.

    The report has n, self_loops_removed and nodes_dropped; ``nodes(id)`` adds nodes without edges.
    """
    both = drop_self_loops(symmetrize(edges))
    every = node_ids(edges) if nodes is None else node_ids(edges).union(nodes.select("id")).distinct()
    kept = kept_component(both)
    ids = relabeled(kept)
    a, b = ids.select(F.col("id").alias("src"), F.col("label").alias("a")), ids.select(F.col("id").alias("dst"), F.col("label").alias("b"))
    out = both.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    loops = edges.agg(F.count_if(F.col("src") == F.col("dst")).alias("self_loops_removed"))
    total, size = every.agg(F.count("*").alias("all")), kept.agg(F.count("*").alias("n"))
    report = size.crossJoin(loops).crossJoin(total).select("n", "self_loops_removed", (F.col("all") - F.col("n")).alias("nodes_dropped"))  # one-row tables
    return Sanitized(out, ids, report)


def reindexed(values: DataFrame, ids: DataFrame) -> DataFrame:
    """Node attributes under the new labels; nodes that went are left out."""
    rest = [c for c in values.columns if c != "id"]
    return values.join(ids, "id").select(F.col("label").alias("id"), *rest)


#: Neighbours of a node that go in one row at most, about.
LIST = 1024


def neighbor_lists(edges: DataFrame) -> DataFrame:
    """``(at, to)``: each node's other neighbours as lists of some LIST entries at most, dealt by a hash, so that a hub is many rows.

    The lists are written down; entries take four bytes where all ids fit in them.
    """
    near = edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).where("at <> to").distinct()
    hubs = near.groupBy("at").agg(F.count("*").alias("_n")).where(F.col("_n") > LIST).select(F.col("at").alias("_hub"), F.ceil(F.col("_n") / LIST).cast("int").alias("_parts"))
    dealt = near.join(F.broadcast(hubs), F.col("at") == F.col("_hub"), "left")  # one row for every LIST edges at most
    part = F.pmod(F.xxhash64("to"), F.coalesce("_parts", F.lit(1)))
    lists = checkpointed(dealt.groupBy("at", part.alias("part")).agg(F.collect_list("to").alias("to")).select("at", "to"))
    low, high = lists.agg(F.min(F.array_min("to")), F.max(F.array_max("to"))).first()
    fits = low is None or -(2**31) <= low and high < 2**31
    return lists.withColumn("to", F.col("to").cast("array<int>" if fits else "array<bigint>"))


def balls(edges: DataFrame, radius: int, roots: DataFrame | None = None) -> DataFrame:
    """``(root, node, dist)``: all nodes within ``radius`` steps of each root, at their least distance.

    Each step joins the last ring alone with the edges, so the work is that of the output. Most of the rows come
    from the last step, so lists of neighbours are dealt to the roots instead of a row for each; a root's rings are
    arrays of one row until the end. Without ``roots(root)`` every node is one.
    """
    roots = node_ids(edges).withColumnRenamed("id", "root") if roots is None else roots.select("root").distinct()
    if radius < 1:
        return roots.select("root", F.col("root").cast("bigint").alias("node"), F.lit(0).alias("dist"))
    lists = neighbor_lists(edges)
    kind = lists.schema["to"].dataType
    rings = [f"_{d}" for d in range(1, radius + 1)]
    state = roots
    for d, ring in enumerate(rings):
        ends = state.select("root", (F.explode(rings[d - 1]) if d else F.col("root")).alias("_end"))
        met = ends.join(lists, F.col("_end").cast("bigint") == F.col("at")).select("root", "to")
        got = met.repartition("root").groupBy("root").agg(F.flatten(F.collect_list("to")).alias("_met"))
        new = F.array_except(F.filter("_met", lambda v: v != F.col("root")), F.concat(*rings[:d]) if d else F.array().cast(kind))
        state = state.join(got, "root", "left").select("root", *rings[:d], F.coalesce(new, F.array().cast(kind)).alias(ring))
    own = F.array(F.col("root").try_cast(kind.elementType))  # null where a root without neighbours doesn't fit
    parted = state.select("root", F.posexplode(F.array(own, *rings)).alias("dist", "_ring"))
    return parted.select("root", F.explode("_ring").alias("node"), "dist").select("root", F.coalesce(F.col("node").cast("bigint"), "root").alias("node"), "dist")


def ball_sizes(found: DataFrame, radius: int) -> DataFrame:
    """``(root, d0, d1, ...)``: the size of each ball up to a radius."""
    return found.groupBy("root").agg(*(F.count_if(F.col("dist") <= d).alias(f"d{d}") for d in range(radius + 1)))


def sketched_ball_sizes(edges: DataFrame, radius: int, roots: DataFrame | None = None, precision: int = 12) -> DataFrame:
    """``(root, d0, d1, ...)``: estimated sizes of the balls up to a radius, without the balls.

    Each node has a HyperLogLog sketch of what it reaches, of 2^``precision`` registers at most; a step
    merges the sketches of its neighbours into it. So a radius costs as many passes over ``edges(src, dst)``
    as it has steps, where the exact ``balls`` write every member. The relative standard error is 1.04 / sqrt(2^precision),
    1.6 % by default; sets of a few members, kept one by one, are counted exactly. Without ``roots(root)`` every node is one.
    """
    ids = node_ids(edges)
    near = checkpointed(edges.select("src", "dst").where("src <> dst").union(ids.select(F.col("id").alias("src"), F.col("id").alias("dst"))).distinct())
    state = ids.groupBy("id").agg(F.hll_sketch_agg("id", precision).alias("sketch"), F.lit(1).cast("long").alias("d0"))
    for d in range(1, radius + 1):
        known = [f"d{k}" for k in range(d)]
        met = near.join(rekeyed(state.withColumnRenamed("id", "dst"), "dst"), "dst")
        own = [F.max(F.when(F.col("src") == F.col("dst"), F.col(c))).alias(c) for c in known]
        state = met.groupBy(F.col("src").alias("id")).agg(F.hll_union_agg("sketch").alias("sketch"), *own).withColumn(f"d{d}", F.hll_sketch_estimate("sketch"))
    out = state.drop("sketch").withColumnRenamed("id", "root")
    return out if roots is None else out.join(roots.select("root").distinct(), "root", "left_semi")


def ego_nodes(found: DataFrame) -> DataFrame:
    """``(root, node, pos)``: the members of a ball by ascending id."""
    return found.select("root", "node", (F.row_number().over(Window.partitionBy("root").orderBy("node")) - 1).cast("int").alias("pos"))


def ego_edges(egos: DataFrame, edges: DataFrame) -> DataFrame:
    """``(root, src_pos, dst_pos)``: the edges with both ends in a ball, by position."""
    a = egos.select("root", F.col("node").alias("src"), F.col("pos").alias("src_pos"))
    b = egos.select("root", F.col("node").alias("dst"), F.col("pos").alias("dst_pos"))
    return a.join(edges, "src").join(b, ["root", "dst"]).select("root", "src_pos", "dst_pos")


def norm_stats(nodes: DataFrame) -> DataFrame:
    """One row mu_x, sigma_x, mu_y, sigma_y over nodes(x, y): means and population deviations."""
    return nodes.agg(F.avg("x").alias("mu_x"), F.stddev_pop("x").alias("sigma_x"), F.avg("y").alias("mu_y"), F.stddev_pop("y").alias("sigma_y"))


def usable_stats(stats: DataFrame) -> DataFrame:
    """The statistics, or an error where x or y hardly varies."""
    ok = (F.col("sigma_x") > 1e-12) & (F.col("sigma_y") > 1e-10)
    return stats.withColumn("sigma_x", F.when(ok, F.col("sigma_x")).otherwise(F.raise_error(F.lit("x or y is constant: nothing to standardise"))))


def vector_stats(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, mu, sigma)`` for each covariate."""
    long = nodes.unpivot([], columns, "column", "v")
    return long.groupBy("column").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sigma"))


def standardized(nodes: DataFrame, stats: DataFrame) -> DataFrame:
    """``(id, xt, yt)``: standardised x and y of nodes(id, x, y)."""
    return nodes.crossJoin(F.broadcast(stats)).select("id", ((F.col("x") - F.col("mu_x")) / F.col("sigma_x")).alias("xt"), ((F.col("y") - F.col("mu_y")) / F.col("sigma_y")).alias("yt"))  # one row of statistics


def ego_batch(roots: DataFrame, egos: DataFrame, nodes: DataFrame, stats: DataFrame, noise=None) -> DataFrame:
    """``(slot, root, pos, node, xt, yt, is_root)``: a batch of ego objects for roots(slot, root).

    A root drawn twice is two objects. ``noise`` is a Column over (slot, node) in units of the
    outcome's deviation that blurs y alone, before it is standardised.
    """
    rows = roots.join(egos, "root").join(nodes.select(F.col("id").alias("node"), "x", "y"), "node").crossJoin(F.broadcast(stats))  # one row of statistics
    y = F.col("y") if noise is None else F.col("y") + noise * F.col("sigma_y")
    return rows.select(
        "slot", "root", "pos", "node",
        ((F.col("x") - F.col("mu_x")) / F.col("sigma_x")).alias("xt"),
        ((y - F.col("mu_y")) / F.col("sigma_y")).alias("yt"),
        (F.col("root") == F.col("node")).cast("double").alias("is_root"),
    )


def batch_pointers(batch: DataFrame) -> DataFrame:
    """``(slot, ptr, root_row)``: where each object of a batch begins, and the row of its root. A batch is small: its sizes are one task's work."""
    sizes = batch.groupBy("slot").agg(F.count("*").alias("size"), F.max(F.when(F.col("is_root") == 1, F.col("pos"))).alias("root_pos"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return sizes.select("slot", before.alias("ptr"), (before + F.col("root_pos")).alias("root_row"))


def ego_overlaps(found: DataFrame) -> DataFrame:
    """``(a, b, shared)``: pairs of balls that share nodes.

    The rows are the result itself: a node in k balls gives k (k - 1) / 2 of them, so this is for the
    balls of roots drawn apart. ``sampling.violations`` tells roots that are too close without such pairs.
    """
    a, b = found.select(F.col("root").alias("a"), "node"), found.select(F.col("root").alias("b"), "node")
    return a.join(b, "node").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def branching(edges: DataFrame, roots: DataFrame, depth: int = 3, precision: int | None = None) -> DataFrame:
    """One row ``branching``: the geometric mean growth of balls per step from radius 1 on.

    Balls that don't grow tell nothing; if none does, it is the mean degree, 1 at least. With a ``precision`` the
    sizes are estimated (see ``sketched_ball_sizes``), for graphs whose balls of that depth are too many to write.
    """
    sizes = ball_sizes(balls(edges, depth, roots), depth) if precision is None else sketched_ball_sizes(edges, depth, roots, precision)
    grown = sizes.select(F.explode(F.array(*(F.array(f"d{d}", f"d{d + 1}") for d in range(1, depth)))).alias("s")).where("s[1] > s[0]")
    rate = grown.agg(F.exp(F.avg(F.log(F.col("s")[1] / F.col("s")[0]))).alias("rate"))
    mean = degrees(edges).agg(F.greatest(F.avg("degree"), F.lit(1.0)).alias("mean"))
    return rate.crossJoin(mean).select(F.coalesce("rate", "mean").alias("branching"))  # one-row tables

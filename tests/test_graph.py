import math
import random
import re
from collections import defaultdict, deque

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from netloom.operators import graph, sampling
from netloom.operators.components import components
from netloom.operators.datasets import NetworkData, Substrate
from netloom.sources import graphs as gen


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def bfs(adj, root, radius):
    dist, todo = {root: 0}, deque([root])
    while todo:
        v = todo.popleft()
        if dist[v] == radius:
            continue
        for u in adj[v]:
            if u not in dist:
                dist[u] = dist[v] + 1
                todo.append(u)
    return dist


def test_components_against_union_find(spark):
    for seed in range(4):
        rng = random.Random(seed)
        n = 120
        rows = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.choice([20, 60, 110]))] + [(200, 200), (None, 3)]
        root = {}

        def find(v, root=root):
            root.setdefault(v, v)
            while root[v] != v:
                v = root[v]
            return v

        for a, b in rows:
            if a is not None:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        assert pairs(components(edges_of(spark, rows))) == sorted((v, find(v)) for v in root)


def test_long_path_and_hub(spark):
    assert {r.component for r in components(gen.path(spark, 300)).collect()} == {0}
    assert {r.component for r in components(gen.star(spark, 500)).collect()} == {0}
    assert components(edges_of(spark, [])).count() == 0


def test_messy_graph(spark):
    rows = [(k, k + 1) for k in range(5)] + [(2, 2)]
    ids = spark.createDataFrame([(k, float(k), 10.0 * k) for k in [*range(6), 99]], "id long, x double, y double")
    clean = graph.sanitize(edges_of(spark, rows), ids)
    assert clean.report.first().asDict() == {"n": 6, "self_loops_removed": 1, "nodes_dropped": 1}
    assert pairs(graph.reindexed(ids, clean.ids)) == [(k, float(k), 10.0 * k) for k in range(6)]
    assert pairs(clean.edges) == sorted([(k, k + 1) for k in range(5)] + [(k + 1, k) for k in range(5)])


def test_component_ties_go_to_the_smallest_member(spark):
    assert pairs(graph.kept_component(graph.symmetrize(edges_of(spark, [(5, 6), (1, 9), (3, 4)])))) == [(1,), (9,)]


def test_row_stochastic_counts_multiplicity(spark):
    w = {(r.src, r.dst): r.w for r in graph.row_stochastic(edges_of(spark, [(0, 1), (0, 1), (0, 2), (1, 0)])).collect()}
    assert w == {(0, 1): pytest.approx(2 / 3), (0, 2): pytest.approx(1 / 3), (1, 0): 1.0}


def test_adjacency_and_lists(spark):
    assert pairs(graph.adjacency(edges_of(spark, [(0, 0), (0, 2), (1, 0), (7, 7)])).select("id", F.col("neighbors").cast("string"))) == [(0, "[1, 2]"), (1, "[0]"), (2, "[0]"), (7, "[]")]
    lists = spark.createDataFrame([(1, [3, 1, 3, 2]), (2, [])], "id long, neighbors array<long>")
    assert [r.neighbors for r in graph.normalized_lists(lists).orderBy("id").collect()] == [[2, 3], []]


def test_golden_balls(spark):
    found = defaultdict(set)
    for r in graph.balls(gen.path(spark, 10), 3).collect():
        for d in range(r.dist, 4):
            found[d, r.root].add(r.node)
    assert found[1, 0] == {0, 1} and found[2, 0] == {0, 1, 2} and found[2, 4] == {2, 3, 4, 5, 6} and found[3, 4] == set(range(1, 8)) and found[2, 9] == {7, 8, 9}


def test_balls_against_search(spark):
    rows = [(int(a), int(b)) for a, b in gen.barabasi_albert_pairs(60, 2, 3)]
    edges = graph.symmetrize(edges_of(spark, rows))
    adj = defaultdict(set)
    for a, b in rows:
        adj[a].add(b)
        adj[b].add(a)
    want = sorted((v, u, d) for v in range(60) for u, d in bfs(adj, v, 2).items())
    assert pairs(graph.balls(edges, 2)) == want
    egos = graph.ego_nodes(graph.balls(edges, 2))
    assert egos.where("pos < 0").count() == 0 and egos.groupBy("root").agg((F.max("pos") + 1 - F.count("*")).alias("d")).where("d <> 0").count() == 0


def greedy(adj, order, radius, target=None):
    taken, blocked = [], set()
    for v in order:
        if v not in blocked:
            taken.append(v)
            blocked |= set(bfs(adj, v, radius))
            if target and len(taken) == target:
                break
    return taken


@pytest.mark.parametrize("radius", [1, 2])
def test_packing_equals_the_greedy_pass(spark, radius):
    rows = [(int(a), int(b)) for a, b in gen.barabasi_albert_pairs(80, 2, 5)]
    edges = graph.symmetrize(edges_of(spark, rows))
    adj = defaultdict(set)
    for a, b in rows:
        adj[a].add(b)
        adj[b].add(a)
    order = [r.id for r in graph.node_ids(edges).orderBy(sampling.priority(4, F.col("id"))).collect()]
    found = graph.balls(edges, radius)
    got = sampling.packed(edges, radius, seed=4)
    assert sorted(r.root for r in got.collect()) == sorted(greedy(adj, order, radius))
    assert sorted(r.root for r in sampling.packed(edges, radius, 3, 4).collect()) == sorted(greedy(adj, order, radius, 3))
    assert sampling.violations(got, found, radius).count() == 0


def test_packing_a_star_of_a_million_leaves(spark):
    """Its balls of two steps would have 10^12 rows; one root is all it takes, the first of them."""
    n = 1_000_000
    leaves = spark.range(1, n + 1)
    edges = leaves.selectExpr("0L as src", "id as dst").union(leaves.selectExpr("id as src", "0L as dst"))
    got = sampling.packed(edges, 2, seed=3).collect()
    first = spark.range(n + 1).orderBy(sampling.priority(3, F.col("id"))).first().id
    assert [r.root for r in got] == [first]


def test_sampler_modes(spark):
    edges = gen.path(spark, 36)
    nodes = graph.node_ids(edges)
    got = sampling.RootSampler("disjoint_relax", relax=(4, 2), min_batch=8, restarts=2).sample(nodes, edges, 12)
    assert got.radius_used == 2 and got.achieved >= 8
    far = sampling.RootSampler("disjoint_relax", relax=(4,), min_batch=30, fallback="uniform").sample(nodes, edges, 30)
    assert far.fallback_reason.startswith("uniform_fallback_below_min_batch") and far.met_target and far.radius_used is None
    best = sampling.RootSampler("disjoint_relax", relax=(4,), min_batch=30, fallback="best").sample(nodes, edges, 30)
    assert best.achieved < 30 and not best.met_target
    with pytest.raises(RuntimeError):
        sampling.RootSampler("disjoint_relax", relax=(4,), min_batch=30, fallback="raise").sample(nodes, edges, 30)
    s = sampling.RootSampler("uniform", seed=1)
    a, b = (s.sample(nodes, None, 50).roots.collect() for _ in range(2))
    assert len(a) == 50 and a != b and all(0 <= r.root < 36 for r in a)
    for bad in ({"mode": "x"}, {"fallback": "x"}, {"restarts": 0}):
        with pytest.raises(ValueError):
            sampling.RootSampler(**bad)


def test_egos_as_table_functions(spark):
    """The same rows as the operators', for some roots too, and by SQL over a view."""
    from netloom.functions import tables

    edges = graph.symmetrize(edges_of(spark, [(int(a), int(b)) for a, b in gen.barabasi_albert_pairs(60, 2, 3)]))
    roots = spark.createDataFrame([(3,), (11,), (3,)], "root long")
    for some in (None, roots):
        want = graph.ego_nodes(graph.balls(edges, 2, some))
        nodes, found = tables.ego(edges, 2, some)
        assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, want.collect()))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, graph.ego_edges(want, edges).collect()))
    graph.balls(edges, 1).createOrReplaceTempView("members_of_egos")
    by_sql = spark.sql("select * from ego_nodes(TABLE(members_of_egos) PARTITION BY root ORDER BY node)")
    assert sorted(map(tuple, by_sql.collect())) == sorted(map(tuple, graph.ego_nodes(graph.balls(edges, 1)).collect()))
    spark.catalog.dropTempView("members_of_egos")


def test_sketched_ball_sizes_keep_their_error(spark):
    """Against the exact sizes: small balls exactly, all within four standard errors, the mean within one."""
    rows = [(int(a), int(b)) for a, b in gen.barabasi_albert_pairs(3000, 3, 5)]
    edges = graph.symmetrize(edges_of(spark, rows)).persist()
    exact = {r.root: tuple(r)[1:] for r in graph.ball_sizes(graph.balls(edges, 3), 3).collect()}
    for precision in (12, 9):
        error = 1.04 / 2 ** (precision / 2)
        got = {r.root: (r.d0, r.d1, r.d2, r.d3) for r in graph.sketched_ball_sizes(edges, 3, precision=precision).collect()}
        assert set(got) == set(exact)
        off = [abs(g / e - 1) for k in got for g, e in zip(got[k], exact[k])]
        assert max(off) < 5 * error and sum(off) / len(off) < error
        assert all(got[k][:1] == exact[k][:1] for k in got) and all(g == e for k in got for g, e in zip(got[k], exact[k]) if e <= 7)
    roots = spark.createDataFrame([(3,), (8,)], "root long")
    assert {r.root for r in graph.sketched_ball_sizes(edges, 2, roots).collect()} == {3, 8}
    a, b = (graph.branching(edges, graph.node_ids(edges).withColumnRenamed("id", "root"), 3, p).first().branching for p in (None, 12))
    assert abs(b / a - 1) < 0.02
    edges.unpersist()


def test_star_best_of_k_stops_early(spark):
    got, tries = sampling.best_packed(gen.star(spark, 5), 1, 5, 10)
    assert got.count() in (1, 5) and (tries < 10 or got.count() < 5)


def test_probe_has_the_hub(spark):
    got = [r.id for r in sampling.probe_nodes(graph.degrees(gen.star(spark, 50)), 10).collect()]
    assert 0 in got and len(got) == len(set(got)) == 10


def test_branching(spark):
    roots = spark.range(10).select(F.col("id").alias("root"))
    assert graph.branching(gen.complete(spark, 12), roots, 3).first()[0] == pytest.approx(11)
    ring = graph.branching(gen.ring_lattice(spark, 60), roots, 3).first()[0]
    assert ring == pytest.approx(math.exp((math.log(5 / 3) + math.log(7 / 5)) / 2))


def test_substrate_checks_and_overlap(spark):
    x = spark.range(10).withColumn("x", F.col("id").cast("double"))
    sub = Substrate.from_edges(gen.path(spark, 10), x)
    assert sub.n == 10
    with pytest.raises(ValueError):
        Substrate.from_edges(gen.path(spark, 12), x)
    with pytest.raises(ValueError):
        Substrate.from_edges(gen.path(spark, 10), x.withColumn("x", F.lit(1.0)))
    with pytest.raises(ValueError):
        NetworkData(sub, x.where("id < 9").withColumnRenamed("x", "y"))
    with pytest.raises(ValueError):
        NetworkData(sub, x.select("id", F.lit(float("nan")).alias("y")))
    with pytest.warns(UserWarning, match="2\\*k"):
        sub.warn_if_overlapping(3)
    grid = gen.grid(spark, 6, 6)
    far, near = (sampling.packed(grid, r) for r in (4, 1))
    share = lambda got: graph.ego_overlaps(graph.balls(grid, 2, got.select("root"))).count()
    assert share(far) == 0 < share(near)


@given(st.integers(30, 80), st.integers(0, 5))
@settings(max_examples=10, deadline=None)
def test_generated_graphs(n, seed):
    p = gen.barabasi_albert_pairs(n, 2, seed)
    assert len(p) == 2 * (n - 2) and p.max() == n - 1 and (p[:, 0] != p[:, 1]).all()


def test_preferential_attachment_by_tasks(spark):
    """Every edge's target follows the draws one by one; connected, the same for any partitioning, degrees of a power law near 3."""
    from netloom.functions.scalar import uniform_hash

    n, m, seed = 3000, 3, 4
    got = {tuple(r) for r in gen.barabasi_albert(spark, n, m, seed).collect()}
    draws = [r.u for r in spark.range(m * (n - m)).select("id", uniform_hash(seed, "ba", F.col("id")).alias("u")).orderBy("id").collect()]
    ends, want = [], set()
    for e, u in enumerate(draws):
        v = m + e // m
        before = 2 * m * (e // m)
        target = e if e < m else ends[math.floor(u * before)]
        ends += [v, target]
        want |= {(v, target), (target, v)}
    assert got == want and all(a != b for a, b in got)
    degree = np.bincount([a for a, _ in got], minlength=n)
    tail = degree[degree >= 8]
    assert len(degree) == n and degree.min() >= 1 and 2 * m * n * 0.95 < len(got) <= 2 * m * n
    assert 2.4 < 1 + len(tail) / np.log(tail / 7.5).sum() < 3.6
    assert {r.component for r in components(gen.barabasi_albert(spark, 200, 1, 1)).collect()} == {0}
    with pytest.raises(ValueError):
        gen.barabasi_albert(spark, 3, 3)


def degrees_of(pairs, n):
    return np.bincount([a for a, _ in pairs], minlength=n)


def test_lfr(spark):
    pairs = {tuple(r) for r in gen.lfr(spark, 400, 1, average_degree=6, max_degree=40).collect()}
    assert all(a != b and (b, a) in pairs and 0 <= a < 400 for a, b in pairs)
    degree = degrees_of(pairs, 400)
    assert 3.5 < degree.mean() < 8 and degree.max() <= 40
    again = gen.lfr(spark, 400, 1, average_degree=6, max_degree=40).repartition(7)
    assert {tuple(r) for r in again.collect()} == pairs != {tuple(r) for r in gen.lfr(spark, 400, 2, average_degree=6, max_degree=40).collect()}
    for bad in ({}, {"average_degree": 4, "min_degree": 2}, {"min_degree": 3, "min_community": 500}, {"min_degree": 3, "min_community": 30, "max_community": 20}):
        with pytest.raises(ValueError):
            gen.lfr(spark, 100, 1, **bad)


def test_lfr_has_the_degrees_asked_for(spark):
    """The maximum-likelihood exponent of the degrees of the tail, and their bound."""
    for tau in (2.3, 2.8):
        pairs = gen.lfr(spark, 6000, 3, tau1=tau, min_degree=8, max_degree=200, min_community=60, max_community=400).collect()
        degree = degrees_of(pairs, 6000)
        tail = degree[degree >= 12]
        exponent = 1 + len(tail) / np.log(tail / 11.5).sum()
        assert abs(exponent - tau) < 0.35, (tau, exponent)
        assert degree.max() <= 200


@pytest.mark.parametrize("mu", [0.2, 0.5])
def test_lfr_has_the_mixing_asked_for(spark, mu):
    """Over more than one block: the share of edges that leave a community, whose ids are consecutive, and the sizes of communities."""
    n = 17_000
    pairs = np.array(gen.lfr(spark, n, 3, mu=mu, min_degree=8, max_degree=60, min_community=70, max_community=80).collect())
    degree = degrees_of(pairs, n)
    assert degree.max() <= 60 and (degree >= 5).mean() > 0.98
    apart = np.abs(pairs[:, 0] - pairs[:, 1])
    assert abs((apart >= 150).mean() - mu) < 0.06  # a community and a rest that joins it have 149 members at most
    assert np.percentile(apart[apart < 150], 99) < 80 and len(np.unique(pairs)) > 0.99 * n


def test_scores_stay_within_their_band():
    """A clipped test function's scores lie in [eta, 1 - eta], whatever its features."""
    from netloom.operators import estimator as est

    draw = np.random.default_rng(0)
    for clip in (2.0, 5.0):
        d = est.RootedGin(3, 8, 2, clip, seed=1)
        for k in d.p:
            d.p[k] = d.p[k] * 50
        rows = np.arange(30)
        b = est.Batch(1e4 * draw.standard_normal((30, 3)), rows, np.roll(rows, 1), rows, rows)
        eta = est.expit(np.array(-clip))
        s = est.expit(d.forward(b)[0])
        assert (s >= eta - 1e-12).all() and (s <= 1 - eta + 1e-12).all()


def test_balls_deal_lists_of_neighbours(spark, monkeypatch):
    """The last step's rows are dealt as lists, four bytes an entry if ids fit; hubs are many rows; large ids, outside roots and loops give the same balls."""
    monkeypatch.setattr(graph, "LIST", 4)
    rows = [(0, k) for k in range(1, 30)] + [(k, k + 1) for k in range(1, 40)] + [(50, 50), (3, 3), (7, 8)]
    for shift, kind in ((0, "array<int>"), (2**40, "array<bigint>")):
        edges = spark.createDataFrame([(a + shift, b + shift) for a, b in rows], "src long, dst long")
        lists = graph.neighbor_lists(edges)
        assert dict(lists.dtypes)["to"] == kind and lists.where(F.size("to") > 4).count() < lists.where(F.col("at") == shift).count() > 4
        found = graph.balls(edges, 3)
        assert not re.search(r"hashpartitioning\(root#\d+L, node#", found._jdf.queryExecution().toString())  # no row of its own for each member
        out = {k: {b for a, b in rows if a == k and b != k} for k in {v for e in rows for v in e}}
        want = set()
        for r in out:
            ring, seen = {r}, {r: 0}
            for d in (1, 2, 3):
                ring = {v for u in ring for v in out[u]} - set(seen)
                seen |= dict.fromkeys(ring, d)
            want |= {(r + shift, v + shift, d) for v, d in seen.items()}
        got = [tuple(x) for x in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        outside = spark.createDataFrame([(2**50,), (50 + shift,), (None,)], "root long")
        assert {tuple(x) for x in graph.balls(edges, 2, outside).collect()} == {(2**50, 2**50, 0), (50 + shift, 50 + shift, 0), (None, None, 0)}
    assert graph.balls(spark.createDataFrame([], "src long, dst long"), 2).count() == 0

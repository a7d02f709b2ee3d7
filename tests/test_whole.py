"""Queries that take all nodes as roots and all steps of a run."""

import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from netloom.plans import estimation, registry
from tests.test_graph import bfs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def balls():
    """(quantity, radius) -> the balls of all nodes, by breadth-first search."""
    lines = duckdb.sql(f"select distinct l_orderkey, l_partkey, l_quantity from '{SF}/lineitem.parquet'").fetchall()

    def found(quantity, radius):
        orders, adj = defaultdict(set), defaultdict(set)
        for o, p, q in lines:
            if q >= quantity:
                orders[o].add(p)
        for parts in orders.values():
            for p in parts:
                adj[p] |= parts - {p}
        return {v: bfs(adj, v, radius) for v in [v for v in adj if adj[v]]}

    return found


def run(spark, name):
    return registry.queries()[name](spark, SF).collect()


def test_every_node_is_a_root(spark, balls):
    two, three, dense = balls(45, 2), balls(45, 3), balls(40, 3)
    want = {(r, v, float(r == v)) for r, b in two.items() for v in b}
    for name in ("ego_features", "ego_features_blurred"):
        got = run(spark, name)
        assert {(r.root, r.node, r.is_root) for r in got} == want and len(got) == len(want)
    pairs = {(a, b): len(two[a].keys() & two[b].keys()) for a in two for b in two if a < b}
    assert {(r.a, r.b): r.shared for r in run(spark, "ego_overlap_pairs")} == {k: n for k, n in pairs.items() if n}
    sizes = [[sum(d <= k for d in b.values()) for k in (1, 2, 3)] for b in three.values()]
    rates = [math.log(s[k + 1] / s[k]) for s in sizes for k in (0, 1) if s[k + 1] > s[k]]
    assert run(spark, "estimate_branching")[0][0] == pytest.approx(math.exp(np.mean(rates)), abs=1e-6)
    assert {(r.root, r.node, r.dist) for r in run(spark, "balls_k3")} == {(r, v, d) for r, b in dense.items() for v, d in b.items()}
    assert {r.root: r.d3 for r in run(spark, "ball_sizes")} == {r: len(b) for r, b in dense.items()}


def test_gin_forward_scores_every_node(spark, balls):
    """Every node of the whole graph, not of its largest component alone."""
    got = run(spark, "gin_forward")
    assert sorted(r.root for r in got) == sorted(balls(45, 2)) and len(got) > estimation.network(spark, SF).n


def test_runs_are_padded_to_the_longest(spark):
    lengths = dict(duckdb.sql(f"select user_id, count(*) from '{SF}/events.parquet' group by 1").fetchall())
    top = max(lengths.values())
    assert min(lengths.values()) < top
    got = defaultdict(dict)
    for r in run(spark, "history_pad"):
        got[r.realization][r.step] = r.beta
    for k, n in lengths.items():
        assert sorted(got[k]) == list(range(top)) and {got[k][s] for s in range(n - 1, top)} == {got[k][n - 1]}
    paths = {r.step: r for r in run(spark, "mc_quantile_paths")}
    assert sorted(paths) == list(range(top))
    for s in (0, 12, top - 1):
        want = np.quantile([b[s] for b in got.values()], [0.05, 0.25, 0.5, 0.75, 0.95])
        assert list(paths[s])[1:] == pytest.approx(want.tolist(), abs=2e-6)
    assert sorted(r.step for r in run(spark, "mc_quantile_loss_paths")) == list(range(top))

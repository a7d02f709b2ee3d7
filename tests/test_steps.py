"""Steps over lists of edges: what they write, and hubs in several rows."""

import pytest
from pyspark.sql import functions as F

from netloom.operators import equilibrium as eq


def test_edges_are_lists_and_a_hub_is_several_of_them(spark, monkeypatch):
    monkeypatch.setattr(eq, "LIST", 16)
    edges = spark.range(1, 101).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(0.5).alias("w"))
    nodes = spark.range(0, 101).select("id", F.col("id").cast("double").alias("y"))
    lists = eq.with_self(edges, nodes)
    assert lists.columns == ["dst", "near"]
    hub = lists.where("near is not null").select(F.size("near").alias("n")).collect()
    assert len(hub) > 3 and sum(r["n"] for r in hub) == 100
    got = {r["id"]: (r["y"], r["peer"]) for r in eq.aggregated(lists, nodes, {"peer": F.col("w") * (F.col("y") + 2)}).collect()}
    assert got == {k: (float(k), 1.0 if k else 0.0) for k in range(101)}


@pytest.mark.parametrize("most", [3, 7, 200])
def test_a_step_carries_no_more_than_one_earlier_value(spark, most):
    widths = []

    def step(df):
        widths.append(len(df.columns))
        return df.withColumn("y", 0.5 * F.col("y") + 1)

    got = eq.picard(step, spark.range(4).select("id", F.col("id").cast("double").alias("y")), 1e-3, most, block=5)
    assert max(widths) <= 3
    y, k, change = [0.0, 1.0, 2.0, 3.0], 0, 1.0
    while k < most and change >= 1e-3:
        new = [0.5 * v + 1 for v in y]
        y, k, change = new, k + 1, max(abs(a - b) for a, b in zip(new, y))
    assert (got.iters, got.residual, got.converged) == (k, change, change < 1e-3)
    assert [r["y"] for r in got.nodes.orderBy("id").collect()] == y

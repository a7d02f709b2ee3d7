"""Shared tables and hubs."""

import os
import subprocess
import sys
from pathlib import Path

from netloom.operators import components, graph

SCRIPT = """
from pyspark.sql import SparkSession
from netloom.operators import components
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{folder}").getOrCreate()
assert components.checkpointed(spark.range(10), slim=3).count() == 10
print(components.scratch(spark))
"""


def test_tables_go_when_the_application_ends(tmp_path):
    here = Path(components.__file__).parents[2]
    told = subprocess.run([sys.executable, "-c", SCRIPT.format(folder=tmp_path)], cwd=here, capture_output=True, text=True, timeout=120)
    folder = told.stdout.split()[-1]
    assert folder.startswith(str(tmp_path)) and not os.path.exists(folder), told.stderr


def test_files_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(components, "SLIM_ROWS", 10)
    few, many = (components.checkpointed(spark.range(0, 1000, 1, 64), slim=n) for n in (True, 400))
    assert len(few.inputFiles()) == 8 and len(many.inputFiles()) == 40


def test_a_hub_is_no_single_task(spark):
    leaves = 60_000
    edges = graph.symmetrize(spark.range(1, leaves + 1).selectExpr("id as src", "0L as dst"))
    plan = graph.row_stochastic(edges)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    weights = {tuple(r): n for *r, n in graph.row_stochastic(edges).groupBy("w").count().collect()}
    assert weights == {(1.0,): leaves, (1 / leaves,): leaves}
    odd = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (None, 4), (None, 4)], "src long, dst long")
    assert sorted(graph.row_stochastic(odd).collect(), key=str) == [(1, 2, 2 / 3), (1, 3, 1 / 3), (None, 4, 1.0)]

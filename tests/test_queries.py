import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from jobs import queries as jobs
from netloom.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries() | jobs.queries(), registry.oracle_sql() | jobs.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()
SLOW = {"check_model_lim", "check_model_effort", "pack_best_of_k", "pack_relax", "picard_lim", "fit_lim", "discriminator_scores", "mc_run", "make_linear_in_means", "make_effort_game", "sanitize_reindex_y", "relabel_nodes", "dropped_nodes", "packing_violations", "pack_result"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def told(rows):
    return sorted(tuple("nan" if isinstance(v, float) and math.isnan(v) else repr(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", [k for k in QUERIES if k in SQL and k not in SLOW])
def test_against_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF), con.sql(SQL[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    assert told(want.project(", ".join(f'"{c}"' for c in cols)).fetchall()) == told(got.select(cols).collect())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 100


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 100


def imported(folder, *options):
    """How many queries and SQL statements the entry of a folder has, in a process that finds nothing but that folder."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    told = subprocess.run([sys.executable, *options, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    return told.stdout.split(), told.stderr


@pytest.fixture
def without(tmp_path):
    """A copy of the repository without the text operators."""
    here = Path(__spark_entry__.__file__).parent
    shutil.copy(here / "__spark_entry__.py", tmp_path)
    shutil.copytree(here / "netloom", tmp_path / "netloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    if (here / "jobs").exists():
        shutil.copytree(here / "jobs", tmp_path / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    return tmp_path


@pytest.mark.parametrize("left", ["nothing", "pipeline", "caches"])
def test_entry_stands_without_the_text_operators(without, left):
    """Silent, whether or not the pipeline's file or a folder of caches was left behind."""
    if left == "pipeline":
        (without / "corpus_pipeline.py").write_text("from netloom.llm import pii\n")
    if left == "caches":
        (without / "netloom" / "llm" / "__pycache__").mkdir(parents=True)
    told, said = imported(without, "-W", "error")
    assert told == [str(len(QUERIES)), str(len(SQL))], said


def test_entry_says_why_the_text_operators_are_left_out(without):
    (without / "netloom" / "llm").mkdir()
    (without / "netloom" / "llm" / "__init__.py").touch()
    (without / "corpus_pipeline.py").write_text("import a_library_that_is_not_there\n")
    told, said = imported(without)
    assert told == [str(len(QUERIES)), str(len(SQL))] and "a_library_that_is_not_there" in said

import json
import logging
import math
import os

import numpy as np
import pytest

from netloom.operators import estimator as est
from netloom.operators import observers as ob
from netloom.sources import files
from tests.test_estimator import TRUE, network, outcome, recipe, start


def fit(*observers):
    net = network(60)
    with pytest.warns(est.NotStationary):
        return est.run_minimax(net, outcome(net), start(), est.RootedGin(3, 6, 2), recipe(max_steps=4), observers=observers)


def test_observers(spark, tmp_path):
    said, h = [], ob.History()
    path = f"{tmp_path}/steps/a.jsonl"
    both = ob.Composite([h, ob.Console(2, "x ", said.append), ob.Console(None), ob.JsonLines(path, 3)])
    assert isinstance(both, ob.Observer)
    got = fit(both)
    assert h.column("loss_d").shape == (4,) and np.isnan(h.column("nothing")).all() and [s.split(":")[0] for s in said[:2]] == ["x step 2", "x step 4"]
    assert h.frame(spark, 3).count() == 4 and math.isclose(h.column("beta")[-1], got.params_final["beta"])
    assert [json.loads(x)["event"] for x in open(path)] == ["run_start", *["step"] * 4, "run_end"]
    assert files.read_steps(spark, path).where("realization = 3").count() == 4
    with pytest.raises(ValueError):
        ob.Console(0)


def test_a_step_record_has_all_fields_everywhere(spark, tmp_path):
    """The 21 fields of every step through an observer's lines, Parquet, JSON and a stream."""
    from netloom.operators.contracts import STEP_FIELDS
    from netloom.streaming import monitor

    net = network(60)
    h, path = ob.History(), str(tmp_path / "lines")
    with pytest.warns(Warning):
        est.run_minimax(net, outcome(net), start(), est.RootedGin(3, 6, 2), recipe(max_steps=4, window=3), observers=(h, ob.JsonLines(path + "/a.json", 3)), sample=est.LocalSampler("disjoint_once", exclusion_r=2))
    assert len(STEP_FIELDS) == 21 and all(set(STEP_FIELDS) <= set(r) for r in h.records)
    same = lambda a, b: repr(a) == repr(b) or a == b  # noqa: E731  NaN too
    cols = [c for c in STEP_FIELDS]
    want = [tuple(r[c] for c in cols) for r in h.records]
    plain = lambda rows: [tuple(dict(v) if isinstance(v, dict) else v for v in (r[c] for c in cols)) for r in sorted(rows, key=lambda r: r.step)]
    lines = files.read_steps(spark, path, tuple(TRUE))
    got = plain(lines.collect())
    assert all(same(a, b) for x, y in zip(got, want) for a, b in zip(x, y)) and len(got) == 4
    assert [r.beta for r in lines.orderBy("step").collect()] == [r["beta"] for r in h.records]
    assert math.isnan(got[0][cols.index("loss_d_rolling")]) and got[3][cols.index("sampler_radius")] == 2 and got[0][cols.index("newton_iterations")] is None
    lines.write.parquet(str(tmp_path / "p"))
    again = spark.read.parquet(str(tmp_path / "p"))
    files.write_steps(again, str(tmp_path / "j"))
    assert repr(plain(again.collect())) == repr(got) == repr(plain(files.read_steps(spark, str(tmp_path / "j"), tuple(TRUE)).collect()))
    name = f"steps_{os.getpid()}"
    q = monitor.steps(spark, path, tuple(TRUE)).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert repr(plain(spark.table(name).collect())) == repr(got)
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "x.json").write_text('{"event": "step", "realization": 1, "step": 5, "loss_d": 1.5, "params": {"beta": 0.25}, "later": 1}\n')
    old = files.read_steps(spark, str(tmp_path / "old")).first()
    assert (old.step, old.loss_d, old.beta, old.gamma, old.tau_y) == (5, 1.5, 0.25, None, None)


def observed(net, seed):
    from netloom.operators.games import LinearInMeans

    return est.LocalGame(LinearInMeans(TRUE, beta_cap=0.85), net).solve(np.random.default_rng(seed).standard_normal(net.n), TRUE)[0]


def make(spec):
    return est.AdversarialEstimator(start(), est.RootedGin(3, 6, 2, seed=spec.index), recipe(max_steps=3))


def test_runner_resumes_and_keeps_configurations_apart(spark, tmp_path):
    net = network(60)
    r = ob.MonteCarloRunner(spark, str(tmp_path), {"a": 1}, TRUE)
    first = r.run(2, net, observed, make)
    assert first["completed"] == 2 and {s["param"] for s in first["summary"]} == set(TRUE)
    again = r.run(3, net, observed, make)
    assert again["completed"] == 1 and sorted(x.realization for x in r.done().collect()) == [0, 1, 2]
    assert r.run(3, net, observed, make)["completed"] == 0
    assert ob.MonteCarloRunner(spark, str(tmp_path), {"a": 2}, TRUE).done() is None


def test_a_killed_run_keeps_what_was_done(spark, tmp_path):
    """The process of a run of the second batch dies; the first batch stays, and a new runner makes the rest, nothing twice."""
    net = network(60)

    def deadly(net, seed):
        if seed == est.seed_streams(0, 4)["gt"]:
            os._exit(1)
        return observed(net, seed)

    r = ob.MonteCarloRunner(spark, str(tmp_path), {"a": 1}, TRUE, batch=3)
    with pytest.raises(Exception, match="(?i)python worker|abort|crash"):
        r.run(7, net, deadly, make)
    kept = sorted(x.realization for x in r.done().collect())
    assert kept == [0, 1, 2] and {x.realization for x in r.histories().select("realization").distinct().collect()} == {0, 1, 2}
    times = {x.realization: x.elapsed_seconds for x in r.done().collect()}
    told = ob.MonteCarloRunner(spark, str(tmp_path), {"a": 1}, TRUE, batch=3).run(7, net, observed, make)
    rows = r.done().collect()
    assert told["completed"] == 4 and sorted(x.realization for x in rows) == list(range(7))
    assert all(x.elapsed_seconds > 0 for x in rows) and all(times[x.realization] == x.elapsed_seconds for x in rows if x.realization < 3)
    assert r.histories().groupBy("realization").count().where("count <> 3").count() == 0


def test_a_run_that_raises_is_a_row(spark, tmp_path):
    net = network(60)

    def picky(spec):
        if spec.index == 1:
            raise FloatingPointError("a zero derivative")
        return make(spec)

    r = ob.MonteCarloRunner(spark, str(tmp_path), {"a": 1}, TRUE)
    told = r.run(3, net, observed, picky)
    rows = {x.realization: x for x in r.done().collect()}
    assert (told["completed"], told["failed"]) == (2, 1) and rows[1].status == "failed:FloatingPointError" and "zero derivative" in rows[1].warnings
    assert "used up its steps" in rows[0].warnings and rows[0].picard_cap_hits >= 0 and rows[1].final_step == 0
    assert {x.realization for x in r.histories().select("realization").distinct().collect()} == {0, 2}


def test_a_history_is_read_alone(spark, tmp_path):
    net = network(60)
    r = ob.MonteCarloRunner(spark, str(tmp_path), {"a": 1}, TRUE)
    r.run(3, net, observed, make)
    assert len(r.histories(1).inputFiles()) == 1 and "realization=1/" in r.histories(1).inputFiles()[0]
    assert [x.step for x in r.histories(1).orderBy("step").collect()] == [1, 2, 3] and r.histories(7) is None and "history" not in r.done().columns


def test_another_configuration_leaves_nothing_behind(spark, tmp_path):
    net = network(60)
    ob.MonteCarloRunner(spark, str(tmp_path), {"a": 1}, TRUE).run(2, net, observed, make)
    new = ob.MonteCarloRunner(spark, str(tmp_path), {"a": 2}, TRUE)
    with pytest.warns(RuntimeWarning, match="configuration has changed"):
        new.run(1, net, observed, make)
    left = {p.name for kind in ("rows", "histories") for p in (tmp_path / kind).iterdir() if p.is_dir()}
    assert left == {os.path.basename(new.path)} and new.run(1, net, observed, make)["completed"] == 0


def test_pictures_come_as_runs_are_done(spark, tmp_path, caplog):
    net, seen = network(60), []
    r = ob.MonteCarloRunner(spark, str(tmp_path), {"a": 1}, TRUE, visualize=lambda rows, steps: seen.append(rows.count()), plot_every=2, progress_every=3, batch=1)
    with caplog.at_level(logging.INFO, "netloom.operators.observers"):
        r.run(5, net, observed, make)
    assert seen == [2, 4, 5] and [x for x in caplog.text.splitlines() if "realisations are done" in x][0].endswith("3 of 5 realisations are done")

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.functions import config as cf
from netloom.functions import scalar as sc
from netloom.operators import series
from netloom.sources import files
from netloom.streaming import monitor


@pytest.fixture(scope="module")
def history(spark):
    rows = [(r, s, 1.38 + 0.01 * math.sin(s + r), 0.69 + 0.01 * math.cos(s), 0.4 + 0.1 / (1 + s), 1.5) for r in range(3) for s in range(20 if r else 2)]
    return spark.createDataFrame(rows, "realization long, step int, loss_d double, loss_g double, beta double, gamma double")


def column(df, c, r=1):
    return [x[c] for x in df.where(f"realization = {r}").orderBy("step").collect()]


def test_rolling(history):
    raw = column(history, "loss_d")
    assert column(series.rolling_mean(history, "loss_d", 4), "mean") == pytest.approx([np.mean(raw[k - 3 : k + 1]) for k in range(3, 20)])
    assert column(series.rolling_mean(history, "loss_d", 4), "mean", 0) == column(history, "loss_d", 0)
    assert column(series.rolling_mean(history, "loss_d", 4, trailing=True), "mean") == pytest.approx([np.mean(raw[max(0, k - 3) : k + 1]) for k in range(20)])
    with pytest.raises(ValueError):
        series.rolling_mean(history, "loss_d", 0)


def test_band_is_nan_until_full(history):
    got = series.loss_band(history, 5, delta_d=0.02, delta_g=0.02)
    assert [math.isnan(v) for v in column(got, "loss_d_mean")] == [True] * 4 + [False] * 16
    assert not any(column(got, "in_equilibrium")[:4]) and all(column(got, "in_equilibrium")[4:])
    stop = {r.realization: r.first_step for r in series.stopping(history, ["beta", "gamma"], window=5, stability_window=3, tol=0.01, delta_d=0.02, delta_g=0.02).collect()}
    beta = column(history, "beta")
    want = next(k for k in range(4, 20) if max(beta[k - 2 : k + 1]) - min(beta[k - 2 : k + 1]) <= 0.01)
    assert stop == {0: None, 1: want, 2: want}


def test_tail_and_estimates(history):
    beta = column(history, "beta")
    row = series.estimates(history, ["beta"], 6).where("realization = 1").first()
    assert (row.coef, row.final, row.path_sd) == (pytest.approx(np.mean(beta[-6:])), beta[-1], pytest.approx(np.std(beta[-6:])))
    with pytest.raises(Exception, match="longer than a history"):
        series.tail_view(history, 5).collect()
    one = series.estimates(history.where("step = 0"), ["gamma"], 6).first()
    assert one.path_sd == 0.0


def test_padding_and_quantiles(history):
    pad = series.padded(history, 25, ["beta"])
    assert column(pad, "beta")[20:] == [column(history, "beta")[-1]] * 5 and len(column(pad, "beta", 0)) == 25
    q = series.quantile_paths(pad, "beta").where("step = 3").first()
    v = [column(pad, "beta", r)[3] for r in range(3)]
    assert list(q)[1:] == pytest.approx(np.quantile(v, [0.05, 0.25, 0.5, 0.75, 0.95]).tolist())
    for bad in ([0.1] * 4, [0.9, 0.1, 0.2, 0.3, 0.4], [0, 0.1, 0.2, 0.3, 1.1]):
        with pytest.raises(ValueError):
            series.check_quantiles(bad)


def test_summary_uses_finite_ok_rows(spark):
    rows = spark.createDataFrame([(0, "ok", 0.5), (1, "ok", 0.3), (2, "failed:x", 9.0), (3, "ok", float("nan")), (4, None, 0.4)], "realization long, status string, beta_hat double")
    s = series.summary(rows, {"beta": 0.4}).first()
    assert s["count"] == 3 and s["mean"] == pytest.approx(0.4) and s["std"] == pytest.approx(np.std([0.5, 0.3, 0.4])) and s["rmse"] == pytest.approx(math.sqrt(0.02 / 3))
    assert sorted(r.realization for r in series.pending(rows, 7).collect()) == [5, 6]


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 3, 4)], "v double")
    got = {r.bin: r.n for r in series.histogram(df, "v", 4).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2}
    assert {r.bin: r.n for r in series.histogram(df.select(F.lit(1.0).alias("v")), "v", 4).collect()} == {0: 5}
    got = series.histogram(df, "v", 4).collect()
    assert sum(r.density for r in got) == pytest.approx(1.0)


def test_overrides():
    assert series.override_tol("gamma", 0.1, {"gamma": 0.5}) == 0.5 and series.override_tol("gammas", 0.1, {"gamma": 0.5}) == series.override_tol("gamma[1]", 0.1, {"gamma": 0.5}) == 0.1


def test_result_files(spark, tmp_path):
    path = f"{tmp_path}/rows"
    a = spark.createDataFrame([(1, 0.5, "ok", "[]")], "realization long, beta_hat double, status string, history string")
    files.append_rows(a, path)
    files.append_rows(spark.createDataFrame([(2, 0.6, 7)], "realization long, beta_hat double, other long"), path)
    got = spark.read.parquet(path)
    assert got.columns == ["realization", "beta_hat", "status"] and got.count() == 2
    csv = tmp_path / "r.csv"
    csv.write_text("realization,beta_hat,converged,gt_seed\n0,0.5,True,12\nx,1,false,3\n2,nan,maybe,4\n")
    with pytest.warns(RuntimeWarning, match="1 malformed"):
        rows = files.load_results(spark, str(csv)).orderBy("realization").collect()
    assert [r.realization for r in rows] == [0, 2] and rows[0].converged is True and rows[1].converged is None and math.isnan(rows[1].beta_hat)
    assert files.load_results(spark, f"{tmp_path}/none.csv") is None
    with pytest.raises(ValueError):
        files.write_csv(a.limit(0), f"{tmp_path}/x")
    for bad in ([], [(1,)]):
        with pytest.raises(ValueError):
            files.check_rows(["a", "b"], bad)
    files.save_manifest(f"{tmp_path}/m/manifest.json", {"b": 1, "a": cf.GraphConfig})
    assert json.load(open(f"{tmp_path}/m/manifest.json"))["b"] == 1


def test_step_records_and_stream(spark, history, tmp_path):
    path = f"{tmp_path}/steps"
    files.write_steps(history, path)
    assert files.read_steps(spark, path).count() == history.count()
    q = monitor.start(monitor.progress(monitor.steps(spark, path)), "progress")
    try:
        q.processAllAvailable()
        assert {(r.realization, r.steps) for r in spark.table("progress").collect()} == {(0, 2), (1, 20), (2, 20)}
    finally:
        q.stop()


def test_configurations():
    assert cf.ExperimentConfig.mc_default().monte_carlo.horizon(cf.TrainingConfig()) == 2000
    with pytest.raises(ValueError, match="blur"):
        cf.ExperimentConfig(training=cf.TrainingConfig(n_steps=300, blur=cf.BlurConfig(anneal_steps=1000)), monte_carlo=cf.MonteCarloConfig())
    cf.ExperimentConfig(training=cf.TrainingConfig(n_steps=300, blur=cf.BlurConfig(anneal_steps=100)), monte_carlo=cf.MonteCarloConfig())
    with pytest.raises(ValueError):
        cf.GraphConfig(min_degree=2)
    assert cf.GraphConfig(kind="ba").generator() == {"m": 2}
    assert cf.config_hash(cf.GraphConfig()) == cf.config_hash(cf.GraphConfig()) != cf.config_hash(cf.GraphConfig(seed=1))
    assert cf.provenance(cf.GraphConfig())["config_hash"]


def test_scalars(spark):
    v = spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "x double")
    assert [r[0] for r in v.select(sc.softplus(F.col("x"))).collect()] == pytest.approx([0.0, math.log(2), 800.0])
    one = spark.range(1)
    value, holds, rate = (one.select(c).first()[0] for c in sc.moment_eta(F.lit(0.4), F.lit(2.0), 2))
    eta = abs(math.log(0.4 * math.sqrt(2)))
    assert (value, holds) == (pytest.approx(0.32), True) and rate == pytest.approx(eta / (2 * math.log(2) + eta))
    assert one.select(sc.moment_eta(F.lit(0.9), F.lit(4.0), 2)[1]).first()[0] is False
    heavy = [one.select(sc.heavy_tail_exponent(F.lit(t))).first()[0] for t in (2.1, 2.5, 2.9, 2.0, 3.0, 3.5)]
    assert heavy == [True] * 3 + [False] * 3
    tau = lambda s, *a: one.select(sc.noise_tau(F.lit(s), *a)).first()[0]
    assert tau(20, 0.15, "exp", 100, 0.01) == pytest.approx(0.15 / math.e) and tau(1000, 0.2, "linear", 100, 0.02) == 0.02 and tau(30, 1.0, "exp", 30, 0.05) == 0.05
    g = spark.range(20_000).select(sc.gaussian_hash(1, F.col("id")).alias("g")).agg(F.avg("g"), F.stddev_pop("g")).first()
    assert abs(g[0]) < 0.03 and abs(g[1] - 1) < 0.03
    with pytest.raises(ValueError):
        sc.soft_clip(F.lit(1.0), 0)

"""Queries over series of steps, runs and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions.scalar import rounded
from netloom.operators import series
from netloom.plans import sqltext as sql
from netloom.plans.registry import query
from netloom.sources import files
from netloom.sources import fixtures as fx

SIX, R, H, RUNS = rounded, sql.rnd, sql.HISTORY, sql.RUNS
TRUTH = {"beta": 0.4, "gamma": 1.5}


def _six(df, *cols):
    return df.withColumns({c: SIX(F.col(c)) for c in cols})


@query(f"""with {H}, m as (select realization, step, loss_d, row_number() over w as k, count(*) over (partition by realization) as n, avg(loss_d) over (w rows between 4 preceding and current row) as a from h window w as (partition by realization order by step))
select realization, step, {R('case when n < 5 then loss_d else a end')} as mean from m where n < 5 or k >= 5""")
def rolling_mean_valid(spark, d):
    return _six(series.rolling_mean(fx.history(spark, d), "loss_d", 5).select("realization", "step", "mean"), "mean")


@query(f"with {H} select realization, step, {R('avg(loss_d) over (partition by realization order by step rows between 4 preceding and current row)')} as mean from h")
def rolling_mean_trailing(spark, d):
    return _six(series.rolling_mean(fx.history(spark, d), "loss_d", 5, trailing=True).select("realization", "step", "mean"), "mean")


def _frame(n):
    return f"(partition by realization order by step rows between {n - 1} preceding and current row)"


BAND_SQL = f"""bd as (select realization, step, beta, gamma, row_number() over (partition by realization order by step) >= 6 as ready,
 avg(loss_d) over {_frame(5)} as md, stddev_pop(loss_d) over {_frame(5)} as sd, avg(loss_g) over {_frame(5)} as mg, stddev_pop(loss_g) over {_frame(5)} as sg from h),
bq as (select *, ready and abs(md - 2 * ln(2)) < 0.03::double and abs(mg - ln(2)) < 0.03::double and sd <= 0.1::double and sg <= 0.1::double as eq from bd)"""
BAND = {"min_steps": 6, "delta_d": 0.03, "delta_g": 0.03, "std_max": 0.1}


@query(f"with {H}, {BAND_SQL} select realization, step, " + ", ".join(f"case when ready then {R(a)} else 'nan'::double end as {b}" for a, b in (("md", "loss_d_mean"), ("sd", "loss_d_std"), ("mg", "loss_g_mean"), ("sg", "loss_g_std"))) + ", eq as in_equilibrium from bq")
def loss_band(spark, d):
    cols = ["loss_d_mean", "loss_d_std", "loss_g_mean", "loss_g_std"]
    return _six(series.loss_band(fx.history(spark, d), 5, **BAND).select("realization", "step", *cols, "in_equilibrium"), *cols)


STABLE_SQL = f"""sb as (select realization, step, row_number() over (partition by realization order by step) >= 4 as full4,
 max(beta) over {_frame(4)} - min(beta) over {_frame(4)} as rb, max(gamma) over {_frame(4)} - min(gamma) over {_frame(4)} as rg from h),
sq as (select *, full4 and rb <= 0.15::double and rg <= 0.3::double as stable from sb)"""
STABLE = {"stability_window": 4, "tol": 0.15, "overrides": {"gamma": 0.3}}


@query(f"with {H}, {STABLE_SQL} select realization, step, case when full4 then {R('rb')} else 'nan'::double end as range_beta, case when full4 then {R('rg')} else 'nan'::double end as range_gamma, stable from sq")
def param_stability(spark, d):
    out = series.param_stability(fx.history(spark, d), ["beta", "gamma"], 4, 0.15, {"gamma": 0.3})
    return _six(out.select("realization", "step", "range_beta", "range_gamma", "stable"), "range_beta", "range_gamma")


@query(f"with {H}, {BAND_SQL}, {STABLE_SQL} select realization, coalesce(min(case when eq and stable then step end), -1)::int as first_step from bq join sq using (realization, step) group by realization")
def stopping_first_step(spark, d):
    return series.stopping(fx.history(spark, d), ["beta", "gamma"], window=5, **STABLE, **BAND).withColumn("first_step", F.coalesce("first_step", F.lit(-1)))


_TAIL = "tl as (select * from (select *, row_number() over (partition by realization order by step desc) as k from h) where k <= 6)"


@query(f"with {H}, {_TAIL} select realization, {R('avg(beta)')} as beta, {R('avg(gamma)')} as gamma, {R('max_by(beta, step)')} as beta_final from tl group by realization")
def tail_average(spark, d):
    t = series.tail(fx.history(spark, d), 6).groupBy("realization").agg(F.avg("beta").alias("beta"), F.avg("gamma").alias("gamma"), F.max_by("beta", "step").alias("beta_final"))
    return _six(t, "beta", "gamma", "beta_final")


@query(f"with {H} select realization, step, {R('beta')} as beta from (select *, row_number() over (partition by realization order by step desc) as k from h) where k <= 2 and realization in (select realization from h group by 1 having count(*) >= 2)")
def tail_view(spark, d):
    h = fx.history(spark, d)
    long = h.groupBy("realization").count().where("count >= 2").select("realization")
    return _six(series.tail_view(h.join(long, "realization", "left_semi"), 2).select("realization", "step", "beta"), "beta")


_EST = f"""es as (select realization, 'beta' as param, avg(beta) as coef, max_by(beta, step) as final, stddev_pop(beta) as path_sd from tl group by realization
union all select realization, 'gamma', avg(gamma), max_by(gamma, step), stddev_pop(gamma) from tl group by realization)"""


@query(f"with {H}, {_TAIL}, {_EST} select realization, param, {R('coef')} as coef, {R('final')} as final, {R('path_sd')} as path_sd from es")
def estimates_table(spark, d):
    return _six(series.estimates(fx.history(spark, d), ["beta", "gamma"], 6), "coef", "final", "path_sd")


@query(f"with {H}, {_TAIL}, {_EST} select realization, param, {R('coef')} as coef, {R('final')} as final, {R('path_sd')} as path_sd, case when param = 'beta' then 0.4::double else 'nan'::double end as \"true\", case when param = 'beta' then {R('abs(coef - 0.4::double)')} else 'nan'::double end as abs_err from es")
def recovery_table(spark, d):
    truth = spark.createDataFrame([("beta", 0.4)], "param string, value double")
    return _six(series.recovery(series.estimates(fx.history(spark, d), ["beta", "gamma"], 6), truth), "coef", "final", "path_sd", "abs_err")


_PAD = """pd as (select u.realization, g.s::int as step, (select max(step) from h z where z.realization = u.realization) as top from (select distinct realization from h) u, (select unnest(range(max(step) + 1)) from h) g(s)),
pp as (select pd.realization, pd.step, h.beta, h.loss_d from pd join h on h.realization = pd.realization and h.step = least(pd.step, pd.top))"""


def _padded(spark, d, columns):
    """Every run at all steps of the longest."""
    h = fx.history(spark, d)
    return series.padded(h, series.horizon(h), columns)


@query(f"with {H}, {_PAD} select realization, step, {R('beta')} as beta, {R('loss_d')} as loss_d from pp")
def history_pad(spark, d):
    return _six(_padded(spark, d, ["beta", "loss_d"]), "beta", "loss_d")


_Q = ", ".join(f"{R(f'quantile_cont(v, {q}::double)')} as q{i}" for i, q in enumerate((0.05, 0.25, 0.5, 0.75, 0.95)))


@query(f"with {H}, {_PAD}, t as (select step, beta as v from pp) select step, {_Q} from t group by step")
def mc_quantile_paths(spark, d):
    return _six(series.quantile_paths(_padded(spark, d, ["beta"]), "beta"), *(f"q{i}" for i in range(5)))


@query(f"with {H}, {_PAD}, t as (select step, avg(loss_d) over {_frame(3)} as v from pp) select step, {_Q} from t group by step")
def mc_quantile_loss_paths(spark, d):
    smooth = series.rolling_mean(_padded(spark, d, ["loss_d"]), "loss_d", 3, trailing=True)
    return _six(series.quantile_paths(smooth, "mean"), *(f"q{i}" for i in range(5)))


_ERR = """er as (select 'beta' as param, realization, beta_hat - 0.4::double as error from r where status = 'ok' and isfinite(beta_hat)
union all select 'gamma', realization, gamma_hat - 1.5::double from r where status = 'ok' and isfinite(gamma_hat))"""


@query(f"with {RUNS}, {_ERR} select param, realization, {R('error')} as error from er")
def mc_param_errors(spark, d):
    return _six(series.errors(fx.runs(spark, d), TRUTH), "error")


@query(f"""with {RUNS}, {_ERR}, f as (select param, error, error + case param when 'beta' then 0.4::double else 1.5::double end as v from er)
select param, {R('avg(v)')} as mean, {R('stddev_pop(v)')} as std, {R('quantile_cont(v, 0.5)')} as median, count(*) as count, case param when 'beta' then 0.4::double else 1.5::double end as "true", {R('avg(error)')} as bias, {R('sqrt(avg(error * error))')} as rmse from f group by param""")
def mc_summary(spark, d):
    return _six(series.summary(fx.runs(spark, d), TRUTH), "mean", "std", "median", "bias", "rmse")


@query(f"with {RUNS} select count(*) filter (status = 'ok') as completed, count(*) filter (status <> 'ok') as failed from r")
def mc_status_counts(spark, d):
    return fx.runs(spark, d).agg(F.count_if(F.col("status") == "ok").alias("completed"), F.count_if(F.col("status") != "ok").alias("failed"))


@query(f"""with {RUNS}, {_ERR}, b as (select param, min(error) as lo, max(error) as hi from er group by param)
select param, case when hi = lo then 0 else least(floor((error - lo) / ((hi - lo) / 25)), 24) end::int as bin, count(*) as n from er join b using (param) group by 1, 2""")
def mc_error_histogram(spark, d):
    return series.histogram(series.errors(fx.runs(spark, d), TRUTH), "error", 25, "param").select("param", "bin", "n")


@query(f"with {RUNS} select i as realization from range(300) t(i) where i not in (select realization from r)")
def mc_resume_pending(spark, d):
    return series.pending(fx.runs(spark, d), 300)


@query(f"""with {RUNS} select realization, status = 'ok' as converged, final_step, status, {R('beta_hat')} as beta_hat, {R('gamma_hat')} as gamma_hat from r""")
def mc_rows(spark, d):
    r = fx.runs(spark, d)
    return _six(r.select("realization", (F.col("status") == "ok").alias("converged"), "final_step", "status", "beta_hat", "gamma_hat"), "beta_hat", "gamma_hat")


@query("""select event_id as realization, value as beta_hat, (event_id * 7 + 1)::bigint as gt_seed, case event_id % 5 when 0 then 'true' when 1 then 'false' when 2 then 'true' when 3 then 'false' else 'unknown' end as converged
from events where event_id % 10 <> 9""")
def mc_load_typed(spark, d):
    n = F.col("event_id")
    token = F.when(n % 5 == 0, "True").when(n % 5 == 1, "false").when(n % 5 == 2, " TRUE ").when(n % 5 == 3, "0").otherwise("maybe")
    text = fx.table(spark, d, "events").select(
        F.when(n % 10 == 9, "broken").otherwise(n.cast("string")).alias("realization"), F.col("value").cast("string").alias("beta_hat"), (n * 7 + 1).cast("string").alias("gt_seed"), token.alias("converged")
    )
    return files.typed_rows(text).select("realization", "beta_hat", "gt_seed", F.coalesce(F.col("converged").cast("string"), F.lit("unknown")).alias("converged"))


@query("select user_id as realization, count(*) as steps, sha256(string_agg(event_id::varchar, ',' order by event_id)) as digest from events group by user_id")
def row_sha256(spark, d):
    e = fx.table(spark, d, "events").groupBy(F.col("user_id").alias("realization")).agg(F.count("*").alias("steps"), F.sort_array(F.collect_list("event_id")).alias("ids"))
    return e.select("realization", "steps", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("digest"))


@query()  # the rows of a table say nothing about the bytes of its file
def file_sha256(spark, d):
    return files.file_hashes(spark, f"{d}/nation.parquet").select("length", "sha256")


@query(f"""with {H} select to_json({{'event': 'step', 'realization': realization, 'step': step, 'loss_d': {R('loss_d')}, 'loss_g': {R('loss_g')}, 'beta': {R('beta')}, 'gamma': {R('gamma')}}})::varchar as value from h""")
def step_metrics_json(spark, d):
    return _six(fx.history(spark, d), "loss_d", "loss_g", "beta", "gamma").select(files.as_json_line("step").alias("value"))

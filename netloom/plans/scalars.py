"""Queries over scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import expr as ex
from netloom.functions import scalar as sc
from netloom.plans import sqltext as sql
from netloom.plans.registry import query
from netloom.sources import fixtures as fx

SIX, R = sc.rounded, sql.rnd


def values(spark, d):
    """(id, v): v between about -10 and 10."""
    return fx.table(spark, d, "events").select(F.col("event_id").alias("id"), (10 * F.sin("value")).alias("v"))


V = "v as (select event_id as id, 10 * sin(value) as v from events)"


@query(f"with {V} select id, {R('case when v > 0 then v + ln(1 + exp(-v)) else ln(1 + exp(v)) end')} as y from v")
def softplus(spark, d):
    return values(spark, d).select("id", SIX(sc.softplus(F.col("v"))).alias("y"))


@query(f"with {V}, p as (select id, 1 / (1 + exp(-v)) as p from v) select id, {R('p')} as p, {R('ln(p / (1 - p))')} as back from p")
def sigmoid_logit(spark, d):
    p = sc.sigmoid(F.col("v"))
    return values(spark, d).select("id", SIX(p).alias("p"), SIX(sc.logit(p)).alias("back"))


def _transform(spark, d, t, scale):
    raw = ex.Var("raw")
    df = values(spark, d).select("id", (F.col("v") * scale).alias("raw")).withColumn("f", t.forward(raw).column({}))
    return df.select("id", SIX(F.col("f")).alias("forward"), SIX(t.inverse_column(F.col("f"))).alias("back"), SIX(t.forward(raw).diff("raw").column({})).alias("slope"))


@query(f"with {V} select id, {R('v')} as forward, {R('v')} as back, 1::double as slope from v")
def transform_real(spark, d):
    return _transform(spark, d, ex.Real(), 1.0)


@query(f"with {V} select id, {R('exp(v / 4)')} as forward, {R('v / 4')} as back, {R('exp(v / 4)')} as slope from v")
def transform_positive(spark, d):
    return _transform(spark, d, ex.Positive(), 0.25)


@query(f"with {V}, f as (select id, 0.85::double * tanh(v / 10) as f, tanh(v / 10) as t from v) select id, {R('f')} as forward, {R('atanh(least(greatest(f / 0.85::double, -0.999999), 0.999999))')} as back, {R('0.85::double * (1 - t * t)')} as slope from f")
def transform_interval(spark, d):
    return _transform(spark, d, ex.Interval(-0.85, 0.85), 0.1)


@query(f"with {V} select id, {R('5 * tanh(v / 5)')} as y from v")
def soft_clip(spark, d):
    return values(spark, d).select("id", SIX(sc.soft_clip(F.col("v"), 5.0)).alias("y"))


STEPS = "h as (select user_id as realization, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as step from events)"


@query(f"""with {STEPS} select realization, step, 1.2::double as constant, {R('greatest(0.02::double, 0.2::double * (1 - step / 60))')} as linear,
{R("case when step >= 60 then 0.01::double else greatest(0.01::double, 0.15::double * exp(-step / 12)) end")} as exp from h""")
def instance_noise_taus(spark, d):
    s = F.col("step")
    df = fx.history(spark, d).select("realization", "step")
    return df.select("realization", "step", sc.noise_tau(s, 1.2, "constant", 60).alias("constant"), SIX(sc.noise_tau(s, 0.2, "linear", 60, 0.02)).alias("linear"), SIX(sc.noise_tau(s, 0.15, "exp", 60, 0.01)).alias("exp"))


@query(f"with {STEPS} select realization, step, {R('0.003::double * pow(0.5, (step >= 22)::int + (step >= 42)::int + (step >= 62)::int + (step >= 78)::int)', 9)} as lr from h")
def lr_schedule(spark, d):
    return fx.history(spark, d).select("realization", "step", SIX(sc.effective_lr(0.003, 0.5, [22, 42, 62, 78], F.col("step")), 9).alias("lr"))


@query(f"""with g as (select event_id as id, 0.05::double + (event_id % 19) / 20::double as rho, 0.5::double + (user_id % 16) / 4::double as branching from events),
m as (select *, rho * rho * branching as value, abs(ln(rho * sqrt(branching))) as le from g)
select id, {R('rho')} as rho, {R('branching')} as branching, {R('value')} as value, value < 1 as holds,
case when value < 1 and branching > 1 then {R('le / (2 * ln(branching) + le)')} else 'nan'::double end as gamma from m""")
def moment_condition(spark, d):
    df = fx.table(spark, d, "events").select(F.col("event_id").alias("id"), (0.05 + (F.col("event_id") % 19) / 20).alias("rho"), (0.5 + (F.col("user_id") % 16) / 4).alias("branching"))
    value, holds, rate = sc.moment_eta(F.col("rho"), F.col("branching"), 2)
    return df.select("id", SIX(F.col("rho")).alias("rho"), SIX(F.col("branching")).alias("branching"), SIX(value).alias("value"), holds.alias("holds"), SIX(rate).alias("gamma"))


@query(f"select event_id as id, {R(sql.uniform('7', chr(39) + 'a' + chr(39), 'event_id'), 9)} as u, {R(sql.gaussian('7', chr(39) + 'a' + chr(39), 'event_id'))} as g from events")
def gaussian_hash(spark, d):
    i = F.col("id")
    return fx.table(spark, d, "events").select(F.col("event_id").alias("id")).select("id", SIX(sc.uniform_hash(7, "a", i), 9).alias("u"), SIX(sc.gaussian_hash(7, "a", i)).alias("g"))


@query("""with g as (select event_id as id, (20 + event_id % 16) / 10::double as tau1, 200 + 37 * user_id as n, case when event_id % 5 = 0 then null else event_id % 2003 end as cap from events)
select id, tau1, n, coalesce(cap, -1) as cap, tau1 > 2 and tau1 < 3 as heavy_exponent, case when cap is null then n >= 1000 else cap > 3 * sqrt(n) end as heavy_cap from g""")
def heavy_tail_grid(spark, d):
    e, u = F.col("event_id"), F.col("user_id")
    df = fx.table(spark, d, "events").select(e.alias("id"), ((20 + e % 16) / 10).alias("tau1"), (200 + 37 * u).alias("n"), F.when(e % 5 != 0, e % 2003).alias("cap"))
    return df.select("id", "tau1", "n", F.coalesce("cap", F.lit(-1).cast("long")).alias("cap"), sc.heavy_tail_exponent(F.col("tau1")).alias("heavy_exponent"), sc.degree_cap_is_heavy(F.col("cap"), F.col("n")).alias("heavy_cap"))


@query("select distinct user_id as realization, 'R' || lpad(user_id::varchar, 4, '0') as label, 'gamma[' || (user_id % 3) || ']' as param, printf('%.4f', user_id / 7) as shown from events")
def param_labels(spark, d):
    u = F.col("user_id")
    return fx.table(spark, d, "events").select(
        u.alias("realization"), F.concat(F.lit("R"), F.lpad(u.cast("string"), 4, "0")).alias("label"), F.concat(F.lit("gamma["), (u % 3).cast("string"), F.lit("]")).alias("param"), F.format_string("%.4f", u / 7).alias("shown")
    ).distinct()


_OPTIMA = "(values ('loss_d', 2 * ln(2), 1), ('loss_g_nonsaturating', ln(2), 2), ('loss_g_saturating', -ln(2), 3)) o(loss, optimum, k)"


@query(f"with {sql.HISTORY}, m as (select realization, avg(loss_d) as d, avg(loss_g) as g from h group by 1) select realization, loss, {R('optimum')} as optimum, {R('case k when 1 then d when 2 then g else -g end - optimum')} as gap from m, {_OPTIMA}")
def loss_optima(spark, d):
    """How far each run's mean losses are from where the test function can tell nothing apart."""
    mean = fx.history(spark, d).groupBy("realization").agg(F.avg("loss_d").alias("d"), F.avg("loss_g").alias("g"))
    at = {"loss_d": F.col("d"), "loss_g_nonsaturating": F.col("g"), "loss_g_saturating": -F.col("g")}
    rows = F.array(*(F.struct(F.lit(k).alias("loss"), F.lit(v).alias("optimum"), (at[k] - v).alias("gap")) for k, v in sc.OPTIMA.items()))
    return mean.select("realization", F.explode(rows).alias("r")).select("realization", "r.loss", SIX(F.col("r.optimum")).alias("optimum"), SIX(F.col("r.gap")).alias("gap"))


L = sql.LOGITS
_SP = "ln(1 + exp({}))"


@query(f"with {L} select {R('avg(ln(1 + exp(-logit))) filter (role = ' + chr(39) + 'real' + chr(39) + ') + avg(ln(1 + exp(logit))) filter (role = ' + chr(39) + 'fake' + chr(39) + ')')} as loss from lg")
def loss_d(spark, d):
    x = F.col("logit")
    return fx.logits(spark, d).agg(SIX(F.avg(F.when(F.col("role") == "real", sc.softplus(-x))) + F.avg(F.when(F.col("role") == "fake", sc.softplus(x)))).alias("loss"))


@query(f"with {L} select {R('avg(ln(1 + exp(-logit)))')} as loss from lg where role = 'fake'")
def loss_g_ns(spark, d):
    return fx.logits(spark, d).where("role = 'fake'").agg(SIX(F.avg(sc.softplus(-F.col("logit")))).alias("loss"))


@query(f"with {L} select {R('-avg(ln(1 + exp(logit)))')} as loss from lg where role = 'fake'")
def loss_g_sat(spark, d):
    return fx.logits(spark, d).where("role = 'fake'").agg(SIX(-F.avg(sc.softplus(F.col("logit")))).alias("loss"))


@query("""with g as (select 1 / (1 + exp(-logit)) as s from (select 2 * sin(value) as logit from events)), b as (select least(floor(s * 30), 29)::int as bin from g)
select bin, count(*) as n, """ + R("count(*) / ((select count(*) from b) * (1 / 30::double))") + " as density from b group by bin")
def score_histogram(spark, d):
    from netloom.operators.series import histogram

    scores = fx.logits(spark, d).select(sc.sigmoid(F.col("logit")).alias("score"))
    return histogram(scores, "score", 30, low=0, high=1).select("bin", "n", SIX(F.col("density")).alias("density"))

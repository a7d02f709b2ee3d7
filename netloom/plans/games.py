"""Queries over best responses, equilibria, sensitivities and admissibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions.scalar import rounded
from netloom.operators import equilibrium as eq
from netloom.operators import games, graph
from netloom.operators.components import checkpointed
from netloom.plans import sqltext as sql
from netloom.plans.graphs import Q40, Q45, g40, g45
from netloom.plans.registry import query
from netloom.sources import fixtures as fx

SIX, R = rounded, sql.rnd
TRUE = {"beta": 0.4, "gamma": 1.5, "sigma_sq": 1.0}
EFFORT = {"gamma": 1.5, "lambda_": 2 / 3, "mu": 0.5, "r": 1.0, "sigma_sq": 1.0}


def network(spark, d, edges=None):
    """Weights and (id, x, eps) of a graph."""
    e = g40(spark, d) if edges is None else edges
    n = fx.nodes(e, fx.price(spark, d))
    return graph.row_stochastic(e), fx.shocked(n)


E = f"eps as (select id, x, {sql.gaussian('7', chr(39) + 'eps' + chr(39), 'id')} as eps from x)"
BASE = f"{Q40}, {sql.W}, {sql.X}, {E}"


def respond(expr: str, value: str = "w * y", source: str = "{prev}") -> str:
    """One best-response step over {prev}(id, x, eps, y); {peer} in expr."""
    got = expr.replace("{peer}", "coalesce(p, 0)")
    return f"select n.* replace ({got} as y) from {source} n left join (select src, sum({value}) as p from w join {source} on id = dst group by src) on src = id"


LIM = "0.4::double * {peer} + (1.5::double * x + eps)"


def chained(n: int, expr: str, value: str = "w * y", start: str = "select *, 0::double as y from eps") -> str:
    return sql.chain(n, respond(expr, value), start)


@query(f"with {Q40}, {sql.W}, {sql.X}, k as (select src, count(*) as degree from e group by src), eps as (select id, x, 0::double as eps from x), {chained(20, '0.4::double * {peer} + 1.5::double * x')} select id, degree, {R('y')} as y from y20 join k on src = id")
def picard_fixed_20(spark, d):
    e = g40(spark, d)
    n = fx.nodes(e, fx.price(spark, d)).withColumn("eps", F.lit(0.0))
    got = games.LinearInMeans(TRUE).solve(graph.row_stochastic(e), n, fixed=20).nodes
    return got.join(graph.degrees(e), "id").select("id", "degree", SIX(F.col("y")).alias("y"))


@query(f"with {BASE}, {chained(30, LIM)} select id, {R('y', 4)} as y from y30")
def picard_lim(spark, d):
    w, n = network(spark, d)
    got = games.LinearInMeans(TRUE, picard_tol=1e-8).solve(w, n)
    return got.nodes.select("id", SIX(F.col("y"), 4).alias("y"))


@query(f"with {BASE}, {chained(8, LIM)} " + " union all ".join(f"select {k} as step, {R(f'max(abs(b.y - a.y))')} as change from y{k - 1} a join y{k} b using (id)" for k in range(1, 9)))
def picard_trace(spark, d):
    w, n = network(spark, d)
    step = games.LinearInMeans(TRUE).step(w)
    now, told = n.withColumn("y", F.lit(0.0)), []
    for k in range(1, 9):
        new = step(now.withColumn("y0", F.col("y")))
        told.append(new.agg(F.lit(k).alias("step"), SIX(F.max(F.abs(F.col("y") - F.col("y0")))).alias("change")))
        now = new.drop("y0")
        if k == 4:
            now = eq.checkpointed(now)
    out = told[0]
    for t in told[1:]:
        out = out.union(t)
    return out


@query(f"with {BASE}, {chained(12, LIM, start='select *, 0::double as y from eps')}, s as (select id, x, eps, cos(id) as y from eps), z0 as (select * from s), {', '.join(f'z{k} as materialized (' + respond(LIM).replace('{prev}', f'z{k - 1}') + ')' for k in range(1, 13))} select {R('max(abs(a.y - b.y))')} as gap from y12 a join z12 b using (id)")
def uniqueness_gap(spark, d):
    w, n = network(spark, d)
    g = games.LinearInMeans(TRUE)
    a = g.solve(w, n, fixed=12).nodes.select("id", "y")
    b = g.solve(w, n, start=F.cos("id"), fixed=12).nodes.select("id", F.col("y").alias("y2"))
    return a.join(b, "id").agg(SIX(F.max(F.abs(F.col("y") - F.col("y2")))).alias("gap"))


@query(f"with {BASE}, xy as (select id, x, eps, sin(3 * x) as y from eps), r as ({respond(LIM, source='xy')}) select id, {R('y')} as y from r")
def best_response_lim(spark, d):
    w, n = network(spark, d)
    got = games.LinearInMeans(TRUE).step(w)(n.withColumn("y", F.sin(3 * F.col("x"))))
    return got.select("id", SIX(F.col("y")).alias("y"))


@query(f"with {BASE}, {chained(6, LIM)} select id, {R('y')} as y from y6")
def simulate_lim(spark, d):
    w, n = network(spark, d)
    return games.LinearInMeans(TRUE).simulate(w, n.drop("eps"), seed=7, fixed=6).nodes.select("id", SIX(F.col("y")).alias("y"))


_NEWTON_SQL = "z0 as (select id, b, greatest(least(b / (1 + 2/3::double), 50), -50) as z, 'inf'::double as c, 0 as n from load), " + ", ".join(
    f"""z{k} as (select id, b, case when c < 1e-10 then z else z - d end as z, case when c < 1e-10 then c else abs(d) end as c, n + (c >= 1e-10)::int as n
  from (select *, ((1 + 2/3::double) * z - 0.5::double * exp(-z) - b) / ((1 + 2/3::double) + 0.5::double * exp(-z)) as d from z{k - 1}))""" for k in range(1, 9)
)


@query(f"""with {BASE}, xy as (select *, sin(3 * x) as y from eps), load as (select id, 2/3::double * coalesce(p, 0) + 1.5::double * x + eps as b from xy left join (select src, sum(w * y) as p from w join xy on id = dst group by src) on src = id), {_NEWTON_SQL}
select id, {R('z')} as y, n as steps, {R('c', 9)} as change, max(n) over () as most_steps, max(c) over () < 1e-10 as settled from z8""")
def newton_effort(spark, d):
    """A best response by Newton of each node, its steps and last change, and the worst of all nodes."""
    w, n = network(spark, d)
    begun = n.withColumns({"y": F.sin(3 * F.col("x")), "newton_change": F.lit(0.0), "newton_iters": F.lit(0)})
    got = checkpointed(games.EffortGame(EFFORT).step(w)(begun))
    worst = got.agg(F.max("newton_iters").alias("most_steps"), (F.max("newton_change") < 1e-10).alias("settled"))
    return got.crossJoin(F.broadcast(worst)).select("id", SIX(F.col("y")).alias("y"), F.col("newton_iters").alias("steps"), SIX(F.col("newton_change"), 9).alias("change"), "most_steps", "settled")  # one row


_TAN = "select n.* replace (0.4::double * coalesce(p, 0) + 1.5::double * x + eps as y, coalesce(p, 0) + 0.4::double * coalesce(pb, 0) as b, x + 0.4::double * coalesce(pg, 0) as g, eps / 2 + 0.4::double * coalesce(ps, 0) as s) from {prev} n left join (select src, sum(w * y) as p, sum(w * b) as pb, sum(w * g) as pg, sum(w * s) as ps from w join {prev} on id = dst group by src) on src = id"


@query(f"with {BASE}, {sql.chain(10, _TAN, 'select *, 0::double as y, 0::double as b, 0::double as g, 0::double as s from eps')} select id, {R('y')} as y, {R('b')} as dy_beta, {R('g')} as dy_gamma, {R('s')} as dy_sigma_sq from y10")
def picard_tangents(spark, d):
    w, n = network(spark, d)
    got = games.LinearInMeans(TRUE).tangents(w, n, ("beta", "gamma", "sigma_sq"), 10)
    return got.select("id", *(SIX(F.col(c)).alias(c) for c in ("y", "dy_beta", "dy_gamma", "dy_sigma_sq")))


_ADJ = "select n.* replace (x + coalesce(s, 0) as y) from {prev} n left join (select dst, sum(0.4::double * w * y) as s from w join {prev} on id = src group by dst) on dst = id"


@query(f"with {Q40}, {sql.W}, {sql.X}, {sql.chain(15, _ADJ, 'select id, x, x as y from x')} select id, {R('y')} as u from y15")
def adjoint_neumann(spark, d):
    e = g40(spark, d)
    jac = graph.row_stochastic(e).select(F.col("src").alias("i"), F.col("dst").alias("j"), (0.4 * F.col("w")).alias("v"))
    c = fx.nodes(e, fx.price(spark, d)).select("id", F.col("x").alias("c"))
    return eq.neumann(jac, c, max_iter=15, fixed=True).nodes.select("id", SIX(F.col("y")).alias("u"))


@query(f"with {Q40}, {sql.W} select {R('max(s)')} as modulus from (select src, sum(abs(0.4::double * w)) as s from w group by src)")
def contraction_lim(spark, d):
    w, n = network(spark, d)
    jac = games.LinearInMeans(TRUE).jacobian(w, n.withColumn("y", F.lit(0.0)))
    return jac.groupBy("i").agg(F.sum(F.abs("v")).alias("s")).agg(SIX(F.max("s")).alias("modulus"))


@query(f"with {BASE}, xy as (select *, sin(3 * x) as y from eps), j as (select src, (2/3::double) / ((5/3::double) + 0.5::double * exp(-y)) as slope, w from w join xy on id = src) select {R('max(s)')} as modulus, {R('2/3::double / (1 + 2/3::double)')} as bound from (select src, sum(abs(slope * w)) as s from j group by src)")
def contraction_effort(spark, d):
    w, n = network(spark, d)
    g = games.EffortGame(EFFORT)
    jac = g.jacobian(w, n.withColumn("y", F.sin(3 * F.col("x"))))
    return jac.groupBy("i").agg(F.sum(F.abs("v")).alias("s")).agg(SIX(F.max("s")).alias("modulus"), F.lit(round(g.contraction_rate, 6)).alias("bound"))


@query(f"with {Q45}, {sql.W}, j as (select a.src as i, b.dst as j, sum(0.4::double * a.w * b.w) as v from w a join w b on a.dst = b.src group by all), o as (select * from j where i <> j and (i, j) not in (select src, dst from e)) select {R('max(abs(v))')} as off_ball from o")
def locality_offball(spark, d):
    e = g45(spark, d)
    w, n = network(spark, d, e)
    jac = games.TwoHop(TRUE).jacobian(w, n.withColumn("y", F.lit(0.0)))
    near = e.select(F.col("src").alias("i"), F.col("dst").alias("j"))
    return jac.where("i <> j").join(near, ["i", "j"], "left_anti").agg(SIX(F.max(F.abs("v"))).alias("off_ball"))


@query(f"with {BASE}, xy as (select *, sin(3 * x) as y from eps) select {R('min(1 / ((5/3::double) + 0.5::double * exp(-y)))')} as least from xy")
def shock_monotone(spark, d):
    _, n = network(spark, d)
    slope = games.EffortGame(EFFORT).partial("eps")
    return n.withColumn("y", F.sin(3 * F.col("x"))).agg(SIX(F.min(slope.column(games.columns(EFFORT)))).alias("least"))


def _game(name: str, game, expr: str, value: str = "w * y", steps: int = 5):
    def run(spark, d):
        w, n = network(spark, d)
        return game.solve(w, n, fixed=steps).nodes.select("id", SIX(F.col("y")).alias("y"))

    query(f"with {BASE}, {chained(steps, expr, value)} select id, {R('y')} as y from y{steps}", name=name)(run)


_game("game_saturating", games.SaturatingPeer(TRUE), "0.4::double * tanh({peer}) + 1.5::double * x + eps", "y")
_game("game_raw_sum", games.RawSum(TRUE | {"beta": 0.02}), "0.02::double * {peer} + 1.5::double * x + eps", "y")
_game("game_foc_linear", games.LinearFoc(TRUE), LIM)


@query(f"with {Q40}, {sql.W}, {sql.VEC}, eps as (select *, {sql.gaussian('7', chr(39) + 'eps' + chr(39), 'id')} as eps from v), {chained(5, '0.4::double * {peer} + eps + 0.01::double * x0 + 1.5::double * x1 - 2 * x2')} select id, {R('y')} as y from y5")
def game_vector(spark, d):
    e = g40(spark, d)
    n = fx.shocked(fx.nodes(e, fx.part_vector(spark, d)))
    g = games.VectorCovariates({"beta": 0.4, "gamma[0]": 0.01, "gamma[1]": 1.5, "gamma[2]": -2.0})
    return g.solve(graph.row_stochastic(e), n, fixed=5).nodes.select("id", SIX(F.col("y")).alias("y"))


_TWO = "select n.* replace (0.4::double * coalesce(p, 0) + (1.5::double * x + eps) as y) from {prev} n left join (select a.src, sum(a.w * b.w * y) as p from w a join w b on a.dst = b.src join {prev} on id = b.dst group by a.src) on src = id"


@query(f"with {BASE}, {sql.chain(4, _TWO, 'select *, 0::double as y from eps')} select id, {R('y')} as y from y4")
def game_two_hop(spark, d):
    w, n = network(spark, d)
    return games.TwoHop(TRUE).solve(w, n, fixed=4, block=2).nodes.select("id", SIX(F.col("y")).alias("y"))


def _effort_step(prev: str) -> str:
    z = ["load as (select n.id, n.x, n.eps, 2/3::double * coalesce(p, 0) + 1.5::double * x + eps as b from " + prev + " n left join (select src, sum(w * y) as p from w join " + prev + " on id = dst group by src) on src = id)"]
    z.append("z0 as (select *, greatest(least(b / (5/3::double), 50), -50) as z from load)")
    z += [f"z{k} as (select id, x, eps, b, z - ((5/3::double) * z - 0.5::double * exp(-z) - b) / ((5/3::double) + 0.5::double * exp(-z)) as z from z{k - 1})" for k in range(1, 9)]
    return f"with {', '.join(z)} select id, x, eps, z as y from z8"


def _check_sql(step: str, slope: str, by_eps: str, learnable: int) -> str:
    """The checks from the tables: ``slope`` is the response's derivative by the peer mean, ``by_eps`` that by the shock, at y."""
    main = sql.chain(26, step, "select *, 0::double as y from eps")
    other = main.replace("0::double as y from eps", "cos(id) as y from eps")
    for k in range(26, -1, -1):
        other = other.replace(f"y{k} ", f"q{k} ")
    return f"""with {Q45}, {sql.W}, {sql.X}, {E}, {main}, {other}, j as (select src, dst, abs({slope} * w) as v from w join y26 on id = src),
t as (select 'equilibrium_residual' as name, max(abs(a.y - b.y)) as value, 0.001::double as threshold from y25 a join y26 b using (id)
union all select 'contraction_modulus', (select max(s) from (select sum(v) as s from j group by src)), 1
union all select 'locality_A2', coalesce((select max(v) from j where src <> dst and (src, dst) not in (select src, dst from e)), 0), 0.0001
union all select 'shock_monotone_U4', (select min({by_eps}) from y26), 0
union all select 'uniqueness', (select max(abs(a.y - b.y)) from y26 a join q26 b using (id)), 0.0001
union all select 'gradients', {learnable}, {learnable})
select name, case name when 'shock_monotone_U4' then value > threshold when 'gradients' then value = threshold else value < threshold end as passed, {R('value', 4)} as value, {R('threshold')} as threshold from t"""


def _report(spark, d, game):
    e = g45(spark, d)
    w, n = network(spark, d, e)
    return games.check_model(game, w, n.drop("eps"), seed=7).frame(spark).select("name", "passed", SIX(F.col("value"), 4).alias("value"), SIX(F.col("threshold")).alias("threshold"))


@query(_check_sql(respond(LIM), "0.4::double", "1::double", 3))
def check_model_lim(spark, d):
    return _report(spark, d, games.LinearInMeans(TRUE))


@query(_check_sql(_effort_step("{prev}"), "(2/3::double) / ((5/3::double) + 0.5::double * exp(-y))", "1 / ((5/3::double) + 0.5::double * exp(-y))", 5))
def check_model_effort(spark, d):
    return _report(spark, d, games.EffortGame(EFFORT))

"""Queries over graphs: preparation, weights, components, balls, egos, sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from netloom.functions import tables
from netloom.functions.scalar import gaussian_hash, rounded
from netloom.operators import equilibrium as eq
from netloom.operators import graph, sampling
from netloom.operators.components import checkpointed
from netloom.plans import sqltext as sql
from netloom.plans.registry import query
from netloom.sources import fixtures as fx
from netloom.sources import graphs as gen

Q40, Q45 = sql.edges(40), sql.edges(45)
SIX = rounded


def g40(spark, d):
    return fx.part_edges(spark, d, 40)


def g45(spark, d):
    return fx.part_edges(spark, d, 45)


def g45l(spark, d):
    return fx.loops(g45(spark, d))


def xy(spark, d, edges):
    """(id, x, y): price, and y a smooth function of it."""
    return fx.nodes(edges, fx.price(spark, d)).withColumn("y", F.sin(3 * F.col("x")) + F.col("id") % 5)


XY = sql.X + ", xy as (select id, x, sin(3 * x) + id % 5 as y from x)"


@query(f"with {Q45} select src, dst from e")
def edges_symmetric(spark, d):
    return graph.symmetrize(graph.undirected(g45(spark, d)))


@query(f"with {sql.looped()} select src, dst from el where src <> dst")
def drop_self_loops(spark, d):
    return graph.drop_self_loops(g45l(spark, d))


@query(f"with {Q45} select src, dst from e where src < dst")
def edges_undirected_export(spark, d):
    return graph.undirected(g45(spark, d))


_KEPT = f"""{sql.looped()}, plain as (select src, dst from el where src <> dst), {sql.components("plain")},
top as (select comp from cc group by comp order by count(*) desc, comp limit 1),
ids as (select id, (row_number() over (order by id) - 1)::bigint as label from cc join top using (comp))"""


@query(f"with {_KEPT} select a.label as src, b.label as dst from plain join ids a on a.id = src join ids b on b.id = dst")
def sanitize_graph(spark, d):
    return graph.sanitize(g45l(spark, d)).edges


@query(f"with {_KEPT} select (select count(*) from ids) as n, (select count(*) from el where src = dst) as self_loops_removed, (select count(*) from cc) - (select count(*) from ids) as nodes_dropped")
def sanitize_report(spark, d):
    return graph.sanitize(g45l(spark, d)).report


@query(f"with {_KEPT}, {XY} select label as id, x, {sql.rnd('y')} as y from xy join ids using (id)")
def sanitize_reindex_y(spark, d):
    edges = g45l(spark, d)
    return graph.reindexed(xy(spark, d, edges), graph.sanitize(edges).ids).select("id", "x", SIX(F.col("y")).alias("y"))


@query(f"with {_KEPT} select id, label from ids")
def relabel_nodes(spark, d):
    return graph.sanitize(g45l(spark, d)).ids


@query(f"with {_KEPT} select id from cc where id not in (select id from ids)")
def dropped_nodes(spark, d):
    edges = g45l(spark, d)
    return graph.node_ids(edges).join(graph.kept_component(graph.drop_self_loops(edges)), "id", "left_anti")


@query(f"with {Q45}, {sql.components()} select id as node, comp as component from cc")
def components(spark, d):
    return graph.components(g45(spark, d))


@query(f"with {Q45}, {sql.components()} select comp as component, count(*) as size from cc group by comp")
def component_sizes(spark, d):
    return graph.components(g45(spark, d)).groupBy("component").agg(F.count("*").alias("size"))


@query(f"with {_KEPT} select id from ids")
def largest_component(spark, d):
    return graph.kept_component(graph.drop_self_loops(g45l(spark, d)))


def parts(spark, d) -> int:
    """The size of a generated graph: as many nodes as there are parts."""
    return fx.table(spark, d, "part").count()


@query("with n as (select count(*) as n from part) select i as src, (i + k + n) % n as dst from n, lateral (select unnest(range(n)) as i), (values (-2), (-1), (1), (2)) o(k)")
def gen_ring_lattice(spark, d):
    return gen.ring_lattice(spark, parts(spark, d), 2)


@query(f"""with {sql.looped()} select id, string_agg(dst, ',' order by dst) as neighbors from (select distinct src as id from el) left join (select distinct src, dst from el where src <> dst) on src = id group by id""")
def adjacency_lists(spark, d):
    return graph.adjacency(g45l(spark, d)).select("id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


@query("""select l_orderkey as id, string_agg(p, ',' order by p) as neighbors from (select distinct l_orderkey, l_partkey as p from lineitem) where p <> l_orderkey group by 1
union all select l_orderkey, '' from lineitem group by 1 having count(*) filter (l_partkey <> l_orderkey) = 0""")
def normalize_adjacency(spark, d):
    lists = fx.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_partkey").alias("neighbors"))
    return graph.normalized_lists(lists).select("id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


@query(f"""with {sql.looped()} select count(*) as n_edges, least(min(src), min(dst)) as lowest, greatest(max(src), max(dst)) as highest, 0::bigint as nulls,
count(*) filter (src = dst) as loops, (count(*) - (select count(*) from (select distinct src, dst from el)))::bigint as duplicates,
(select count(*) from (select dst from el except select src from el)) as dead_ends, true as ok from el""")
def validate_edges(spark, d):
    return graph.validated(g45l(spark, d))


@query("""select 'p_retailprice' as "column", count(*) filter (p_retailprice is null or not isfinite(p_retailprice)) as invalid from part
union all select 'p_size', count(*) filter (p_size is null) from part""")
def validate_finite(spark, d):
    part = fx.table(spark, d, "part").select("p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    return graph.invalid_values(part, ["p_retailprice", "p_size"])


@query(f"with {Q40}, {sql.W} select src, dst, {sql.rnd('w')} as w from w")
def row_stochastic_w(spark, d):
    return graph.row_stochastic(g40(spark, d)).select("src", "dst", SIX(F.col("w")).alias("w"))


@query(f"with {Q40}, {sql.W} select src, {sql.rnd('sum(w)')} as total from w group by src")
def w_row_sums(spark, d):
    return graph.row_stochastic(g40(spark, d)).groupBy("src").agg(SIX(F.sum("w")).alias("total"))


@query(f"with {Q40} select id, coalesce(k, 0) as degree from (select p_partkey as id from part) left join (select src, count(*) as k from e group by src) on src = id")
def degrees(spark, d):
    return graph.degrees(g40(spark, d), fx.price(spark, d))


@query(f"with {Q40}, k as (select src, count(*) as k from e group by src) select count(*) as n, sum(k)::bigint as m, {sql.rnd('avg(k)')} as mean_degree, max(k) as max_degree from k")
def degree_summary(spark, d):
    return graph.degrees(g40(spark, d)).agg(F.count("*").alias("n"), F.sum("degree").alias("m"), SIX(F.avg("degree")).alias("mean_degree"), F.max("degree").alias("max_degree"))


@query(f"with {Q40}, k as (select src, count(*)::double as k from e group by src) select {sql.rnd('sum(k * (k - 1)) / sum(k)')} as branching from k")
def branching_moment(spark, d):
    k = F.col("degree")
    return graph.degrees(g40(spark, d)).agg(SIX(F.sum(k * (k - 1)) / F.sum(k)).alias("branching"))


@query(f"with {Q40}, k as (select src, count(*) as k from e group by src) select count(*) as n, max(k) as max_degree, max(k) > 3 * sqrt(count(*)) as heavy from k")
def heavy_tail_flag(spark, d):
    n = graph.degrees(g40(spark, d)).agg(F.count("*").alias("n"), F.max("degree").alias("max_degree"))
    return n.withColumn("heavy", F.col("max_degree") > 3.0 * F.pow(F.col("n"), F.lit(0.5)))


def _peer(value: str) -> str:
    return f"with {Q40}, {sql.W}, {XY} select src as id, {sql.rnd(f'sum({value})')} as peer from w join xy on id = dst group by src"


def _told(df):
    return df.select("id", SIX(F.col("peer")).alias("peer"))


@query(_peer("w * y"))
def peer_mean(spark, d):
    e = g40(spark, d)
    return _told(eq.peer_mean(graph.row_stochastic(e), xy(spark, d, e)))


@query(_peer("y"))
def peer_sum(spark, d):
    e = g40(spark, d)
    return _told(eq.peer_sum(graph.row_stochastic(e), xy(spark, d, e)))


@query(_peer("tanh(y)"))
def peer_sum_tanh(spark, d):
    e = g40(spark, d)
    return _told(eq.peer_sum(graph.row_stochastic(e), xy(spark, d, e), F.tanh("y")))


@query(_peer("(1 + (src + dst) % 3) * sqrt(1 + y * y)"))
def peer_weighted(spark, d):
    e = g40(spark, d)
    a = e.withColumn("w", 1.0 + (F.col("src") + F.col("dst")) % 3)
    return _told(eq.peer_mean(a, xy(spark, d, e), F.sqrt(1 + F.col("y") * F.col("y"))))


@query(f"with {Q40}, {sql.W}, {XY}, one as (select src as id, sum(w * y) as y from w join xy on id = dst group by src) select src as id, {sql.rnd('sum(w * y)')} as peer from w join one on id = dst group by src")
def peer_mean_two_hop(spark, d):
    e = g40(spark, d)
    w = graph.row_stochastic(e)
    one = eq.peer_mean(w, xy(spark, d, e)).select("id", F.col("peer").alias("y"))
    return _told(eq.peer_mean(w, one))


for _r in (1, 2, 3):

    def _balls(spark, d, r=_r):
        return graph.balls(g40(spark, d), r)

    query(f"with {Q40}, {sql.balls(_r)} select root, node, dist from b", name=f"balls_k{_r}")(_balls)


@query(f"with {Q40}, {sql.balls(3)} select root, count(*) filter (dist <= 0) as d0, count(*) filter (dist <= 1) as d1, count(*) filter (dist <= 2) as d2, count(*) as d3 from b group by root")
def ball_sizes(spark, d):
    return graph.ball_sizes(graph.balls(g40(spark, d), 3), 3)


@query()
def ball_sizes_sketched(spark, d):
    return graph.sketched_ball_sizes(g40(spark, d), 3)


_EGO = f"{sql.balls(2)}, ego as (select root, node, (row_number() over (partition by root order by node) - 1)::int as pos from b)"


@query(f"with {Q45}, {_EGO} select * from ego")
def ego_nodes_k2(spark, d):
    return graph.ego_nodes(graph.balls(g45(spark, d), 2))


@query(f"with {Q45}, {_EGO} select a.root, a.pos as src_pos, b.pos as dst_pos from ego a join e on e.src = a.node join ego b on b.root = a.root and b.node = e.dst")
def ego_edges_k2(spark, d):
    e = g45(spark, d)
    return graph.ego_edges(graph.ego_nodes(graph.balls(e, 2)), e)


@query(f"with {Q45}, {_EGO} select root, node, pos from ego")
def ego_nodes_table(spark, d):
    """The ego's nodes by a table function."""
    return tables.ego(g45(spark, d), 2)[0]


@query(f"with {Q45}, {_EGO} select a.root, a.pos as src_pos, b.pos as dst_pos from ego a join e on e.src = a.node join ego b on b.root = a.root and b.node = e.dst")
def ego_edges_table(spark, d):
    """The ego's edges by a table function."""
    return tables.ego(g45(spark, d), 2)[1]


_STATS = "st as (select avg(x) as mu_x, stddev_pop(x) as sigma_x, avg(y) as mu_y, stddev_pop(y) as sigma_y from xy)"


@query(f"with {Q40}, {XY}, {_STATS} select {', '.join(f'{sql.rnd(c)} as {c}' for c in ('mu_x', 'sigma_x', 'mu_y', 'sigma_y'))} from st")
def norm_stats(spark, d):
    e = g40(spark, d)
    return graph.norm_stats(xy(spark, d, e)).select(*(SIX(F.col(c)).alias(c) for c in ("mu_x", "sigma_x", "mu_y", "sigma_y")))


@query(f"with {Q40}, {sql.VEC}, l as (select unnest(['x0', 'x1', 'x2']) as \"column\", unnest([x0, x1, x2]) as v from v) select \"column\", {sql.rnd('avg(v)')} as mu, {sql.rnd('stddev_pop(v)')} as sigma from l group by 1")
def norm_stats_vector(spark, d):
    v = fx.nodes(g40(spark, d), fx.part_vector(spark, d))
    return graph.vector_stats(v, ["x0", "x1", "x2"]).select("column", SIX(F.col("mu")).alias("mu"), SIX(F.col("sigma")).alias("sigma"))


@query(f"with {Q40}, {XY}, {_STATS} select id, {sql.rnd('(x - mu_x) / sigma_x')} as xt, {sql.rnd('(y - mu_y) / sigma_y')} as yt from xy, st")
def standardize_nodes(spark, d):
    n = xy(spark, d, g40(spark, d))
    return graph.standardized(n, graph.norm_stats(n)).select("id", SIX(F.col("xt")).alias("xt"), SIX(F.col("yt")).alias("yt"))


@query(f"with {Q40}, {XY} select {sql.rnd('corr(x, y)')} as r from xy")
def xy_corr(spark, d):
    return xy(spark, d, g40(spark, d)).agg(SIX(F.corr("x", "y")).alias("r"))


def _features(spark, d, noise=None):
    """Every node is a root, in a slot of its own."""
    e = g45(spark, d)
    n = xy(spark, d, e)
    slots = graph.node_ids(e).select(F.col("id").alias("root"), F.col("id").alias("slot"))
    b = graph.ego_batch(slots, graph.ego_nodes(graph.balls(e, 2)), n, graph.norm_stats(n), noise)
    return b.select("root", "node", SIX(F.col("xt")).alias("xt"), SIX(F.col("yt")).alias("yt"), "is_root")


def _features_sql(y: str) -> str:
    return f"with {Q45}, {XY}, {_STATS}, {_EGO} select root, node, {sql.rnd('(x - mu_x) / sigma_x')} as xt, {sql.rnd(f'({y} - mu_y) / sigma_y')} as yt, (root = node)::int::double as is_root from ego join xy on id = node, st"


@query(_features_sql("y"))
def ego_features(spark, d):
    return _features(spark, d)


_BLURRED = "(y + 0.5::double * sigma_y * " + sql.gaussian("3", "'real'", "root", "node") + ")"


@query(_features_sql(_BLURRED))
def ego_features_blurred(spark, d):
    return _features(spark, d, 0.5 * gaussian_hash(3, "real", F.col("slot"), F.col("node")))


_NUMBERED = "nid as (select src as id, (row_number() over (order by src) - 1)::bigint as label from (select distinct src from e))"
_UNIFORM = f"nn as (select count(*) as n from nid), ru as (select s::int as slot, floor({sql.uniform('0', chr(39) + 'root' + chr(39), '0', 's')} * n)::bigint as label from range(40) r(s), nn), rr as (select slot, id as root from ru join nid using (label))"


def numbered(e):
    return graph.relabeled(graph.node_ids(e))


@query(f"with {Q45}, {_NUMBERED}, {_UNIFORM} select slot, label as root from ru")
def roots_uniform(spark, d):
    ids = numbered(g45(spark, d)).select(F.col("label").alias("id"))
    return sampling.uniform(ids, 40, 0, 0)


def _drawn(spark, d, e):
    ids = numbered(e)
    picks = sampling.uniform(ids.select(F.col("label").alias("id")), 40, 0, 0)
    return picks.join(ids, picks.root == ids.label).select("slot", F.col("id").alias("root"))


_BATCH = f"{Q45}, {XY}, {_STATS}, {_NUMBERED}, {_UNIFORM}, {_EGO}, bt as (select slot, root, pos, node, (x - mu_x) / sigma_x as xt, (y - mu_y) / sigma_y as yt, (root = node)::int::double as is_root from rr join ego using (root) join xy on id = node, st)"


def _batch(spark, d):
    e = g45(spark, d)
    roots, n = _drawn(spark, d, e), xy(spark, d, e)
    return graph.ego_batch(roots, graph.ego_nodes(graph.balls(e, 2, roots)), n, graph.norm_stats(n))


@query(f"with {_BATCH} select slot, root, pos, node, {sql.rnd('xt')} as xt, {sql.rnd('yt')} as yt, is_root from bt")
def ego_batch(spark, d):
    return _batch(spark, d).select("slot", "root", "pos", "node", SIX(F.col("xt")).alias("xt"), SIX(F.col("yt")).alias("yt"), "is_root")


@query(f"with {_BATCH}, z as (select slot, count(*) as size, max(case when is_root = 1 then pos end) as rp from bt group by slot), p as (select slot, coalesce(sum(size) over (order by slot rows between unbounded preceding and 1 preceding), 0)::bigint as ptr, rp from z) select slot, ptr, ptr + rp as root_row from p")
def batch_ptr(spark, d):
    return graph.batch_pointers(_batch(spark, d))


@query(f"with {_BATCH} select slot, node, {sql.rnd('yt')} as real_y, {sql.rnd('yt * 0.5 + 1')} as fake_y from bt")
def paired_real_fake(spark, d):
    b = _batch(spark, d)
    real = b.select("slot", "node", F.col("yt").alias("real_y"))
    fake = b.select("slot", "node", (F.col("yt") * 0.5 + 1).alias("fake_y"))
    return real.join(fake, ["slot", "node"]).select("slot", "node", SIX(F.col("real_y")).alias("real_y"), SIX(F.col("fake_y")).alias("fake_y"))


@query(f"with {Q45}, {sql.balls(2)} select x.root as a, y.root as b, count(*) as shared from b x join b y on x.node = y.node and x.root < y.root group by all")
def ego_overlap_pairs(spark, d):
    return graph.ego_overlaps(graph.balls(g45(spark, d), 2))


@query(f"""with {Q45}, {sql.balls(3)}, z as (select root, count(*) filter (dist <= 1) as d1, count(*) filter (dist <= 2) as d2, count(*) as d3 from b group by root),
q as (select ln(d2 / d1) as r from z where d2 > d1 union all select ln(d3 / d2) from z where d3 > d2) select {sql.rnd('exp(avg(r))')} as branching from q""")
def estimate_branching(spark, d):
    e = g45(spark, d)
    return graph.branching(e, graph.node_ids(e).withColumnRenamed("id", "root"), 3).select(SIX(F.col("branching")).alias("branching"))


@query(f"""with {Q45}, k as (select src as id, count(*) as degree from e group by src), t as (select id, 0 as kind, -degree::double as k from k order by degree desc, id limit 21),
q as (select id, 1 as kind, {sql.uniform('0', chr(39) + 'probe' + chr(39), 'id')} as k from k order by 3, id limit 40),
f as (select id, min({{'kind': kind, 'k': k}}) as a from (select * from t union all select * from q) group by id) select id from f order by a, id limit 40""")
def probe_nodes(spark, d):
    return sampling.probe_nodes(graph.degrees(g45(spark, d)), 40)


def pack_sql(radius: int, rounds: int, seed: int = 0) -> str:
    """Rounds of local minima, written out; pk(root, u) at the end."""
    pr = sql.uniform(str(seed), "'pack'", "node")
    out = [f"n0 as materialized (select root, node, {{'u': {pr}, 'id': node}} as p from b where dist <= {radius})"]
    for k in range(rounds):
        out.append(f"w{k} as materialized (select root, p.u as u from (select root, min(p) as p from n{k} group by root) where p.id = root)")
        out.append(f"d{k} as materialized (select distinct node as id from n{k} where root in (select root from w{k}))")
        out.append(f"n{k + 1} as materialized (select * from n{k} where root not in (select id from d{k}) and node not in (select id from d{k}))")
    return ", ".join(out) + ", pk as (" + " union all ".join(f"select root, u from w{k}" for k in range(rounds)) + ")"


@query(f"with {Q45}, {sql.balls(2)}, {pack_sql(2, 12)} select root, {sql.rnd('u', 9)} as u from pk")
def pack_once(spark, d):
    return sampling.packed(g45(spark, d), 2).select("root", F.round("u", 9).alias("u"))


@query(f"""with {Q45}, {sql.balls(2)}, a as (with {pack_sql(2, 12, 0)} select 0 as k, * from pk), b1_ as (with {pack_sql(2, 12, 1)} select 1 as k, * from pk), c as (with {pack_sql(2, 12, 2)} select 2 as k, * from pk),
t as (select * from a union all select * from b1_ union all select * from c), top as (select k from t group by k order by count(*) desc, k limit 1) select root, {sql.rnd('u', 9)} as u from t join top using (k)""")
def pack_best_of_k(spark, d):
    best, _ = sampling.best_packed(g45(spark, d), 2, None, 3)
    return best.select("root", F.round("u", 9).alias("u"))


@query(f"with {Q45}, {sql.balls(2)}, {pack_sql(2, 12, 1)}, t as (select root, u from pk order by u, root limit 20) select (row_number() over (order by u, root) - 1)::int as slot, root, 2 as radius_used, true as met_target from t")
def pack_result(spark, d):
    e = g45(spark, d)
    got = sampling.RootSampler("disjoint_once", exclusion_r=2, seed=0).sample(graph.node_ids(e), e, 20)
    return got.roots.withColumn("radius_used", F.lit(got.radius_used)).withColumn("met_target", F.lit(got.met_target))


@query(f"with {Q45}, {sql.balls(3)}, {pack_sql(3, 14, 1)}, t as (select root, u from pk order by u, root limit 30) select (row_number() over (order by u, root) - 1)::int as slot, root, 3 as radius_used from t")
def pack_relax(spark, d):
    e = g45(spark, d)
    got = sampling.RootSampler("disjoint_relax", relax=(3, 2), restarts=1, seed=0).sample(graph.node_ids(e), e, 30)
    return got.roots.withColumn("radius_used", F.lit(got.radius_used))


@query(f"with {Q45}, {sql.balls(2)}, {pack_sql(2, 12)} select x.root as a, x.node as b, x.dist from b x join pk p on p.root = x.root join pk q on q.root = x.node where x.root < x.node")
def packing_violations(spark, d):
    e = g45(spark, d)
    roots = checkpointed(sampling.packed(e, 2))
    return sampling.violations(roots, graph.balls(e, 2, roots), 2)


@query(f"""with {Q45}, s as (select id from (select distinct src as id from e) order by {sql.uniform('5', chr(39) + 'plot' + chr(39), 'id')}, id limit 100)
select src, dst from e where src < dst and src in (select id from s) and dst in (select id from s)""")
def plot_subgraph(spark, d):
    from netloom.functions.scalar import uniform_hash

    e = g45(spark, d)
    some = graph.node_ids(e).orderBy(uniform_hash(5, "plot", F.col("id")), "id").limit(100)
    kept = graph.undirected(e).join(some.withColumnRenamed("id", "src"), "src", "left_semi")
    return kept.join(some.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


_BA = f"""with recursive n as (select count(*) as n from part), k(e, s) as (select e, e from n, lateral (select unnest(range(2 * (n - 2))) as e)
  union all select e, case when s < 2 then -1 - s when r % 2 = 0 then -1 - (2 + (r // 2) // 2) else r // 2 end
  from (select e, s, floor({sql.uniform('1', chr(39) + 'ba' + chr(39), 's')} * (4 * (s // 2)))::bigint as r from k where s >= 0)),
p as (select 2 + e // 2 as src, -1 - s as dst from k where s < 0) select src, dst from p union select dst, src from p"""


@query(_BA)
def gen_ba(spark, d):
    return gen.barabasi_albert(spark, parts(spark, d), 2, seed=1)


def _lfr_sql(seed: int = 1, average: float = 6, top: int = 40, mu: float = 0.3, low: int = 20, high: int = 100) -> str:
    q = lambda *k: sql.uniform(str(seed), *(f"'{x}'" if i == 0 else x for i, x in enumerate(k)))
    law = lambda x, u: f"pow({x.base!r}::double + {u} * {x.width!r}::double, {x.root!r}::double)"
    degrees, sizes, width = gen.Law.of(2.5, gen.least_degree(2.5, top, average), top), gen.Law.of(1.5, low, high), 100 * high
    pairs = lambda kind, group: f"""select v, c, lead(v) over o as t, lead(c) over o as tc, row_number() over o as k
  from (select v, c, i, {group} as g from s, b, lateral (select unnest(range(1, {kind} + 1)) as i)) window o as (partition by g order by {q(kind.strip(chr(34)), "v", "i")}, v, i)"""  # noqa: E731
    return f"""with n as (select count(*) as n, greatest(1, count(*) // {width}) as blocks from part),
d0 as (select b as block, j, case when b = blocks - 1 then n - b * {width} else {width} end as length, floor({law(sizes, q("size", "b", "j"))})::bigint as size
  from n, lateral (select unnest(range(blocks)) as b), lateral (select unnest(range({2 * width // low} + 1)) as j)),
d1 as (select *, sum(size) over (partition by block order by j) - size as start from d0),
d2 as (select *, lead(start) over (partition by block order by j) as next from d1 where start < length),
d3 as (select block, j, start, case when next is null or length - next < {low} then length else next end as stop from d2 where not (next is null and length - start < {low} and j > 0)),
v0 as (select (block * {width} + p)::bigint as v, (block * 1048576 + j)::bigint as c, stop - start as size from d3, lateral (select unnest(range(start::bigint, stop::bigint)) as p)),
v1 as (select *, greatest(round_even({law(degrees, q("degree", "v"))}, 0)::bigint, 1) as degree from v0),
v2 as (select *, least(round_even({1 - mu!r}::double * degree, 0)::bigint, size - 1)::bigint as inner_ from v1),
s as materialized (select v, c, inner_ as "inner", (degree - inner_)::bigint as "outer" from v2),
b as (select greatest(1, sum("outer") // 512) as buckets from s),
m as ({pairs('"inner"', "c")} union all select * from ({pairs('"outer"', f"floor({q('bucket', 'v', 'i')} * buckets)::bigint")}) where c <> tc),
p as (select v as src, t as dst from m where k % 2 = 1 and t is not null and v <> t)
select src, dst from p union select dst, src from p"""


@query(_lfr_sql())
def gen_lfr(spark, d):
    return gen.lfr(spark, parts(spark, d), seed=1, average_degree=6, max_degree=40)

"""The jobs as registered queries: each runs twice into one new folder and returns what is there after the second run."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobs import run_monitor, text_network
from jobs.common import configuration
from netloom.functions.scalar import rounded
from netloom.operators.components import shared_folder
from netloom.plans import report, sqltext as sql


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_text_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes, edges and report of the text network, one kind of row each."""
    out = _folder(spark, "text-network")
    for _ in range(2):
        text_network.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", out)
    nodes, edges, found = (spark.read.parquet(f"{out}/{t}") for t in ("nodes", "edges", "report"))
    number: Callable[[str], Column] = lambda c: rounded(F.col(c)).alias(c)
    rows = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("doc_id").alias("b"), "lang", "degree", number("x"), number("peer_x"), number("peer2_x"), "y", "known", number("peer_y"))
    links = edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("bucket").cast("long").alias("degree"), number("w"))
    one = found.select(
        F.lit("report").alias("kind"), F.col("n").alias("a"), F.col("n_edges").alias("b"), F.col("max_degree").alias("degree"), rounded(F.col("mean_degree")).alias("x"),
        rounded(F.col("branching")).alias("w"), F.col("nodes_dropped").cast("double").alias("y"), F.col("self_loops_removed").cast("double").alias("known"),
    )
    return rows.unionByName(links, allowMissingColumns=True).unionByName(one, allowMissingColumns=True)


def job2_run_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each closed step of each run with its statistics, and the step at which the run may stop."""
    folder = _folder(spark, "run-monitor")  # a stream takes one file by a pattern alone
    for _ in range(2):
        run_monitor.run(spark, f"{sf_dir}/{{events}}.parquet", f"{folder}/steps", f"{folder}/checkpoint")
    steps = spark.read.parquet(f"{folder}/steps")
    numbers = ["loss_d_mean", "loss_d_std", "loss_g_mean", "loss_g_std", "range_beta", "range_gamma"]
    return steps.select("realization", "step", *(rounded(F.col(c)).alias(c) for c in numbers), "in_equilibrium", "stable", "stop", F.col("day").cast("string").alias("day"))


_NETWORK = f"""with l as (select distinct doc_id, trim(line, ' ') as line from (select doc_id, unnest(string_split(text, chr(10))) as line from documents where doc_id is not null and text is not null)
  where length(trim(line, ' ')) >= 40),
f as (select line, min(doc_id) as origin from l group by line having count(*) > 1),
p as (select distinct doc_id as src, origin as dst from l join f using (line) where doc_id <> origin),
e as (select src, dst from p union select dst, src from p),
{sql.components()},
big as (select comp from cc group by comp order by count(*) desc, comp limit 1),
ids as (select id, row_number() over (order by id) - 1 as label from cc where comp in (from big)),
w as (select a.label as src, b.label as dst, 1::double / count(*) over (partition by a.label) as w from e join ids a on e.src = a.id join ids b on e.dst = b.id),
t as (select doc_id as id, max(length(coalesce(text, ''))) as size, min(lang) as lang from documents where doc_id is not null group by 1),
m as (select doc_id as id, max(quality)::double as label from labels where doc_id is not null and quality is not null group by 1),
r as (select ids.label as id, t.id as doc_id, lang, ln(1 + size::double) as x, coalesce(m.label, 0) as y, case when m.label is null then 0::double else 1::double end as known
  from t join ids using (id) left join m using (id)),
z as (select * replace (case when stddev_pop(x) over () > 1e-12 then (x - avg(x) over ()) / stddev_pop(x) over () else 0 end as x) from r),
q as (select src as id, count(*) as degree, sum(w * x) as peer_x, sum(known) as k, sum(known * y) as ky from w join z on z.id = dst group by src),
q2 as (select src as id, sum(w * peer_x) as peer2_x from w join q on q.id = dst group by src)
select 'node' as kind, id as a, doc_id as b, lang, degree, {sql.rnd('x')} as x, {sql.rnd('peer_x')} as peer_x, {sql.rnd('peer2_x')} as peer2_x, y, known,
  {sql.rnd('case when k > 0 then ky / k end')} as peer_y, null::double as w from z join q using (id) join q2 using (id)
union all select 'edge', src, dst, null, src % 16, null, null, null, null, null, null, {sql.rnd('w')} from w
union all select 'report', count(*), sum(degree)::bigint, null, max(degree), {sql.rnd('avg(degree)')}, null, null,
  ((select count(*) from t) - count(*))::double, 0::double, null, {sql.rnd('sum(degree * (degree - 1)) / sum(degree)')} from q"""

_HELD = sql.HISTORY.replace("from events)", "from events where epoch_ms(ts) < (select max(epoch_ms(ts)) - 3600000 from events))").replace("h as (select", "h as (select strftime(ts, '%Y-%m-%d') as day,")
_MONITOR = f"""with {_HELD}, {report.BAND_SQL}, {report.STABLE_SQL},
j as (select h.day, bq.*, rb, rg, full4, stable, eq and stable as hit from bq join sq using (realization, step) join h using (realization, step))
select realization, step, {', '.join(f"case when {ok} then {sql.rnd(a)} else 'nan'::double end as {b}" for ok, a, b in (('ready', 'md', 'loss_d_mean'), ('ready', 'sd', 'loss_d_std'), ('ready', 'mg', 'loss_g_mean'), ('ready', 'sg', 'loss_g_std'), ('full4', 'rb', 'range_beta'), ('full4', 'rg', 'range_gamma')))},
  eq as in_equilibrium, stable, hit and step = min(case when hit then step end) over (partition by realization) as stop, day from j"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_text_network": job1_text_network, "job2_run_monitor": job2_run_monitor}


def oracle_sql() -> dict[str, str]:
    return {"job1_text_network": _NETWORK, "job2_run_monitor": _MONITOR}


def shipped(spark: SparkSession, job: str) -> dict:
    """The settings of a job's own configuration file."""
    module = {"text_network": text_network, "run_monitor": run_monitor}[job]
    return configuration(spark, str(Path(__file__).resolve().parent / f"{job}.json"), module.DEFAULTS)

import json
import logging
import math
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import queries, run_monitor, text_network
from jobs.common import configuration
from netloom.operators import series

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parent.parent


def rows(df):
    return sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


def files(path):
    return sorted(str(p) for p in Path(path).rglob("*.parquet"))


def corpus(spark, folder, docs, labels=()):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, ID string, key int").write.parquet(f"{folder}/documents")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels")
    return f"{folder}/documents", f"{folder}/labels", f"{folder}/out"


LINE = "a line of forty characters and some more, number {}"


def test_text_network_by_hand(spark, tmp_path, caplog):
    a, b, c = (LINE.format(k) for k in "abc")
    docs = [
        (10, f"{a}\nshort", "en", "x", 1), (11, f"  {a}  \n{b}", "de", "x", 1), (12, b, None, "x", 1), (13, f"{b}\n{b}\n{c}", "en", "x", 1), (20, LINE.format("alone"), "en", "x", 1),
        (30, LINE.format("pair"), "fr", "x", 1), (31, LINE.format("pair"), "fr", "x", 1), (40, None, "en", "x", 1), (None, a, "en", "x", 1), (12, b, None, "x", 1),
    ]
    paths = corpus(spark, tmp_path, docs, [(10, 1, 0), (12, 0, 0), (12, 0, 1), (13, None, 0), (None, 1, 0)])
    with caplog.at_level(logging.INFO, "jobs"):
        text_network.run(spark, *paths)
    out = paths[2]
    found = {r.doc_id: r for r in spark.read.parquet(f"{out}/nodes").collect()}
    assert sorted((r.doc_id, r.id, r.degree, r.lang) for r in found.values()) == [(10, 0, 1, "en"), (11, 1, 3, "de"), (12, 2, 1, None), (13, 3, 1, "en")]
    size = {10: len(docs[0][1]), 11: len(docs[1][1]), 12: len(b), 13: len(docs[3][1])}
    x = {k: math.log1p(v) for k, v in size.items()}
    mu = sum(x.values()) / 4
    sd = math.sqrt(sum((v - mu) ** 2 for v in x.values()) / 4)
    z = {k: (v - mu) / sd for k, v in x.items()}
    assert all(abs(found[k].x - z[k]) < 1e-12 for k in z)
    assert abs(found[11].peer_x - (z[10] + z[12] + z[13]) / 3) < 1e-12 and abs(found[10].peer2_x - found[11].peer_x) < 1e-12
    assert found[11].peer_y == 0.5 and found[10].peer_y is None and found[13].known == 0
    edges = sorted((r.src, r.dst, round(r.w, 9)) for r in spark.read.parquet(f"{out}/edges").collect())
    assert edges == [(0, 1, 1.0), (1, 0, 0.333333333), (1, 2, 0.333333333), (1, 3, 0.333333333), (2, 1, 1.0), (3, 1, 1.0)]
    report = spark.read.parquet(f"{out}/report").first()
    assert (report.n, report.n_edges, report.nodes_dropped, report.max_degree, report.mean_degree, report.branching) == (4, 6, 4, 3, 1.5, 1.0)
    assert "read 8 documents" in caplog.text and "wrote 4 nodes and 6 edges" in caplog.text
    assert {p.name for p in Path(out, "nodes").iterdir() if p.is_dir()} == {"lang=en", "lang=de", "lang=__HIVE_DEFAULT_PARTITION__"}


def test_text_network_reruns_with_the_same_rows(spark, tmp_path):
    """What a first run left of rows that are no longer there goes."""
    docs = [(i, LINE.format(i // 3) + "\n" + LINE.format("all"), "de" if i % 2 else "en", "x", 1) for i in range(60)]
    paths = corpus(spark, tmp_path, docs)
    once = {}
    for _ in range(2):
        text_network.run(spark, *paths, buckets=3)
        now = {t: rows(spark.read.parquet(f"{paths[2]}/{t}")) for t in ("nodes", "edges", "report")}
        assert not once or now == once
        once = now
    assert len(once["nodes"]) == 60
    spark.createDataFrame([d for d in docs if d[2] == "en"], "doc_id long, text string, lang string, ID string, key int").write.parquet(f"{tmp_path}/fewer")
    text_network.run(spark, f"{tmp_path}/fewer", *paths[1:])
    assert {r.lang for r in spark.read.parquet(f"{paths[2]}/nodes").collect()} == {"en"}


def test_text_network_of_a_line_that_a_third_of_all_documents_have(spark, tmp_path):
    docs = [(i, LINE.format("hot") if i % 3 == 0 else LINE.format(i), "en", "x", 1) for i in range(3000)]
    paths = corpus(spark, tmp_path, docs)
    text_network.run(spark, *paths)
    report = spark.read.parquet(f"{paths[2]}/report").first()
    assert (report.n, report.n_edges, report.max_degree) == (1000, 2 * 999, 999)  # no pairs of the group


def test_text_network_of_nothing(spark, tmp_path):
    paths = corpus(spark, tmp_path, [])
    text_network.run(spark, *paths)
    report = spark.read.parquet(f"{paths[2]}/report").first()
    assert (report.n, report.n_edges) == (0, None)


EVENTS = "event_id long, ts timestamp, user_id long, value double"


def events(spark):
    return spark.read.schema(EVENTS).parquet(f"{SF}/events.parquet")


def expected(closed):
    """The steps by the batch operators over the same records."""
    h = run_monitor.records(closed).withColumn("step", F.expr("row_number() over (partition by realization order by ts, id) - 1").cast("int"))
    band = {k: run_monitor.DEFAULTS[k] for k in ("min_steps", "delta_d", "delta_g", "std_max")}
    both = series.param_stability(series.loss_band(h, 5, **band), ["beta", "gamma"], 4, 0.15, {"gamma": 0.3})
    first = series.stopping(h, ["beta", "gamma"], window=5, stability_window=4, tol=0.15, overrides={"gamma": 0.3}, **band)
    cols = ["loss_d_mean", "loss_d_std", "loss_g_mean", "loss_g_std", "range_beta", "range_gamma"]
    joined = both.join(first, "realization").withColumn("stop", F.coalesce(F.col("step") == F.col("first_step"), F.lit(False)))
    return rows(joined.select("realization", "step", *(F.round(c, 9).alias(c) for c in cols), "in_equilibrium", "stable", "stop"))


def written(spark, out):
    cols = ["loss_d_mean", "loss_d_std", "loss_g_mean", "loss_g_std", "range_beta", "range_gamma"]
    return rows(spark.read.parquet(out).select("realization", "step", *(F.round(c, 9).alias(c) for c in cols), "in_equilibrium", "stable", "stop"))


def closed(df, hours=1):
    top = df.agg(F.max(F.unix_millis("ts")).alias("m")).first().m
    return df.where(F.unix_millis("ts") < top - 3_600_000 * hours)


def test_run_monitor_over_growing_input(spark, tmp_path, caplog):
    """Three runs: the first days, then the rest in files that arrive in no order, then nothing new."""
    whole = events(spark).repartition(1).sortWithinPartitions("ts").persist()
    mid = whole.selectExpr("percentile_approx(unix_millis(ts), 0.5) as m").first().m
    source, out, checkpoint = f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    early = whole.where(F.unix_millis("ts") < mid)
    early.write.mode("append").parquet(source)
    with caplog.at_level(logging.INFO, "jobs"):
        run_monitor.run(spark, source, out, checkpoint)
    first = written(spark, out)
    assert first == expected(closed(early)) and len(first) > 300
    seen = files(out)
    later = whole.where(F.unix_millis("ts") >= mid)
    later.repartition(4, F.col("event_id")).write.mode("append").parquet(source)
    run_monitor.run(spark, source, out, checkpoint)
    now = written(spark, out)
    assert now == expected(closed(whole)) and set(seen) <= set(files(out))
    assert sum("True" in r for r in now) > 0 and any(r.stop for r in spark.read.parquet(out).collect())
    seen = files(out)
    with caplog.at_level(logging.INFO, "jobs"):
        caplog.clear()
        run_monitor.run(spark, source, out, checkpoint)
    assert written(spark, out) == now and files(out) == seen and "read 0 records" in caplog.text
    whole.unpersist()


def test_run_monitor_puts_records_in_order(spark, tmp_path):
    """Within the lateness files may come in any order, one file a batch, each batch from the checkpoint of the last."""
    whole = events(spark)
    source, out, checkpoint = f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    parts = whole.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(3))).persist()
    for k in range(3):
        parts.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(source)
        run_monitor.run(spark, source, out, checkpoint, lateness="40 days")
    assert spark.read.schema("day string").parquet(out).count() == 0 if files(out) else True
    top = whole.agg(F.max("ts").alias("t")).first().t
    spark.createDataFrame([(10**6, top, -1, 1.0)], EVENTS).withColumn("ts", F.col("ts") + F.expr("interval 60 days")).coalesce(1).write.mode("append").parquet(source)
    run_monitor.run(spark, source, out, checkpoint, lateness="40 days")
    assert written(spark, out) == expected(whole)
    parts.unpersist()


def test_run_monitor_odd_records(spark, tmp_path):
    """Records without a run or a time take no part, equal ones count each, later ones than allowed are counted and left out."""
    base = "timestamp_seconds({})"
    df = spark.sql(" union all ".join(f"select {e} as event_id, {base.format(t) if t is not None else 'cast(null as timestamp)'} as ts, {u} as user_id, cast({v} as double) as value, 1 as Step" for e, t, u, v in [
        (1, 1000, 1, 5), (1, 1000, 1, 5), (2, 1000, 1, 6), (0, 1000, 1, 7), (5, None, 1, 5), (6, 1001, "cast(null as long)", 5), (7, 90_000, 2, 5)]))
    source, out, checkpoint = f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    df.write.parquet(source)
    run_monitor.run(spark, source, out, checkpoint)
    found = sorted((r.realization, r.step, round(r.range_beta, 6) if r.step > 2 else None, r.day) for r in spark.read.parquet(out).selectExpr("*", "cast(day as string) as d").drop("day").withColumnRenamed("d", "day").collect())
    value = [0.4 + 0.1 * math.sin(3 * v / 100) for v in (7, 5, 5, 6)]
    assert found == [(1, k, round(max(value) - min(value), 6) if k == 3 else None, "1970-01-01") for k in range(4)]
    spark.sql(f"select 8L as event_id, {base.format(2000)} as ts, 1L as user_id, 1D as value").write.mode("append").parquet(source)
    run_monitor.run(spark, source, out, checkpoint)
    assert spark.read.parquet(out).count() == 4


def test_configuration(spark, tmp_path):
    assert queries.shipped(spark, "text_network") == text_network.DEFAULTS and queries.shipped(spark, "run_monitor") == run_monitor.DEFAULTS
    (tmp_path / "c.json").write_text(json.dumps({"least_chars": 7}))
    assert configuration(spark, f"{tmp_path}/c.json", text_network.DEFAULTS) == {"least_chars": 7, "buckets": 16}
    (tmp_path / "c.json").write_text(json.dumps({"no_such": 7}))
    with pytest.raises(ValueError, match="no_such"):
        configuration(spark, f"{tmp_path}/c.json", text_network.DEFAULTS)


def test_command_line(tmp_path):
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=2 --conf spark.ui.enabled=false pyspark-shell"}
    told = subprocess.run(
        [sys.executable, "-m", "jobs.text_network", f"{SF}/documents.parquet", f"{SF}/labels.parquet", f"{tmp_path}/out", "--config", "jobs/text_network.json"],
        cwd=REPO, env=env, capture_output=True, text=True, timeout=300,
    )
    assert told.returncode == 0 and "wrote" in told.stderr and Path(tmp_path, "out", "nodes", "_SUCCESS").exists(), told.stderr[-2000:]


def test_jobs_import_no_text_operators():
    code = "import sys, jobs.queries; print([m for m in sys.modules if m.startswith(('netloom.llm', 'corpus_pipeline'))])"
    told = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert told.stdout.strip() == "[]", told.stderr


def test_run_monitor_deals_runs_into_groups(spark, tmp_path, monkeypatch):
    """Runs share a state and a call: 3 groups or one for nearly each run give the same steps, over input that grows within the runs."""
    from netloom.streaming import monitor

    got = {}
    for groups in (3, 1 << 30):
        monkeypatch.setattr(monitor, "GROUPS", groups)
        source, out, checkpoint = (str(tmp_path / f"{n}{groups}") for n in ("in", "out", "check"))
        for lot in range(3):
            rows = spark.range(400).select(
                (F.col("id") + 400 * lot).alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + 86_400 * lot + F.col("id") * 200).alias("ts"),
                (F.col("id") * 7 % 23 - 2).alias("user_id"), (F.col("id") * 13 % 101).cast("double").alias("value"),
            )
            rows.write.mode("append").parquet(source)
            run_monitor.run(spark, source, out, checkpoint)
        assert spark.read.format("statestore").load(checkpoint).count() == min(groups, 23)
        got[groups] = sorted(str(tuple(r)) for r in spark.read.parquet(out).collect())
    assert got[3] == got[1 << 30] and len(got[3]) > 1100

"""Follow training runs: step records as a file stream, rolling loss and stability statistics, the step at which each run may stop.

    python -m jobs.run_monitor EVENTS OUT CHECKPOINT [--config jobs/run_monitor.json]

EVENTS is a folder of Parquet step records in the columns of the ``events`` table, or a pattern of
files. A call
takes the files that are new since the last one, writes the steps that are closed by now, and ends;
it may be called again at any time, and after a crash. OUT is Parquet by day.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobs.common import log, main
from netloom.streaming import monitor

DEFAULTS = {
    "lateness": "1 hour", "max_files_per_trigger": None, "window": 5, "stability_window": 4, "tol": 0.15, "overrides": {"gamma": 0.3},
    "min_steps": 6, "delta_d": 0.03, "delta_g": 0.03, "std_max": 0.1,
}
RECORDS = "event_id long, ts timestamp, user_id long, value double"


def records(events: DataFrame) -> DataFrame:
    """``(realization, ts, id, loss_d, loss_g, beta, gamma)``: an event as a step of its user's run."""
    v = F.col("value") / 100
    return events.select(
        F.col("user_id").alias("realization"), "ts", F.col("event_id").alias("id"), (1.3863 + 0.05 * F.sin(v)).alias("loss_d"), (0.6931 + 0.04 * F.cos(v)).alias("loss_g"),
        (0.4 + 0.1 * F.sin(3 * v)).alias("beta"), (1.5 + 0.2 * F.cos(2 * v)).alias("gamma"),
    )


def run(spark: SparkSession, events: str, out: str, checkpoint: str, lateness: str = DEFAULTS["lateness"], max_files_per_trigger: int | None = None, **rule) -> None:
    """Take the records that are new, write the steps that are closed, by day; see ``monitor.follow``."""
    stream = spark.readStream.schema(RECORDS)
    if max_files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", max_files_per_trigger)
    settings = {k: v for k, v in DEFAULTS.items() if k not in ("lateness", "max_files_per_trigger")} | rule
    followed = monitor.follow(records(stream.parquet(events)), monitor.Rule(("beta", "gamma"), **settings), lateness)
    day = F.date_format(F.date_from_unix_date(F.floor(F.col("at") / 86_400_000_000).cast("int")), "yyyy-MM-dd")
    query = (
        followed.withColumn("day", day).writeStream.queryName(f"run-monitor-{uuid.uuid4().hex}").outputMode("append").partitionBy("day")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)
    )
    query.awaitTermination()
    done = query.recentProgress
    late = sum(s.get("numRowsDroppedByWatermark", 0) for p in done for s in (p["stateOperators"] or []))
    log.info("run_monitor: read %d records of %s in %d batches, %d of them too late; wrote steps to %s", sum(p["numInputRows"] for p in done), events, len(done), late, out)


if __name__ == "__main__":
    main(run, DEFAULTS, ["events", "out", "checkpoint"])

"""What watches a run, and the runner that keeps its rows."""

from __future__ import annotations

import json
import logging
import os
import time
import warnings
from collections.abc import Callable, Sequence
from typing import Any, Protocol, runtime_checkable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from netloom.functions.config import config_hash, jsonable, provenance
from netloom.operators import estimator as est
from netloom.operators import series
from netloom.operators.components import checkpointed
from netloom.sources import files

log = logging.getLogger(__name__)


@runtime_checkable
class Observer(Protocol):
    def run_start(self, config: Any) -> None: ...
    def step(self, record: dict) -> None: ...
    def run_end(self, result: Any) -> None: ...


class History:
    """All step records, by column."""

    def __init__(self):
        self.records: list[dict] = []

    def run_start(self, config): self.records = []
    def step(self, record): self.records.append(dict(record))
    def run_end(self, result): pass
    def column(self, name: str) -> np.ndarray: return np.array([r.get(name, np.nan) for r in self.records], float)

    def frame(self, spark: SparkSession, realization: int = 0) -> DataFrame:
        number = lambda v: float(v) if isinstance(v, (bool, int, float, np.number)) else None
        names = sorted({k for r in self.records for k, v in r.items() if number(v) is not None} - {"step"})
        rows = [(realization, int(r["step"]), *(number(r.get(k)) for k in names)) for r in self.records]
        return spark.createDataFrame(rows, "realization long, step int" + "".join(f", `{k}` double" for k in names))


class Console:
    """A line every so many steps; None says nothing."""

    def __init__(self, every: int | None = 100, prefix: str = "", write: Callable[[str], Any] = print):
        if every is not None and every <= 0:
            raise ValueError("every must be positive or None")
        self.every, self.prefix, self.write = every, prefix, write

    def run_start(self, config): pass

    def step(self, record):
        if self.every and record["step"] % self.every == 0:
            self.write(f"{self.prefix}step {record['step']}: loss_d {record['loss_d']:.4f}, loss_g {record['loss_g']:.4f}")

    def run_end(self, result):
        if self.every:
            self.write(f"{self.prefix}{result.status} after {result.final_step} steps")


def _named(value: Any) -> Any:
    """Numbers that aren't finite by the names that a reader of JSON takes for them."""
    if isinstance(value, dict):
        return {k: _named(v) for k, v in value.items()}
    if isinstance(value, (float, np.floating)) and not np.isfinite(value):
        return "NaN" if np.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    return value


class JsonLines:
    """A record per line for the start, each step and the end: what ``files.read_steps`` and the stream monitor read.

    The file is one of the machine that the run is on; what a Monte Carlo run keeps is written by ``MonteCarloRunner``.
    """

    def __init__(self, path: str, realization: int = 0):
        self.path, self.realization = path, realization

    def _put(self, event: str, **fields) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        with open(self.path, "a") as f:
            f.write(json.dumps(jsonable(_named({"event": event, "realization": self.realization, **fields}))) + "\n")

    def run_start(self, config): self._put("run_start", config=config)
    def step(self, record): self._put("step", **record)
    def run_end(self, result): self._put("run_end", status=result.status, final_step=result.final_step)


class Composite:
    def __init__(self, observers: Sequence[Observer]):
        self.observers = tuple(observers)

    def run_start(self, config): [o.run_start(config) for o in self.observers]
    def step(self, record): [o.step(record) for o in self.observers]
    def run_end(self, result): [o.run_end(result) for o in self.observers]


class MonteCarloRunner:
    """Realisations kept under ``out``: resumed by number whatever their status, purged if the configuration changed.

    Runs are made in batches, a task each. A batch is committed before the next begins: first its histories,
    ``histories/config=/realization=``, where a run's own partition is overwritten, then its rows, ``rows/config=``,
    which say that a run is done. So a crash loses one batch at most, and nothing is kept twice.
    ``visualize`` is called on the driver with the rows and the steps of all runs so far, each time ``plot_every`` more are
    done and at the end; ``progress_every`` does the same for a line in the log.
    """

    def __init__(
        self, spark: SparkSession, out: str, config: Any, truth: dict[str, float], *, master: int = 0, visualize: Callable[[DataFrame, DataFrame], Any] | None = None,
        plot_every: int | None = None, progress_every: int | None = None, batch: int | None = None,
    ):
        self.spark, self.out, self.config, self.truth, self.master, self.visualize = spark, out, config, truth, master, visualize
        self.plot_every, self.progress_every, self.batch = plot_every, progress_every, batch

    @property
    def _own(self) -> str:
        return f"config={config_hash(self.config)[:16]}"

    @property
    def path(self) -> str:
        """The rows of this configuration: another one has another folder."""
        return f"{self.out}/rows/{self._own}"

    def _read(self, path: str, base: str | None = None) -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", base or path).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def done(self) -> DataFrame | None:
        return self._read(self.path)

    def histories(self, realization: int | None = None) -> DataFrame | None:
        """``(realization, step, losses, parameters ...)`` of all runs that are kept, or of one, of which only its own partition is listed."""
        base = f"{self.out}/histories/{self._own}"
        steps = self._read(base if realization is None else f"{base}/realization={realization}", base)
        return None if steps is None else steps.select(F.col("realization").cast("long").alias("realization"), *(c for c in steps.columns if c != "realization"))

    def purge(self) -> list[str]:
        """Delete what other configurations left under ``out``, with a warning; their folders are returned."""
        stale = []
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for kind in ("rows", "histories"):
            folder = jvm.org.apache.hadoop.fs.Path(f"{self.out}/{kind}")
            fs = folder.getFileSystem(conf)
            for found in fs.listStatus(folder) if fs.exists(folder) else ():
                name = found.getPath().getName()
                if name.startswith("config=") and name != self._own:
                    fs.delete(found.getPath(), True)
                    stale.append(f"{kind}/{name}")
        if stale:
            warnings.warn(f"the configuration has changed: {', '.join(stale)} of {self.out} are deleted", RuntimeWarning, stacklevel=3)
        return stale

    def _commit(self, fresh: DataFrame) -> None:
        steps = est.histories_of(fresh)
        steps.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("realization").parquet(f"{self.out}/histories/{self._own}")
        files.append_rows(fresh.coalesce(1), self.path)

    def run(self, n: int, network: est.LocalNetwork, observed, estimator) -> dict[str, Any]:
        """Run what is missing of 0..n-1 batch by batch, and return the manifest of this run alone."""
        self.purge()
        began, before = time.time(), self.done()
        had = set() if before is None else {r.realization for r in before.where(F.col("realization").between(0, n - 1)).select("realization").collect()}  # n ids at most
        todo = [k for k in range(n) if k not in had]
        size = self.batch or max(1, self.spark.sparkContext.defaultParallelism)
        shown = 0
        for at in range(0, len(todo), size):
            ids = todo[at : at + size]
            self._commit(checkpointed(est.monte_carlo(self.spark, n, network, observed, estimator, master=self.master, params=tuple(self.truth), histories=True, ids=ids)))
            was, now = len(had) + at, len(had) + at + len(ids)
            if self.progress_every and was // self.progress_every < now // self.progress_every:
                log.info("%d of %d realisations are done", now, n)
            if self.visualize is not None and self.plot_every and was // self.plot_every < now // self.plot_every:
                self.visualize(self.done(), self.histories())
                shown = now
        if self.visualize is not None and todo and shown < len(had) + len(todo):
            self.visualize(self.done(), self.histories())
        now = self.done()
        status, summary = {"completed": 0, "failed": 0}, []
        if todo:
            new = now.join(F.broadcast(self.spark.createDataFrame([(k,) for k in todo], "realization long")), "realization", "left_semi")  # n ids at most
            status = new.agg(F.count_if(F.col("status") == "ok").alias("completed"), F.count_if(F.col("status") != "ok").alias("failed")).first().asDict()
            summary = [r.asDict() for r in series.summary(new, self.truth).collect()]  # a row per parameter
        return provenance(self.config, seconds=time.time() - began, **status, summary=summary)

"""Following runs by their step records as a stream."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netloom.functions.scalar import OPTIMA
from netloom.operators.series import override_tol
from netloom.sources import files


def steps(spark: SparkSession, path: str, params: Sequence[str] = ("beta", "gamma")) -> DataFrame:
    """The step records that arrive as JSON lines in a folder."""
    return files.steps_of(spark.readStream.schema(files.step_schema(params)).json(path), params)


def progress(stream: DataFrame) -> DataFrame:
    """Per realisation: steps so far, last step, mean losses; a running aggregate of one row per run."""
    return stream.groupBy("realization").agg(F.count("*").alias("steps"), F.max("step").alias("last_step"), F.avg("loss_d").alias("loss_d"), F.avg("loss_g").alias("loss_g"))


def start(table: DataFrame, name: str):
    return table.writeStream.outputMode("complete").format("memory").queryName(name).start()


@dataclass(frozen=True)
class Rule:
    """When a run's losses are in equilibrium and its parameters stable, as ``series.loss_band`` and ``series.param_stability`` say."""

    params: tuple[str, ...]
    window: int
    stability_window: int
    tol: float
    overrides: dict[str, float] = field(default_factory=dict)
    min_steps: int = 0
    delta_d: float = 0.01
    delta_g: float = 0.01
    std_max: float = 0.1
    target_d: float = OPTIMA["loss_d"]
    target_g: float = OPTIMA["loss_g_nonsaturating"]

    @property
    def kept(self) -> int:
        """Steps before a step that can matter for it."""
        return max(self.window, self.stability_window) - 1

    def judged(self, values: np.ndarray, number: np.ndarray) -> dict[str, np.ndarray]:
        """The statistics of the rows of values(loss_d, loss_g, params...), the steps of one run after another.

        ``number`` counts a run's steps from 1; a run that goes on begins with its last ``kept`` steps, whose own statistics mean nothing here.
        """
        out = {}

        def rolling(columns: np.ndarray, width: int, of) -> np.ndarray:
            full = np.full(columns.shape, math.nan)
            if len(columns) >= width:
                full[width - 1 :] = of(np.lib.stride_tricks.sliding_window_view(columns, width, axis=0))
            full[number < width] = math.nan  # a window over the end of another run
            return full

        ready = number >= max(self.window, self.min_steps)
        mean, std = rolling(values[:, :2], self.window, lambda w: w.mean(-1)), rolling(values[:, :2], self.window, lambda w: w.std(-1))
        for k, c in enumerate(("loss_d", "loss_g")):
            out[f"{c}_mean"], out[f"{c}_std"] = np.where(ready, mean[:, k], math.nan), np.where(ready, std[:, k], math.nan)
        spread = rolling(values[:, 2:], self.stability_window, lambda w: w.max(-1) - w.min(-1))
        stable = number >= self.stability_window
        for k, p in enumerate(self.params):
            out[f"range_{p}"] = spread[:, k]
            stable = stable & (spread[:, k] <= override_tol(p, self.tol, self.overrides))
        inside = (np.abs(out["loss_d_mean"] - self.target_d) < self.delta_d) & (np.abs(out["loss_g_mean"] - self.target_g) < self.delta_g)
        out["in_equilibrium"] = ready & inside & (out["loss_d_std"] <= self.std_max) & (out["loss_g_std"] <= self.std_max)
        return out | {"stable": stable}


#: Groups that runs are dealt into by a hash; a group has one state and is one call of Python, which costs more than a run's steps do.
#: A checkpoint keeps to the number it began with.
GROUPS = 4096
_STATE = "runs binary, seen binary, stopped binary, tail binary, waiting binary"


def follow(records: DataFrame, rule: Rule, lateness: str, key: str = "realization") -> DataFrame:
    """Each step of each run once it is closed: key, step, at, the rolling statistics of ``rule``, and stop.

    ``records`` is a stream with the run's ``key`` (long), the event time ``ts``, an ``id`` (long)
    that orders records of equal time, loss_d, loss_g and the rule's parameters. A record is closed
    when the watermark, the latest event time less ``lateness``, has passed it; the closed records of a
    run are numbered 0, 1, ... by (ts, id). So the order in which files arrive plays no part, as long as nothing
    comes later than ``lateness``; what does is left out and counted in the query's progress
    (``numRowsDroppedByWatermark``). ``stop`` marks the first step at which losses are in equilibrium and parameters stable.
    ``at`` is the event time in microseconds.

    The state of a run is its last few steps and the records that aren't closed; runs are dealt into GROUPS states, which go into the
    query's checkpoint, so a restart carries on where the last batch ended. Records without a key or time take no part.
    """
    names = ["loss_d", "loss_g", *rule.params]
    wide = len(names)
    clean = records.where(F.col(key).isNotNull() & F.col("ts").isNotNull())
    clean = clean.select(F.col(key).cast("long").alias(key), F.col("ts"), F.unix_micros("ts").alias("at"), F.col("id").cast("long").alias("id"), *(F.col(c).cast("double").alias(c) for c in names))
    ranges = "".join(f", range_{p} double" for p in rule.params)
    shape = f"{key} long, step int, at long, loss_d_mean double, loss_d_std double, loss_g_mean double, loss_g_std double, in_equilibrium boolean{ranges}, stable boolean, stop boolean"

    def closed(of: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored = state.get if state.exists else (b"",) * 5
        runs, seen, stopped = (np.frombuffer(b, t) for b, t in zip(stored, (np.int64, np.int64, bool)))
        tail, rows = np.frombuffer(stored[3], np.float64).reshape(-1, wide), np.frombuffer(stored[4], np.float64).reshape(-1, wide + 3)
        marks, values = [rows[:, :3].view(np.int64)], [rows[:, 3:]]  # whole numbers are carried bit by bit
        for part in parts:
            marks.append(part[[key, "at", "id"]].fillna(0).to_numpy(np.int64))
            values.append(part[names].to_numpy(np.float64))
        mark, value = np.concatenate(marks), np.concatenate(values)
        passed = state.getCurrentWatermarkMs()
        over = mark[:, 1] // 1000 < passed
        if over.any():
            now, new = mark[over], value[over]
            order = np.lexsort((now[:, 2], now[:, 1], now[:, 0]))
            now, new = now[order], new[order]
            every = np.union1d(runs, now[:, 0])
            at = np.searchsorted(every, runs)
            seen, stopped = (np.bincount(at, v, len(every)).astype(v.dtype) for v in (seen, stopped))
            before = np.minimum(seen, rule.kept)
            run = np.concatenate([np.repeat(np.arange(len(every)), before), np.searchsorted(every, now[:, 0])])
            order = np.argsort(run, kind="stable")  # a run's last steps, then its new ones
            run, steps, ts = run[order], np.concatenate([tail, new])[order], np.concatenate([np.zeros(len(tail), np.int64), now[:, 1]])[order]
            size = np.bincount(run, minlength=len(every))
            place = np.arange(len(run)) - (np.cumsum(size) - size)[run]
            number, fresh = (seen - before)[run] + place + 1, place >= before[run]
            told = {c: v[fresh] for c, v in rule.judged(steps, number).items()}
            hits = np.flatnonzero(told["in_equilibrium"] & told["stable"] & ~stopped[run[fresh]])
            who, first = np.unique(run[fresh][hits], return_index=True)
            stop = np.zeros(len(now), bool)
            stop[hits[first]] = True
            yield pd.DataFrame({key: every[run[fresh]], "step": (number[fresh] - 1).astype(np.int32), "at": ts[fresh], **told, "stop": stop})
            stopped[who] = True
            runs, seen = every, seen + size - before
            tail = steps[place >= (size - np.minimum(seen, rule.kept))[run]]
        mark, value = mark[~over], value[~over]
        left = np.concatenate([np.ascontiguousarray(mark).view(np.float64), value], axis=1)
        state.update(tuple(np.ascontiguousarray(v).tobytes() for v in (runs, seen, stopped, tail, left)))
        if len(left):
            state.setTimeoutTimestamp(max(int(mark[:, 1].min() // 1000), passed + 1))

    dealt = clean.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(GROUPS)))
    found = dealt.withWatermark("ts", lateness).groupBy("_group").applyInPandasWithState(closed, shape, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    numbers = [f"{c}_{k}" for c in ("loss_d", "loss_g") for k in ("mean", "std")] + [f"range_{p}" for p in rule.params]
    return found.withColumns({c: F.coalesce(c, F.lit(math.nan)) for c in numbers})  # pandas makes null of what is not a number

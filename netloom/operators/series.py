"""Series of steps and runs: rolling statistics, stopping, tails, envelopes, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _by(key: str, order: str = "step"):
    return Window.partitionBy(key).orderBy(order)


def rolling_mean(df: DataFrame, column: str, window: int, key: str = "realization", order: str = "step", trailing: bool = False) -> DataFrame:
    """df with ``mean``: of the last ``window`` values.

    Trailing, the first values are means of what there is. Otherwise a series begins where its
    first window is full; one shorter than the window is returned as it is.
    """
    if window < 1:
        raise ValueError("the window must be positive")
    w = _by(key, order)
    mean = F.avg(column).over(w.rowsBetween(1 - window, 0))
    if trailing:
        return df.withColumn("mean", mean)
    size = F.count("*").over(Window.partitionBy(key))
    marked = df.withColumn("_k", F.row_number().over(w)).withColumn("_n", size).withColumn("_mean", mean)
    short = F.col("_n") < window
    return marked.where(short | (F.col("_k") >= window)).withColumn("mean", F.when(short, F.col(column)).otherwise(F.col("_mean"))).drop("_k", "_n", "_mean")


def loss_band(df: DataFrame, window: int, min_steps: int = 0, delta_d: float = 0.01, delta_g: float = 0.01, std_max: float = 0.1, target_d: float = 1.3862943611198906, target_g: float = 0.6931471805599453, key: str = "realization") -> DataFrame:
    """df with rolling means and population deviations of both losses, NaN until a window is full, and in_equilibrium.

    Both means must lie strictly within their band, and both deviations must not exceed ``std_max``.
    """
    w = _by(key)
    frame = w.rowsBetween(1 - window, 0)
    ready = F.row_number().over(w) >= max(window, min_steps)
    nan = F.lit(float("nan"))
    out = df
    for c in ("loss_d", "loss_g"):
        out = out.withColumn(f"{c}_mean", F.when(ready, F.avg(c).over(frame)).otherwise(nan)).withColumn(f"{c}_std", F.when(ready, F.stddev_pop(c).over(frame)).otherwise(nan))
    inside = (F.abs(F.col("loss_d_mean") - target_d) < delta_d) & (F.abs(F.col("loss_g_mean") - target_g) < delta_g) & (F.col("loss_d_std") <= std_max) & (F.col("loss_g_std") <= std_max)
    return out.withColumn("in_equilibrium", F.coalesce(ready & inside, F.lit(False)))


def param_stability(df: DataFrame, params: list[str], window: int, tol: float, overrides: dict[str, float] | None = None, key: str = "realization") -> DataFrame:
    """df with ``range_<p>`` over the last ``window`` steps and ``stable``: all ranges within their tolerance, window full."""
    w = _by(key)
    frame = w.rowsBetween(1 - window, 0)
    ready = F.row_number().over(w) >= window
    out = df.withColumns({f"range_{p}": F.when(ready, F.max(p).over(frame) - F.min(p).over(frame)).otherwise(float("nan")) for p in params})
    ok = ready
    for p in params:
        ok = ok & (F.col(f"range_{p}") <= override_tol(p, tol, overrides))
    return out.withColumn("stable", ok)


def override_tol(param: str, tol: float, overrides: dict[str, float] | None) -> float:
    """A parameter's own tolerance, by its exact name, or the common one."""
    return (overrides or {}).get(param, tol)


def stopping(df: DataFrame, params: list[str], *, window: int, stability_window: int, tol: float, min_steps: int = 0, overrides: dict[str, float] | None = None, key: str = "realization", **band) -> DataFrame:
    """``(key, first_step)``: the first step at which the losses are in their band and the parameters stable; null if none."""
    both = param_stability(loss_band(df, window, min_steps, key=key, **band), params, stability_window, tol, overrides, key)
    return both.groupBy(key).agg(F.min(F.when(F.col("in_equilibrium") & F.col("stable"), F.col("step"))).alias("first_step"))


def tail(df: DataFrame, window: int, key: str = "realization") -> DataFrame:
    """The last ``window`` rows of each series (all of a shorter one)."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("step")))
    return df.withColumn("_k", at).where(F.col("_k") <= window).drop("_k")


def tail_view(df: DataFrame, window: int, key: str = "realization") -> DataFrame:
    """``tail``, or an error for a series shorter than the window."""
    n = F.count("*").over(Window.partitionBy(key))
    checked = df.withColumn("_n", n).withColumn("step", F.when(F.col("_n") >= window, F.col("step")).otherwise(F.raise_error(F.lit("the window is longer than a history")).cast("int")))
    return tail(checked.drop("_n"), window, key)


def estimates(df: DataFrame, params: list[str], window: int, key: str = "realization") -> DataFrame:
    """``(key, param, coef, final, path_sd)``: mean of the tail, last value, and the tail's population deviation (no standard error)."""
    last = tail(df, window, key).groupBy(key).agg(*(a for p in params for a in (F.avg(p).alias(f"{p}|coef"), F.max_by(p, "step").alias(f"{p}|final"), F.coalesce(F.stddev_pop(p), F.lit(0.0)).alias(f"{p}|path_sd"))))
    rows = F.array(*(F.struct(F.lit(p).alias("param"), F.col(f"{p}|coef").alias("coef"), F.col(f"{p}|final").alias("final"), F.col(f"{p}|path_sd").alias("path_sd")) for p in params))
    return last.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def recovery(table: DataFrame, truth: DataFrame) -> DataFrame:
    """The estimates beside the true values: param, coef, true, abs_err, path_sd; NaN where no truth is known."""
    known = table.join(F.broadcast(truth.select("param", F.col("value").alias("true"))), "param", "left").withColumn("true", F.coalesce("true", F.lit(float("nan"))))  # a row per parameter
    return known.withColumn("abs_err", F.abs(F.col("coef") - F.col("true")))


def padded(df: DataFrame, horizon: int, columns: list[str], key: str = "realization") -> DataFrame:
    """Each series at steps 0..horizon-1: cut, or carried on with its last value."""
    grid = df.select(key).distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    w = _by(key).rowsBetween(Window.unboundedPreceding, 0)
    joined = grid.join(df.select(key, "step", *columns), [key, "step"], "left")
    return joined.select(key, "step", *(F.last(c, ignorenulls=True).over(w).alias(c) for c in columns))


def horizon(df: DataFrame) -> int:
    """Steps of the longest series, by its last step; 1 if there is none."""
    top = df.agg(F.max("step").alias("top")).first()["top"]
    return 1 if top is None else top + 1


def check_quantiles(quantiles: list[float]) -> list[float]:
    if len(quantiles) != 5 or any(not 0 <= q <= 1 for q in quantiles) or sorted(quantiles) != list(quantiles):
        raise ValueError("five quantiles between 0 and 1 in ascending order are needed")
    return list(quantiles)


def quantile_paths(df: DataFrame, column: str, quantiles: list[float] = [0.05, 0.25, 0.5, 0.75, 0.95]) -> DataFrame:  # noqa: B006
    """``(step, q0..q4)``: exact quantiles over runs at each step, with linear interpolation."""
    qs = check_quantiles(quantiles)
    got = df.groupBy("step").agg(F.percentile(column, F.array(*map(F.lit, qs))).alias("q"))
    return got.select("step", *(F.col("q")[i].alias(f"q{i}") for i in range(5)))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def errors(rows: DataFrame, truth: dict[str, float]) -> DataFrame:
    """``(param, realization, error)`` of the runs that are ok, for finite estimates."""
    ok = rows.where("status is null or status = 'ok'")
    long = ok.select("realization", F.explode(F.array(*(F.struct(F.lit(p).alias("param"), (F.col(f"{p}_hat") - v).alias("error")) for p, v in truth.items()))).alias("e")).select("e.param", "realization", "e.error")
    return long.where(finite(F.col("error")))


def summary(rows: DataFrame, truth: dict[str, float]) -> DataFrame:
    """``(param, mean, std, median, count, true, bias, rmse)`` over finite estimates of the runs that are ok."""
    err = errors(rows, truth)
    true = F.create_map(*(F.lit(x) for p, v in truth.items() for x in (p, float(v))))[F.col("param")]
    v = F.col("error") + true
    return err.withColumn("v", v).withColumn("true", true).groupBy("param").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.percentile("v", 0.5).alias("median"), F.count("*").alias("count"),
        F.max("true").alias("true"), F.avg("error").alias("bias"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
    )


def histogram(df: DataFrame, column: str, bins: int, key: str | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """``(key, bin, n, density)``: equal-width bins from the least to the greatest value, or given ends; the last one is closed."""
    keys = [key] if key else []
    ends = df.groupBy(*keys).agg((F.min(column) if low is None else F.lit(float(low))).alias("_lo"), (F.max(column) if high is None else F.lit(float(high))).alias("_hi"), F.count("*").alias("_n"))
    joined = df.join(ends, keys) if keys else df.crossJoin(F.broadcast(ends))  # without a key, one row of ends
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col(column) - F.col("_lo")) / width), F.lit(bins - 1)))
    return joined.withColumn("bin", at.cast("int")).groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.max(F.when(width > 0, 1 / (F.col("_n") * width)).otherwise(1 / F.col("_n"))).alias("_u")).withColumn("density", F.col("n") * F.col("_u")).drop("_u")


def pending(done: DataFrame, n: int) -> DataFrame:
    """``(realization)``: the runs 0..n-1 of which no row is there, whatever its status."""
    spark = done.sparkSession
    return spark.range(n).select(F.col("id").alias("realization")).join(done.select("realization").distinct(), "realization", "left_anti")

"""Files: result tables, manifests, step records, hashes."""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from netloom.operators.contracts import STEP_SCHEMA


def write_csv(df: DataFrame, path: str) -> None:
    """A table as CSV with a header; an empty one is an error."""
    if df.isEmpty():
        raise ValueError("there are no rows to write")
    df.write.mode("overwrite").csv(path, header=True)


def check_rows(header: Sequence[str], rows: Sequence[Sequence[Any]]) -> None:
    """Rows must be there and as wide as the header."""
    if not rows:
        raise ValueError("there are no rows to write")
    for k, row in enumerate(rows):
        if len(row) != len(header):
            raise ValueError(f"row {k} has {len(row)} values; the header has {len(header)}")


def append_rows(df: DataFrame, path: str, history: bool = False) -> None:
    """Append to a Parquet table in the columns it has: others are left out, missing ones are null; ``history`` is written only if asked for."""
    df = df if history else df.drop("history")
    spark = df.sparkSession
    try:
        known = spark.read.parquet(path).schema
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = df.schema
    cols = [F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in known]
    df.select(*cols).write.mode("append").parquet(path)


def kind(name: str) -> str:
    """The type of a result column by its name."""
    if name.endswith("_seed") or name in ("realization", "final_step"):
        return "bigint"
    if name.endswith(("_hat", "_final", "_init")) or name == "elapsed_seconds":
        return "double"
    return "boolean" if name == "converged" else "string"


def _typed(name: str) -> Column:
    text = F.trim(F.col(name))
    if kind(name) == "boolean":
        low = F.lower(text)
        return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)
    return text.try_cast(kind(name)) if kind(name) != "string" else F.col(name)


def typed_rows(text: DataFrame) -> DataFrame:
    """Result rows read as strings, typed by their columns' names; rows without a number of their run are left out."""
    return text.select(*(_typed(c).alias(c) for c in text.columns)).where("realization is not null")


def load_results(spark: SparkSession, path: str) -> DataFrame | None:
    """The result rows of a CSV, or None where there is none; how many were malformed is a warning."""
    try:
        text = spark.read.csv(path, header=True)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    rows = typed_rows(text)
    if lost := text.count() - rows.count():
        warnings.warn(f"{lost} malformed rows of {path} are left out", RuntimeWarning, stacklevel=2)
    return rows


def save_manifest(path: str, manifest: Mapping[str, Any]) -> None:
    """A manifest as JSON, written only once it is known to be serialisable."""
    text = json.dumps(manifest, indent=2, sort_keys=True, default=str)
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        f.write(text + "\n")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, sha256)`` of each file; a missing one is an error."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def as_json_line(event: str) -> Column:
    """A row as one JSON record with the kind of event in it."""
    return F.to_json(F.struct(F.lit(event).alias("event"), F.col("*")))


def step_schema(params: Sequence[str] = ("beta", "gamma")) -> str:
    """The columns of a line of step records: the kind of event, the run, ``contracts.STEP_FIELDS``, and parameters by name.

    A file with fewer of them, as older ones have, is read with nulls in their place; further ones are left out.
    """
    return f"event string, realization bigint, {STEP_SCHEMA}" + "".join(f", `{p}` double" for p in params)


def steps_of(lines: DataFrame, params: Sequence[str] = ("beta", "gamma")) -> DataFrame:
    """The step records among lines, batch or stream, each parameter by its own name or out of ``params``."""
    return lines.where("event = 'step'").drop("event").withColumns({p: F.coalesce(F.col(p), F.col("params")[p]) for p in params})


def write_steps(df: DataFrame, path: str) -> None:
    df.select(as_json_line("step").alias("value")).write.mode("append").text(path)


def read_steps(spark: SparkSession, path: str, params: Sequence[str] = ("beta", "gamma")) -> DataFrame:
    return steps_of(spark.read.schema(step_schema(params)).json(path), params)

"""Graphs, attributes and series derived from the star-schema tables.

Two parts are neighbours if one order has both, each in a line of at least a given quantity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from netloom.functions.scalar import gaussian_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_edges(spark: SparkSession, sf_dir: str, quantity: int = 40) -> DataFrame:
    """``(src, dst)`` in both directions, distinct: parts that meet in an order.

    The pairs of an order are made within its own set of parts (seven lines at most), so the
    only shuffles are by order and by pair.
    """
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= quantity)
    sets = lines.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    one = sets.select(F.explode("parts").alias("src"), "parts")
    return one.select("src", F.explode("parts").alias("dst")).where("src <> dst").distinct()


def loops(edges: DataFrame, every: int = 97) -> DataFrame:
    """The edges and a self-loop at each node whose id is divisible by ``every``."""
    nodes = edges.select(F.col("src").alias("id")).where(F.col("id") % every == 0).distinct()
    return edges.union(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")))


def price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, x)``: the retail price in thousands."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 1000).alias("x"))


def part_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, x0, x1, x2)``: size, price in thousands, mean discount."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x0"), (F.col("p_retailprice") / 1000).alias("x1"))
    discount = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.avg("l_discount").alias("x2"))
    return part.join(discount, "id", "left").withColumn("x2", F.coalesce("x2", F.lit(0.0)))


def nodes(edges: DataFrame, values: DataFrame) -> DataFrame:
    """The rows of ``values`` for the nodes of a graph."""
    return values.join(edges.select(F.col("src").alias("id")).distinct(), "id")


def shocked(df: DataFrame, seed: int = 7, column: str = "eps", sigma: float = 1.0) -> DataFrame:
    return df.withColumn(column, sigma * gaussian_hash(seed, "eps", F.col("id")))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(realization, step, loss_d, loss_g, beta, gamma)``: the events of a user as the steps of a run."""
    events = table(spark, sf_dir, "events")
    step = F.expr("row_number() over (partition by user_id order by ts, event_id) - 1").cast("int")
    v = F.col("value") / 100
    return events.select(
        F.col("user_id").alias("realization"),
        step.alias("step"),
        (1.3863 + 0.05 * F.sin(v)).alias("loss_d"),
        (0.6931 + 0.04 * F.cos(v)).alias("loss_g"),
        (0.4 + 0.1 * F.sin(3 * v)).alias("beta"),
        (1.5 + 0.2 * F.cos(2 * v)).alias("gamma"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(realization, status, beta_hat, gamma_hat, final_step)``: one row a user, some failed or not a number."""
    h = history(spark, sf_dir).groupBy("realization").agg(F.avg("beta").alias("beta_hat"), F.avg("gamma").alias("gamma_hat"), F.count("*").cast("int").alias("final_step"))
    bad = F.col("realization") % 11 == 3
    status = F.when(bad, "failed:nan_loss").otherwise("ok")
    gone = F.when(bad | (F.col("realization") % 13 == 5), float("nan"))
    return h.select("realization", status.alias("status"), F.coalesce(gone, "beta_hat").alias("beta_hat"), F.coalesce(gone, "gamma_hat").alias("gamma_hat"), "final_step")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(slot, role, logit)`` from the events, real and fake by turns."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("slot"), F.when(F.col("event_id") % 2 == 0, "real").otherwise("fake").alias("role"), (2 * F.sin(F.col("value"))).alias("logit")
    )

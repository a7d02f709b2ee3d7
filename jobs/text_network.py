"""A network data set from a corpus: who shares lines with whom, with the covariates that peer-effect models take.

    python -m jobs.text_network DOCUMENTS LABELS OUT [--config jobs/text_network.json]

DOCUMENTS and LABELS are Parquet tables in the columns of ``documents`` and ``labels``. OUT gets three
Parquet tables: ``nodes`` by language, ``edges`` by a bucket of the source node, and ``report``, one row. A call makes them
anew from the whole tables; the same tables give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobs.common import log, main
from netloom.operators import equilibrium, graph
from netloom.operators.components import checkpointed, rekeyed

DEFAULTS = {"least_chars": 40, "buckets": 16}


def shared_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """``(src, dst)``: each document with the first one, by id, that has a line of its own too.

    Lines are parted by line feeds and count without outer blanks, from ``least_chars``
    characters on. A line in n documents gives n - 1 edges and no pairs: the first document that has it is taken
    for its origin. Rows without an id or text have no lines.
    """
    lines = docs.where("doc_id is not null and text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    lines = lines.select("doc_id", F.trim("line").alias("line")).where(F.length("line") >= least_chars)
    # a digest of 256 bits, its first 64 as the key to deal rows by
    digest = F.sha2(F.col("line").cast("binary"), 256)
    lines = checkpointed(lines.select("doc_id", F.xxhash64("line").alias("key"), F.unhex(digest).alias("line")).distinct())
    first = lines.groupBy("key", "line").agg(F.min("doc_id").alias("origin"), F.count("*").alias("n")).where("n > 1").select("key", "line", "origin")
    met = lines.join(rekeyed(first, "key"), ["key", "line"])
    return met.where("doc_id <> origin").select(F.col("doc_id").alias("src"), F.col("origin").alias("dst")).distinct()


def covariates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(id, lang, x, y, known)`` for each doc_id: the logarithm of one and its characters, its quality label (0 where none is known).

    Of rows that share a doc_id the longest text counts, and the least language of those; of several labels the greatest.
    """
    text = F.length(F.coalesce("text", F.lit("")))
    one = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(text).alias("size"), F.min("lang").alias("lang"))
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").cast("double").alias("label"))
    joined = one.join(marks, "id", "left")
    return joined.select("id", "lang", F.log1p(F.col("size").cast("double")).alias("x"), F.coalesce("label", F.lit(0.0)).alias("y"), F.when(F.col("label").isNull(), 0.0).otherwise(1.0).alias("known"))


def run(spark: SparkSession, documents: str, labels: str, out: str, least_chars: int = DEFAULTS["least_chars"], buckets: int = DEFAULTS["buckets"]) -> None:
    """Make the network data set of a corpus: the largest component of documents that share lines, with peer means of x and y.

    nodes: id (0..m-1), doc_id, degree, x (standardised over the nodes), peer_x, peer2_x (the peers' peer_x), y,
    known, peer_y (mean label of the labelled peers, null without any), lang. edges: src, dst,
    w (row-stochastic), bucket. report: n, n_edges, self_loops_removed, nodes_dropped, mean_degree, max_degree, branching.
    """
    docs, marks = spark.read.parquet(documents).select("doc_id", "text", "lang"), spark.read.parquet(labels).select("doc_id", "quality")
    pairs = checkpointed(shared_lines(docs, least_chars))
    facts = checkpointed(covariates(docs, marks))
    clean = graph.sanitize(pairs, facts.select("id"))
    weights = checkpointed(graph.row_stochastic(clean.edges))
    ids = checkpointed(clean.ids)
    raw = facts.join(ids, "id").select(F.col("label").alias("id"), F.col("id").alias("doc_id"), "lang", "x", "y", "known")
    spread = raw.agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sigma"))
    x = F.when(F.col("sigma") > 1e-12, (F.col("x") - F.col("mu")) / F.col("sigma")).otherwise(0.0)
    nodes = checkpointed(raw.crossJoin(F.broadcast(spread)).withColumn("x", x).drop("mu", "sigma"))  # one row of statistics
    linked = checkpointed(equilibrium.with_self(weights, nodes))
    one = F.col("w") * F.col("x")
    told = equilibrium.aggregated(linked, nodes, {"degree": F.lit(1.0), "peer_x": one, "_known": F.col("known"), "_y": F.col("known") * F.col("y")})
    told = equilibrium.aggregated(linked, checkpointed(told), {"peer2_x": F.col("w") * F.col("peer_x")})
    told = checkpointed(told)
    peer_y = F.when(F.col("_known") > 0, F.col("_y") / F.col("_known")).alias("peer_y")
    told.select("id", "doc_id", F.col("degree").cast("long").alias("degree"), "x", "peer_x", "peer2_x", "y", "known", peer_y, "lang").write.mode("overwrite").partitionBy("lang").parquet(f"{out}/nodes")
    weights.withColumn("bucket", F.pmod("src", F.lit(buckets)).cast("int")).repartition("bucket", F.pmod(F.xxhash64("src", "dst"), F.lit(8))).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/edges")
    d = F.col("degree")
    growth = told.agg(F.sum("degree").cast("long").alias("n_edges"), F.avg("degree").alias("mean_degree"), F.max("degree").cast("long").alias("max_degree"), (F.sum(d * (d - 1)) / F.sum(d)).alias("branching"))
    report = clean.report.crossJoin(growth)  # one-row tables
    report.select("n", "n_edges", "self_loops_removed", "nodes_dropped", "mean_degree", "max_degree", "branching").coalesce(1).write.mode("overwrite").parquet(f"{out}/report")
    found = spark.read.parquet(f"{out}/report").first()
    log.info("text_network: read %d documents of %s and %d labelled ones of %s; wrote %d nodes and %d edges to %s", facts.count(), documents, facts.where("known > 0").count(), labels, found["n"], found["n_edges"] or 0, out)


if __name__ == "__main__":
    main(run, DEFAULTS, ["documents", "labels", "out"])

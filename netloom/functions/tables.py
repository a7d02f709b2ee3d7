"""Ego objects as table functions of SQL: ``ego_nodes`` and ``ego_edges`` over tables partitioned by root."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from netloom.operators.components import rekeyed
from netloom.operators.graph import balls


class EgoNodes:
    """``ego_nodes(TABLE(members) PARTITION BY root ORDER BY node)``: the members(root, node) of each ego with their places, from 0."""

    def __init__(self):
        self.pos = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        yield row["root"], row["node"], self.pos
        self.pos += 1


class EgoEdges:
    """``ego_edges(TABLE(rows) PARTITION BY root ORDER BY (dst NULLS FIRST, src))``: the edges with both ends in an ego, by place.

    ``rows(root, src, dst)`` are the members, with dst null, and edges that begin at a member.
    What is held is one ego's members.
    """

    def __init__(self):
        self.at: dict[int, int] = {}

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["dst"] is None:
            self.at[row["src"]] = len(self.at)
        elif row["dst"] in self.at:
            yield row["root"], self.at[row["src"]], self.at[row["dst"]]


def register(spark: SparkSession) -> None:
    """Make both functions known to SQL."""
    spark.udtf.register("ego_nodes", F.udtf(EgoNodes, returnType="root bigint, node bigint, pos int"))
    spark.udtf.register("ego_edges", F.udtf(EgoEdges, returnType="root bigint, src_pos int, dst_pos int"))


def ego(edges: DataFrame, k: int, roots: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes(root, node, pos), edges(root, src_pos, dst_pos)) of the egos of radius k, of every node or of ``roots(root)``, by the table functions."""
    spark = edges.sparkSession
    register(spark)
    members = balls(edges, k, roots).select("root", "node")
    nodes = spark.sql("select * from ego_nodes(TABLE(select root, node from {members}) PARTITION BY root ORDER BY node)", members=members)
    begun = members.join(rekeyed(edges.select("src", "dst"), "src"), F.col("node") == F.col("src")).select("root", "src", "dst")
    rows = members.select("root", F.col("node").alias("src"), F.lit(None).cast("long").alias("dst")).union(begun)
    found = spark.sql("select * from ego_edges(TABLE(select root, src, dst from {rows}) PARTITION BY root ORDER BY (dst NULLS FIRST, src))", rows=rows)
    return nodes, found

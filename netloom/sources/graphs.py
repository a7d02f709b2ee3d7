"""Synthetic graphs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from netloom.functions.scalar import uniform_hash
from netloom.operators.components import checkpointed


def ring_lattice(spark: SparkSession, n: int, k: int = 1) -> DataFrame:
    """Each node with the k next ones on either side of a ring; both directions."""
    if n < 2 * k + 1:
        raise ValueError("the ring is too short for its neighbourhoods")
    hops = F.explode(F.array(*(F.lit(h) for h in range(-k, k + 1) if h)))
    return spark.range(n).select(F.col("id").alias("src"), hops.alias("h")).select("src", F.pmod(F.col("src") + F.col("h"), F.lit(n)).cast("long").alias("dst"))


def path(spark: SparkSession, n: int) -> DataFrame:
    a = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    return a.union(a.select("dst", "src"))


def star(spark: SparkSession, leaves: int) -> DataFrame:
    a = spark.range(1, leaves + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    return a.union(a.select("dst", "src"))


def complete(spark: SparkSession, n: int) -> DataFrame:
    """All ordered pairs; for small n."""
    ends = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    return spark.range(n).select(F.col("id").alias("src"), ends.alias("dst")).where("src <> dst")


def grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    at = spark.range(rows * cols)
    right = at.where(F.col("id") % cols != cols - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    down = at.where(F.col("id") < (rows - 1) * cols).select(F.col("id").alias("src"), (F.col("id") + cols).alias("dst"))
    a = right.union(down)
    return a.union(a.select("dst", "src"))


def from_pairs(spark: SparkSession, pairs: np.ndarray) -> DataFrame:
    """Both directions of the rows of an (m, 2) array, distinct and without self-loops."""
    both = np.concatenate([pairs, pairs[:, ::-1]]).astype(np.int64)
    both = np.unique(both[both[:, 0] != both[:, 1]], axis=0)
    return spark.createDataFrame(pa.table({"src": both[:, 0], "dst": both[:, 1]}), "src long, dst long")


def barabasi_albert_pairs(n: int, m: int, seed: int) -> np.ndarray:
    """Preferential attachment: each new node joins m earlier ones, drawn from the list of all edge ends so far."""
    if not 1 <= m < n:
        raise ValueError("m must be at least 1 and below n")
    draw = np.random.default_rng(seed)
    ends: list[int] = []
    pairs = []
    targets = list(range(m))
    for new in range(m, n):
        pairs += [(new, t) for t in targets]
        ends += targets + [new] * m
        chosen: set[int] = set()
        while len(chosen) < m:
            chosen.add(ends[draw.integers(len(ends))])
        targets = sorted(chosen)
    return np.array(pairs)


#: Steps after which a draw is given up; each ends with a chance of a half at least.
_STEPS = 128


def barabasi_albert(spark: SparkSession, n: int, m: int = 2, seed: int = 0) -> DataFrame:
    """Preferential attachment without a list of ends: every edge finds its target by itself; both directions, distinct.

    Edge e of node v = m + e // m joins it to the end at a place drawn by a hash of (seed, e) among all
    ends of the edges of earlier nodes. An even place is the start of an edge, which is known; an odd one is the target of an
    earlier edge, which is found in the same way. So a draw costs two steps on average, no edge
    waits for another, and any number of tasks makes the same graph. The first m edges join node m to nodes 0..m-1.
    Of equal draws of a node one edge stays, so a few nodes have less than m; the graph is connected.
    """
    if not 1 <= m < n:
        raise ValueError("m must be at least 1 and below n")

    def one(s: Column, _: Column) -> Column:
        node = F.floor(s / m)  # the node's number behind the first m
        place = F.floor(uniform_hash(seed, "ba", s) * (2 * m * node)).cast("long")
        end = -1 - (m + F.floor(F.floor(place / 2) / m))
        return F.when(s < 0, s).when(s < m, -1 - s).when(place % 2 == 0, end).otherwise(F.floor(place / 2)).cast("long")

    edges = spark.range(m * (n - m))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), F.col("id"), one)
    target = F.when(found < 0, -1 - found).otherwise(F.raise_error(F.lit("a draw did not end")).cast("long"))
    pairs = edges.select((m + F.floor(F.col("id") / m)).cast("long").alias("src"), target.alias("dst"))
    return pairs.union(pairs.select("dst", "src")).distinct()


#: Nodes of a block in which communities are drawn, by the largest community; stubs of a bucket in which they are matched.
_BLOCK, _BUCKET = 100, 512


def least_degree(tau: float, top: float, average: float) -> float:
    """The least value of a power law up to ``top`` that gives a mean."""
    low, high = 1.0, float(average)
    for _ in range(50):
        mid = (low + high) / 2
        mean = (1 - tau) / (2 - tau) * (top ** (2 - tau) - mid ** (2 - tau)) / (top ** (1 - tau) - mid ** (1 - tau))
        low, high = (mid, high) if mean < average else (low, mid)
    return low


@dataclass(frozen=True)
class Law:
    """A power law between two values, by its inverse: ``power(base + u * width, root)`` for a uniform u."""

    base: float
    width: float
    root: float

    @classmethod
    def of(cls, tau: float, low: float, high: float) -> "Law":
        a = 1 - tau
        return cls(low**a, high**a - low**a, 1 / a)

    def column(self, u: Column) -> Column:
        return F.pow(self.base + u * self.width, F.lit(self.root))


def lfr(
    spark: SparkSession, n: int, seed: int = 0, *, tau1: float = 2.5, tau2: float = 1.5, mu: float = 0.3, average_degree: float | None = None, min_degree: int | None = None,
    max_degree: int | None = None, min_community: int = 20, max_community: int = 100,
) -> DataFrame:
    """A community graph made by any number of tasks: power-law degrees and community sizes, a share ``mu`` of each degree between communities.

    All draws are hashes. Nodes lie in blocks, and each block is filled with communities one behind the other; a rest that is too small
    joins the one before. A node has as many inner stubs as its community allows, the others are outer ones. The stubs of a community
    are put in a random order and joined two by two, outer stubs likewise in random buckets. Loops, repeated edges and outer pairs of one
    community are left out, so degrees fall a little short. Both directions, distinct.
    """
    if (average_degree is None) == (min_degree is None):
        raise ValueError("give exactly one of average_degree and min_degree")
    if not 1 < min_community <= max_community or n < min_community:
        raise ValueError("communities must fit into the graph")
    top = max_degree or n - 1
    degrees = Law.of(tau1, float(min_degree) if average_degree is None else least_degree(tau1, top, average_degree), top)
    sizes = Law.of(tau2, min_community, max_community)
    width = _BLOCK * max_community
    blocks = max(1, n // width)
    length = F.when(F.col("block") == blocks - 1, n - F.col("block") * width).otherwise(width)
    drawn = spark.range(blocks).select(F.col("id").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(2 * width // min_community))).alias("j")).withColumn("length", length)
    drawn = drawn.withColumn("size", F.floor(sizes.column(uniform_hash(seed, "size", F.col("block"), F.col("j")))))
    in_block = Window.partitionBy("block").orderBy("j")
    drawn = drawn.withColumn("start", F.sum("size").over(in_block) - F.col("size")).where("start < length")
    drawn = drawn.withColumn("next", F.lead("start").over(in_block))
    short = F.col("length") - F.col("next") < min_community  # what is left for the last one
    last = F.col("next").isNull()
    drawn = drawn.where(~(last & (F.col("length") - F.col("start") < min_community) & (F.col("j") > 0)))
    drawn = drawn.withColumn("end", F.when(last | short, F.col("length")).otherwise(F.col("next")))
    node = (F.col("block") * width + F.col("pos")).cast("long")
    nodes = drawn.select((F.col("block") * 2**20 + F.col("j")).alias("c"), (F.col("end") - F.col("start")).alias("size"), "block", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    nodes = nodes.select(node.alias("v"), "c", "size").withColumn("degree", F.greatest(F.rint(degrees.column(uniform_hash(seed, "degree", F.col("v")))).cast("long"), F.lit(1)))
    inner = F.least(F.rint((1 - mu) * F.col("degree")).cast("long"), F.col("size") - 1)
    nodes = checkpointed(nodes.withColumn("inner", inner).select("v", "c", "inner", (F.col("degree") - F.col("inner")).alias("outer")))
    buckets = max(1, (nodes.agg(F.sum("outer")).first()[0] or 0) // _BUCKET)

    def matched(kind: str, group: Column) -> DataFrame:
        """Neighbours in a random order of each group's stubs, two by two."""
        stubs = nodes.where(F.col(kind) > 0).select("v", "c", F.explode(F.sequence(F.lit(1).cast("long"), F.col(kind))).alias("i")).withColumn("g", group)
        order = Window.partitionBy("g").orderBy(uniform_hash(seed, kind, F.col("v"), F.col("i")), "v", "i")
        pairs = stubs.select("v", "c", F.lead("v").over(order).alias("to"), F.lead("c").over(order).alias("to_c"), F.row_number().over(order).alias("k"))
        return pairs.where("k % 2 = 1 and to is not null and v <> to")

    bucket = F.floor(uniform_hash(seed, "bucket", F.col("v"), F.col("i")) * buckets)
    pairs = matched("inner", F.col("c")).union(matched("outer", bucket).where("c <> to_c")).select(F.col("v").alias("src"), F.col("to").alias("dst"))
    return pairs.union(pairs.select("dst", "src")).distinct()

"""Network data: a clean graph with covariates and one outcome, given or simulated."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from netloom.functions.scalar import gaussian_hash
from netloom.operators import graph
from netloom.operators.components import checkpointed
from netloom.operators.games import EffortGame, Game, LinearInMeans
from netloom.sources import graphs as gen

LINEAR_TRUTH = {"beta": 0.4, "gamma": 1.5, "sigma_sq": 1.0}
EFFORT_TRUTH = {"gamma": 1.5, "lambda_": 2 / 3, "mu": 0.5, "r": 1.0, "sigma_sq": 1.0}


@dataclass(frozen=True)
class Substrate:
    """A graph labelled 0..n-1 with weights and covariates, and no outcome; shared by realisations."""

    edges: DataFrame
    weights: DataFrame
    covariates: DataFrame
    n: int
    k: int
    report: DataFrame | None = None

    @classmethod
    def from_edges(cls, edges: DataFrame, covariates: DataFrame, *, k: int = 2, symmetric: bool = True) -> "Substrate":
        """From clean edges over 0..n-1; both directions are added unless told otherwise."""
        if k < 1:
            raise ValueError("k must be positive")
        edges = checkpointed(graph.symmetrize(edges) if symmetric else edges.select("src", "dst"))
        n = covariates.count()
        told = graph.validated(edges, n).first()
        if not told["ok"]:
            raise ValueError(f"unusable edges: {told.asDict()}")
        names = [c for c in covariates.columns if c != "id"]
        bad = [r["column"] for r in graph.invalid_values(covariates, names).collect() if r["invalid"]]
        flat = [r["column"] for r in graph.vector_stats(covariates, names).collect() if not (r["sigma"] or 0) > 1e-12]
        if bad or flat:
            raise ValueError(f"covariates that are not finite: {bad}; that don't vary: {flat}")
        return cls(edges, checkpointed(graph.row_stochastic(edges)), covariates, n, k)

    @classmethod
    def from_graph(cls, edges: DataFrame, covariates: DataFrame, *, k: int = 2) -> "Substrate":
        """From a messy graph: cleaned, cut to its largest component and relabelled."""
        clean = graph.sanitize(edges, covariates.select("id"))
        base = cls.from_edges(clean.edges, graph.reindexed(covariates, clean.ids), k=k, symmetric=False)
        return cls(base.edges, base.weights, base.covariates, base.n, k, clean.report)

    def balls(self, radius: int | None = None, roots: DataFrame | None = None) -> DataFrame:
        return graph.balls(self.edges, radius or self.k, roots)

    def warn_if_overlapping(self, exclusion_r: int | None) -> None:
        """Ego objects of radius k surely share no node only if roots lie 2k apart."""
        if exclusion_r is not None and exclusion_r < 2 * self.k:
            warnings.warn(f"exclusion radius {exclusion_r} < 2*k = {2 * self.k}: ego objects may overlap", UserWarning, stacklevel=2)


@dataclass(frozen=True)
class NetworkData:
    """A substrate and one validated outcome (id, y)."""

    substrate: Substrate
    outcome: DataFrame

    def __post_init__(self):
        told = self.outcome.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(F.col("y").isNull() | F.isnan("y") | (F.abs("y") == float("inf"))).alias("bad")).first()
        if told["n"] != self.substrate.n or told["ids"] != told["n"] or told["bad"]:
            raise ValueError(f"an outcome needs one finite y per node: {told.asDict()}")

    @classmethod
    def simulate(cls, substrate: Substrate, game: Game, seed: int = 0) -> "NetworkData":
        solved = game.simulate(substrate.weights, substrate.covariates, seed)
        return cls(substrate, solved.nodes.select("id", "y"))

    @classmethod
    def from_graph(cls, edges: DataFrame, nodes: DataFrame, *, k: int = 2) -> "NetworkData":
        """From a messy graph and nodes(id, covariates ..., y), which are reindexed onto the nodes that are kept."""
        clean = graph.sanitize(edges, nodes.select("id"))
        kept = checkpointed(graph.reindexed(nodes, clean.ids))
        base = Substrate.from_edges(clean.edges, kept.drop("y"), k=k, symmetric=False)
        return cls(replace(base, report=clean.report), kept.select("id", "y"))

    @classmethod
    def from_edges(cls, edges: DataFrame, nodes: DataFrame, *, k: int = 2, symmetric: bool = True) -> "NetworkData":
        """From clean edges over 0..n-1 and nodes(id, covariates ..., y)."""
        return cls(Substrate.from_edges(edges, nodes.drop("y"), k=k, symmetric=symmetric), nodes.select("id", "y"))

    # what a data set consists of

    @property
    def num_nodes(self) -> int:
        return self.substrate.n

    @property
    def k(self) -> int:
        return self.substrate.k

    @property
    def topology(self) -> Substrate:
        return self.substrate

    @property
    def weights(self) -> DataFrame:
        return self.substrate.weights

    @property
    def covariates(self) -> DataFrame:
        return self.substrate.covariates

    @property
    def report(self) -> DataFrame | None:
        """Counts of what cleaning took out, or None for a graph that came clean."""
        return self.substrate.report

    @property
    def nodes(self) -> DataFrame:
        return self.substrate.covariates.join(self.outcome, "id")

    def undirected(self) -> DataFrame:
        return graph.undirected(self.substrate.edges)


def generated(spark: SparkSession, kind: str, n: int, seed: int, **how) -> DataFrame:
    if kind == "ba":
        return gen.barabasi_albert(spark, n, how.pop("m", 2), seed, **how)
    if kind == "lfr":
        tau1, top = how.get("tau1", 2.5), how.get("max_degree")
        if 2 < tau1 < 3:
            warnings.warn(f"degree exponent {tau1} lies in (2, 3): the second moment diverges as n grows", RuntimeWarning, stacklevel=3)
        if top is None and n >= 1000 or top is not None and top > 3 * n**0.5:
            warnings.warn("the largest degree may grow faster than sqrt(n)", RuntimeWarning, stacklevel=3)
        return gen.lfr(spark, n, seed, **how)
    raise ValueError(f"no generator {kind!r}")


def _made(spark: SparkSession, game: Game, kind: str, n: int, k: int, seed: int, how: dict) -> NetworkData:
    edges = generated(spark, kind, n, seed, **how)
    x = spark.range(n).withColumn("x", gaussian_hash(seed + 1, "x", F.col("id")))
    return NetworkData.simulate(Substrate.from_graph(edges, x, k=k), game, seed + 2)


def linear_in_means(spark: SparkSession, n: int = 10_000, kind: str = "ba", k: int = 2, truth: dict | None = None, beta_cap: float = 0.85, seed: int = 0, **how) -> NetworkData:
    """A graph (seed), X ~ N(0, 1) (seed + 1) and the linear game's y at the truth (seed + 2)."""
    return _made(spark, LinearInMeans(truth or LINEAR_TRUTH, beta_cap=beta_cap), kind, n, k, seed, how)


def effort_game(
    spark: SparkSession, n: int = 10_000, kind: str = "ba", k: int = 2, truth: dict | None = None, lambda_max: float = 4.0, fix_r: float | None = 1.0, fix_sigma_sq: float | None = 1.0, seed: int = 0, **how
) -> NetworkData:
    """The same for the effort game; fixed values take the place of true ones."""
    fixed = {"r": fix_r, "sigma_sq": fix_sigma_sq}
    values = {k: v for k, v in (truth or EFFORT_TRUTH).items() if fixed.get(k) is None}
    return _made(spark, EffortGame(values, lambda_max=lambda_max, fix_r=fix_r, fix_sigma_sq=fix_sigma_sq), kind, n, k, seed, how)

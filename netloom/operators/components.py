"""Connected components as alternating star contractions."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Narrow rows of a file at most, about.
SLIM_ROWS = 8_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where a session names none, and runs in one process (as in tests), is a local folder used.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints"


def scratch(spark: SparkSession) -> str:
    """The application's own folder in the shared one, for tables that are read again; removed when Python exits."""
    folder = f"{shared_folder(spark)}/netloom-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def checkpointed(df: DataFrame, slim: bool | int = False) -> DataFrame:
    """Cut the lineage: the rows as a Parquet table of their own in the shared folder.

    ``slim`` says that rows are few or narrow, and best how many there may be: they are written in no
    more files than twice the cluster has cores, or one for every SLIM_ROWS if that is more, as a file
    costs more than its rows then.

    A table takes a fraction of the room of an RDD checkpoint, is read by columns and tells its
    size to the planner.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    if slim:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-int(slim) // SLIM_ROWS)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_folders: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended before
        pass


def rekeyed(df: DataFrame, key: str) -> DataFrame:
    """The same rows, with the key behind an expression of equal value.

    An aggregate's output is already dealt by its key, so a join would reuse that dealing and
    adaptive execution could not split a hot key on the other side; this makes the join deal both.
    """
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def components(edges: DataFrame, max_rounds: int = 60, most: int | None = None) -> DataFrame:
    """``(node, component)`` for every node of ``edges(src, dst)``; component is the smallest member.

    Large-star and small-star steps alternate until the edge set no longer changes, which
    takes a number of rounds logarithmic in the longest path. Each step is a partial-aggregated
    minimum per node and a join back, so that a hub costs no more than its edges. Self-loops
    stand for nodes without neighbours; edges with a null end are left out. ``most`` says how many edges
    there may be, where that is known, so that they are written in as few files as that asks for.
    """
    pairs = checkpointed(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), slim=most or False)
    loops = pairs.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    now, mark, rows = pairs.where("src <> dst"), None, max(1, pairs.count())  # what a step makes is no more than it got
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = both.where("dst > src").join(rekeyed(least, "src"), "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(rekeyed(least, "src"), "src").where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        now = checkpointed(small.union(least.select("src", F.col("m").alias("dst"))).distinct(), slim=rows)
        seen = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(src, dst))").alias("x")).first()
        if mark == (seen["n"], seen["x"]):
            break
        mark, rows = (seen["n"], seen["x"]), max(1, seen["n"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = found.select(F.col("component").alias("node"), "component").distinct()
    alone = loops.join(found.union(roots).select("node"), "node", "left_anti")
    return found.union(roots).union(alone)

"""N-gram Jaccard join by MinHash banding (operator 1)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from netloom.llm.text import by_batch, by_group, fresh, mix, shingles
from netloom.operators.components import checkpointed, components, rekeyed
from netloom.operators.graph import relabeled

N, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Members of a block in verification: the least, and the most for very large groups; shingles of a block, about.
BLOCK, BLOCK_MOST, BLOCKS, SHINGLES = 64, 512, 32, 2_000_000


def banding(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 5) -> tuple[int, int]:
    """(bands, rows): the fewest bands by which a pair at the threshold meets with probability ``recall``."""
    if not 0 < threshold < 1 or not 0 < recall < 1:
        raise ValueError("threshold and recall lie between 0 and 1")
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)), rows


def _bands(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """The band hashes of each set, one row a set; sets must not be empty."""
    draw = np.random.Generator(np.random.PCG64(20_240_501))
    xor, mul = (draw.integers(0, 2**64, bands * rows, dtype=np.uint64) for _ in range(2))
    mul |= np.uint64(1)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    keys = np.zeros((len(sets), bands), np.uint64)
    for part in np.array_split(np.arange(len(sets)), max(1, int(sizes.sum()) // 60_000)):
        if not len(part):
            continue
        x = np.concatenate([sets[i] for i in part])
        at = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
        for b in range(bands):
            key = np.full(len(part), b + 1, np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                key = mix(key + np.minimum.reduceat((x ^ xor[k]) * mul[k], at))
            keys[part, b] = key
    return keys


def _sketch(n: int, bands: int, rows: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, n) for t in batch.column("text").to_pylist()]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        flat = pa.array(_bands([s for s in sets if len(s)], bands, rows).view(np.int64).ravel())
        at = np.zeros(len(sets) + 1, np.int32)
        at[1:] = np.cumsum((sizes > 0) * bands)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.binary()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(at), flat)], ["doc_id", "print", "size", "bands"])

    return by_batch(fn)


def _sets(n: int, bands: int, rows: int):
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The shingle sets, and the band hashes of documents that are verified by bucket."""
        sets = [shingles(t, n) for t in batch.column("text").to_pylist()]
        mine = [bool(u and u[0]["by"] and len(s)) for u, s in zip(batch.column("units").to_pylist(), sets)]
        found = iter(_bands([s for s, m in zip(sets, mine) if m], bands, rows))
        keys = [next(found).tobytes() if m else None for m in mine]
        cols = [*(batch.column(c) for c in ("node", "copies", "units")), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(keys, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["node", "copies", "units", "set", "bands"])

    return by_batch(fn)


def overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of some sets of hashes, in column chunks of bounded width."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    rank = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], rank[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n))
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [at, at + width])
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        out += m @ m.T
    return out


def _met_before(keys: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Whether two members of a band's bucket share an earlier band as well, or one of them lacks this one."""
    own = keys == band
    at = np.where(own.any(1), own.argmax(1), -1)
    out = (at[:, None] != at) | (at < 0)[:, None]
    for k in range(int(at.max(initial=0))):
        out |= (keys[:, k][:, None] == keys[:, k]) & (at > k)
    return out


def _verify(threshold: float):
    def fn(group: pa.Table) -> pa.RecordBatch:
        node, copies, block = (group.column(c).to_numpy() for c in ("node", "copies", "block"))
        sets = [np.frombuffer(s, np.uint64) for s in group.column("set").to_pylist()]
        size = np.array([len(s) for s in sets])
        common = overlaps(sets)
        linked = (common > 0) & (common >= threshold * (size[:, None] + size - common) - 1e-9)
        if group.column("i")[0].as_py() != group.column("j")[0].as_py():
            linked &= block[:, None] != block
        if group.column("by")[0].as_py():
            keys = np.array([np.frombuffer(b, np.uint64) for b in group.column("bands").to_pylist()])
            linked &= ~_met_before(keys, np.array(group.column("key")[0].as_py(), np.int64).view(np.uint64))
        np.fill_diagonal(linked, False)
        linked &= node[:, None] != node
        counts = (linked * copies).sum(1)
        root = np.arange(len(node))
        while True:  # the least linked index, to a fixed point: a spanning forest in place of all pairs
            low = np.minimum(root, np.where(linked, root, len(node)).min(1))
            low = low[low]
            if (low == root).all():
                break
            root = low
        some = counts > 0
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(counts[some].astype(np.int64)), pa.array(node[root[some]])], ["node", "links", "root"])

    return by_group(["by", "key", "i", "j"], fn)


def _blocks() -> Column:
    """Into how many blocks a group of ``n`` members with ``shingles`` in all is dealt."""
    most = F.greatest(F.ceil(F.col("n") / BLOCK_MOST), F.ceil(F.col("shingles") / SHINGLES))
    return F.greatest(most, F.least(F.lit(BLOCKS), F.ceil(F.col("n") / BLOCK))).cast("int").alias("blocks")


def _unit(key: str, by: bool) -> Column:
    return F.struct(F.col(key).alias("key"), F.lit(by).alias("by"), "blocks").alias("unit")


def _units(members: DataFrame, met: DataFrame) -> DataFrame:
    """``(node, copies, units)``: the units of work that verify each of members(node, component, copies, size).

    A unit is a whole candidate component, or, where a component of more than BLOCK_MOST members
    would take more comparisons so, as chains of unlike texts do, the buckets of met(node, band) in it.
    """
    most = max(1, members.count())  # of a table that is written
    groups = members.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    large = checkpointed(groups.where(F.col("n") > BLOCK_MOST).select("component", "n"), slim=most // BLOCK_MOST + 1)
    whole, apart = members, None
    if large.limit(1).count():
        inside = members.select("node", "size", "component").join(rekeyed(large.select("component"), "component"), "component", "left_semi")
        rows = checkpointed(met.join(inside, "node").select("node", "band", "component", "size"), slim=most * BLOCKS)  # about as many bands
        buckets = rows.groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")).where("n > 1")
        dear = buckets.groupBy("component").agg(F.sum(F.col("n") * F.col("n")).alias("cost"))
        split = checkpointed(large.join(dear, "component").where(F.col("cost") < F.col("n") * F.col("n")).select("component"), slim=most // BLOCK_MOST + 1)
        split = rekeyed(split, "component")
        whole = members.join(split, "component", "left_anti")
        buckets = buckets.join(split, "component", "left_semi").select("band", _blocks())
        apart = rows.join(rekeyed(buckets, "band"), "band").select("node", _unit("band", True))
    units = whole.join(rekeyed(groups.select("component", _blocks()), "component"), "component").select("node", _unit("component", False))
    if apart is not None:
        units = units.union(apart)
    units = units.groupBy("node").agg(F.collect_list("unit").alias("units"))  # one component, or a bucket a band
    return members.select("node", "copies").join(units, "node")


def _of_one_document(usable: DataFrame, classes: DataFrame) -> DataFrame:
    """``(src, dst)``: nodes whose sets one document has, each with the least of them."""
    nodes = usable.select("doc_id", "print").join(classes.select("print", "node"), "print").select("doc_id", "node").distinct()
    least = nodes.groupBy("doc_id").agg(F.min("node").alias("dst"), F.max("node").alias("top")).where("dst < top").select("doc_id", "dst")
    return nodes.join(rekeyed(least, "doc_id"), "doc_id").where("node <> dst").select(F.col("node").alias("src"), "dst")


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = 5) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, copy_id, class_id, n_copies, n_links.

    Documents whose n-word shingle sets have a Jaccard similarity of ``threshold`` or more are
    linked. ``copy_id`` is the least doc_id with the same set, ``class_id`` the least doc_id
    reachable over links, ``n_copies`` the number of rows with the same set and ``n_links`` that
    of other rows linked to this one, copies included.

    Sets are sketched by MinHash; bands and rows follow from the recall wanted at the threshold.
    Rows with equal sets fold into one class first. Classes that meet under a band hash form
    candidate components (a star per bucket, never its pairs). Each component is verified on the
    full sets in blocks of bounded size, every pair of blocks a unit of work of its own, which
    returns link counts and a spanning forest, not pairs. So a hot group is spread over many
    tasks, and no link between different sets of a component is lost. A large component whose buckets
    have fewer pairs than it has, as in chains of unlike texts, is verified by bucket, each pair in its first common band.

    Null or empty texts have no shingles: they are linked to nothing and are their own class.
    Rows with a null doc_id are returned with null ids and no links. Rows that share a doc_id
    are one document, counted with all its rows for each of its texts that is linked. Other columns of
    ``docs`` are ignored; an empty table gives no rows.
    """
    bands, rows = banding(threshold, recall, rows)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = checkpointed(slim.mapInArrow(_sketch(n, bands, rows), "doc_id long, print binary, size long, bands array<long>"))
    usable = sketched.where("doc_id is not null and print is not null")
    classes = checkpointed(usable.groupBy("print").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    met = classes.select("node", F.explode("bands").alias("band"))
    stars = met.groupBy("band").agg(F.min("node").alias("dst"), F.max("node").alias("top")).where("dst < top").select("band", "dst")
    edges = met.join(rekeyed(stars, "band"), "band").where("node <> dst").select(F.col("node").alias("src"), "dst")
    nodes = classes.groupBy("node").agg(F.sum("copies").alias("copies"), F.sum("size").alias("size"))
    most = max(1, classes.count())
    members = checkpointed(components(edges, most=most * bands).repartition(F.col("node")).join(rekeyed(nodes, "node"), "node"), slim=most)
    units = checkpointed(_units(members, met.distinct()), slim=most)
    texts = slim.join(units, slim["doc_id"] == units["node"]).select("node", "copies", "units", "text")
    shape = "units array<struct<key: long, by: boolean, blocks: int>>"
    sets = texts.mapInArrow(_sets(n, bands, rows), f"node long, copies long, {shape}, set binary, bands binary")
    if repeated := usable.groupBy("doc_id").count().where("count > 1").limit(1).count():  # each set once
        sets = sets.dropDuplicates(["node", "set"])
    sets = sets.withColumn("unit", F.explode("units")).select("node", "copies", "set", "bands", "unit.*")
    units = (
        sets.withColumn("block", F.expr("pmod(xxhash64(node), blocks)").cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .select("by", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "set", "bands")
        .repartition(F.col("by"), F.col("key"), F.col("i"), F.col("j"))
        .sortWithinPartitions("by", "key", "i", "j")
    )
    links = checkpointed(units.mapInArrow(_verify(threshold), "node long, links long, root long"))
    bonds = links.where("node <> root").select(F.col("node").alias("src"), F.col("root").alias("dst"))
    if repeated:
        bonds = bonds.union(_of_one_document(usable, classes))
    joined = components(bonds, most=most * bands)
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    told = (
        classes.select("print", "node", "copies")
        .join(counts, "node", "left")
        .join(joined, "node", "left")
        .select("print", F.col("node").alias("copy_id"), F.coalesce("component", "node").alias("class_id"), F.col("copies").alias("n_copies"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        .where("n_copies > 1 or n_links > 0 or class_id <> copy_id")
    )
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return (
        sketched.select("doc_id", "print")
        .join(told, "print", "left")
        .select(
            "doc_id",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("copy_id", "doc_id")).alias("copy_id"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("n_copies", one)).otherwise(one).alias("n_copies"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", none)).otherwise(none).alias("n_links"),
        )
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without those that are near duplicates of a row with a smaller doc_id.

    Of each class one row stays, the one with the least doc_id; of repeated rows with that doc_id, one.
    Texts that share a doc_id are told apart, in the order of a digest of theirs. Rows without
    shingles or without a doc_id stay. All columns are kept as they are, whatever their names; an empty table gives no rows.
    """
    name = fresh(docs, "_gone")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    if not ids.groupBy("doc_id").count().where("count > 1").limit(1).count():
        gone = near_duplicates(docs, **options).where("n_links > 0 and doc_id <> class_id").select(F.col("doc_id").alias(name)).distinct()
        return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("digest")))
    labels = checkpointed(relabeled(docs.select(own.alias("id")).where("id is not null")))
    slim = docs.select(own.alias("id"), "text").join(labels, "id").select(F.col("label").alias("doc_id"), "text")
    found = checkpointed(near_duplicates(slim, **options).where("n_links > 0").select("doc_id", "class_id", "n_copies").distinct())
    gone = found.where("doc_id <> class_id").select(F.col("doc_id").alias("label"))
    more = found.where("doc_id = class_id and n_copies > 1").select(F.col("doc_id").alias("label"), F.lit(True).alias("more"))
    told = labels.join(gone, "label", "left_anti").join(more, "label", "left").select("id", F.struct("label", "more").alias(name))
    key = fresh(docs, "_key")
    kept = docs.withColumn(key, own).join(told.withColumnRenamed("id", key), key, "left").where(F.col(key).isNull() | F.col(name).isNotNull())
    many = F.coalesce(F.col(f"{name}.more"), F.lit(False))
    return kept.where(~many).unionByName(kept.where(many).dropDuplicates([key])).select(*(F.col(f"`{c}`") for c in docs.columns))

"""Exact top-k inner-product search with block-at-a-time pruning (operator 10).

Rows are dealt into shards by their largest component, then cut into blocks by the next largest, so
that what lies near each other shares a bound. A query meets its own kind's shard first; the k-th score there is a floor
below which no other shard, and no block of one, is looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netloom.llm.text import by_group
from netloom.operators.components import checkpointed

K, EVERY = 5, 50
#: Candidates of a shard, of a block within it, and queries of a chunk, about.
SHARD, BLOCK, CHUNK = 16384, 256, 2048
#: Shards whose bounds are compared with a chunk of queries at once.
BOUNDS = 1024
_EXACT = 2**53


#: Beyond these a score isn't told as it is, and 32-bit components don't do.
_MOST, _NARROW = 2**63 - 1, 2**31


def floored(x: float) -> int:
    """floor(256 x) of a finite double, exactly; beyond a double's range as well."""
    y = 256.0 * x
    return math.floor(y) if math.isfinite(y) else 256 * int(x)


def leads(x: np.ndarray, n: int = 1) -> np.ndarray:
    """The places of the n largest components of each row by size, as 2 place, or 2 place + 1 where the component is negative."""
    x = x.astype(np.float64)
    size, out, rows = np.abs(x), np.zeros((n, len(x)), np.int64), np.arange(len(x))
    for k in range(min(n, x.shape[1])):
        at = size.argmax(1)
        out[k] = 2 * at + (x[rows, at] < 0)
        size[rows, at] = -1
    return out


def _lead(data: bytes, wide: bool) -> int:
    return int(leads(np.frombuffer(data, np.float64 if wide else np.int32)[None])[0, 0])


def _quantize(batches):
    """The usable vectors of a batch as one matrix: 32-bit whole numbers, or the doubles themselves where one doesn't fit."""
    for batch in batches:
        found = batch.column("embedding")
        sizes = np.nan_to_num(found.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
        ends = np.cumsum(sizes)
        x = found.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null is NaN
        owner = np.repeat(np.arange(len(sizes)), sizes)
        bad = np.bincount(owner[~np.isfinite(x)], minlength=len(sizes)) > 0
        with np.errstate(over="ignore", invalid="ignore"):
            y = np.floor(256.0 * x)
            wide = np.bincount(owner[~(np.abs(y) < _NARROW)], minlength=len(sizes)) > 0
        keep = np.flatnonzero((sizes > 0) & ~bad & batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False))
        narrow = np.where(np.repeat(wide | bad, sizes), 0, y).astype(np.int32)
        data = [(x if wide[i] else narrow)[ends[i] - sizes[i] : ends[i]].tobytes() for i in keep]
        first = [_lead(d, w) for d, w in zip(data, wide[keep])] if len(np.unique(sizes[keep])) > 1 or wide[keep].any() else leads(np.frombuffer(b"".join(data), np.int32).reshape(len(keep), -1))[0] if len(keep) else []
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(keep)), pa.array(sizes[keep], pa.int32()), pa.array(wide[keep], pa.bool_()), pa.array(first, pa.int32()), pa.array(data, pa.binary())], ["vec_id", "dim", "wide", "lead", "data"])


def _matrix(data: list[bytes], wide: list[bool], dim: int) -> np.ndarray:
    """Whole numbers as doubles, exact below 2**53; as Python's own where a vector is wide."""
    if not any(wide):
        return np.frombuffer(b"".join(data), np.int32).reshape(len(data), dim).astype(np.float64)
    out = np.zeros((len(data), dim), object)
    for k, (d, w) in enumerate(zip(data, wide)):
        out[k] = [floored(x) for x in np.frombuffer(d).tolist()] if w else np.frombuffer(d, np.int32).tolist()
    return out


def told(score: int) -> tuple[int, bytes | None]:
    """(score as a 64-bit number, order): the nearest one beyond the range, with bytes that sort like the scores themselves."""
    if -_MOST - 1 < score < _MOST:
        return score, None
    size = (abs(score).bit_length() + 8) // 8
    sign = 1 if score > 0 else -1
    return max(-_MOST - 1, min(_MOST, score)), (2**31 + sign * size).to_bytes(4, "big") + (score if score > 0 else score + 256**size).to_bytes(size, "big")


def search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, block: int = BLOCK, floor: np.ndarray | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """(query, candidate, score) of each query's k best candidates other than itself, and the scores computed.

    Candidates in the order of their largest components, then of their ids, are cut into ranges. A range's maxima and minima per component
    bound the score of all its members for a query: the sum of the larger products. Ranges are
    gone through by descending bound, per query as far as the bound is at least the k-th score so
    far (a tie may still win by its id) and the query's ``floor``; a range's rows are scored for all queries that need it at once.
    """
    order = np.lexsort((ids, *leads(x, 3)[::-1])) if x.dtype != object else np.argsort(ids, kind="stable")
    floor = np.full(len(query_ids), -math.inf) if floor is None else floor
    ids, x = ids[order], x[order]
    at = list(range(0, len(ids), block))
    top = np.array([x[a : a + block].max(0) for a in at])
    low = np.array([x[a : a + block].min(0) for a in at])
    up, down = np.where(q > 0, q, 0 * q), np.where(q < 0, q, 0 * q)
    bound = up @ top.T + down @ low.T
    n = len(query_ids)
    best = np.full((n, k), -np.inf) if q.dtype != object else np.full((n, k), -math.inf, object)
    best_id = np.full((n, k), np.iinfo(np.int64).max)
    rank = np.argsort(-bound.astype(np.float64), axis=1, kind="stable") if q.dtype != object else np.array([sorted(range(len(at)), key=lambda j: -r[j]) for r in bound])
    done = 0
    for step in range(len(at)):
        mine = rank[:, step]
        needed = (bound[np.arange(n), mine] >= best[:, -1]) & (bound[np.arange(n), mine] >= floor)
        if q.dtype != object and not needed.any():
            break
        for b in np.unique(mine[needed]) if needed.any() else ():
            who = np.flatnonzero(needed & (mine == b))
            rows = slice(at[b], at[b] + block)
            got = q[who] @ x[rows].T
            done += got.size
            own = ids[rows][None, :] == query_ids[who][:, None]
            got = np.where(own, -math.inf, got)
            scores = np.concatenate([best[who], got], 1)
            names = np.concatenate([best_id[who], np.broadcast_to(ids[rows], got.shape)], 1)
            for r, w in enumerate(who):
                line = scores[r]
                if q.dtype != object and len(line) > 4 * k:
                    cut = np.partition(line, len(line) - k)[len(line) - k]
                    some = np.flatnonzero(line >= cut)
                else:
                    some = np.arange(len(line))
                some = some[np.lexsort((names[r][some], -line[some].astype(np.float64)))] if q.dtype != object else np.array(sorted(some, key=lambda i: (-line[i], names[r][i])))
                some = some[:k]
                best[w, : len(some)], best_id[w, : len(some)] = line[some], names[r][some]
    out = [(int(query_ids[i]), int(best_id[i, j]), int(best[i, j])) for i in range(n) for j in range(k) if best[i, j] != -math.inf]
    return out, done


def _score(k: int, block: int):
    def fn(group: pa.Table) -> pa.RecordBatch | None:
        dim, kind = group.column("dim")[0].as_py(), np.array(group.column("is_query").to_pylist(), bool)
        if not kind.any() or kind.all():
            return None
        ids, data, wide = group.column("vec_id").to_numpy(), group.column("data").to_pylist(), group.column("wide").to_pylist()
        pick = lambda mask: (ids[mask], _matrix([d for d, m in zip(data, mask) if m], [w for w, m in zip(wide, mask) if m], dim))
        (qi, q), (xi, x) = pick(kind), pick(~kind)
        floor = np.array([-math.inf if f is None else f for f, m in zip(group.column("floor").to_pylist(), kind) if m], object)
        most = lambda m: max(int(abs(m.min())), int(abs(m.max())))
        if q.dtype == object or x.dtype == object or most(q) * most(x) * dim >= _EXACT:
            whole = lambda m: m if m.dtype == object else m.astype(np.int64).astype(object)
            q, x = whole(q), whole(x)
        else:
            floor = floor.astype(np.float64)  # such scores are exact as doubles
        rows, done = search(xi, x, qi, q, k, block, floor)
        cols = [*zip(*((a, b, *told(c), done * (i == 0)) for i, (a, b, c) in enumerate(rows)))] if rows else [[]] * 5
        kinds = [pa.int64()] * 3 + [pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["query_id", "vec_id", "score", "order", "scored"])

    return by_group(["dim", "kind", "chunk", "lead", "salt"], fn)


def _boxed(group: pa.Table) -> pa.RecordBatch:
    """Maxima and minima per component of some vectors of a shard, as doubles; none where a component is wide."""
    dim, data, wide = group.column("dim")[0].as_py(), group.column("data").to_pylist(), any(group.column("wide").to_pylist())
    if not wide:
        x = np.frombuffer(b"".join(data), np.int32).reshape(len(data), dim)
    box = (None, None) if wide else (x.max(0).astype(np.float64).tobytes(), x.min(0).astype(np.float64).tobytes())
    return pa.RecordBatch.from_arrays([*(group.column(c)[:1].combine_chunks() for c in ("dim", "lead", "salt")), *(pa.array([b], pa.binary()) for b in box)], ["dim", "lead", "salt", "top", "low"])


def _boxes(batches):
    """``_boxed`` of each shard's rows in each batch."""
    for batch in batches:
        if batch.num_rows:
            t = pa.Table.from_batches([batch]).sort_by([("dim", "ascending"), ("lead", "ascending"), ("salt", "ascending")]).combine_chunks()
            yield from by_group(["dim", "lead", "salt"], _boxed)(iter(t.to_batches()))


def _merged(group: pa.Table) -> pa.RecordBatch:
    """One box for all of a shard's."""
    top, low = (group.column(c).to_pylist() for c in ("top", "low"))
    whole = None not in top
    fold = lambda f, xs: f.reduce([np.frombuffer(x) for x in xs]).tobytes() if whole else None
    return pa.RecordBatch.from_arrays([*(group.column(c)[:1].combine_chunks() for c in ("dim", "lead", "salt")), pa.array([fold(np.maximum, top)], pa.binary()), pa.array([fold(np.minimum, low)], pa.binary())], ["dim", "lead", "salt", "top", "low"])


def _needed(group: pa.Table) -> pa.RecordBatch | None:
    """The shards of a unit that can have one of the k best of any query of a chunk that hasn't met them."""
    asks = np.array(group.column("is_query").to_pylist(), bool)
    if not asks.any() or asks.all():
        return None
    dim, kind, chunk = (group.column(c)[0].as_py() for c in ("dim", "kind", "chunk"))
    queries, shards = group.filter(pa.array(asks)), group.filter(pa.array(~asks))
    lead, salt = (shards.column(c).to_numpy() for c in ("lead", "salt"))
    top, low = (shards.column(c).to_pylist() for c in ("top", "low"))
    wide = np.array(queries.column("wide").to_pylist(), bool)
    floors = np.array([-math.inf if f is None or w else f for f, w in zip(queries.column("floor").to_pylist(), wide)])
    need = ~((queries.column("lead").to_numpy()[:, None] == lead) & (salt == 0))
    known, told_ = np.array([i for i, t in enumerate(top) if t is not None], int), np.flatnonzero(floors > -math.inf)
    if len(known) and len(told_):
        q = _matrix([queries.column("data")[int(i)].as_py() for i in told_], [False] * len(told_), dim)
        t, b = (np.array([np.frombuffer(x[i]) for i in known]) for x in (top, low))
        bound = np.maximum(q, 0) @ t.T + np.minimum(q, 0) @ b.T
        slack = 1 + 1e-9 * (np.abs(q) @ np.maximum(np.abs(t), np.abs(b)).T)  # for rounding in the sums
        need[np.ix_(told_, known)] &= bound + slack >= floors[told_, None]
    at = np.flatnonzero(need.any(0))
    cols = [np.full(len(at), v) for v in (dim, kind, chunk)] + [lead[at], salt[at]]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in cols], ["dim", "kind", "chunk", "lead", "salt"])


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, shard: int = SHARD, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best candidates by integer inner product.

    Queries are the rows of vectors(vec_id, embedding) whose id is divisible by ``every``, candidates
    all rows but those with the query's own id. Components become floor(256 x). Ties go to the smaller id; a query
    with fewer candidates gets all. Vectors that are null, empty or hold null or non-finite
    components take no part, nor rows without an id; vectors meet only those of their own length.
    Repeated rows count each as a candidate; a repeated query id is answered once, for the least of its vectors.
    Scores are exact whatever the size of the components; one that no 64-bit number can tell is ranked by its
    exact value and told as the nearest 64-bit number. An empty table, or one without queries, gives no rows; further columns are ignored.

    See ``scored`` for how; every score that can be among the k best is computed exactly.
    """
    best = scored(vectors, k, every, shard, chunk, block)
    ranked = best.selectExpr("*", "row_number() over (partition by query_id order by score desc, order desc nulls last, vec_id) as rank")
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scored(vectors: DataFrame, k: int = K, every: int = EVERY, shard: int = SHARD, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """``(query_id, vec_id, score, order, scored)``: the k best of each shard that a query meets; ``scored`` sums up to the scores computed.

    Candidates with the same largest component (and sign) make shards of about ``shard`` rows, queries chunks of
    about ``chunk`` (of several kinds where there are few), so that a hot vector only makes more shards. A query first meets one shard of its own kind, and the k-th score
    there is its floor. Then the bounds of all shards, a box of maxima and minima each, are compared with the floors
    of each chunk, and only for the pairs left are candidates and queries sent on; a pair is a task's
    unit of bounded size, which prunes by blocks.
    """
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = slim.mapInArrow(_quantize, "vec_id long, dim int, wide boolean, lead int, data binary")
    sizes = usable.groupBy("dim", "lead").agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("q"))
    parts = lambda c, most: F.greatest(F.ceil(F.col(c) / most), F.lit(1)).cast("int")
    whole = sizes.groupBy("dim").agg(F.sum("q").alias("all")).select("dim", parts("all", chunk).alias("kinds"))
    sizes = sizes.select("dim", "lead", parts("n", shard).alias("salts"), parts("q", chunk).alias("chunks")).join(whole, "dim")
    # few queries of many kinds make one chunk, of neighbouring kinds
    sizes = checkpointed(sizes.withColumn("kind", F.floor(F.col("lead") * F.least("kinds", 2 * F.col("dim")) / (2 * F.col("dim"))).cast("int")), slim=True)
    dealt = lambda c: F.pmod(F.xxhash64("vec_id"), F.col(c)).cast("int")
    placed = checkpointed(usable.join(sizes, ["dim", "lead"]).select("dim", "lead", dealt("salts").alias("salt"), "vec_id", "wide", "data"))
    queries = placed.where(F.col("vec_id") % every == 0).groupBy("dim", "vec_id").agg(F.min(F.struct("data", "wide", "lead")).alias("v"))
    queries = queries.select("dim", "vec_id", "v.*").join(sizes, ["dim", "lead"])
    queries = checkpointed(queries.select("dim", F.col("lead").alias("q_lead"), "kind", dealt("chunks").alias("chunk"), "vec_id", "wide", "data"))
    cols, none = ["dim", "kind", "chunk", "lead", "salt", "is_query", "floor", "vec_id", "wide", "data"], F.lit(None).cast("long").alias("floor")
    unit, found = ["dim", "kind", "chunk", "lead", "salt"], "query_id long, vec_id long, score long, order binary, scored long"

    def met(pairs: DataFrame, asked: DataFrame) -> DataFrame:
        """The best of each pair(dim, kind, chunk, lead, salt) of a chunk and a shard, of ``asked`` as far as they haven't met."""
        rows = placed.join(pairs, ["dim", "lead", "salt"]).withColumns({"is_query": F.lit(False), "floor": none}).select(cols)
        rows = rows.union(asked.join(pairs, ["dim", "kind", "chunk"]).where("not met or q_lead <> lead or salt <> 0").withColumn("is_query", F.lit(True)).select(cols))
        return rows.repartition(*map(F.col, unit)).sortWithinPartitions(*unit).mapInArrow(_score(k, block), found)

    # first a shard of its own kind for each query
    alone = queries.withColumns({"kind": F.col("q_lead"), "floor": none, "met": F.lit(False)})
    own = alone.select("dim", "kind", "chunk", F.col("q_lead").alias("lead"), F.lit(0).alias("salt")).distinct()
    first = checkpointed(met(own, alone))
    full = (F.count("*") == k) & (F.count("order") == 0)
    floors = first.groupBy(F.col("query_id").alias("of")).agg(F.when(full, F.min("score")).alias("floor"))
    asked = checkpointed(queries.join(floors, queries["vec_id"] == F.col("of"), "left").drop("of").withColumn("met", F.lit(True)))
    chunks = checkpointed(asked.select("dim", "kind", "chunk").distinct(), slim=True)
    boxes = placed.mapInArrow(_boxes, "dim int, lead int, salt int, top binary, low binary").repartition("dim", "lead", "salt").sortWithinPartitions("dim", "lead", "salt")
    boxes = checkpointed(boxes.mapInArrow(by_group(["dim", "lead", "salt"], _merged), "dim int, lead int, salt int, top binary, low binary"))
    groups = -(-boxes.count() // BOUNDS) or 1
    empty = F.lit(None).cast("binary")
    grid = boxes.join(chunks, "dim").select("dim", "kind", "chunk", F.pmod(F.xxhash64("lead", "salt"), F.lit(groups)).cast("int").alias("part"), F.lit(False).alias("is_query"), none, F.lit(False).alias("wide"), empty.alias("data"), "lead", "salt", "top", "low")
    spread = asked.select("dim", "kind", "chunk", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(True).alias("is_query"), "floor", "wide", "data", F.col("q_lead").alias("lead"), F.lit(-1).alias("salt"), empty.alias("top"), empty.alias("low"))
    key = ["dim", "kind", "chunk", "part"]
    grid = grid.union(spread).repartition(*map(F.col, key)).sortWithinPartitions(*key)
    pairs = checkpointed(grid.mapInArrow(by_group(key, _needed), ", ".join(f"{c} int" for c in unit)))
    return first.union(met(pairs, asked))
